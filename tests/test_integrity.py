"""A2 integrity audit: zero on the fixture views, and each broken rule is caught."""

from pyspark.sql import functions as F

from marketgrid.operators.integrity import integrity_audit
from marketgrid.plans.integrity import shop_tables
from marketgrid.sources import load_shop


def _audit(tables):
    return {(r.rule, r.table_name): r.violations for r in integrity_audit(tables).collect()}


def test_views_are_clean(spark):
    res = _audit(shop_tables(load_shop(spark, "/root/testdata/sf0.001")))
    assert res and all(v == 0 for v in res.values()), {k: v for k, v in res.items() if v}


def test_broken_rules_are_counted(spark):
    t = shop_tables(load_shop(spark, "/root/testdata/sf0.001"))
    p = t["product"]
    first = p.limit(1)
    t["product"] = (p.unionByName(first)  # duplicate key
                    .unionByName(first.withColumn("product_id", F.lit("zz")).withColumn("vendor_id", F.lit("nobody"))
                                 .withColumn("status", F.lit("Gone"))))
    tg = t["tagging"]
    t["tagging"] = tg.unionByName(tg.limit(1).withColumn("position", F.lit(9)).withColumn("tag_id", F.lit(-1)))
    res = _audit(t)
    assert res[("pk:product_id", "product")] == 1
    assert res[("fk:vendor_id->vendor", "product")] == 1
    assert res[("enum:status", "product")] == 1
    assert res[("check_position:position", "tagging")] == 1
    assert res[("fk:tag_id->tag", "tagging")] == 1


def test_null_keys_customers_and_admins(spark):
    t = shop_tables(load_shop(spark, "/root/testdata/sf0.001"))
    o, u, a = t["orders"], t["user_account"], t["admins"]
    none = F.lit(None).cast("string")
    supplier = u.filter("user_id LIKE 's%'").limit(1).select(F.col("user_id").alias("customer_id"))
    t["orders"] = (o.unionByName(o.limit(2).withColumn("order_id", none))  # NULL primary keys
                   .unionByName(o.limit(1).drop("customer_id").withColumn("order_id", F.lit("new")).join(supplier, how="cross")
                                .select(*o.columns))  # an account that is no customer
                   .unionByName(o.limit(1).withColumn("order_id", F.lit("new2")).withColumn("payment_status", none)))
    t["admins"] = a.unionByName(a.limit(1).withColumn("admin_id", F.lit("nobody")))
    tg = t["tagging"]
    t["tagging"] = tg.unionByName(tg.limit(1).withColumn("tag_id", F.lit(None).cast("int")))
    one = tg.limit(1)
    for k in range(4):
        t["tagging"] = t["tagging"].unionByName(one.withColumn("position", F.lit(3 - k)).withColumn("tag_id", F.lit(-k)))
    res = _audit(t)
    assert res[("pk:order_id", "orders")] == 2
    assert res[("fk:customer_id->customer", "orders")] == 1
    assert res[("not_null:customer_id,order_date,total_amount,status,payment_status", "orders")] == 1
    assert res[("fk:admin_id->user_account", "admins")] == 1
    assert res[("pk:product_id,tag_id", "tagging")] == 1
    assert res[("max_tags:product_id", "tagging")] >= 1
    assert res[("fk:tag_id->tag", "tagging")] == 4
    assert res[("check_position:position", "tagging")] == 1


def test_one_grouped_pass(spark):
    """Every table is scanned once, and all rules share one exchange by key."""
    plan = integrity_audit(shop_tables(load_shop(spark, "/root/testdata/sf0.001")))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(domain") == 1 and "Join" not in plan
    assert plan.count("FileScan") == 12
