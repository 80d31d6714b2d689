"""Vendor dashboards (C) on the seed."""

from decimal import Decimal

from pyspark.sql import functions as F

from marketgrid.operators import vendors as V


def test_vendor_stats_seed(seed):
    s = {r.vendor_id: r for r in V.vendor_stats(seed["product"], seed["vendor"]).collect()}
    assert (s["u4"].total_products, s["u4"].total_stock, s["u4"].out_of_stock) == (5, 195, 0)
    assert (s["u5"].total_products, s["u5"].total_stock, s["u5"].out_of_stock) == (3, 80, 0)


def test_low_stock_none(seed):
    assert V.low_stock_products(seed["product"]).count() == 0


def test_low_stock_top_k(seed):
    p = seed["product"].withColumn("stock", F.when(F.col("vendor_id") == "u4", F.lit(3)).otherwise(F.col("stock")))
    rows = V.low_stock_products(p, limit=2).collect()
    assert sorted(r.product_id for r in rows) == ["p1", "p3"]


def test_status_breakdown_percentages(seed):
    p = seed["product"].withColumn("status", F.when(F.col("product_id") == "p1", "Inactive")
                                   .otherwise(F.col("status")))
    rows = {(r.vendor_id, r.status): r for r in V.vendor_status_breakdown(p, seed["vendor"]).collect()}
    assert rows[("u4", "Inactive")]["count"] == 1 and rows[("u4", "Inactive")].percentage == 20.0
    assert rows[("u4", "Active")].percentage == 80.0


def test_average_rating_fallbacks(spark, seed):
    rating = spark.createDataFrame([(1, "u2", "u4", 5), (2, "u3", "u4", 4), (3, "u2", "u4", 4)],
                                   "id long, customer_id string, vendor_id string, score int")
    r = {x.vendor_id: x.average_rating for x in V.vendor_average_rating(rating, seed["vendor"]).collect()}
    assert r["u4"] == 4.33  # 13/3 to two places
    assert r["u5"] == 4.5   # no ratings: stored Vendor.Rating


def test_vendor_counts_rollup(seed):
    assert {r.scope: r.vendor_count for r in V.vendor_counts(seed["vendor"]).collect()} == {"ALL": 2, "Active": 2}


def test_available_users(seed):
    assert sorted(r.id for r in V.available_users(seed["users"]).collect()) == ["u2", "u3"]


def test_analytics_average_over_all_sub_orders(spark, seed):
    # Q6: avg_order_value divides by ALL sub-orders, cancelled ones included
    subs = spark.createDataFrame([("s1", "u4", Decimal("100.00"), "pending"), ("s2", "u4", Decimal("50.00"), "cancelled")],
                                 "sub_order_id string, merchant_id string, sub_total_amount decimal(10,2), status string")
    r = {x.vendor_id: x for x in V.vendor_analytics(subs, seed["vendor"]).collect()}
    assert (r["u4"].total_sales, r["u4"].total_orders, r["u4"].avg_order_value, r["u4"].avg_active_order_value) == \
        (100.0, 2, 50.0, 100.0)
    assert (r["u5"].total_sales, r["u5"].total_orders, r["u5"].avg_order_value) == (0.0, 0, 0.0)


def test_top_products_active_items_of_live_sub_orders(spark, seed):
    # Q7: built from the template's contract
    items = spark.createDataFrame(
        [("s1", "u4", "p1", 2, Decimal("11998.00"), "active"), ("s1", "u4", "p3", 1, Decimal("1299.00"), "active"),
         ("s1", "u4", "p4", 9, Decimal("80991.00"), "removed"), ("s2", "u4", "p5", 1, Decimal("6999.00"), "active")],
        "sub_order_id string, merchant_id string, product_id string, quantity int, total_price decimal(10,2), item_status string")
    subs = spark.createDataFrame([("s1", "pending"), ("s2", "cancelled")], "sub_order_id string, status string")
    got = [(r.product_id, r.sales_count, r.total_revenue, r.rank)
           for r in V.vendor_top_products(items, subs, seed["product"], n=10).orderBy("rank").collect()]
    assert got == [("p1", 2, 11998.0, 1), ("p3", 1, 1299.0, 2)]
