"""Sources: view texts, the shared-CTE oracle builder, the JDBC split, the writer."""

from pyspark.sql import functions as F

from marketgrid.sources.jdbc import SHOP_TABLES, partition_predicates
from marketgrid.sources.sink import read_state, write_shop
from marketgrid.sources.tables import load_shop
from marketgrid.sources.views import ALL_VIEWS, deps, with_views


def test_jdbc_predicates_cover_each_row_once():
    preds = partition_predicates("Product_ID", 4)
    assert len(preds) == 4 and len(set(preds)) == 4
    assert all("CRC32(`Product_ID`)" in p for p in preds)
    assert partition_predicates("x", 1) == ["1 = 1"]


def test_jdbc_mapping_names_the_operator_columns():
    view, key, cols = SHOP_TABLES["Product"]
    assert view == "shop_product" and key in cols
    assert {c for c, _ in cols.values()} >= {"product_id", "price", "stock", "vendor_id", "status"}


def test_with_views_pulls_dependencies_in_order():
    sql = with_views("SELECT count(*) FROM shop_sub_orders")
    assert sql.index("shop_cart_line AS") < sql.index("shop_order_items AS") < sql.index("shop_sub_orders AS")
    assert "{" not in sql and all(n in ALL_VIEWS for n in ["shop_sub_orders", "shop_orders"])
    merged = with_views("WITH x AS (SELECT 1) SELECT * FROM x, shop_tag")
    assert merged.startswith("WITH shop_tag_raw AS") and "x AS (SELECT 1)" in merged


def test_write_shop_new_version_each_time(spark):
    df = spark.createDataFrame([(1, "a")], "id int, v string")
    p1 = write_shop(df, "t")
    p2 = write_shop(df, "t")
    assert p1 != p2 and read_state(spark, p1).count() == 1


def test_staged_views_equal_lazy_views(spark):
    from marketgrid.sources import load_shop
    staged, lazy = load_shop(spark, "/root/testdata/sf0.001"), load_shop(spark, "/root/testdata/sf0.001", staged=False)
    for v in ["shop_sub_orders", "shop_tag", "shop_order_state"]:
        a, b = staged[v], lazy[v]
        assert a.columns == b.columns
        assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_publish_keeps_the_first_committed_table(spark, tmp_path):
    from marketgrid.sources.tables import _publish
    a, b, dst = str(tmp_path / "a"), str(tmp_path / "b"), str(tmp_path / "t")
    spark.createDataFrame([(1,)], "x int").write.parquet(a)
    spark.createDataFrame([(2,), (3,)], "x int").write.parquet(b)
    _publish(spark, a, dst)
    _publish(spark, b, dst)
    assert sorted(r.x for r in spark.read.parquet(dst).collect()) == [1]


def test_scale_conf_sizes_partitions():
    from marketgrid.session import scale_conf
    small = scale_conf(40 << 20, 8)
    assert small["spark.sql.shuffle.partitions"] == "8"
    big = int(scale_conf(100 << 40, 8000)["spark.sql.shuffle.partitions"])
    assert big % 8000 == 0 and 100 * 1024 * 4 <= big <= 100 * 1024 * 4 + 8000


def test_staged_table_follows_its_input(spark, tmp_path):
    import shutil

    for t in ("nation", "supplier", "part"):
        shutil.copyfile(f"/root/testdata/sf0.001/{t}.parquet", tmp_path / f"{t}.parquet")
    before = load_shop(spark, str(tmp_path)).shop_product.count()
    shutil.copyfile("/root/testdata/sf0.01/part.parquet", tmp_path / "part.parquet")
    after = load_shop(spark, str(tmp_path)).shop_product.count()
    assert after == spark.read.parquet(str(tmp_path / "part.parquet")).count() > before


def _raw_shop(spark, path):
    """A few orders whose lines have odd keys: unknown and null products, null flags, lines of no order."""
    import datetime as dt

    day = dt.datetime(2024, 1, 2)
    spark.createDataFrame([(k, f"p{k} x", "Brand#1", "SMALL", 1 + k, 10.25 * k) for k in range(6)] + [(None, "n", "b", "t", 1, 1.0)],
                          "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double") \
        .write.parquet(f"{path}/part.parquet")
    spark.createDataFrame([(k, f"s{k}", 0, 1.0) for k in range(3)],
                          "s_suppkey long, s_name string, s_nationkey int, s_acctbal double").write.parquet(f"{path}/supplier.parquet")
    spark.createDataFrame([(1, 1, "P", 1.0, day, "1-URGENT"), (2, 1, "O", 1.0, day, "5-LOW"), (3, 2, None, 1.0, None, None)],
                          "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp,"
                          " o_orderpriority string").write.parquet(f"{path}/orders.parquet")
    lines = [(o, p, 0, n, float(n), 1.0, 0.1, 0.0, flag, status, day) for n, (o, p, flag, status) in enumerate(
        [(1, 1, "R", "F"), (1, 4, "N", "O"), (1, 2, "A", "F"), (1, 9, "N", "O"), (2, None, "N", "O"), (2, 3, None, None),
         (2, 5, "R", "O"), (3, 5, "R", "F"), (7, 5, "N", "F")])]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double,"
                          " l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string,"
                          " l_shipdate timestamp").write.parquet(f"{path}/lineitem.parquet")


def test_numeric_forms_give_the_rows_of_the_texts(spark, tmp_path):
    _raw_shop(spark, tmp_path)
    shop = load_shop(spark, str(tmp_path))
    for v in ("shop_order_items", "shop_sub_orders"):
        text = spark.sql(ALL_VIEWS[v], **{d: shop.lazy[d] for d in deps(v)})
        got = shop.lazy[v]
        assert got.columns == text.columns and [f.dataType for f in got.schema] == [f.dataType for f in shop[v].schema]
        assert sorted(map(str, got.select(*text.columns).collect())) == sorted(map(str, text.select(
            *[F.col(c).cast(got.schema[c].dataType) for c in text.columns]).collect()))


def test_plans_that_read_a_table_once_write_none(spark, tmp_path):
    from marketgrid.plans.changes import q_vendor_delete
    from marketgrid.plans.orders import q_cancel_orders, q_cancel_orders_items, q_cancel_orders_stock
    from marketgrid.session import state_root

    _raw_shop(spark, tmp_path)
    spark.createDataFrame([(1, "c1", 0, 1.0, "BUILDING")], "c_custkey long, c_name string, c_nationkey int, c_acctbal double,"
                          " c_mktsegment string").write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame([(0, "n", 0)], "n_nationkey int, n_name string, n_regionkey int").write.parquet(f"{tmp_path}/nation.parquet")
    for q in (q_vendor_delete, q_cancel_orders, q_cancel_orders_items, q_cancel_orders_stock):
        read = q(load_shop(spark, str(tmp_path))).inputFiles()
        assert not [f for f in read if "/staged/shop_sub_orders" in f or "/staged/shop_order_items" in f], state_root(spark)


def test_session_is_sized_with_the_input(spark):
    from marketgrid.session import size_session

    names = ("spark.sql.shuffle.partitions", "spark.sql.adaptive.advisoryPartitionSizeInBytes")
    old = [spark.conf.get(n) for n in names]
    try:
        size_session(spark, 1 << 20)
        assert spark.conf.get(names[0]) == old[0]
        size_session(spark, 1 << 30)
        assert int(spark.conf.get(names[0])) == max(128, int(old[0]))
        spark.conf.set(names[0], "500")
        size_session(spark, 1 << 30)
        assert spark.conf.get(names[0]) == "500"
    finally:
        for n, v in zip(names, old):
            spark.conf.set(n, v)


def test_python_workers_hold_bounded_rows():
    from marketgrid.functions.scan import CHUNK_ROWS
    from marketgrid.llm.packing import CACHE_WORDS, PIECE_BYTES

    assert CHUNK_ROWS <= 250_000 and CACHE_WORDS <= 400_000 and PIECE_BYTES <= 2_000_000
