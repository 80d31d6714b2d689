"""H1/H2 streaming jobs: final state equals the batch answer; late rows counted."""

import datetime as dt
import os
import tempfile

from marketgrid.operators import changes as X
from marketgrid.streaming import ratings_stream as H1
from marketgrid.streaming import stock_stream as H2


def _dirs():
    base = tempfile.mkdtemp(prefix="mg-stream-test-")
    return [os.path.join(base, d) for d in ("in", "out", "ck")]


def test_rating_stream_two_arrivals(spark):
    inp, out, ck = _dirs()
    t = dt.datetime(2024, 1, 1)
    a = spark.createDataFrame([(1, "c1", "s1", 5, t), (2, "c2", "s1", 3, t)], H1.RATING_SCHEMA)
    b = spark.createDataFrame([(3, "c3", "s1", 1, t), (4, "c3", "s2", 4, t)], H1.RATING_SCHEMA)
    a.write.parquet(inp)
    H1.run_rating_stream(spark, inp, out, ck)
    b.write.mode("append").parquet(inp)
    H1.run_rating_stream(spark, inp, out, ck)
    got = {r.vendor_id: (r.rating_count, r.score_sum, r.avg_score) for r in H1.current_vendor_ratings(spark, out).collect()}
    assert got == {"s1": (3, 9, 3.0), "s2": (1, 4, 4.0)}


def test_stock_stream_in_order_equals_ledger_and_late_rows(spark):
    inp, out, ck = _dirs()
    product = spark.createDataFrame([("p1", 5, "Active"), ("p2", 0, "OutOfStock")], "product_id string, stock int, status string")
    t = dt.datetime(2024, 1, 1)
    rows1 = [(1, "p1", "decrease", 7, t), (2, "p2", "increase", 3, t + dt.timedelta(hours=1)),
             (3, "p1", "increase", 2, t + dt.timedelta(hours=2))]
    rows2 = [(4, "p1", "decrease", 1, t + dt.timedelta(hours=3)), (5, "p2", "decrease", 3, t + dt.timedelta(hours=4))]
    late = [(6, "p1", "increase", 10, t + dt.timedelta(minutes=30))]
    spark.createDataFrame(rows1, H2.CHANGE_SCHEMA).write.parquet(inp)
    H2.run_stock_stream(spark, inp, out, ck)
    spark.createDataFrame(rows2, H2.CHANGE_SCHEMA).write.mode("append").parquet(inp)
    H2.run_stock_stream(spark, inp, out, ck)
    got = {r.product_id: (r.stock, r.status, r.changes_seen, r.late_rows) for r in H2.current_stock(spark, out, product).collect()}
    ch = spark.createDataFrame(rows1 + rows2, H2.CHANGE_SCHEMA)
    final = {r.product_id: (r.stock, r.status) for r in X.stock_after_ledger(product, X.stock_ledger(product, ch)).collect()}
    assert {k: v[:2] for k, v in got.items()} == final
    assert got["p1"][2:] == (3, 0) and got["p2"] == (0, "OutOfStock", 2, 0)
    spark.createDataFrame(late, H2.CHANGE_SCHEMA).write.mode("append").parquet(inp)
    H2.run_stock_stream(spark, inp, out, ck)
    got = {r.product_id: (r.stock, r.changes_seen, r.late_rows) for r in H2.current_stock(spark, out, product).collect()}
    assert got["p1"] == (11, 4, 1)  # takes its place in time and is counted late


def _stream(spark, arrivals, product, **kw):
    inp, out, ck = _dirs()
    for part in arrivals:
        spark.createDataFrame(part, H2.CHANGE_SCHEMA).write.mode("append").parquet(inp)
        H2.run_stock_stream(spark, inp, out, ck, **kw)
    return {r.product_id: (r.stock, r.status, r.changes_seen, r.late_rows)
            for r in H2.current_stock(spark, out, product).collect()}, out


def test_out_of_order_files_and_a_hot_product(spark):
    """Shuffled arrivals over several buckets; chunks far smaller than the hot product's share of a bucket."""
    import random
    rnd = random.Random(4)
    t = dt.datetime(2024, 1, 1)
    rows = [(k, "hot" if rnd.random() < .6 else f"p{k % 7}", rnd.choice(["increase", "decrease", "decrease"]), rnd.randint(0, 9),
             t + dt.timedelta(minutes=rnd.randint(0, 3 * 24 * 60))) for k in range(700)]
    ids = sorted({r[1] for r in rows})
    product = spark.createDataFrame([(p, 6, "Inactive" if p == "p3" else "Active") for p in ids],
                                    "product_id string, stock int, status string")
    got, _ = _stream(spark, [rows[:300], rows[300:650], rows[650:]], product, chunk_rows=40)
    ledger = X.stock_ledger(product, spark.createDataFrame(rows, H2.CHANGE_SCHEMA))
    final = {r.product_id: (r.stock, r.status) for r in X.stock_after_ledger(product, ledger).collect()}
    assert {k: v[:2] for k, v in got.items()} == final
    first, late = {}, dict.fromkeys(ids, 0)
    for part in (rows[:300], rows[300:650], rows[650:]):
        for r in part:
            late[r[1]] += r[1] in first and (r[4], r[0]) <= first[r[1]]
        for r in part:
            first[r[1]] = max(first.get(r[1], (t, -1)), (r[4], r[0]))
    assert {k: v[3] for k, v in got.items()} == late


def test_closed_buckets_keep_their_summary(spark):
    """Rows far behind the newest change are dropped; a change for their bucket comes at the bucket's end."""
    t = dt.datetime(2024, 1, 1)
    day = dt.timedelta(days=1)
    product = spark.createDataFrame([("p", 5, "Active")], "product_id string, stock int, status string")
    lots = [[(1, "p", "decrease", 9, t + day / 2), (2, "p", "increase", 3, t + day / 2 + day / 8)],
            [(3, "p", "increase", 4, t + 20 * day)], [(4, "p", "decrease", 1, t)], [(5, "p", "decrease", 2, t + 19.5 * day)]]
    got, out = _stream(spark, lots, product, keep="2 days")
    # 5 -> 0 -> 3, then the late 4 at the end of its closed day -> 2, then 5 in its place -> 0, then 3 -> 4
    assert got == {"p": (4, "Active", 5, 2)}
    kept = {d.split("bucket=")[1][:10] for d, _, fs in os.walk(out + "/rows") if "bucket=" in d and fs}
    assert kept == {"2024-01-20", "2024-01-21"}


def test_a_batch_run_again_changes_nothing(spark):
    inp, out, ck = _dirs()
    t = dt.datetime(2024, 1, 1)
    product = spark.createDataFrame([("p", 5, "Active")], "product_id string, stock int, status string")
    lots = [[(1, "p", "decrease", 2, t)], [(2, "p", "increase", 7, t), (3, "p", "decrease", 1, t - dt.timedelta(days=1))]]
    for again in range(2):
        for epoch, lot in enumerate(lots):
            H2.apply_batch(spark.createDataFrame(lot, H2.CHANGE_SCHEMA), epoch, out)
        r = H2.current_stock(spark, out, product).first()
        assert (r.stock, r.changes_seen, r.late_rows) == (9, 3, 1)


def test_compaction_keeps_the_current_view(spark):
    inp, out, ck = _dirs()
    t = dt.datetime(2024, 1, 1)
    spark.createDataFrame([(1, "c1", "s1", 5, t), (2, "c2", "s1", 3, t)], H1.RATING_SCHEMA).write.parquet(inp)
    H1.run_rating_stream(spark, inp, out, ck)
    path = H1.compact_vendor_ratings(spark, out)
    got = {r.vendor_id: (r.rating_count, r.score_sum) for r in spark.read.parquet(path).collect()}
    assert got == {"s1": (2, 8)}
