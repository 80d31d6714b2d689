"""Registered streaming jobs (H): files arrive, the stream runs, the current
state is read back.  Input, output and checkpoints live in a fresh folder
under the shared state root."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..session import state_root
from ..streaming import ratings_stream as H1
from ..streaming import stock_stream as H2
from .changes import LEDGER_SQL
from .registry import register


def _dirs(spark, name):
    base = f"{state_root(spark)}/streams/{name}-{uuid.uuid4().hex}"
    return f"{base}/input", f"{base}/output", f"{base}/checkpoint"


@register("rating_stream", """
SELECT vendor_id, count(*) rating_count, CAST(sum(score) AS BIGINT) score_sum,
 CAST(sum(score) AS DOUBLE) / count(*) avg_score FROM shop_rating GROUP BY vendor_id""")
def q_rating_stream(shop):
    """H1: ratings land in as many files as their scan has tasks; a micro-batch
    takes a few of them (sums do not depend on arrival order)."""
    spark = shop.spark
    inp, out, ck = _dirs(spark, "ratings")
    (shop.shop_rating.select("id", "customer_id", "vendor_id", "score", "created_at")
     .write.parquet(inp))
    H1.run_rating_stream(spark, inp, out, ck, max_files_per_trigger=64,
                         state_partitions=spark.sparkContext.defaultParallelism)
    return H1.current_vendor_ratings(spark, out)


_LAST = """l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY ts DESC, change_id DESC) rn
 FROM led) q WHERE rn = 1),
n AS (SELECT product_id, count(*) changes_seen FROM led GROUP BY 1)"""


def _arrivals(shop, parts):
    """Run the stream after each of ``parts`` (DataFrames of changes) has arrived; the current view."""
    spark = shop.spark
    inp, out, ck = _dirs(spark, "stock")
    for part in parts:
        part.write.mode("append").parquet(inp)
        H2.run_stock_stream(spark, inp, out, ck, max_files_per_trigger=64)
    return H2.current_stock(spark, out, shop.shop_product)


@register("stock_stream", f"""
WITH {LEDGER_SQL},
{_LAST}
SELECT l.product_id, l.stock_after stock, l.status_after status, n.changes_seen, CAST(0 AS BIGINT) late_rows
FROM l JOIN n ON n.product_id = l.product_id""")
def q_stock_stream(shop, chunks: int = 4):
    """H2: changes arrive in ``chunks`` time slices, in time order; the same
    checkpoint carries the summaries per bucket from slice to slice."""
    spark = shop.spark
    ch = shop.shop_stock_change.select("change_id", "product_id", "action", "amount", "ts")
    bounds = ch.agg(F.min("ts").alias("lo"), F.max("ts").alias("hi")).first()  # one row
    if bounds["lo"] is None:
        return spark.createDataFrame([], "product_id STRING, stock LONG, status STRING, changes_seen LONG, "
                                     "late_rows LONG")
    lo, step = bounds["lo"], (bounds["hi"] - bounds["lo"]) / chunks
    at = F.col("ts")
    edges = [F.lit(lo + step * k) for k in range(1, chunks)]
    parts = [ch.filter((at >= edges[k - 1] if k else F.lit(True)) & (at < edges[k] if k < chunks - 1 else F.lit(True)))
             for k in range(chunks)]
    return _arrivals(shop, parts)


@register("stock_stream_late", f"""
WITH {LEDGER_SQL},
{_LAST},
a AS (SELECT product_id, change_id, ts, (hour(ts) + 1) % 3 arrival FROM led),
h AS (SELECT product_id, arrival, max(struct_pack(ts := ts, id := change_id)) newest FROM a GROUP BY 1, 2),
late AS (SELECT a.product_id, count(*) n FROM a WHERE EXISTS (SELECT 1 FROM h WHERE h.product_id = a.product_id
  AND h.arrival < a.arrival AND h.newest >= struct_pack(ts := a.ts, id := a.change_id)) GROUP BY 1)
SELECT l.product_id, l.stock_after stock, l.status_after status, n.changes_seen, CAST(coalesce(late.n, 0) AS BIGINT) late_rows
FROM l JOIN n ON n.product_id = l.product_id LEFT JOIN late ON late.product_id = l.product_id""")
def q_stock_stream_late(shop):
    """H2 out of order: the hours of all days arrive in three lots, so most
    changes of the second and third are late; the result is that of the ledger."""
    ch = shop.shop_stock_change.select("change_id", "product_id", "action", "amount", "ts")
    return _arrivals(shop, [ch.filter((F.hour("ts") + 1) % 3 == k) for k in range(3)])
