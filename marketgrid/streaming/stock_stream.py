"""H2: stock changes arriving as files -> current stock and status per product.

The floored ledger of a run of changes is a map: with net sum A and lowest
prefix m (m <= 0), a start stock s >= 0 becomes max(s + A, A - m), and two runs
compose as (A1 + A2, min(m1, A1 + m2)).  The status has a closed form too:
Inactive stays Inactive; stock 0 is OutOfStock; otherwise Active once any
increase happened, else the start status.

The stream keeps one such summary per (product, time bucket), so what a late
change touches is one bucket, not the product's whole history.  Each micro-batch
stores its rows by bucket and summarises every bucket it touches anew, from all
rows of that bucket: a change that arrives out of order takes its place by (ts,
change_id), whenever it comes, and is counted in ``late_rows``.  The current view
composes a product's buckets in time order and applies them to the product
table, which the stream itself never joins.

Hot products: a bucket's rows are summarised over ``range_chunks``, runs of
bounded rows, so neither a product nor a bucket is one task or one frame.

State bound: with ``keep``, buckets that lie further back than that behind the
newest change are closed after the batch: their rows are dropped, their summary
stays.  A change for a closed bucket is composed to the bucket's end.

A batch writes folders named after its epoch, from rows and summaries of earlier
epochs, so a batch re-run after a failure replaces its own output.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scan import CHUNK_ROWS, range_chunks
from ..sources.tables import _fs

CHANGE_SCHEMA = "change_id BIGINT, product_id STRING, action STRING, amount INT, ts TIMESTAMP_NTZ"
ROW_SCHEMA = CHANGE_SCHEMA + ", late BOOLEAN, epoch BIGINT, bucket TIMESTAMP_NTZ"
RUN_SCHEMA = ("product_id STRING, bucket TIMESTAMP_NTZ, a LONG, m LONG, any_increase BOOLEAN, changes_seen LONG, late_rows LONG, "
              "last_ts TIMESTAMP_NTZ, last_id LONG, epoch LONG")
PAIR = ["product_id", "bucket"]


def _zero() -> Column:
    return F.lit(0).cast("bigint")


def bucket_runs(rows: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """One summary per (product, bucket) of ``rows``, in (ts, change_id) order."""
    d = F.when(F.col("action") == "increase", F.col("amount")).otherwise(-F.col("amount")).cast("bigint")
    c = range_chunks(rows.select(*PAIR, "ts", "change_id", d.alias("d"), (F.col("action") == "increase").alias("up"), "late"),
                     [*PAIR, "ts", "change_id"], chunk_rows)
    inside = Window.partitionBy(*PAIR, "chunk").orderBy("ts", "change_id").rowsBetween(Window.unboundedPreceding, 0)
    parts = c.withColumn("p", F.sum("d").over(inside)).groupBy(*PAIR, "chunk").agg(
        F.sum("d").alias("a"), F.min("p").alias("m"), F.max("up").alias("up"), F.count(F.lit(1)).alias("n"),
        F.sum(F.col("late").cast("bigint")).alias("late"), F.max(F.struct("ts", "change_id")).alias("last"))
    earlier = Window.partitionBy(*PAIR).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("m", F.coalesce(F.sum("a").over(earlier), _zero()) + F.col("m"))
    return (parts.groupBy(*PAIR).agg(F.sum("a").alias("a"), F.least(_zero(), F.min("m")).alias("m"), F.max("up").alias("any_increase"),
                                     F.sum("n").alias("changes_seen"), F.sum("late").alias("late_rows"), F.max("last").alias("l"))
            .select(*PAIR, "a", "m", "any_increase", "changes_seen", "late_rows", F.col("l.ts").alias("last_ts"),
                    F.col("l.change_id").alias("last_id")))


def _stored(spark: SparkSession, path: str, schema: str) -> DataFrame:
    folder, fs = _fs(spark, path)
    return spark.read.schema(schema).parquet(path) if fs.exists(folder) else spark.createDataFrame([], schema)


def latest_runs(summaries: DataFrame) -> DataFrame:
    """The newest summary of every (product, bucket)."""
    values = [c for c in summaries.columns if c not in PAIR]
    newest = F.max(F.struct("epoch", *[c for c in values if c != "epoch"])).alias("s")
    return summaries.groupBy(*PAIR).agg(newest).select(*PAIR, "s.*")


def _close(spark: SparkSession, output_dir: str, bound) -> None:
    """Drop the stored rows of buckets before ``bound``."""
    import datetime as dt
    from urllib.parse import unquote

    pattern, fs = _fs(spark, f"{output_dir}/rows/epoch=*/bucket=*")
    for found in fs.globStatus(pattern) or []:
        name = unquote(found.getPath().getName().split("=", 1)[1])
        if dt.datetime.fromisoformat(name) < bound:
            fs.delete(found.getPath(), True)


def apply_batch(batch: DataFrame, epoch: int, output_dir: str, bucket: str = "day", keep: str | None = None,
                chunk_rows: int = CHUNK_ROWS) -> None:
    """Store one micro-batch's changes and the new summaries of the buckets it touches."""
    spark = batch.sparkSession
    before = F.col("epoch") < epoch
    summaries = latest_runs(_stored(spark, f"{output_dir}/runs", RUN_SCHEMA).filter(before))
    seen = summaries.groupBy("product_id").agg(F.max(F.struct("last_ts", "last_id")).alias("seen"))
    rows = (batch.filter((F.col("amount") >= 0) & F.col("action").isin("increase", "decrease"))
            .select("change_id", "product_id", "action", "amount", "ts", F.date_trunc(bucket, "ts").cast("timestamp_ntz").alias("bucket"))
            .join(seen, "product_id", "left")
            .withColumn("late", F.coalesce(F.struct(F.col("ts").alias("last_ts"), F.col("change_id").alias("last_id"))
                                           <= F.col("seen"), F.lit(False))).drop("seen"))
    here = f"{output_dir}/rows/epoch={epoch}"
    rows.hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(here)
    mine = _stored(spark, f"{output_dir}/rows", ROW_SCHEMA).filter(F.col("epoch") == epoch)
    low = mine.agg(F.min("bucket"), F.max("bucket"), F.max("ts")).first()  # one row
    if low[0] is None:
        return
    touched = mine.select(*PAIR).distinct()
    kept = _stored(spark, f"{output_dir}/rows", ROW_SCHEMA).filter(
        (F.col("epoch") <= epoch) & F.col("bucket").between(F.lit(low[0]), F.lit(low[1])))  # prunes folders
    columns = [c.split()[0] for c in RUN_SCHEMA.split(", ")]
    closed = None
    if keep:
        newest = summaries.agg(F.date_trunc(bucket, F.max("last_ts") - F.expr(f"INTERVAL {keep}")).cast("timestamp_ntz")).first()[0]
        closed = newest  # as the batch before left it
    fresh = kept.join(touched, PAIR, "left_semi")
    if closed is not None:
        late_runs = bucket_runs(mine.filter(F.col("bucket") < F.lit(closed)), chunk_rows)
        old = summaries.select(*PAIR, *[F.col(c).alias(f"old_{c}") for c in columns if c not in (*PAIR, "epoch")])
        both = late_runs.join(old, PAIR, "left")
        first_a = F.coalesce("old_a", _zero())
        total = {"m": F.least(F.coalesce("old_m", _zero()), first_a + F.col("m")), "a": first_a + F.col("a"),
                 "any_increase": F.col("any_increase") | F.coalesce("old_any_increase", F.lit(False)),
                 "changes_seen": F.col("changes_seen") + F.coalesce("old_changes_seen", _zero()),
                 "late_rows": F.col("late_rows") + F.coalesce("old_late_rows", _zero())}
        newer = F.greatest(F.struct("last_ts", "last_id"), F.struct(F.col("old_last_ts").alias("last_ts"), F.col("old_last_id").alias("last_id")))
        ended = both.withColumns({**total, "l": F.when(F.col("old_last_ts").isNull(), F.struct("last_ts", "last_id")).otherwise(newer)}) \
            .withColumns({"last_ts": F.col("l.last_ts"), "last_id": F.col("l.last_id")}).select(*columns[:-1])
        runs = bucket_runs(fresh.filter(F.col("bucket") >= F.lit(closed)), chunk_rows).unionByName(ended)
    else:
        runs = bucket_runs(fresh, chunk_rows)
    runs.select(*columns[:-1]).write.mode("overwrite").parquet(f"{output_dir}/runs/epoch={epoch}")
    if keep:
        bound = spark.range(1).select(F.date_trunc(bucket, F.greatest(
            F.lit(low[2]), F.lit(summaries.agg(F.max("last_ts")).first()[0])) - F.expr(f"INTERVAL {keep}")).cast("timestamp_ntz")).first()[0]
        _close(spark, output_dir, bound)


def run_stock_stream(spark: SparkSession, input_dir: str, output_dir: str, checkpoint_dir: str,
                     max_files_per_trigger: int | None = None, bucket: str = "day", keep: str | None = None,
                     chunk_rows: int = CHUNK_ROWS) -> None:
    """Process every file now in ``input_dir`` (availableNow) and stop.

    ``bucket`` is a date_trunc unit, ``keep`` an interval ("7 days"; None: rows are kept for good).
    """
    reader = spark.readStream.schema(CHANGE_SCHEMA)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    q = (reader.parquet(input_dir).writeStream
         .foreachBatch(lambda batch, epoch: apply_batch(batch, epoch, output_dir, bucket, keep, chunk_rows))
         .option("checkpointLocation", checkpoint_dir).trigger(availableNow=True).start())
    q.awaitTermination()


def current_stock(spark: SparkSession, output_dir: str, product: DataFrame) -> DataFrame:
    """Current stock and status of every product the stream has seen.

    A product's buckets are composed in time order (one row per bucket) and
    applied to its start stock and status.
    """
    runs = latest_runs(_stored(spark, f"{output_dir}/runs", RUN_SCHEMA))
    earlier = Window.partitionBy("product_id").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    whole = (runs.withColumn("m", F.coalesce(F.sum("a").over(earlier), _zero()) + F.col("m"))
             .groupBy("product_id").agg(F.sum("a").alias("a"), F.least(_zero(), F.min("m")).alias("m"),
                                        F.max("any_increase").alias("any_increase"), F.sum("changes_seen").alias("changes_seen"),
                                        F.sum("late_rows").alias("late_rows")))
    p = product.select("product_id", F.col("stock").cast("bigint").alias("s0"), F.col("status").alias("st0"))
    stock = F.greatest(F.col("s0") + F.col("a"), F.col("a") - F.col("m"))
    status = (F.when(F.col("st0") == "Inactive", F.lit("Inactive"))
              .when(F.col("stock") == 0, F.lit("OutOfStock"))
              .when(F.col("any_increase"), F.lit("Active"))
              .otherwise(F.col("st0")))
    return (whole.join(p, "product_id").withColumn("stock", stock)
            .select("product_id", "stock", status.alias("status"), "changes_seen", "late_rows"))
