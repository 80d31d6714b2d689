"""A3 for small batches: next states written by touched bucket.

A table is stored in ``bucket=`` folders by the hash of a key (order items by
order_id).  A batch of changes names the keys it touches; only their buckets
are read (partition pruning), changed and written, so cancelling a few orders
does not rewrite all order items.

A batch is staged first, next to the table, and published from there by a
dynamic partition overwrite: a plain copy of whole buckets, which may be
repeated after a lost driver without applying the changes twice.  A batch that
was published leaves a mark and is not published again, so running it once more
changes nothing, also when later batches have changed the same buckets.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import _committed, _fs

BUCKETS = 64


def bucket_of(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def _write(df: DataFrame, path: str, mode: str) -> None:
    """Write buckets: ``static`` replaces the whole folder, ``dynamic`` only the buckets that occur."""
    df.write.mode("overwrite").option("partitionOverwriteMode", mode).option("compression", "zstd") \
        .partitionBy("bucket").parquet(path)


def _by_bucket(df: DataFrame) -> DataFrame:
    """Rows brought together by bucket: files of a good size, and a bucket with a hot key is split over tasks."""
    return df.hint("rebalance", "bucket")


def write_buckets(df: DataFrame, path: str, key: str, buckets: int = BUCKETS) -> str:
    """Store ``df`` in ``buckets`` folders by ``key`` under the new folder ``path``."""
    _write(_by_bucket(df.withColumn("bucket", bucket_of(key, buckets))), path, "static")
    return path


def read_buckets(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop("bucket")


def write_delta(spark: SparkSession, path: str, key: str, touched: DataFrame,
                change: Callable[[DataFrame], DataFrame], batch: str, buckets: int = BUCKETS) -> list[int]:
    """Apply ``change`` to the buckets that hold the keys of ``touched``; the buckets rewritten.

    ``change`` gets all rows of these buckets and returns their next rows.
    ``batch`` names the changes: a batch that was published is not applied again.
    """
    staged, numbers, mark = (f"{path}.batches/{batch}/{x}" for x in ("rows", "buckets", "published"))
    done, fs = _fs(spark, mark)
    if fs.exists(done):
        return []
    if not _committed(spark, numbers):
        # the bucket numbers, of which there are at most ``buckets``
        touched.select(bucket_of(key, buckets).alias("bucket")).distinct().coalesce(1).write.mode("overwrite").parquet(numbers)
    ids = sorted(r[0] for r in spark.read.parquet(numbers).collect())
    stored = spark.read.parquet(path)
    if ids and not _committed(spark, staged):
        before = stored.filter(F.col("bucket").isin(ids))
        after = change(before.drop("bucket")).withColumn("bucket", bucket_of(key, buckets))
        _write(_by_bucket(after.select(*stored.columns)), staged, "static")
    if ids:
        rows = spark.read.schema(stored.schema).parquet(staged)
        # staged files hold a bucket each, so they are copied without a shuffle
        _write(rows, path, "dynamic")
        left = {r[0] for r in rows.select("bucket").distinct().collect()}
        for b in set(ids) - left:  # nothing of the bucket is left: no rows overwrite its folder
            folder, _ = _fs(spark, f"{path}/bucket={b}")
            fs.delete(folder, True)
    fs.mkdirs(done)
    return ids
