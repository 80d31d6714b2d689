"""Prefix scans over a distributed order, with a bounded number of rows a task.

A window over a key puts all rows of the key into one task.  A scan of
composable steps (sums, clamps) can be cut anywhere instead: ``range_chunks``
deals the rows into runs of neighbours in key order, whoever they belong to; the
caller scans inside (key, chunk), and carries one summary per key and chunk over
to the next, as the running totals of a ledger are carried from page to page.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import state_root

CHUNK_ROWS = 250_000  # rows a Python worker holds at once


def kept_rows(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared folder and read back."""
    spark = df.sparkSession
    path = f"{state_root(spark)}/scan/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def range_chunks(df: DataFrame, keys: list[str], rows: int = CHUNK_ROWS, name: str = "chunk") -> DataFrame:
    """``df`` plus ``name``: which run of about ``rows`` rows in the order of ``keys`` a row is in.

    ``keys`` must be unique, so that a hot leading key is spread over runs, and
    numbers ascend with the keys.  Range bounds come from a sample, so the split
    is fixed by writing it to the shared folder; the stored rows are read back.
    Rows that fill one run only are neither split nor written.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    n = df.count()
    parts = max(-(-n // rows), min(cores, -(-n // max(rows // 12, 1))), 1)
    if parts == 1:
        return df.withColumn(name, F.lit(0))
    return kept_rows(df.repartitionByRange(parts, *keys).withColumn(name, F.spark_partition_id()))
