"""A3 ``write_shop``: persist a next-state table.

A next state is written to a NEW folder under the shared state root (never
over the folder it was computed from) and read back, which also cuts the
lineage for the next batch.  Writes go through Spark's committer, so a lost
executor only reruns its tasks.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from ..session import state_root


def write_shop(df: DataFrame, table: str, version: str | None = None,
               partition_by: str | None = None, root: str | None = None) -> str:
    spark = df.sparkSession
    version = version or uuid.uuid4().hex
    path = f"{(root or state_root(spark)).rstrip('/')}/{table}/v={version}"
    writer = df.write.mode("errorifexists")
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.parquet(path)
    return path


def read_state(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
