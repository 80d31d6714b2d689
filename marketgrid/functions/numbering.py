"""Dense row numbers in a global order without a single-partition window.

``row_number() OVER (ORDER BY k)`` with no PARTITION BY runs in one task.
Here the rows are range-partitioned and sorted on ``order``, the split is
fixed by a reliable checkpoint (range bounds come from sampling, so two
evaluations could otherwise cut differently), each partition counts its
rows, and a prefix sum over those counts - one row per partition, so a
broadcast bounded by the partition count - turns the position inside a
partition into the global number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir


def dense_numbers(df: DataFrame, order: list[str], base: Column | int = 0, name: str = "rn") -> DataFrame:
    """``df`` plus ``name`` = base + 1, 2, ... following ``order`` (a unique key)."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    parts = max(spark.sparkContext.defaultParallelism, 1)
    ranged = df.repartitionByRange(parts, *order).sortWithinPartitions(*order).checkpoint(eager=True)
    pid = F.spark_partition_id()
    idx = ranged.select("*", pid.alias("_p"),
                        (F.monotonically_increasing_id() - F.shiftleft(pid.cast("long"), 33)).alias("_i"))
    counts = idx.groupBy("_p").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    base_col = base if isinstance(base, Column) else F.lit(base)
    return (idx.join(F.broadcast(offsets), "_p")
            .select(*df.columns, (base_col + F.col("_off") + F.col("_i") + 1).alias(name)))
