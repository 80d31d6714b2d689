"""Running sums over a distributed order, without gathering it in one task."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from .common import python_ready, stored


def running_sum(df: DataFrame, group: Column, order: list[str], value: str, name: str) -> DataFrame:
    """``df`` with column ``name``: sum of ``value`` over the earlier rows of the row's group.

    Rows are range-partitioned by (group, order), so a hot group spreads over
    many tasks; each task sums its own rows, and only one total per task and
    group is summed across tasks.  The result is read from a stored table.
    """
    spark = df.sparkSession
    python_ready(spark)
    df = df.withColumn("__g", F.xxhash64(group, group.isNull()))
    schema = StructType([*df.schema.fields, StructField("__pid", IntegerType()), StructField("__local", LongType())])
    g, v = df.columns.index("__g"), df.columns.index(value)

    def run(batches):
        target, pid = to_arrow_schema(schema), TaskContext.get().partitionId()
        last, carried = None, 0
        for b in batches:
            if not b.num_rows:
                continue
            ids, n = b.column(g).to_numpy(zero_copy_only=False), b.column(v).to_numpy(zero_copy_only=False)
            before = np.cumsum(n) - n
            new = np.concatenate(([ids[0] != last], ids[1:] != ids[:-1]))
            start = np.maximum.accumulate(np.where(new, np.arange(len(n)), 0))
            local = before - before[start]
            if not new[0]:
                local[: int(np.argmax(new)) if new.any() else len(n)] += carried
            last, carried = ids[-1], int(local[-1] + n[-1])
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(np.full(len(n), pid, np.int32)), pa.array(local)], schema=target)

    ranged = df.repartitionByRange("__g", *order).sortWithinPartitions("__g", *order)
    ranged = stored(ranged.mapInArrow(run, schema), "ranged")
    totals = ranged.groupBy("__g", "__pid").agg(F.sum(value).alias("__n"))
    earlier = Window.partitionBy("__g").orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    totals = stored(totals.select("__g", "__pid", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before")), "totals")
    return ranged.join(totals, ["__g", "__pid"]).withColumn(name, F.col("__local") + F.col("__before")) \
        .drop("__g", "__pid", "__local", "__before")
