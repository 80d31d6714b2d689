"""Connected components of an edge table by alternating large and small stars.

Each round points every node's larger neighbours at its smallest neighbour
(large star), then the smaller ones (small star); the edge table never grows
beyond the input's edges and ends as one star per component after a number of
rounds that is logarithmic in practice.  Minima are aggregates with map-side
combine and the joins are plain exchanges, so a node with very many
neighbours is split, not gathered.  Each round's table is written to the
shared folder, which cuts lineage; only its row count and checksum reach the
driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def _minima(pairs: DataFrame, bound: str) -> DataFrame:
    return pairs.groupBy("__u").agg(F.min("__v").alias("__m")).select("__u", F.least("__m", bound).alias("__m"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("__v").alias("__u"), F.col("__u").alias("__v")))
    least = stored(_minima(both, "__u"), "star")
    return both.filter(F.col("__v") > F.col("__u")).join(least, "__u") \
        .select(F.col("__v").alias("__u"), F.col("__m").alias("__v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    # every edge is (larger, smaller): the larger node's smaller neighbours meet at the least of them
    least = stored(_minima(edges, "__u"), "star")
    moved = edges.join(least, "__u").filter(F.col("__v") != F.col("__m")).select(F.col("__v").alias("__u"), F.col("__m").alias("__v"))
    return moved.unionByName(least.select("__u", F.col("__m").alias("__v"))).distinct()


def components(edges: DataFrame, u: str = "u", v: str = "v", max_rounds: int = 100) -> DataFrame:
    """(node, root) for every node with an edge; root is the smallest node reachable.

    Self-loops and nulls are ignored; repeated edges are harmless.
    """
    e = edges.select(F.greatest(u, v).alias("__u"), F.least(u, v).alias("__v")) \
        .filter(F.col(u).isNotNull() & F.col(v).isNotNull() & (F.col("__u") != F.col("__v"))).distinct()
    e = stored(e, "edges")
    seen = None
    for _ in range(max_rounds):
        mark = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("__u", "__v").cast("decimal(38,0)"))).first()
        if mark[0] == 0 or tuple(mark) == seen:
            break
        seen = tuple(mark)
        e = stored(_small_star(stored(_large_star(e), "edges")), "edges")
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    pairs = e.select(F.col("__u").alias("node"), F.col("__v").alias("root"))
    return pairs.unionByName(pairs.select(F.col("root").alias("node"), "root").distinct())
