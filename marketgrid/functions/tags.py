"""Tag helpers: joined tag rows and the per-product ordered tag list.

A product carries at most three tags (Position 1..3 is unique per product),
so the per-product list is a bounded group: collecting it never grows with
the data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tag_rows(tagging: DataFrame, tag: DataFrame) -> DataFrame:
    """(product_id, tag_id, name, position)."""
    return tagging.join(tag, "tag_id").select("product_id", "tag_id", "name", "position")


def tag_list(tagging: DataFrame, tag: DataFrame, sep: str = "||",
             products: DataFrame | None = None) -> DataFrame:
    """(product_id, tags, tag_count): names joined by ``sep`` in position order.

    ``products`` (a DataFrame with ``product_id``) restricts the work to those
    products before the aggregate, e.g. one result page.
    """
    rows = tagging
    if products is not None:
        rows = rows.join(products.select("product_id"), "product_id", "left_semi")
    rows = rows.join(tag, "tag_id")
    ordered = F.array_sort(F.collect_list(F.struct("position", "name")))
    return rows.groupBy("product_id").agg(
        F.array_join(F.transform(ordered, lambda s: s["name"]), sep).alias("tags"),
        F.count("tag_id").alias("tag_count"),
    )


def split_tags(col: str) -> F.Column:
    """'a||b' -> ['a', 'b'] ('' -> [])."""
    return F.when(F.col(col) == "", F.array().cast("array<string>")).otherwise(F.split(F.col(col), r"\|\|"))
