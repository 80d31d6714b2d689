"""Query registry: each key binds an operator to fixed parameters over the
shop views of one data folder, plus the DuckDB text of the same question.

Oracle texts read the raw tables by name; the shop views they mention are
prepended as CTEs from the one shared definition (``sources.views``).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.tables import Shop, load_shop
from ..sources.views import with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(key: str, oracle: str | None = None):
    """Register ``fn(shop) -> DataFrame`` under ``key``."""

    def deco(fn: Callable[[Shop], DataFrame]):
        if key in QUERIES:
            raise ValueError(f"duplicate query key {key}")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(load_shop(spark, sf_dir))

        run.__name__ = fn.__name__
        run.__doc__ = fn.__doc__
        QUERIES[key] = run
        if oracle is not None:
            ORACLE[key] = with_views(oracle)
        return fn

    return deco


# Card columns of a listing CTE named L (product columns + store_name).
def cards_sql(listing: str = "L") -> str:
    return f"""
SELECT L.product_id, L.name, coalesce(L.description, '') description, CAST(L.price AS DOUBLE) price,
 L.stock, L.category, L.image_url, L.vendor_id, L.status, CAST(coalesce(L.rating, 0) AS DOUBLE) rating,
 L.store_name, coalesce(T.tags, '') tag_names,
 CASE WHEN L.stock = 0 OR L.status = 'OutOfStock' THEN 'Out of Stock' ELSE 'Active' END status_label,
 CASE WHEN L.stock = 0 OR L.status = 'OutOfStock' THEN 'Out of Stock' ELSE 'In Stock' END stock_status,
 concat('$', CAST(L.price AS VARCHAR)) price_formatted, L.created_seq
FROM {listing} L LEFT JOIN (
 SELECT tg.product_id, string_agg(t.name, '||' ORDER BY tg.position) tags
 FROM shop_tagging tg JOIN shop_tag t ON t.tag_id = tg.tag_id GROUP BY tg.product_id) T
 ON T.product_id = L.product_id"""
