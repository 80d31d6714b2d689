"""C9 in mergeable form: orders per vendor as sketches per vendor and day.

A day's orders of a vendor are one HyperLogLog sketch of their order ids (4 KB
at most), so a new day is summarised once and every later figure is a union of
sketches, which neither reads order items again nor shuffles an order id.  The
estimate is exact for few orders; its standard error is 1.04 / sqrt(2^lg_k)
beyond.  The order of the unions may move an estimate within that error, as
the library's estimator depends on how a sketch was made.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LG_K = 12
STANDARD_ERROR = 1.04 / 2 ** (LG_K / 2)


def daily_order_sketches(product: DataFrame, items: DataFrame, orders: DataFrame, lg_k: int = LG_K) -> DataFrame:
    """(vendor_id, day, sketch) of the orders with a product of the vendor."""
    lines = items.select("order_id", "product_id").join(product.select("product_id", "vendor_id"), "product_id")
    lines = lines.join(orders.select("order_id", F.to_date("order_date").alias("day")), "order_id")
    return lines.groupBy("vendor_id", "day").agg(F.hll_sketch_agg("order_id", lg_k).alias("sketch"))


def merge_sketches(sketches: DataFrame, *keys: str) -> DataFrame:
    """The union of the sketches of every key."""
    return sketches.groupBy(*keys).agg(F.hll_union_agg("sketch").alias("sketch"))


def vendor_orders_estimate(vendor: DataFrame, sketches: DataFrame) -> DataFrame:
    """Per vendor the estimated number of orders over all days; 0 without orders."""
    counts = merge_sketches(sketches, "vendor_id").select("vendor_id", F.hll_sketch_estimate("sketch").alias("orders_estimate"))
    return (vendor.select("vendor_id").join(counts, "vendor_id", "left")
            .select("vendor_id", F.coalesce("orders_estimate", F.lit(0)).cast("bigint").alias("orders_estimate")))
