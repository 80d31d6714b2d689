"""Registered stored forms: keyset pages (B2, B9, B10), the piece index (B4) and order sketches."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import listing as L
from ..operators import order_sketches as S
from ..operators import text_index as T
from ..operators import vendors as V
from ..session import state_root
from .catalog import _B2_WHERE, _B9_TAGS, _B9_WHERE, _B10_IDS, _B10_TAGS, _TAG_JOIN
from .registry import cards_sql, register
from .vendors import _ORDERS_PER_VENDOR


def _second_page(shop, of, limit):
    """Page two of ``of(listing, tagging, tag, after=, limit=)``: the rows behind the last key of page one."""
    path = L.write_listing(shop.shop_product, shop.shop_vendor, f"{state_root(shop.spark)}/listing-{uuid.uuid4().hex}")
    listing = shop.spark.read.parquet(path)
    first = of(listing, shop.shop_tagging, shop.shop_tag, after=None, limit=limit)
    return of(listing, shop.shop_tagging, shop.shop_tag, after=L.last_key(first), limit=limit)


def _page_sql(where):
    return f"""WITH L AS (SELECT p.*, v.store_name FROM shop_product p JOIN shop_vendor v ON v.vendor_id = p.vendor_id
 WHERE {where} ORDER BY p.created_seq DESC, p.product_id LIMIT 20 OFFSET 20)
{cards_sql()}"""


@register("public_products_after", _page_sql(_B2_WHERE))
def q_public_products_after(shop):
    def of(*tables, **page):
        return L.public_products_after(*tables, keyword="gear", category="economy", tags=["Hot"], **page)
    return _second_page(shop, of, 20)


@register("tags_any_after", _page_sql(_B9_WHERE))
def q_tags_any_after(shop):
    def of(*tables, **page):
        return L.tags_any_after(*tables, tags=_B9_TAGS, **page)
    return _second_page(shop, of, 20)


@register("tags_all_after", _page_sql(f"p.product_id IN ({_B10_IDS})"))
def q_tags_all_after(shop):
    def of(*tables, **page):
        return L.tags_all_after(*tables, tags=_B10_TAGS, **page)
    return _second_page(shop, of, 20)


@register("search_products_index", f"""
SELECT p.product_id, p.name, p.category, CAST(p.price AS DOUBLE) price, v.store_name
FROM shop_product p JOIN shop_vendor v ON v.vendor_id = p.vendor_id
WHERE p.status = 'Active' AND v.status = 'Active' AND p.price <= 1500
 AND (contains(lower(p.name), 'gear') OR contains(lower(p.name), 'ed') OR contains(lower(p.name), 'brand#1')
  OR EXISTS (SELECT 1 FROM {_TAG_JOIN} WHERE tg.product_id = p.product_id
   AND (contains(lower(t.name), 'gear') OR contains(lower(t.name), 'ed') OR contains(lower(t.name), 'brand#1'))))""")
def q_search_products_index(shop):
    """B4 through the index, with a term of two letters among the terms."""
    index = T.write_index(shop.shop_product, shop.shop_tag, f"{state_root(shop.spark)}/pieces-{uuid.uuid4().hex}")
    found = T.search_products_index(shop.shop_product, shop.shop_vendor, shop.shop_tagging, shop.shop_tag, index,
                                    keyword="GEAR", max_price=1500, tags=["brand#1", "ed"])
    return found.select("product_id", "name", "category", F.col("price").cast("double").alias("price"), "store_name")


@register("vendor_orders_sketch", f"""
SELECT v.vendor_id, CAST(coalesce(o.orders_count, 0) AS BIGINT) orders_count, TRUE within_bound
FROM shop_vendor v LEFT JOIN ({_ORDERS_PER_VENDOR}) o ON o.vendor_id = v.vendor_id""")
def q_vendor_orders_sketch(shop):
    """The exact count, and whether the merged daily sketches meet it within five standard errors."""
    daily = S.daily_order_sketches(shop.shop_product, shop.shop_order_items, shop.shop_orders)
    estimate = S.vendor_orders_estimate(shop.shop_vendor, daily)
    exact = V.vendor_orders_count(shop.shop_product, shop.shop_vendor, shop.shop_order_items)
    off = F.abs(F.col("orders_estimate") - F.col("orders_count"))
    return exact.join(estimate, "vendor_id").select("vendor_id", "orders_count",
                                                    (off <= 5 * S.STANDARD_ERROR * F.col("orders_count")).alias("within_bound"))
