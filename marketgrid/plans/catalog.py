"""Registered catalog queries (B) and the shop loader check (A1)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import catalog as C
from ..sources.contract import schema_report, schema_sql
from .registry import cards_sql, register

_TAG_JOIN = "shop_tagging tg JOIN shop_tag t ON t.tag_id = tg.tag_id"


def _std(shop):
    return shop.shop_product, shop.shop_vendor, shop.shop_tagging, shop.shop_tag


@register("shop_tables", """
SELECT 'product' table_name, count(*) n_rows FROM shop_product
UNION ALL SELECT 'vendor', count(*) FROM shop_vendor
UNION ALL SELECT 'tag', count(*) FROM shop_tag
UNION ALL SELECT 'tagging', count(*) FROM shop_tagging
UNION ALL SELECT 'category', count(*) FROM shop_category
UNION ALL SELECT 'user_account', count(*) FROM shop_user
UNION ALL SELECT 'rating', count(*) FROM shop_rating
UNION ALL SELECT 'orders', count(*) FROM shop_orders
UNION ALL SELECT 'sub_orders', count(*) FROM shop_sub_orders
UNION ALL SELECT 'order_items', count(*) FROM shop_order_items""")
def q_shop_tables(shop):
    """A1: every shop table loads; row count per table."""
    parts = []
    for name, view in [("product", "shop_product"), ("vendor", "shop_vendor"), ("tag", "shop_tag"),
                       ("tagging", "shop_tagging"), ("category", "shop_category"),
                       ("user_account", "shop_user"), ("rating", "shop_rating"),
                       ("orders", "shop_orders"), ("sub_orders", "shop_sub_orders"),
                       ("order_items", "shop_order_items")]:
        parts.append(shop[view].agg(F.count("*").alias("n_rows"))
                     .select(F.lit(name).alias("table_name"), "n_rows"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# The phone number lies in the profile here, and the order header has no address.
@register("schema_report", schema_sql({("shop_user", "phone_number"), ("shop_order_state", "shipping_address")}))
def q_schema_report(shop):
    """A1: every declared column of the shop tables against its declaration."""
    return schema_report(shop.__getitem__)


@register("product_detail_view", f"""
SELECT p.product_id, p.name, p.description, CAST(p.price AS DOUBLE) price, p.stock, p.category, p.image_url,
 p.vendor_id, p.status, CAST(p.rating AS DOUBLE) rating, p.created_seq, v.store_name,
 v.location vendor_location, v.status vendor_status, T.tags, CAST(coalesce(T.tag_count, 0) AS BIGINT) tag_count
FROM shop_product p LEFT JOIN shop_vendor v ON v.vendor_id = p.vendor_id
LEFT JOIN (SELECT tg.product_id, string_agg(t.name, ', ' ORDER BY tg.position) tags, count(t.tag_id) tag_count
 FROM {_TAG_JOIN} GROUP BY tg.product_id) T ON T.product_id = p.product_id""")
def q_product_detail_view(shop):
    return C.product_detail_view(*_std(shop))


# B2/B3/B4 share one filter: keyword 'gear' or tag term 'Hot', category 'economy'.
_B2_WHERE = f"""p.status = 'Active' AND v.status = 'Active' AND lower(p.category) = 'economy'
 AND (contains(lower(p.name), 'gear') OR contains(lower(p.name), 'hot')
  OR EXISTS (SELECT 1 FROM {_TAG_JOIN} WHERE tg.product_id = p.product_id
             AND (contains(lower(t.name), 'gear') OR contains(lower(t.name), 'hot'))))"""


@register("public_products", f"""
WITH L AS (SELECT p.*, v.store_name FROM shop_product p JOIN shop_vendor v ON v.vendor_id = p.vendor_id
 WHERE {_B2_WHERE} ORDER BY p.created_seq DESC, p.product_id LIMIT 20 OFFSET 20)
{cards_sql()}""")
def q_public_products(shop):
    return C.public_products(*_std(shop), keyword="gear", category="economy", tags=["Hot"],
                             limit=20, offset=20)


@register("public_products_count", f"""
SELECT count(DISTINCT p.product_id) total FROM shop_product p JOIN shop_vendor v ON v.vendor_id = p.vendor_id
WHERE {_B2_WHERE}""")
def q_public_products_count(shop):
    return C.public_products_count(*_std(shop), keyword="gear", category="economy", tags=["Hot"])


@register("search_products", f"""
SELECT p.product_id, p.name, p.category, CAST(p.price AS DOUBLE) price, v.store_name
FROM shop_product p JOIN shop_vendor v ON v.vendor_id = p.vendor_id
WHERE p.status = 'Active' AND v.status = 'Active' AND p.price <= 1500
 AND (contains(lower(p.name), 'gear') OR contains(lower(p.name), 'brand#1')
  OR EXISTS (SELECT 1 FROM {_TAG_JOIN} WHERE tg.product_id = p.product_id
             AND (contains(lower(t.name), 'gear') OR contains(lower(t.name), 'brand#1'))))""")
def q_search_products(shop):
    return (C.search_products(*_std(shop), keyword="GEAR", max_price=1500, tags=["brand#1"])
            .select("product_id", "name", "category", F.col("price").cast("double").alias("price"),
                    "store_name"))


@register("product_cards", f"""
WITH L AS (SELECT p.*, v.store_name FROM shop_product p JOIN shop_vendor v ON v.vendor_id = p.vendor_id)
{cards_sql()}""")
def q_product_cards(shop):
    listing = shop.shop_product.join(shop.shop_vendor.select("vendor_id", "store_name"), "vendor_id")
    return C.product_cards(listing, shop.shop_tagging, shop.shop_tag)


@register("public_product_details", f"""
SELECT p.product_id id, p.name title, coalesce(p.description, '') description, CAST(p.price AS DOUBLE) price,
 p.stock, p.category, p.image_url image, p.vendor_id, p.status, CAST(coalesce(p.rating, 0) AS DOUBLE) rating,
 v.store_name, coalesce(T.tags, '') tags
FROM shop_product p JOIN shop_vendor v ON v.vendor_id = p.vendor_id
LEFT JOIN (SELECT tg.product_id, string_agg(t.name, '||' ORDER BY tg.position) tags FROM {_TAG_JOIN}
 GROUP BY tg.product_id) T ON T.product_id = p.product_id
WHERE p.status <> 'Inactive' AND v.status = 'Active'""")
def q_public_product_details(shop):
    return C.public_product_details(*_std(shop))


@register("categories", "SELECT name FROM shop_category")
def q_categories(shop):
    return C.categories(shop.shop_category)


@register("vendor_names", """
SELECT u.user_id vendor_id, coalesce(v.store_name, 'Unknown') store_name
FROM shop_user u LEFT JOIN shop_vendor v ON v.vendor_id = u.user_id""")
def q_vendor_names(shop):
    return C.vendor_names(shop.shop_vendor, shop.shop_user.select(F.col("user_id").alias("vendor_id")))


_B9_WHERE = f"""p.status = 'Active' AND v.status = 'Active' AND (
 EXISTS (SELECT 1 FROM {_TAG_JOIN} WHERE tg.product_id = p.product_id AND lower(t.name) IN ('widget', 'brand#7', 'red'))
 OR contains(lower(p.name), 'widget') OR contains(lower(p.name), 'brand#7') OR contains(lower(p.name), 'red'))"""
_B9_TAGS = ["Widget", " brand#7 ", "RED", "  "]


@register("tags_any", f"""
WITH L AS (SELECT p.*, v.store_name FROM shop_product p JOIN shop_vendor v ON v.vendor_id = p.vendor_id
 WHERE {_B9_WHERE} ORDER BY p.created_seq DESC, p.product_id LIMIT 20)
{cards_sql()}""")
def q_tags_any(shop):
    return C.tags_any(*_std(shop), tags=_B9_TAGS, limit=20, offset=0)


@register("tags_any_count", f"""
SELECT count(DISTINCT p.product_id) total FROM shop_product p JOIN shop_vendor v ON v.vendor_id = p.vendor_id
WHERE {_B9_WHERE}""")
def q_tags_any_count(shop):
    return C.tags_any_count(*_std(shop), tags=_B9_TAGS)


_B10_IDS = f"""SELECT p.product_id FROM shop_product p JOIN shop_vendor v ON v.vendor_id = p.vendor_id
 JOIN {_TAG_JOIN} ON tg.product_id = p.product_id
 WHERE p.status = 'Active' AND v.status = 'Active' AND lower(t.name) IN ('red', 'widget')
 GROUP BY p.product_id HAVING count(DISTINCT lower(t.name)) = 2"""
_B10_TAGS = ["red", "Widget", "RED"]


@register("tags_all", f"""
WITH L AS (SELECT p.*, v.store_name FROM shop_product p JOIN shop_vendor v ON v.vendor_id = p.vendor_id
 WHERE p.product_id IN ({_B10_IDS}))
{cards_sql()}""")
def q_tags_all(shop):
    return C.tags_all(*_std(shop), tags=_B10_TAGS)


@register("tags_all_count", f"SELECT count(*) total FROM ({_B10_IDS}) m")
def q_tags_all_count(shop):
    return C.tags_all_count(*_std(shop), tags=_B10_TAGS)


@register("popular_tags", """
SELECT t.name, count(DISTINCT tg.product_id) usage_count
FROM shop_tag t JOIN shop_tagging tg ON tg.tag_id = t.tag_id
JOIN shop_product p ON p.product_id = tg.product_id JOIN shop_vendor v ON v.vendor_id = p.vendor_id
WHERE p.status = 'Active' AND v.status = 'Active'
GROUP BY t.tag_id, t.name ORDER BY usage_count DESC, t.name ASC LIMIT 20""")
def q_popular_tags(shop):
    return C.popular_tags(*_std(shop), limit=20)


@register("product_tags", f"SELECT tg.product_id, tg.tag_id, t.name, tg.position FROM {_TAG_JOIN}")
def q_product_tags(shop):
    return C.product_tags(shop.shop_tagging, shop.shop_tag)


@register("all_tags", "SELECT tag_id, name FROM shop_tag")
def q_all_tags(shop):
    return C.all_tags(shop.shop_tag)


_PRODUCT_ROW = """p.product_id, p.name, p.description, CAST(p.price AS DOUBLE) price, p.stock, p.category,
 p.image_url, p.vendor_id, p.status, CAST(p.rating AS DOUBLE) rating, p.created_seq"""


@register("customer_products", f"""
SELECT DISTINCT {_PRODUCT_ROW} FROM shop_product p JOIN shop_tagging tg ON p.product_id = tg.product_id
WHERE tg.tag_id = (SELECT tag_id FROM shop_tag WHERE name = 'Brand#3') AND contains(lower(p.name), 'bolt')""")
def q_customer_products(shop):
    tag_ids = shop.shop_tag.filter(F.col("name") == "Brand#3")
    return C.customer_products(shop.shop_product, shop.shop_tagging, keyword="Bolt", tag_ids=tag_ids)


@register("products_with_vendor", f"""
SELECT {_PRODUCT_ROW}, v.store_name, v.location vendor_location
FROM shop_product p LEFT JOIN shop_vendor v ON p.vendor_id = v.vendor_id""")
def q_products_with_vendor(shop):
    return C.products_with_vendor(shop.shop_product, shop.shop_vendor)


@register("products_by_ids", """
SELECT p.product_id id, p.name title, CAST(p.price AS DOUBLE) price, p.image_url image, p.vendor_id,
 v.store_name vendor_name
FROM shop_product p JOIN shop_vendor v ON p.vendor_id = v.vendor_id
WHERE p.product_id IN (SELECT product_id FROM shop_stock_change)""")
def q_products_by_ids(shop):
    return C.products_by_ids(shop.shop_product, shop.shop_vendor, shop.shop_stock_change)


@register("browse_page_meta", """
WITH tot AS (
 SELECT count(DISTINCT p.product_id) total FROM shop_product p JOIN shop_vendor v ON v.vendor_id = p.vendor_id
 WHERE p.status = 'Active' AND v.status = 'Active' AND (
  EXISTS (SELECT 1 FROM shop_tagging tg JOIN shop_tag t ON t.tag_id = tg.tag_id
          WHERE tg.product_id = p.product_id AND lower(t.name) IN ('gear', 'hot'))
  OR contains(lower(p.name), 'gear') OR contains(lower(p.name), 'hot'))),
meta AS (
 SELECT total total_products,
  CAST(CASE WHEN total > 0 THEN ceil(total / 20.0) ELSE 0 END AS BIGINT) total_pages,
  CAST(CASE WHEN total > 0 THEN 41 ELSE 0 END AS BIGINT) start_item,
  least(CAST(60 AS BIGINT), total) end_item, CAST(3 AS BIGINT) page FROM tot),
btn AS (
 SELECT 'meta' kind, CAST(3 AS BIGINT) target_page FROM meta
 UNION ALL SELECT 'prev', 2 FROM meta WHERE total_pages > 1
 UNION ALL SELECT 'page', g FROM meta, range(1, 6) r(g) WHERE total_pages > 1 AND g <= total_pages
 UNION ALL SELECT 'next', 4 FROM meta WHERE total_pages > 1 AND 3 < total_pages)
SELECT total_products, total_pages, start_item, end_item, page, kind, CAST(target_page AS BIGINT) target_page,
 target_page = page is_current FROM meta, btn""")
def q_browse_page_meta(shop):
    return C.browse_page_meta(*_std(shop), tags=["gear", " hot"], page=3)


@register("vendor_table_filter", """
SELECT vendor_id, product_id, name, category FROM shop_product
WHERE contains(lower(name), 'anvil') AND category = 'PROMO'""")
def q_vendor_table_filter(shop):
    return C.vendor_table_filter(shop.shop_product, term="ANVIL", category="PROMO")
