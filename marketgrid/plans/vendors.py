"""Registered vendor-dashboard queries (C)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import vendors as V
from .registry import cards_sql, register


@register("vendor_products", f"""
WITH R AS (SELECT p.*, v.store_name,
  row_number() OVER (PARTITION BY p.vendor_id ORDER BY p.created_seq DESC, p.product_id) rn
 FROM shop_product p JOIN shop_vendor v ON v.vendor_id = p.vendor_id WHERE p.status <> 'Inactive'),
L AS (SELECT * FROM R WHERE rn <= 20)
SELECT C.*, CAST(L2.rn AS BIGINT) rn FROM ({cards_sql()}) C JOIN L L2 ON L2.product_id = C.product_id""")
def q_vendor_products(shop):
    return V.vendor_products(shop.shop_product, shop.shop_vendor, shop.shop_tagging, shop.shop_tag,
                             tab="inventory", page=1)


@register("vendor_products_count", """
SELECT v.vendor_id,
 CAST(count(p.product_id) AS BIGINT) all_count,
 CAST(count(CASE WHEN p.status = 'Active' THEN 1 END) AS BIGINT) active_count,
 CAST(count(CASE WHEN p.status = 'Inactive' THEN 1 END) AS BIGINT) inactive_count,
 CAST(count(CASE WHEN p.status <> 'Inactive' THEN 1 END) AS BIGINT) inventory_count
FROM shop_vendor v LEFT JOIN shop_product p ON p.vendor_id = v.vendor_id GROUP BY v.vendor_id""")
def q_vendor_products_count(shop):
    return V.vendor_products_count(shop.shop_product, shop.shop_vendor)


_STATS_SQL = """
SELECT v.vendor_id, CAST(count(p.product_id) AS BIGINT) total_products,
 CAST(coalesce(sum(CASE WHEN p.status = 'Active' THEN 1 ELSE 0 END), 0) AS BIGINT) active_products,
 CAST(coalesce(sum(p.stock), 0) AS BIGINT) total_stock,
 CAST(coalesce(sum(CASE WHEN p.stock = 0 THEN 1 ELSE 0 END), 0) AS BIGINT) out_of_stock,
 CAST(coalesce(sum(CASE WHEN p.status = 'Inactive' THEN 1 ELSE 0 END), 0) AS BIGINT) inactive_products
FROM shop_vendor v LEFT JOIN shop_product p ON p.vendor_id = v.vendor_id GROUP BY v.vendor_id"""


@register("vendor_stats", _STATS_SQL)
def q_vendor_stats(shop):
    return V.vendor_stats(shop.shop_product, shop.shop_vendor)


@register("vendor_status_breakdown", f"""
WITH S AS ({_STATS_SQL})
SELECT vendor_id, status, count, CASE WHEN total_products > 0 THEN count / total_products * 100 ELSE 0.0 END percentage
FROM (SELECT vendor_id, total_products, 'Active' status, active_products count FROM S
 UNION ALL SELECT vendor_id, total_products, 'OutOfStock', out_of_stock FROM S
 UNION ALL SELECT vendor_id, total_products, 'Inactive', inactive_products FROM S) x""")
def q_vendor_status_breakdown(shop):
    return V.vendor_status_breakdown(shop.shop_product, shop.shop_vendor)


@register("low_stock_products", """
SELECT vendor_id, product_id, name, stock FROM (
 SELECT vendor_id, product_id, name, stock,
  row_number() OVER (PARTITION BY vendor_id ORDER BY stock, product_id) rn
 FROM shop_product WHERE stock > 0 AND stock < 10) x WHERE rn <= 5""")
def q_low_stock_products(shop):
    return V.low_stock_products(shop.shop_product, limit=5)


@register("vendors_list", """
SELECT vendor_id, store_name, location, status, CAST(coalesce(rating, 0) AS DOUBLE) rating, created_seq
FROM shop_vendor WHERE contains(lower(location), 'nation_1')""")
def q_vendors_list(shop):
    return V.vendors_list(shop.shop_vendor, location="NATION_1")


@register("vendor_counts", """
SELECT CASE WHEN grouping(status) = 1 THEN 'ALL' ELSE status END scope, count(*) vendor_count
FROM shop_vendor GROUP BY ROLLUP (status)""")
def q_vendor_counts(shop):
    return V.vendor_counts(shop.shop_vendor)


_ORDERS_PER_VENDOR = """SELECT p.vendor_id, count(DISTINCT i.order_id) orders_count
 FROM shop_order_items i JOIN shop_product p ON p.product_id = i.product_id GROUP BY p.vendor_id"""


@register("vendor_inventory_totals", f"""
SELECT s.vendor_id, s.total_products, s.active_products, s.out_of_stock, s.total_stock,
 CAST(coalesce(o.orders_count, 0) AS BIGINT) orders_count
FROM ({_STATS_SQL}) s LEFT JOIN ({_ORDERS_PER_VENDOR}) o ON o.vendor_id = s.vendor_id""")
def q_vendor_inventory_totals(shop):
    return V.vendor_inventory_totals(shop.shop_product, shop.shop_vendor, shop.shop_order_items)


@register("vendor_orders_count", f"""
SELECT v.vendor_id, CAST(coalesce(o.orders_count, 0) AS BIGINT) orders_count
FROM shop_vendor v LEFT JOIN ({_ORDERS_PER_VENDOR}) o ON o.vendor_id = v.vendor_id""")
def q_vendor_orders_count(shop):
    return V.vendor_orders_count(shop.shop_product, shop.shop_vendor, shop.shop_order_items)


@register("vendor_order_lines", """
SELECT DISTINCT p.vendor_id, i.order_id, i.product_id, i.quantity, CAST(i.price_per_unit AS DOUBLE) price,
 strftime(o.order_date, '%Y-%m-%d %H:%M:%S') order_date, o.status, o.customer_id, p.name product_name
FROM shop_order_items i JOIN shop_product p ON p.product_id = i.product_id
JOIN shop_orders o ON o.order_id = i.order_id""")
def q_vendor_order_lines(shop):
    return V.vendor_order_lines(shop.shop_product, shop.shop_order_items, shop.shop_orders)


@register("vendor_sub_orders", """
SELECT so.sub_order_id, so.order_id, so.merchant_id, CAST(so.sub_total_amount AS DOUBLE) sub_total_amount,
 so.status, so.shipping_status, strftime(so.created_at, '%Y-%m-%d %H:%M:%S') created_at,
 (SELECT count(*) FROM shop_order_items i WHERE i.sub_order_id = so.sub_order_id) item_count,
 u.username customer_name
FROM shop_sub_orders so JOIN shop_orders o ON so.order_id = o.order_id JOIN shop_user u ON o.customer_id = u.user_id""")
def q_vendor_sub_orders(shop):
    return V.vendor_sub_orders(shop.shop_sub_orders, shop.shop_order_items, shop.shop_orders, shop.shop_user)


@register("vendor_analytics", """
WITH a AS (SELECT merchant_id vendor_id,
  CAST(sum(CASE WHEN status <> 'cancelled' THEN sub_total_amount ELSE 0 END) AS DOUBLE) sales,
  count(*) n, count(CASE WHEN status <> 'cancelled' THEN 1 END) na
 FROM shop_sub_orders GROUP BY merchant_id)
SELECT v.vendor_id, coalesce(a.sales, 0.0) total_sales, CAST(coalesce(a.n, 0) AS BIGINT) total_orders,
 CASE WHEN coalesce(a.n, 0) > 0 THEN a.sales / a.n ELSE 0.0 END avg_order_value,
 CASE WHEN coalesce(a.na, 0) > 0 THEN a.sales / a.na ELSE 0.0 END avg_active_order_value
FROM shop_vendor v LEFT JOIN a ON a.vendor_id = v.vendor_id""")
def q_vendor_analytics(shop):
    return V.vendor_analytics(shop.shop_sub_orders, shop.shop_vendor)


@register("vendor_top_products", """
WITH s AS (SELECT i.merchant_id, i.product_id, sum(i.quantity) sales_count, sum(i.total_price) revenue
 FROM shop_order_items i WHERE i.item_status = 'active'
  AND i.sub_order_id IN (SELECT sub_order_id FROM shop_sub_orders WHERE status <> 'cancelled')
 GROUP BY i.merchant_id, i.product_id),
r AS (SELECT *, row_number() OVER (PARTITION BY merchant_id ORDER BY revenue DESC, product_id) rk FROM s)
SELECT r.merchant_id vendor_id, r.product_id, p.name, CAST(r.sales_count AS BIGINT) sales_count,
 CAST(r.revenue AS DOUBLE) total_revenue, CAST(r.rk AS BIGINT) rank
FROM r JOIN shop_product p ON p.product_id = r.product_id WHERE r.rk <= 10""")
def q_vendor_top_products(shop):
    return V.vendor_top_products(shop.shop_order_items, shop.shop_sub_orders, shop.shop_product, n=10)


_AVG_RATING_SQL = """
SELECT v.vendor_id, coalesce(floor(a.avg_score * 100 + 0.5) / 100, CAST(v.rating AS DOUBLE), 0.0) average_rating
FROM shop_vendor v LEFT JOIN (SELECT vendor_id, avg(score) avg_score FROM shop_rating GROUP BY vendor_id) a
 ON a.vendor_id = v.vendor_id"""


@register("vendor_average_rating", _AVG_RATING_SQL)
def q_vendor_average_rating(shop):
    return V.vendor_average_rating(shop.shop_rating, shop.shop_vendor)


@register("vendor_service_stats", f"""
SELECT v.vendor_id, v.store_name business_name, s.total_products, s.active_products, r.average_rating, v.status
FROM shop_vendor v JOIN ({_STATS_SQL}) s ON s.vendor_id = v.vendor_id
JOIN ({_AVG_RATING_SQL}) r ON r.vendor_id = v.vendor_id""")
def q_vendor_service_stats(shop):
    return V.vendor_service_stats(shop.shop_product, shop.shop_vendor, shop.shop_rating)


@register("recent_products", f"""
WITH R AS (SELECT p.*, v.store_name,
  row_number() OVER (PARTITION BY p.vendor_id ORDER BY p.created_seq DESC, p.product_id) rn
 FROM shop_product p JOIN shop_vendor v ON v.vendor_id = p.vendor_id),
L AS (SELECT * FROM R WHERE rn <= 10)
SELECT C.*, CAST(L2.rn AS BIGINT) rn FROM ({cards_sql()}) C JOIN L L2 ON L2.product_id = C.product_id""")
def q_recent_products(shop):
    return V.recent_products(shop.shop_product, shop.shop_vendor, shop.shop_tagging, shop.shop_tag, n=10)


@register("vendor_profile", """
SELECT u.user_id vendor_id, v.vendor_id IS NOT NULL "exists", v.store_name business_name,
 v.location geographical_presence, v.status,
 CASE WHEN v.vendor_id IS NOT NULL THEN CAST(coalesce(v.rating, 0) AS DOUBLE) END average_rating
FROM shop_user u LEFT JOIN shop_vendor v ON v.vendor_id = u.user_id""")
def q_vendor_profile(shop):
    ids = shop.shop_user.select(F.col("user_id").alias("vendor_id"))
    return V.vendor_profile(shop.shop_vendor, ids)


@register("available_users", """
SELECT user_id id, username, role_bits role FROM shop_user WHERE (role_bits & 2) = 0 AND (role_bits & 4) = 0""")
def q_available_users(shop):
    return V.available_users(shop.shop_user)


@register("vendor_catalog", """
SELECT p.vendor_id, p.product_id, p.name, p.description, CAST(p.price AS DOUBLE) price, p.stock, p.category,
 p.image_url, p.status, CAST(p.rating AS DOUBLE) rating, p.created_seq
FROM shop_product p WHERE p.vendor_id IN (SELECT vendor_id FROM shop_vendor)""")
def q_vendor_catalog(shop):
    return V.vendor_catalog(shop.shop_product, shop.shop_vendor)
