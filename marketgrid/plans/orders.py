"""Registered cart / order queries (D)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import money
from ..operators import cart as C
from ..operators import orders as O
from .registry import register

_VIS = """vis AS (SELECT p.product_id, p.vendor_id, p.price, p.status, p.stock FROM shop_product p
 JOIN shop_vendor v ON v.vendor_id = p.vendor_id WHERE p.status <> 'Inactive' AND v.status = 'Active')"""
_SEQ = ["ts", "seq1", "seq2", "seq3"]


@register("cart_totals", """
SELECT c.cart_id, CAST(count(*) AS BIGINT) item_lines, CAST(sum(p.price * c.quantity) AS DOUBLE) total
FROM shop_cart_line c JOIN shop_product p ON p.product_id = c.product_id
WHERE p.vendor_id IN (SELECT vendor_id FROM shop_vendor) GROUP BY c.cart_id""")
def q_cart_totals(shop):
    return O.cart_totals(shop.shop_cart_line, shop.shop_product, shop.shop_vendor)


@register("cart_merge", """
SELECT cart_id, product_id, quantity FROM (
 SELECT c.cart_id, c.product_id, CAST(least(sum(c.quantity), min(p.stock)) AS BIGINT) quantity
 FROM shop_cart_line c JOIN shop_product p ON p.product_id = c.product_id JOIN shop_vendor v ON v.vendor_id = p.vendor_id
 WHERE p.status = 'Active' AND v.status = 'Active' AND c.quantity > 0 GROUP BY c.cart_id, c.product_id) x
WHERE quantity > 0""")
def q_cart_merge(shop):
    return O.cart_merge(shop.shop_cart_line, shop.shop_product, shop.shop_vendor)


# The oracle applies one event a step to every line: an independent check of the scan.
_CART_FOLD = """recursive e AS (
 SELECT x.*, row_number() OVER (PARTITION BY x.cart_id, x.product_id ORDER BY x.ts, x.event_id) k, p.stock s,
  coalesce(p.status = 'Active', false) can_add, p.product_id IS NOT NULL shown
 FROM shop_cart_event x LEFT JOIN (SELECT p.* FROM shop_product p JOIN shop_vendor v ON v.vendor_id = p.vendor_id
  WHERE p.status <> 'Inactive' AND v.status = 'Active') p ON p.product_id = x.product_id),
f AS (
 SELECT d.cart_id, d.product_id, CAST(0 AS BIGINT) k, CAST(coalesce(c.quantity, 0) AS BIGINT) q, CAST(NULL AS BIGINT) event_id
 FROM (SELECT DISTINCT cart_id, product_id FROM shop_cart_event) d
 LEFT JOIN shop_cart_start c ON c.cart_id = d.cart_id AND c.product_id = d.product_id
 UNION ALL
 SELECT f.cart_id, f.product_id, e.k, CAST(CASE WHEN e.action = 'remove' THEN 0
  WHEN e.action = 'add' AND e.can_add THEN greatest(0, least(e.s, f.q + coalesce(e.quantity, 1)))
  WHEN e.action = 'increase' AND e.shown AND f.q > 0 AND f.q + 1 <= e.s THEN f.q + 1
  WHEN e.action = 'decrease' AND e.shown AND f.q > 0 THEN f.q - 1 ELSE f.q END AS BIGINT), e.event_id
 FROM f JOIN e ON e.cart_id = f.cart_id AND e.product_id = f.product_id AND e.k = f.k + 1)"""


def _cart_history(shop):
    return C.cart_history(shop.shop_cart_event, shop.shop_cart_start, shop.shop_product, shop.shop_vendor)


@register("cart_history", f"WITH {_CART_FOLD} SELECT event_id, cart_id, product_id, q quantity FROM f WHERE k > 0")
def q_cart_history(shop):
    """Every cart line after every event."""
    return _cart_history(shop).drop("ts")


@register("cart_state", f"""
WITH {_CART_FOLD},
l AS (SELECT cart_id, product_id, arg_max(q, k) q FROM f GROUP BY 1, 2)
SELECT cart_id, product_id, q quantity FROM l WHERE q > 0
UNION ALL SELECT c.cart_id, c.product_id, CAST(c.quantity AS BIGINT) FROM shop_cart_start c
WHERE NOT EXISTS (SELECT 1 FROM l WHERE l.cart_id = c.cart_id AND l.product_id = c.product_id)""")
def q_cart_state(shop):
    """The carts at the end."""
    return C.cart_state(shop.shop_cart_start, _cart_history(shop))


@register("checkout_validation", f"""
WITH {_VIS},
l AS (SELECT c.cart_id, c.line_no, c.product_id, c.quantity,
  CASE WHEN vis.product_id IS NULL THEN 'missing' WHEN vis.status <> 'Active' THEN 'unavailable'
   WHEN c.quantity > vis.stock THEN 'insufficient_stock' ELSE 'ok' END reason
 FROM shop_cart_line c LEFT JOIN vis ON vis.product_id = c.product_id),
b AS (SELECT *, row_number() OVER (PARTITION BY cart_id ORDER BY line_no, product_id, quantity) rn
 FROM l WHERE reason <> 'ok')
SELECT k.cart_id, coalesce(b.reason, 'ok') verdict, coalesce(b.line_no, 0) failed_line_no, b.product_id failed_product_id
FROM (SELECT DISTINCT cart_id FROM shop_cart_line) k LEFT JOIN b ON b.cart_id = k.cart_id AND b.rn = 1""")
def q_checkout_validation(shop):
    return O.checkout_validation(shop.shop_cart_line, shop.shop_product, shop.shop_vendor)


_SPLIT_IT = f"""WITH {_VIS},
it AS (SELECT concat('i', CAST(c.cart_id AS VARCHAR), '-', CAST(c.line_no AS VARCHAR), '-', c.product_id, '-',
  CAST(c.quantity AS VARCHAR)) order_item_id, concat('o', CAST(c.cart_id AS VARCHAR)) order_id,
  concat('o', CAST(c.cart_id AS VARCHAR), '-', vis.vendor_id) sub_order_id, vis.vendor_id merchant_id, c.product_id,
  c.quantity, vis.price price_per_unit, CAST(c.quantity * vis.price AS DECIMAL(10,2)) total_price
 FROM shop_cart_line c JOIN vis ON vis.product_id = c.product_id)"""


@register("split_orders", f"""
{_SPLIT_IT},
so AS (SELECT order_id, sub_order_id, merchant_id, sum(total_price) sub_total_amount, count(*) item_count
 FROM it GROUP BY 1, 2, 3),
o AS (SELECT order_id, sum(sub_total_amount) total_amount FROM so GROUP BY 1)
SELECT so.order_id, so.sub_order_id, so.merchant_id, CAST(so.sub_total_amount AS DOUBLE) sub_total_amount,
 CAST(so.item_count AS BIGINT) item_count, CAST(o.total_amount AS DOUBLE) total_amount,
 'pending' status, 'pending' shipping_status
FROM so JOIN o ON o.order_id = so.order_id""")
def q_split_orders(shop):
    s = O.split_orders(shop.shop_cart_line, shop.shop_product, shop.shop_vendor)
    return (s.sub_orders.join(s.orders.select("order_id", "total_amount"), "order_id")
            .select("order_id", "sub_order_id", "merchant_id", money("sub_total_amount").alias("sub_total_amount"),
                    F.col("item_count").cast("bigint").alias("item_count"), money("total_amount").alias("total_amount"),
                    "status", "shipping_status"))


@register("split_order_items", f"""
{_SPLIT_IT}
SELECT order_item_id, order_id, sub_order_id, merchant_id, product_id, quantity,
 CAST(price_per_unit AS DOUBLE) price_per_unit, CAST(total_price AS DOUBLE) total_price, 'active' item_status FROM it""")
def q_split_order_items(shop):
    s = O.split_orders(shop.shop_cart_line, shop.shop_product, shop.shop_vendor)
    return s.items.select("order_item_id", "order_id", "sub_order_id", "merchant_id", "product_id", "quantity",
                          money("price_per_unit").alias("price_per_unit"), money("total_price").alias("total_price"),
                          "item_status")


@register("checkout_stock", f"""
{_SPLIT_IT}
SELECT p.product_id, p.stock stock_before, CAST(coalesce(o.ordered, 0) AS BIGINT) ordered,
 CAST(p.stock - coalesce(o.ordered, 0) AS BIGINT) stock_after,
 CASE WHEN o.ordered IS NOT NULL AND p.stock = o.ordered AND p.status <> 'Inactive' THEN 'OutOfStock'
  WHEN o.ordered < p.stock AND p.stock = 0 AND p.status = 'OutOfStock' THEN 'Active' ELSE p.status END status_after
FROM shop_product p LEFT JOIN (SELECT product_id, sum(quantity) ordered FROM it GROUP BY 1) o
 ON o.product_id = p.product_id""")
def q_checkout_stock(shop):
    s = O.split_orders(shop.shop_cart_line, shop.shop_product, shop.shop_vendor)
    return O.checkout_stock(shop.shop_product, s.items)


_PLACE = f"""{_SPLIT_IT},
bad AS (SELECT DISTINCT c.cart_id FROM shop_cart_line c LEFT JOIN vis ON vis.product_id = c.product_id
 WHERE vis.product_id IS NULL OR vis.status <> 'Active' OR c.quantity > vis.stock),
head AS (SELECT concat('o', CAST(h.cart_id AS VARCHAR)) order_id, h.customer_id, h.order_date, trim(h.shipping_address) shipping_address
 FROM shop_cart_header h LEFT JOIN bad ON bad.cart_id = h.cart_id
 WHERE bad.cart_id IS NULL AND trim(h.shipping_address) <> ''),
placed AS (SELECT it.* FROM it JOIN head ON head.order_id = it.order_id)"""


def _placed(shop):
    return O.place_orders(shop.shop_cart_line, shop.shop_cart_header, shop.shop_product, shop.shop_vendor)


@register("place_orders", f"""
{_PLACE}
SELECT h.order_id, h.customer_id, CAST(h.order_date AS DATE) order_date, h.shipping_address,
 CAST(sum(i.total_price) AS DOUBLE) total_amount, 'pending' status, 'unpaid' payment_status
FROM head h JOIN placed i ON i.order_id = h.order_id GROUP BY h.order_id, h.customer_id, h.order_date, h.shipping_address""")
def q_place_orders(shop):
    return _placed(shop).orders.select(
        "order_id", "customer_id", F.col("order_date").cast("date").alias("order_date"), "shipping_address",
        money("total_amount").alias("total_amount"), "status", "payment_status")


@register("place_orders_stock", f"""
{_PLACE}
SELECT p.product_id, p.stock stock_before, CAST(coalesce(o.ordered, 0) AS BIGINT) ordered,
 CAST(p.stock - coalesce(o.ordered, 0) AS BIGINT) stock_after,
 CASE WHEN o.ordered IS NOT NULL AND p.stock = o.ordered AND p.status <> 'Inactive' THEN 'OutOfStock'
  WHEN o.ordered < p.stock AND p.stock = 0 AND p.status = 'OutOfStock' THEN 'Active' ELSE p.status END status_after
FROM shop_product p LEFT JOIN (SELECT product_id, sum(quantity) ordered FROM placed GROUP BY 1) o
 ON o.product_id = p.product_id""")
def q_place_orders_stock(shop):
    return O.checkout_stock(shop.shop_product, _placed(shop).items)


@register("remove_sub_order_products", """
SELECT i.order_item_id, i.sub_order_id, i.order_id, i.product_id, i.quantity, i.item_status FROM shop_order_items i
WHERE NOT EXISTS (SELECT 1 FROM shop_order_items r JOIN shop_item_removal q ON q.order_item_id = r.order_item_id
 WHERE r.sub_order_id = i.sub_order_id AND r.product_id = i.product_id)""")
def q_remove_sub_order_products(shop):
    pairs = shop.shop_order_items.join(shop.shop_item_removal, "order_item_id", "left_semi")
    return (O.remove_sub_order_products(shop.shop_order_items, pairs)
            .select("order_item_id", "sub_order_id", "order_id", "product_id", "quantity", "item_status"))


@register("order_details", """
SELECT o.order_id, o.customer_id, o.status order_status, CAST(o.total_amount AS DOUBLE) total_amount,
 so.sub_order_id, so.merchant_id, so.status sub_status, so.shipping_status, i.order_item_id, i.product_id,
 coalesce(i.quantity, 0) quantity, CAST(i.total_price AS DOUBLE) total_price, i.name product_name
FROM shop_order_state o LEFT JOIN shop_sub_orders so ON so.order_id = o.order_id
LEFT JOIN (SELECT i.*, p.name FROM shop_order_items i JOIN shop_product p ON p.product_id = i.product_id) i
 ON i.sub_order_id = so.sub_order_id""")
def q_order_details(shop):
    return O.order_details_flat(shop.shop_order_state, shop.shop_sub_orders, shop.shop_order_items,
                                shop.shop_product)


@register("order_items_named", """
SELECT i.order_item_id, i.sub_order_id, i.order_id, i.product_id, i.quantity,
 CAST(i.price_per_unit AS DOUBLE) price_per_unit, CAST(i.total_price AS DOUBLE) total_price, i.item_status,
 p.name product_name, p.image_url product_image
FROM shop_order_items i JOIN shop_product p ON p.product_id = i.product_id""")
def q_order_items_named(shop):
    return O.order_items_named(shop.shop_order_items, shop.shop_product)


@register("customer_orders", """
SELECT order_id, customer_id, strftime(order_date, '%Y-%m-%d %H:%M:%S') order_date, status, CAST(total_amount AS DOUBLE) total_amount,
 payment_status FROM shop_order_state""")
def q_customer_orders(shop):
    return O.customer_orders(shop.shop_order_state)


@register("order_visibility", """
WITH r AS (SELECT q.viewer_id, q.login_type, q.order_id, coalesce(u.role_bits, 0) bits, o.customer_id,
  o.order_id IS NOT NULL found
 FROM shop_view_request q LEFT JOIN shop_user u ON u.user_id = q.viewer_id
 LEFT JOIN shop_orders o ON o.order_id = q.order_id),
a AS (SELECT viewer_id, order_id, CASE WHEN NOT found THEN 'not_found' WHEN (bits & 4) <> 0 THEN 'admin'
  WHEN login_type = 'backend' AND (bits & 2) <> 0 THEN 'vendor' WHEN customer_id = viewer_id THEN 'customer'
  ELSE 'denied' END access FROM r)
SELECT a.viewer_id, a.order_id, a.access, so.sub_order_id FROM a
 LEFT JOIN shop_sub_orders so ON so.order_id = a.order_id WHERE a.access IN ('admin', 'customer')
UNION ALL
SELECT a.viewer_id, a.order_id,
 CASE WHEN so.sub_order_id IS NULL AND EXISTS (SELECT 1 FROM shop_sub_orders s2 WHERE s2.order_id = a.order_id)
  THEN 'denied' ELSE 'vendor' END, so.sub_order_id
FROM a LEFT JOIN shop_sub_orders so ON so.order_id = a.order_id AND so.merchant_id = a.viewer_id
WHERE a.access = 'vendor'
UNION ALL
SELECT viewer_id, order_id, access, CAST(NULL AS VARCHAR) FROM a WHERE access IN ('denied', 'not_found')""")
def q_order_visibility(shop):
    return O.order_visibility(shop.shop_view_request, shop.shop_user, shop.shop_orders, shop.shop_sub_orders)


@register("apply_order_status", """
WITH l AS (SELECT order_id, field, value,
  row_number() OVER (PARTITION BY order_id, field ORDER BY ts DESC, seq1 DESC, seq2 DESC, seq3 DESC) rn
 FROM shop_order_change)
SELECT o.order_id, coalesce(s.value, o.status) status, coalesce(pm.value, o.payment_status) payment_status
FROM shop_order_state o
LEFT JOIN l s ON s.order_id = o.order_id AND s.field = 'status' AND s.rn = 1
LEFT JOIN l pm ON pm.order_id = o.order_id AND pm.field = 'payment_status' AND pm.rn = 1""")
def q_apply_order_status(shop):
    return O.apply_order_status(shop.shop_order_state, shop.shop_order_change, _SEQ)


@register("apply_sub_order_changes", """
WITH l AS (SELECT sub_order_id, field, value,
  row_number() OVER (PARTITION BY sub_order_id, field ORDER BY ts DESC, seq1 DESC, seq2 DESC, seq3 DESC) rn
 FROM shop_sub_order_change)
SELECT s.sub_order_id, s.order_id, s.merchant_id, coalesce(st.value, s.status) status,
 coalesce(sh.value, s.shipping_status) shipping_status
FROM shop_sub_orders s
LEFT JOIN l st ON st.sub_order_id = s.sub_order_id AND st.field = 'status' AND st.rn = 1
LEFT JOIN l sh ON sh.sub_order_id = s.sub_order_id AND sh.field = 'shipping_status' AND sh.rn = 1""")
def q_apply_sub_order_changes(shop):
    return O.apply_sub_order_changes(shop.lazy.shop_sub_orders, shop.shop_sub_order_change, _SEQ)


# Status after stock p.stock + a.q (a.q NULL: not restored).
_RESTORED = """CASE WHEN a.q IS NOT NULL AND p.stock + a.q = 0 AND p.status <> 'Inactive' THEN 'OutOfStock'
  WHEN p.stock + a.q > 0 AND p.stock = 0 AND p.status = 'OutOfStock' THEN 'Active' ELSE p.status END"""
_CANCEL = """req AS (SELECT DISTINCT order_id FROM shop_cancel_request),
acc AS (SELECT r.order_id FROM req r WHERE EXISTS (SELECT 1 FROM shop_order_state o WHERE o.order_id = r.order_id)
 AND NOT EXISTS (SELECT 1 FROM shop_sub_orders s WHERE s.order_id = r.order_id AND s.shipping_status <> 'pending'))"""


def _cancel(shop, orders=None):
    """D11 over lazy tables, each of which the plan reads about once.  Where the next orders
    are not asked for, the order table without its totals tells as well which orders there are."""
    t = shop.lazy
    return O.cancel_orders(t.shop_orders if orders is None else orders, t.shop_sub_orders, t.shop_order_items,
                           t.shop_product, t.shop_cancel_request)


@register("cancel_orders", f"""
WITH {_CANCEL}
SELECT r.order_id,
 CASE WHEN NOT EXISTS (SELECT 1 FROM shop_order_state o WHERE o.order_id = r.order_id) THEN 'not_found'
  WHEN r.order_id NOT IN (SELECT order_id FROM acc) THEN 'refused' ELSE 'cancelled' END outcome,
 CAST(coalesce((SELECT sum(i.quantity) FROM shop_order_items i WHERE i.order_id = r.order_id
  AND i.item_status = 'active' AND r.order_id IN (SELECT order_id FROM acc)), 0) AS BIGINT) restored_units
FROM req r""")
def q_cancel_orders(shop):
    return _cancel(shop).outcomes


@register("cancel_orders_stock", f"""
WITH {_CANCEL},
a AS (SELECT product_id, sum(quantity) q FROM shop_order_items
 WHERE item_status = 'active' AND order_id IN (SELECT order_id FROM acc) GROUP BY 1)
SELECT p.product_id, CAST(p.stock + coalesce(a.q, 0) AS INT) stock, {_RESTORED} status
FROM shop_product p LEFT JOIN a ON a.product_id = p.product_id""")
def q_cancel_orders_stock(shop):
    return _cancel(shop).product.select("product_id", "stock", "status")


@register("cancel_orders_orders", f"""
WITH {_CANCEL}
SELECT order_id, customer_id, CAST(total_amount AS DOUBLE) total_amount, payment_status,
 CASE WHEN order_id IN (SELECT order_id FROM acc) THEN 'cancelled' ELSE status END status FROM shop_order_state""")
def q_cancel_orders_orders(shop):
    return _cancel(shop, shop.shop_order_state).orders.select("order_id", "customer_id", money("total_amount").alias("total_amount"),
                                       "payment_status", "status")


@register("cancel_orders_sub_orders", f"""
WITH {_CANCEL}
SELECT sub_order_id, order_id, merchant_id, CAST(sub_total_amount AS DOUBLE) sub_total_amount, shipping_status,
 CASE WHEN order_id IN (SELECT order_id FROM acc) THEN 'cancelled' ELSE status END status FROM shop_sub_orders""")
def q_cancel_orders_sub_orders(shop):
    return _cancel(shop).sub_orders.select("sub_order_id", "order_id", "merchant_id",
                                           money("sub_total_amount").alias("sub_total_amount"), "shipping_status",
                                           "status")


_ITEM_COLS = ["order_item_id", "order_id", "sub_order_id", "product_id", "quantity", "item_status"]


@register("cancel_orders_items", f"""
WITH {_CANCEL}
SELECT order_item_id, order_id, sub_order_id, product_id, quantity,
 CASE WHEN order_id IN (SELECT order_id FROM acc) THEN 'removed' ELSE item_status END item_status
FROM shop_order_items""")
def q_cancel_orders_items(shop):
    return _cancel(shop).items.select(*_ITEM_COLS)


_REMOVE = """req AS (SELECT DISTINCT order_item_id FROM shop_item_removal),
rm AS (SELECT i.* FROM shop_order_items i WHERE i.order_item_id IN (SELECT order_item_id FROM req)
 AND i.item_status = 'active'
 AND i.sub_order_id IN (SELECT sub_order_id FROM shop_sub_orders WHERE shipping_status = 'pending')),
ni AS (SELECT i.sub_order_id, i.order_id,
  CASE WHEN i.order_item_id IN (SELECT order_item_id FROM rm) THEN 'removed' ELSE i.item_status END item_status
 FROM shop_order_items i),
ps AS (SELECT sub_order_id, sum(total_price) amt FROM rm GROUP BY 1),
ns AS (SELECT s.sub_order_id, s.order_id, s.merchant_id, s.sub_total_amount - coalesce(ps.amt, 0) sub_total_amount,
  CASE WHEN ps.sub_order_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM ni WHERE ni.sub_order_id = s.sub_order_id
   AND ni.item_status = 'active') THEN 'cancelled' ELSE s.status END status
 FROM shop_sub_orders s LEFT JOIN ps ON ps.sub_order_id = s.sub_order_id)"""


def _remove(shop, orders=None):
    """D12; the order totals are stored only where the next orders are asked for."""
    orders = shop.lazy.shop_order_state if orders is None else orders
    return O.remove_order_items(orders, shop.shop_sub_orders, shop.shop_order_items,
                                shop.shop_product, shop.shop_item_removal)


@register("remove_order_items", f"""
WITH {_REMOVE}
SELECT sub_order_id, order_id, merchant_id, CAST(sub_total_amount AS DOUBLE) sub_total_amount, status FROM ns""")
def q_remove_order_items(shop):
    return _remove(shop).sub_orders.select("sub_order_id", "order_id", "merchant_id",
                                           money("sub_total_amount").alias("sub_total_amount"), "status")


@register("remove_order_items_orders", f"""
WITH {_REMOVE},
po AS (SELECT order_id, sum(total_price) amt FROM rm GROUP BY 1)
SELECT o.order_id, CAST(o.total_amount - coalesce(po.amt, 0) AS DOUBLE) total_amount,
 CASE WHEN po.order_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM ns WHERE ns.order_id = o.order_id
  AND ns.status <> 'cancelled') THEN 'cancelled' ELSE o.status END status
FROM shop_order_state o LEFT JOIN po ON po.order_id = o.order_id""")
def q_remove_order_items_orders(shop):
    return _remove(shop, shop.shop_order_state).orders.select("order_id", money("total_amount").alias("total_amount"), "status")


@register("remove_order_items_items", f"""
WITH {_REMOVE}
SELECT order_item_id, order_id, sub_order_id, product_id, quantity,
 CASE WHEN order_item_id IN (SELECT order_item_id FROM rm) THEN 'removed' ELSE item_status END item_status
FROM shop_order_items""")
def q_remove_order_items_items(shop):
    return _remove(shop).items.select(*_ITEM_COLS)


@register("remove_order_items_stock", f"""
WITH {_REMOVE},
a AS (SELECT product_id, sum(quantity) q FROM rm GROUP BY 1)
SELECT p.product_id, CAST(p.stock + coalesce(a.q, 0) AS INT) stock, {_RESTORED} status
FROM shop_product p LEFT JOIN a ON a.product_id = p.product_id""")
def q_remove_order_items_stock(shop):
    return _remove(shop).product.select("product_id", "stock", "status")


@register("apply_shipping", """
WITH l AS (SELECT sub_order_id, value,
  row_number() OVER (PARTITION BY sub_order_id ORDER BY ts DESC, seq1 DESC, seq2 DESC, seq3 DESC) rn
 FROM shop_shipping_update WHERE value IN ('pending', 'shipped', 'delivered'))
SELECT s.sub_order_id, s.order_id, s.merchant_id, coalesce(l.value, s.status) status,
 coalesce(l.value, s.shipping_status) shipping_status
FROM shop_sub_orders s LEFT JOIN l ON l.sub_order_id = s.sub_order_id AND l.rn = 1""")
def q_apply_shipping(shop):
    return O.apply_shipping(shop.shop_sub_orders, shop.shop_shipping_update, _SEQ)[0]


@register("apply_shipping_rejected", """
SELECT sub_order_id, value, seq1, seq2, seq3 FROM shop_shipping_update
WHERE value IS NULL OR value NOT IN ('pending', 'shipped', 'delivered')""")
def q_apply_shipping_rejected(shop):
    return (O.apply_shipping(shop.shop_sub_orders, shop.shop_shipping_update, _SEQ)[1]
            .select("sub_order_id", "value", "seq1", "seq2", "seq3"))


@register("order_history_json", """
SELECT c.user_id, o.order_id,
 CASE WHEN o.order_id IN (SELECT order_id FROM shop_cancel_request) THEN 'Cancelled' ELSE o.status END status,
 strftime(o.order_date, '%Y-%m-%d') order_date
FROM shop_customer_profile c LEFT JOIN shop_orders o ON o.customer_id = c.user_id""")
def q_order_history_json(shop):
    history = O.order_history_fragments(shop.shop_customer_profile, shop.shop_orders)
    req = shop.shop_cancel_request.join(shop.shop_orders.select("order_id", "customer_id"), "order_id")
    return O.cancel_in_history(history, req)[0]


@register("order_history_written", """
WITH c AS (SELECT DISTINCT customer_id, order_id FROM shop_history_cancel),
m AS (SELECT o.customer_id, o.order_id, o.order_date, o.status, c.order_id IS NOT NULL hit FROM shop_orders o
 LEFT JOIN c ON c.customer_id = o.customer_id AND c.order_id = o.order_id),
h AS (SELECT customer_id, sum(hit::INT) cancelled, concat('[', string_agg(concat('{"Order_ID":"', order_id, '","Status":"',
  CASE WHEN hit THEN 'Cancelled' ELSE status END, '","Order_Date":"', strftime(order_date, '%Y-%m-%d'), '"}'), ','
  ORDER BY order_id), ']') t FROM m GROUP BY customer_id)
SELECT u.user_id, coalesce(h.t, 'history') order_history, CAST(coalesce(h.cancelled, 0) AS BIGINT) cancelled
FROM shop_customer_profile u LEFT JOIN h ON h.customer_id = u.user_id""")
def q_order_history_written(shop):
    """The rewritten JSON text of every customer."""
    return O.cancel_in_stored_history(shop.shop_customer_history, shop.shop_history_cancel)
