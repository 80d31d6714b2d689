"""Registered change queries (F): state + change rows -> next state."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import money
from ..operators import changes as X
from .registry import register


def parse_sql(src: str, text_col: str = "tags_text") -> str:
    """F1 in DuckDB: split, trim, drop empty, first occurrence (case-free), first 3."""
    return f"""SELECT product_id, name, CAST(position AS INT) position FROM (
 SELECT product_id, name, row_number() OVER (PARTITION BY product_id ORDER BY ord) position FROM (
  SELECT product_id, name, ord, row_number() OVER (PARTITION BY product_id, lower(name) ORDER BY ord) r1 FROM (
   SELECT product_id, trim(x) name, ord FROM (
    SELECT product_id, unnest(l) x, generate_subscripts(l, 1) ord
    FROM (SELECT product_id, string_split({text_col}, ',') l FROM {src}) s0) s1
   WHERE trim(x) <> '') s2) s3 WHERE r1 = 1) s4 WHERE position <= 3"""


def upsert_sql(names: str) -> str:
    """F2 in DuckDB over a CTE ``names`` (product_id, name, position): the next tag table."""
    return f"""SELECT tag_id, name FROM shop_tag
 UNION ALL SELECT CAST((SELECT max(tag_id) FROM shop_tag) + row_number() OVER (ORDER BY k, name) AS INT), name
 FROM (SELECT lower(name) k, min(name) name FROM {names}
       WHERE lower(name) NOT IN (SELECT lower(name) FROM shop_tag) GROUP BY 1) c"""


@register("parse_product_tags", parse_sql("shop_tag_text"))
def q_parse_product_tags(shop):
    return X.parse_product_tags(shop.shop_tag_text)


@register("upsert_tags", f"WITH n AS ({parse_sql('shop_new_product')}) {upsert_sql('n')}")
def q_upsert_tags(shop):
    return X.upsert_tags(shop.shop_tag, X.parse_product_tags(shop.shop_new_product))


def _add(shop):
    return X.add_products(shop.shop_product, shop.shop_tag, shop.shop_tagging, shop.shop_new_product)


@register("add_products", """
SELECT r.product_id, CASE WHEN p.product_id IS NULL THEN 'added' ELSE 'rejected' END outcome
FROM shop_new_product r LEFT JOIN shop_product p ON p.product_id = r.product_id""")
def q_add_products(shop):
    return _add(shop).outcomes


@register("add_products_product", """
SELECT product_id, name, description, CAST(price AS DOUBLE) price, stock, category, image_url, vendor_id, status,
 CAST(rating AS DOUBLE) rating, created_seq FROM shop_product
UNION ALL
SELECT product_id, name, description, CAST(price AS DOUBLE), CAST(stock AS INTEGER), category, image_url, vendor_id,
 'Active', 0.0, created_seq FROM shop_new_product WHERE product_id NOT IN (SELECT product_id FROM shop_product)""")
def q_add_products_product(shop):
    return _add(shop).product.withColumns({"price": money("price"), "rating": money("rating")})


@register("add_products_tagging", f"""
WITH acc AS (SELECT * FROM shop_new_product WHERE product_id NOT IN (SELECT product_id FROM shop_product)),
n AS ({parse_sql('acc')}),
t AS ({upsert_sql('n')})
SELECT n.product_id, t.tag_id, t.name, n.position FROM n JOIN t ON lower(t.name) = lower(n.name)""")
def q_add_products_tagging(shop):
    st = _add(shop)
    added = st.outcomes.filter(F.col("outcome") == "added").select("product_id")
    return (st.tagging.join(added, "product_id", "left_semi").join(st.tag, "tag_id")
            .select("product_id", "tag_id", "name", "position"))


def _update(shop):
    return X.update_products(shop.shop_product, shop.shop_tag, shop.shop_tagging, shop.shop_product_update, ["seq"])


_OWNED_UPDATE = """u AS (SELECT * FROM (SELECT x.*, row_number() OVER (PARTITION BY x.product_id ORDER BY x.seq DESC) rn
 FROM shop_product_update x JOIN shop_product p ON p.product_id = x.product_id AND p.vendor_id = x.vendor_id) y
 WHERE rn = 1)"""


@register("update_products", f"""
WITH {_OWNED_UPDATE}
SELECT p.product_id,
 CASE WHEN u.product_id IS NOT NULL THEN u.name ELSE p.name END name,
 CASE WHEN u.product_id IS NOT NULL THEN u.description ELSE p.description END description,
 CAST(CASE WHEN u.product_id IS NOT NULL THEN u.price ELSE p.price END AS DOUBLE) price,
 CASE WHEN u.product_id IS NOT NULL THEN CAST(u.stock AS INTEGER) ELSE p.stock END stock,
 CASE WHEN u.product_id IS NOT NULL THEN u.category ELSE p.category END category,
 CASE WHEN u.product_id IS NOT NULL THEN u.image_url ELSE p.image_url END image_url,
 CASE WHEN u.product_id IS NULL THEN p.status WHEN u.stock = 0 AND u.status <> 'Inactive' THEN 'OutOfStock'
  WHEN u.stock > 0 AND p.stock = 0 AND u.status = 'OutOfStock' THEN 'Active' ELSE u.status END status, p.vendor_id
FROM shop_product p LEFT JOIN u ON u.product_id = p.product_id""")
def q_update_products(shop):
    return _update(shop).product.select("product_id", "name", "description", money("price").alias("price"),
                                        "stock", "category", "image_url", "status", "vendor_id")


@register("update_products_tagging", f"""
WITH {_OWNED_UPDATE},
n AS ({parse_sql('u')}),
t AS ({upsert_sql('n')})
SELECT n.product_id, t.tag_id, t.name, n.position FROM n JOIN t ON lower(t.name) = lower(n.name)""")
def q_update_products_tagging(shop):
    st = _update(shop)
    touched = st.outcomes.filter(F.col("outcome") == "updated").select("product_id")
    return (st.tagging.join(touched, "product_id", "left_semi").join(st.tag, "tag_id")
            .select("product_id", "tag_id", "name", "position"))


@register("ownership_check", """
SELECT c.product_id, c.vendor_id, coalesce(p.vendor_id = c.vendor_id, false) is_owner
FROM shop_ownership_claim c LEFT JOIN shop_product p ON p.product_id = c.product_id""")
def q_ownership_check(shop):
    return X.ownership_check(shop.shop_product, shop.shop_ownership_claim)


@register("toggle_products", """
SELECT p.product_id, CASE WHEN t.n IS NULL THEN p.status
 WHEN (p.status = 'Active') <> (t.n % 2 = 1) THEN 'Active' ELSE 'Inactive' END status
FROM shop_product p LEFT JOIN (SELECT product_id, count(*) n FROM shop_toggle_request GROUP BY 1) t
 ON t.product_id = p.product_id""")
def q_toggle_products(shop):
    return X.toggle_products(shop.shop_product, shop.shop_toggle_request).select("product_id", "status")


_WIN = "PARTITION BY product_id ORDER BY ts, change_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
# The oracle is the plain single-level scan (no chunks): an independent check
# of the two-level Spark plan.
LEDGER_SQL = f"""c AS (SELECT s.change_id, s.product_id, s.action, s.amount, s.ts, p.stock s0, p.status st0,
  CASE WHEN s.action = 'increase' THEN s.amount ELSE -s.amount END d
 FROM shop_stock_change s JOIN shop_product p ON p.product_id = s.product_id
 WHERE s.amount >= 0 AND s.action IN ('increase', 'decrease')),
x AS (SELECT *, s0 + sum(d) OVER ({_WIN}) xk FROM c),
y AS (SELECT *, xk - least(0, min(xk) OVER ({_WIN})) stock_after FROM x),
z AS (SELECT *, CASE WHEN stock_after = 0 THEN 'OutOfStock' WHEN action = 'increase' THEN 'Active' END ev FROM y),
led AS (SELECT change_id, product_id, ts, CAST(stock_after AS BIGINT) stock_after,
  CASE WHEN st0 = 'Inactive' THEN 'Inactive' ELSE coalesce(last_value(ev IGNORE NULLS) OVER ({_WIN}), st0) END status_after
 FROM z)"""


def _ledger(shop):
    return X.stock_ledger(shop.shop_product, shop.shop_stock_change)


@register("stock_ledger", f"WITH {LEDGER_SQL} SELECT change_id, product_id, stock_after, status_after FROM led")
def q_stock_ledger(shop):
    return _ledger(shop).select("change_id", "product_id", "stock_after", "status_after")


FINAL_SQL = f"""{LEDGER_SQL},
l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY ts DESC, change_id DESC) rn
 FROM led) q WHERE rn = 1),
fin AS (SELECT p.product_id, CASE WHEN l.product_id IS NOT NULL THEN CAST(l.stock_after AS INTEGER) ELSE p.stock END stock,
 coalesce(l.status_after, p.status) status FROM shop_product p LEFT JOIN l ON l.product_id = p.product_id)"""


@register("stock_ledger_final", f"WITH {FINAL_SQL} SELECT product_id, stock, status FROM fin")
def q_stock_ledger_final(shop):
    return X.stock_after_ledger(shop.shop_product, _ledger(shop)).select("product_id", "stock", "status")


@register("product_stock_status", f"""
WITH {FINAL_SQL} SELECT product_id, stock, status FROM fin
WHERE product_id IN (SELECT product_id FROM shop_stock_change)""")
def q_product_stock_status(shop):
    after = X.stock_after_ledger(shop.shop_product, _ledger(shop))
    return X.product_stock_status(after, shop.shop_stock_change)


@register("stock_status_rule", """
SELECT change_id, product_id, CAST(ns AS BIGINT) new_stock,
 CASE WHEN ns = 0 AND manual <> 'Inactive' THEN 'OutOfStock'
  WHEN ns > 0 AND os = 0 AND manual = 'OutOfStock' THEN 'Active' ELSE manual END new_status
FROM (SELECT *, CASE WHEN action = 'increase' AND st = 'OutOfStock' THEN 'Active'
  WHEN action = 'decrease' AND ns <= 0 AND st = 'Active' THEN 'OutOfStock' ELSE st END manual
 FROM (SELECT s.change_id, s.product_id, s.action, p.stock os, p.status st,
  CASE WHEN s.action = 'increase' THEN p.stock + s.amount ELSE greatest(0, p.stock - s.amount) END ns
  FROM shop_stock_change s JOIN shop_product p ON p.product_id = s.product_id) a) b""")
def q_stock_status_rule(shop):
    return X.stock_status_rule(shop.shop_product, shop.shop_stock_change)


_ONBOARD = """r0 AS (SELECT user_id, trim(business_name) business_name, trim(location) location, seq,
  coalesce(trim(business_name), '') <> '' AND coalesce(trim(location), '') <> '' ok FROM shop_onboard_request),
r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ok DESC, seq) rn FROM r0) x
 WHERE rn = 1),
o AS (SELECT r.user_id, r.business_name, r.location, CASE WHEN NOT r.ok THEN 'invalid'
  WHEN u.user_id IS NULL THEN 'unknown_user' WHEN v.vendor_id IS NOT NULL THEN 'exists' ELSE 'onboarded' END outcome
 FROM r LEFT JOIN shop_user u ON u.user_id = r.user_id LEFT JOIN shop_vendor v ON v.vendor_id = r.user_id)"""


def _onboard(shop):
    return X.vendor_onboard(shop.shop_vendor, shop.shop_user, shop.shop_onboard_request, ["seq"])


@register("vendor_onboard", f"""
WITH {_ONBOARD}
SELECT o.user_id, o.outcome, CASE WHEN o.outcome = 'onboarded' THEN u.role_bits | 2 ELSE u.role_bits END role_bits
FROM o LEFT JOIN shop_user u ON u.user_id = o.user_id""")
def q_vendor_onboard(shop):
    return _onboard(shop)[0]


@register("vendor_onboard_vendors", f"""
WITH {_ONBOARD}
SELECT vendor_id, store_name, location, status, CAST(rating AS DOUBLE) rating FROM shop_vendor
UNION ALL SELECT user_id, business_name, location, 'Active', 0.0 FROM o WHERE outcome = 'onboarded'""")
def q_vendor_onboard_vendors(shop):
    return _onboard(shop)[1].select("vendor_id", "store_name", "location", "status", money("rating").alias("rating"))


@register("vendor_onboard_users", f"""
WITH {_ONBOARD}
SELECT u.user_id, u.username, CASE WHEN o.outcome = 'onboarded' THEN u.role_bits | 2 ELSE u.role_bits END role_bits
FROM shop_user u LEFT JOIN o ON o.user_id = u.user_id""")
def q_vendor_onboard_users(shop):
    return _onboard(shop)[2].select("user_id", "username", "role_bits")


@register("vendor_update", """
WITH u AS (SELECT vendor_id, CASE WHEN trim(store_name) <> '' THEN store_name END store_name,
  CASE WHEN trim(location) <> '' THEN location END location, seq FROM shop_vendor_update),
l AS (SELECT vendor_id, arg_max(store_name, seq) FILTER (WHERE store_name IS NOT NULL) n,
  arg_max(location, seq) FILTER (WHERE location IS NOT NULL) l FROM u GROUP BY 1),
n AS (SELECT v.vendor_id, coalesce(l.n, v.store_name) store_name, coalesce(l.l, v.location) location
 FROM shop_vendor v LEFT JOIN l ON l.vendor_id = v.vendor_id)
SELECT u.vendor_id, CASE WHEN n.vendor_id IS NULL THEN 'not_found'
  WHEN u.store_name IS NULL AND u.location IS NULL THEN 'no_change' ELSE 'updated' END outcome,
 n.store_name, n.location
FROM u LEFT JOIN n ON n.vendor_id = u.vendor_id""")
def q_vendor_update(shop):
    return X.vendor_update(shop.shop_vendor, shop.shop_vendor_update, ["seq"])


@register("vendor_update_next", """
WITH u AS (SELECT vendor_id, seq, CASE WHEN trim(store_name) <> '' THEN store_name END store_name,
  CASE WHEN trim(location) <> '' THEN location END location, CASE WHEN status IN ('Active', 'Inactive') THEN status END status,
  CASE WHEN rating BETWEEN 0 AND 5 THEN rating END rating FROM shop_vendor_patch),
l AS (SELECT vendor_id, arg_max(store_name, seq) FILTER (WHERE store_name IS NOT NULL) n,
  arg_max(location, seq) FILTER (WHERE location IS NOT NULL) l, arg_max(status, seq) FILTER (WHERE status IS NOT NULL) s,
  arg_max(rating, seq) FILTER (WHERE rating IS NOT NULL) r FROM u GROUP BY 1)
SELECT v.vendor_id, coalesce(l.n, v.store_name) store_name, coalesce(l.l, v.location) location,
 coalesce(l.s, v.status) status, CAST(coalesce(l.r, v.rating) AS DOUBLE) rating, v.created_seq
FROM shop_vendor v LEFT JOIN l ON l.vendor_id = v.vendor_id""")
def q_vendor_update_next(shop):
    return X.next_vendors(shop.shop_vendor, shop.shop_vendor_patch, ["seq"]).withColumn("rating", F.col("rating").cast("double"))


@register("vendor_status_change", """
WITH r AS (SELECT * FROM shop_vendor_status_request WHERE action IN ('activate', 'deactivate', 'toggle')),
s AS (SELECT vendor_id, action, seq FROM (SELECT *, row_number() OVER (PARTITION BY vendor_id ORDER BY seq DESC) rn
 FROM r WHERE action <> 'toggle') x WHERE rn = 1),
f AS (SELECT r.vendor_id, count(*) flips FROM r LEFT JOIN s ON s.vendor_id = r.vendor_id
 WHERE r.action = 'toggle' AND (s.seq IS NULL OR r.seq > s.seq) GROUP BY 1),
b AS (SELECT v.vendor_id, v.location, CASE WHEN s.action = 'activate' THEN 'Active'
  WHEN s.action = 'deactivate' THEN 'Inactive' ELSE v.status END base, coalesce(f.flips, 0) flips
 FROM shop_vendor v LEFT JOIN s ON s.vendor_id = v.vendor_id LEFT JOIN f ON f.vendor_id = v.vendor_id),
c AS (SELECT vendor_id, location, CASE WHEN flips % 2 = 1 THEN CASE WHEN base = 'Active' THEN 'Inactive' ELSE 'Active' END
  ELSE base END status FROM b)
SELECT vendor_id, CASE WHEN contains(lower(location), 'nation_2') AND status = 'Active' THEN 'Inactive'
 ELSE status END status FROM c""")
def q_vendor_status_change(shop):
    return (X.vendor_status_change(shop.shop_vendor, shop.shop_vendor_status_request, [("NATION_2", "deactivate")])
            .select("vendor_id", "status"))


@register("vendor_delete", """
SELECT r.vendor_id, CASE WHEN v.vendor_id IS NULL THEN 'not_found'
 WHEN r.vendor_id IN (SELECT vendor_id FROM shop_product) OR r.vendor_id IN (SELECT merchant_id FROM shop_sub_orders)
 THEN 'blocked' ELSE 'deleted' END outcome
FROM (SELECT DISTINCT user_id vendor_id FROM shop_user) r LEFT JOIN shop_vendor v ON v.vendor_id = r.vendor_id""")
def q_vendor_delete(shop):
    req = shop.shop_user.select(F.col("user_id").alias("vendor_id"))
    return X.vendor_delete(shop.shop_vendor, shop.shop_product, shop.lazy.shop_sub_orders, req)


@register("vendor_delete_vendors", """
SELECT vendor_id, store_name, location, status FROM shop_vendor v
WHERE vendor_id NOT IN (SELECT user_id FROM shop_user) OR EXISTS (SELECT 1 FROM shop_product p WHERE p.vendor_id = v.vendor_id)
 OR EXISTS (SELECT 1 FROM shop_sub_orders s WHERE s.merchant_id = v.vendor_id)""")
def q_vendor_delete_vendors(shop):
    return (X.vendors_after_delete(shop.shop_vendor, q_vendor_delete(shop))
            .select("vendor_id", "store_name", "location", "status"))


_CASCADE = """d_o AS (SELECT concat('o', CAST(o_orderkey AS VARCHAR)) order_id FROM orders WHERE o_orderpriority = '5-LOW'),
o AS (SELECT * FROM shop_orders WHERE order_id NOT IN (SELECT order_id FROM d_o)),
so AS (SELECT * FROM shop_sub_orders WHERE order_id NOT IN (SELECT order_id FROM d_o)),
it AS (SELECT * FROM shop_order_items WHERE sub_order_id IN (SELECT sub_order_id FROM so)),
dp AS (SELECT product_id FROM shop_product WHERE stock = 49),
gone AS (SELECT product_id FROM dp WHERE product_id NOT IN (SELECT product_id FROM it)),
dt AS (SELECT tag_id FROM shop_tag WHERE name LIKE 'Brand#2%')"""


@register("cascade_delete", f"""
WITH {_CASCADE}
SELECT 'orders' table_name, count(*) n_rows FROM o
UNION ALL SELECT 'sub_orders', count(*) FROM so
UNION ALL SELECT 'order_items', count(*) FROM it
UNION ALL SELECT 'product', count(*) FROM shop_product WHERE product_id NOT IN (SELECT product_id FROM gone)
UNION ALL SELECT 'tag', count(*) FROM shop_tag WHERE tag_id NOT IN (SELECT tag_id FROM dt)
UNION ALL SELECT 'tagging', count(*) FROM shop_tagging WHERE product_id NOT IN (SELECT product_id FROM gone)
 AND tag_id NOT IN (SELECT tag_id FROM dt)
UNION ALL SELECT 'product_blocked', count(*) FROM dp WHERE product_id IN (SELECT product_id FROM it)""")
def q_cascade_delete(shop):
    parts = [df.agg(F.count("*").alias("n_rows")).select(F.lit(k).alias("table_name"), "n_rows")
             for k, df in _cascade(shop).items()]
    res = parts[0]
    for p in parts[1:]:
        res = res.unionByName(p)
    return res


def _cascade(shop):
    d_o = shop.orders.filter(F.col("o_orderpriority") == "5-LOW").select(
        F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("order_id"))
    return X.cascade_delete(shop.shop_orders, shop.shop_sub_orders, shop.shop_order_items, shop.shop_product,
                           shop.shop_tag, shop.shop_tagging, del_orders=d_o,
                            del_products=shop.shop_product.filter(F.col("stock") == 49),
                            del_tags=shop.shop_tag.filter(F.col("name").startswith("Brand#2")))


@register("cascade_orders", f"WITH {_CASCADE} SELECT order_id, customer_id, status FROM o")
def q_cascade_orders(shop):
    return _cascade(shop)["orders"].select("order_id", "customer_id", "status")


@register("cascade_sub_orders", f"WITH {_CASCADE} SELECT sub_order_id, order_id, merchant_id FROM so")
def q_cascade_sub_orders(shop):
    return _cascade(shop)["sub_orders"].select("sub_order_id", "order_id", "merchant_id")


@register("cascade_order_items", f"WITH {_CASCADE} SELECT order_item_id, sub_order_id, product_id FROM it")
def q_cascade_order_items(shop):
    return _cascade(shop)["order_items"].select("order_item_id", "sub_order_id", "product_id")


@register("cascade_product", f"""
WITH {_CASCADE}
SELECT product_id, name FROM shop_product WHERE product_id NOT IN (SELECT product_id FROM gone)""")
def q_cascade_product(shop):
    return _cascade(shop)["product"].select("product_id", "name")


@register("cascade_tagging", f"""
WITH {_CASCADE}
SELECT product_id, tag_id, position FROM shop_tagging WHERE product_id NOT IN (SELECT product_id FROM gone)
 AND tag_id NOT IN (SELECT tag_id FROM dt)""")
def q_cascade_tagging(shop):
    return _cascade(shop)["tagging"].select("product_id", "tag_id", "position")


@register("cascade_tag", f"WITH {_CASCADE} SELECT tag_id, name FROM shop_tag WHERE tag_id NOT IN (SELECT tag_id FROM dt)")
def q_cascade_tag(shop):
    return _cascade(shop)["tag"].select("tag_id", "name")


@register("cascade_product_blocked", f"WITH {_CASCADE} SELECT product_id FROM dp WHERE product_id IN (SELECT product_id FROM it)")
def q_cascade_product_blocked(shop):
    return _cascade(shop)["product_blocked"].select("product_id")


@register("customer_profile", """
SELECT c.user_id, coalesce(u.nick_name, c.nick_name) nick_name, coalesce(u.address, c.address) address,
 coalesce(u.phone_number, c.phone_number) phone_number
FROM shop_customer_profile c LEFT JOIN (SELECT user_id, arg_max(nick_name, seq) FILTER (WHERE nick_name IS NOT NULL) nick_name,
 arg_max(address, seq) FILTER (WHERE address IS NOT NULL) address,
 arg_max(phone_number, seq) FILTER (WHERE phone_number IS NOT NULL) phone_number FROM shop_profile_update GROUP BY 1) u ON u.user_id = c.user_id""")
def q_customer_profile(shop):
    return X.customer_profile_update(shop.shop_customer_profile, shop.shop_profile_update, ["seq"])
