"""Shop-shaped views over the driver's parquet tables.

Each view is ONE SQL text shared by Spark and the DuckDB oracle.  Relations a
view reads are written ``{name}``: Spark binds them to DataFrames through
``spark.sql(text, name=df)``, the oracle renders them as plain names inside a
``WITH`` list.  (One view, ``shop_sub_orders``, has a DataFrame form for Spark
with the same rows and a cheaper plan: ``tables.SPARK_FORMS``.)
``created_seq`` stands in for Created_At so "newest first" is deterministic.

Fixed values: the view texts under FIXTURE_VIEWS are the test-fixture
definitions and must stay as written so both engines see the same rows.
"""

from __future__ import annotations

import re

RAW_TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
)

# ---- fixed values: fixture view definitions -------------------------------
FIXTURE_VIEWS: dict[str, str] = {
    "shop_vendor": """
SELECT concat('s',CAST(s_suppkey AS STRING)) vendor_id, s_name store_name, n_name location,
 CASE WHEN s_acctbal < 0 THEN 'Inactive' ELSE 'Active' END status,
 CAST((s_suppkey % 51) / 10.0 AS DECIMAL(3,2)) rating, s_suppkey created_seq
FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey""",
    "shop_product": """
SELECT concat('p',CAST(p_partkey AS STRING)) product_id, p_name name,
 CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE concat(p_type,' ',p_name) END description,
 CAST(p_retailprice AS DECIMAL(10,2)) price, p_size - 1 stock, p_type category,
 concat('img/',CAST(p_partkey AS STRING)) image_url,
 concat('s',CAST(p_partkey % (SELECT count(*) FROM {supplier}) AS STRING)) vendor_id,
 CASE WHEN p_partkey % 11 = 0 THEN 'Inactive' WHEN p_size = 1 THEN 'OutOfStock' ELSE 'Active' END status,
 CASE WHEN p_partkey % 9 = 0 THEN NULL ELSE CAST((p_partkey % 51) / 10.0 AS DECIMAL(3,2)) END rating,
 p_partkey created_seq
FROM {part}""",
    "shop_category": """
SELECT DISTINCT p_type name FROM {part}""",
    "shop_tag_raw": """
SELECT concat('p',CAST(p_partkey AS STRING)) product_id, split_part(p_name,' ',1) name, 1 position FROM {part} WHERE p_partkey % 13 <> 0
UNION ALL SELECT concat('p',CAST(p_partkey AS STRING)), split_part(p_name,' ',2), 2 FROM {part} WHERE p_partkey % 13 <> 0
UNION ALL SELECT concat('p',CAST(p_partkey AS STRING)), p_brand, 3 FROM {part} WHERE p_partkey % 13 <> 0 AND p_size % 3 = 0""",
    "shop_tag": """
SELECT CAST(row_number() OVER (ORDER BY name) AS INT) tag_id, name FROM (SELECT DISTINCT name FROM {shop_tag_raw}) d""",
    "shop_tagging": """
SELECT r.product_id, t.tag_id, r.position FROM {shop_tag_raw} r JOIN {shop_tag} t ON t.name = r.name""",
    "shop_tag_text": """
SELECT concat('p',CAST(p_partkey AS STRING)) product_id,
 concat(' ',split_part(p_name,' ',1),', ',split_part(p_name,' ',2),',, ',p_brand,' ,extra') tags_text FROM {part}""",
    "shop_user": """
SELECT concat('c',CAST(c_custkey AS STRING)) user_id, c_name username, 1 role_bits FROM {customer}
UNION ALL SELECT concat('s',CAST(s_suppkey AS STRING)), s_name, CASE WHEN s_suppkey % 5 = 0 THEN 3 ELSE 2 END FROM {supplier}
UNION ALL SELECT 'u1','admin',4""",
    "shop_rating": """
SELECT event_id id, concat('c',CAST(user_id AS STRING)) customer_id,
 concat('s',CAST(event_id % (SELECT count(*) FROM {supplier}) AS STRING)) vendor_id,
 CAST(1 + CAST(floor(value) AS BIGINT) % 5 AS INT) score, ts created_at
FROM {events} WHERE event_type = 'purchase' AND event_id % 4 <> 0""",
    "shop_rating_request": """
SELECT event_id id, concat('c',CAST(user_id AS STRING)) customer_id,
 concat('s',CAST(event_id % (SELECT count(*) FROM {supplier}) AS STRING)) vendor_id,
 CASE WHEN event_id % 10 = 0 THEN 'abc' ELSE CAST(CAST(floor(value) AS BIGINT) % 8 AS STRING) END score_text, ts created_at
FROM {events} WHERE event_type = 'signup'""",
    "shop_stock_change": """
SELECT event_id change_id, concat('p',CAST(event_id % 97 AS STRING)) product_id,
 CASE WHEN event_type='view' THEN 'increase' ELSE 'decrease' END action,
 CAST(1 + CAST(floor(value) AS BIGINT) % 20 AS INT) amount, ts
FROM {events} WHERE event_type IN ('view','click')""",
    "shop_cart_line": """
SELECT l_orderkey cart_id, l_linenumber line_no, concat('p',CAST(l_partkey AS STRING)) product_id,
 CAST(l_quantity AS INT) quantity, l_linestatus, l_returnflag FROM {lineitem}""",
    "shop_orders": """
SELECT concat('o',CAST(o_orderkey AS STRING)) order_id, concat('c',CAST(o_custkey AS STRING)) customer_id, o_orderdate order_date,
 CASE o_orderstatus WHEN 'P' THEN 'pending' WHEN 'O' THEN 'shipped' ELSE 'cancelled' END status FROM {orders}""",
    "shop_order_items": """
SELECT concat('i',CAST(cart_id AS STRING),'-',CAST(line_no AS STRING),'-',c.product_id,'-',CAST(c.quantity AS STRING)) order_item_id,
 concat('o',CAST(cart_id AS STRING)) order_id, concat('o',CAST(cart_id AS STRING),'-',p.vendor_id) sub_order_id, p.vendor_id merchant_id,
 c.product_id, c.quantity, p.price price_per_unit, CAST(c.quantity * p.price AS DECIMAL(10,2)) total_price,
 CASE WHEN l_returnflag='R' THEN 'removed' ELSE 'active' END item_status, l_linestatus
FROM {shop_cart_line} c JOIN {shop_product} p ON p.product_id = c.product_id""",
    "shop_sub_orders": """
SELECT i.sub_order_id, i.order_id, i.merchant_id, SUM(CASE WHEN item_status='active' THEN total_price ELSE 0 END) sub_total_amount,
 CASE WHEN SUM(CASE WHEN item_status='active' THEN 1 ELSE 0 END)=0 THEN 'cancelled' ELSE MAX(o.status) END status,
 CASE WHEN MAX(CASE WHEN l_linestatus='F' THEN 1 ELSE 0 END)=1 THEN 'shipped' ELSE 'pending' END shipping_status, MAX(o.order_date) created_at
FROM {shop_order_items} i JOIN {shop_orders} o ON o.order_id=i.order_id GROUP BY 1,2,3""",
}
# ---- end of fixed values ---------------------------------------------------

# Views of this project: more shop state and the change/request tables the
# batch operators consume.  All derive from the given tables, so they grow
# with them.  Requests pick rows by a natural attribute, never by id ranges.
DERIVED_VIEWS: dict[str, str] = {
    # Order header with the stored total (= sum of its sub-order totals).
    "shop_order_state": """
SELECT o.order_id, o.customer_id, o.order_date, o.status,
 CAST(coalesce(s.total_amount, 0) AS DECIMAL(12,2)) total_amount, 'unpaid' payment_status
FROM {shop_orders} o LEFT JOIN (SELECT order_id, SUM(sub_total_amount) total_amount FROM {shop_sub_orders} GROUP BY order_id) s
 ON s.order_id = o.order_id""",
    # Customer profile rows (phone lives on the user account).
    "shop_customer_profile": """
SELECT concat('c',CAST(c_custkey AS STRING)) user_id, c_name nick_name, n_name address,
 concat('+', CAST(c_nationkey AS STRING), '-', CAST(c_custkey AS STRING)) phone_number, c_mktsegment segment
FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey""",
    # Admin accounts.
    "shop_admin": """
SELECT user_id admin_id, username display_name FROM {shop_user} WHERE role_bits >= 4""",
    # Customer.Order_History: one JSON text per customer, 'history' (no JSON) where nothing was ordered.
    "shop_customer_history": """
SELECT u.user_id, coalesce(h.order_history, 'history') order_history
FROM {shop_customer_profile} u LEFT JOIN (
 SELECT customer_id, concat('[', string_agg(concat('{{"Order_ID":"', order_id, '","Status":"', status, '","Order_Date":"',
  strftime(order_date, '%Y-%m-%d'), '"}}'), ',' ORDER BY order_id), ']') order_history
 FROM {shop_orders} GROUP BY customer_id) h ON h.customer_id = u.user_id""",
    # Customers cancel urgent orders of theirs in that text; others ask for orders that are not theirs.
    "shop_history_cancel": """
SELECT concat('c',CAST(o_custkey AS STRING)) customer_id, concat('o',CAST(o_orderkey AS STRING)) order_id
FROM {orders} WHERE o_orderpriority = '1-URGENT'
UNION ALL SELECT concat('c',CAST(o_custkey + 1 AS STRING)), concat('o',CAST(o_orderkey AS STRING))
FROM {orders} WHERE o_orderpriority = '4-NOT SPECIFIED'""",
    # Who checks a cart out, when, and where it ships to.
    "shop_cart_header": """
SELECT o_orderkey cart_id, concat('c',CAST(o_custkey AS STRING)) customer_id, o_orderdate order_date, u.address shipping_address
FROM {orders} LEFT JOIN {shop_customer_profile} u ON u.user_id = concat('c',CAST(o_custkey AS STRING))""",
    # Open carts: a user's purchase events name lines put in long ago (so some exceed today's stock).
    "shop_cart_start": """
SELECT concat('c',CAST(user_id AS STRING)) cart_id,
 concat('p',CAST((user_id * 3 + event_id % 3) % (SELECT count(*) FROM {part}) AS STRING)) product_id,
 CAST(max(1 + CAST(floor(value) AS BIGINT) % 60) AS INT) quantity
FROM {events} WHERE event_type = 'purchase' GROUP BY 1, 2""",
    # What users then do to their carts; some adds are negative or zero.
    "shop_cart_event": """
SELECT event_id, ts, concat('c',CAST(user_id AS STRING)) cart_id,
 concat('p',CAST((user_id * 3 + event_id % 3) % (SELECT count(*) FROM {part}) AS STRING)) product_id,
 CASE WHEN event_type = 'view' THEN 'add' WHEN event_type = 'error' THEN 'decrease'
  WHEN event_type = 'signup' AND value < 10 THEN 'remove' ELSE 'increase' END action,
 CASE WHEN event_type = 'view' THEN CAST(CAST(floor(value) AS BIGINT) % 9 - 2 AS INT) END quantity
FROM {events} WHERE event_type IN ('view', 'click', 'error', 'signup')""",
    # Orders of the newest day are called back.
    "shop_recall_request": """
SELECT concat('o',CAST(o_orderkey AS STRING)) order_id FROM {orders}
WHERE o_orderdate = (SELECT max(o_orderdate) FROM {orders})""",
    # Urgent orders ask to be cancelled.
    "shop_cancel_request": """
SELECT concat('o',CAST(o_orderkey AS STRING)) order_id FROM {orders} WHERE o_orderpriority = '1-URGENT'""",
    # Lines bought at the top discount are taken back out of their order.
    "shop_item_removal": """
SELECT concat('i',CAST(l_orderkey AS STRING),'-',CAST(l_linenumber AS STRING),'-p',CAST(l_partkey AS STRING),'-',
 CAST(CAST(l_quantity AS INT) AS STRING)) order_item_id
FROM {lineitem} WHERE l_discount >= 0.095""",
    # Shipping updates per sub-order, one per line, in ship-date order;
    # returned lines carry an invalid value that must be rejected.
    "shop_shipping_update": """
SELECT concat('o',CAST(l_orderkey AS STRING),'-',p.vendor_id) sub_order_id,
 CASE l_returnflag WHEN 'A' THEN 'delivered' WHEN 'N' THEN 'shipped' ELSE 'returned' END value,
 l_shipdate ts, l_linenumber seq1, l_partkey seq2, CAST(l_quantity AS INT) seq3
FROM {lineitem} JOIN {shop_product} p ON p.product_id = concat('p',CAST(l_partkey AS STRING))""",
    # Sub-order changes, one per order line: the return flag picks the field.
    "shop_sub_order_change": """
SELECT concat('o',CAST(l_orderkey AS STRING),'-',p.vendor_id) sub_order_id,
 CASE WHEN l_returnflag = 'N' THEN 'status' ELSE 'shipping_status' END field,
 CASE WHEN l_linestatus = 'F' THEN 'delivered' ELSE 'shipped' END value,
 l_shipdate ts, l_linenumber seq1, l_partkey seq2, CAST(l_quantity AS INT) seq3
FROM {lineitem} JOIN {shop_product} p ON p.product_id = concat('p',CAST(l_partkey AS STRING))""",
    # Order/payment status changes, one per order line in ship-date order:
    # the return flag picks the field, the line status the value.
    "shop_order_change": """
SELECT concat('o',CAST(l_orderkey AS STRING)) order_id,
 CASE WHEN l_returnflag = 'N' THEN 'payment_status' ELSE 'status' END field,
 CASE WHEN l_returnflag = 'N' THEN CASE WHEN l_linestatus = 'F' THEN 'paid' ELSE 'refunded' END
  WHEN l_returnflag = 'R' THEN 'cancelled'
  ELSE CASE WHEN l_linestatus = 'F' THEN 'completed' ELSE 'shipped' END END value,
 l_shipdate ts, l_linenumber seq1, l_partkey seq2, CAST(l_quantity AS INT) seq3
FROM {lineitem}""",
    # Order page views: owners, the admin, shipping vendors, other suppliers
    # (customer key read as supplier key), other customers, unknown orders.
    "shop_view_request": """
SELECT customer_id viewer_id, 'customer' login_type, order_id FROM {shop_orders}
UNION ALL SELECT 'u1', 'backend', concat('o',CAST(o_orderkey AS STRING)) FROM {orders} WHERE o_orderpriority = '2-HIGH'
UNION ALL SELECT merchant_id, 'backend', order_id FROM {shop_sub_orders} WHERE shipping_status = 'shipped'
UNION ALL SELECT concat('s',CAST(o_custkey AS STRING)), 'backend', concat('o',CAST(o_orderkey AS STRING)) FROM {orders} WHERE o_orderpriority = '3-MEDIUM'
UNION ALL SELECT concat('c',CAST(o_custkey + 1 AS STRING)), 'customer', concat('o',CAST(o_orderkey AS STRING)) FROM {orders} WHERE o_orderpriority = '4-NOT SPECIFIED'
UNION ALL SELECT customer_id, 'customer', concat(order_id,'x') FROM {shop_orders} WHERE status = 'cancelled'""",
    # Products toggled on error events, over all products.
    "shop_toggle_request": """
SELECT event_id request_id, concat('p',CAST(event_id % (SELECT count(*) FROM {part}) AS STRING)) product_id, ts
FROM {events} WHERE event_type = 'error'""",
    # Claims "supplier owns part" taken from each order line.
    "shop_ownership_claim": """
SELECT concat('p',CAST(l_partkey AS STRING)) product_id, concat('s',CAST(l_suppkey AS STRING)) vendor_id
FROM {lineitem}""",
    # Onboarding requests: building-segment customers (some after a blank
    # request, some asking again) and rich suppliers.
    "shop_onboard_request": """
SELECT concat('c',CAST(c_custkey AS STRING)) user_id, concat(c_name,' Shop') business_name, n_name location, 2 seq
FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey WHERE c_mktsegment = 'BUILDING'
UNION ALL
SELECT concat('c',CAST(c_custkey AS STRING)), '  ', 'nowhere', 1 FROM {customer} WHERE c_mktsegment = 'BUILDING' AND c_acctbal < 2000
UNION ALL
SELECT concat('c',CAST(c_custkey AS STRING)), '!Late', 'A', 3 FROM {customer} WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 1000
UNION ALL
SELECT concat('c',CAST(c_custkey AS STRING)), NULL, 'A', 1 FROM {customer} WHERE c_mktsegment = 'MACHINERY'
UNION ALL
SELECT concat('s',CAST(s_suppkey AS STRING)), s_name, n_name, 1
FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey WHERE s_acctbal > 9000""",
    # Vendor edits: low-balance suppliers rename, negative-balance ones move,
    # some rename once more; machinery customers (not vendors) try too.
    "shop_vendor_update": """
SELECT concat('s',CAST(s_suppkey AS STRING)) vendor_id,
 CASE WHEN s_acctbal < 2000 THEN concat(s_name,' Outlet') END store_name,
 CASE WHEN s_acctbal < 0 THEN r_name END location, 1 seq
FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey
WHERE s_acctbal < 4000
UNION ALL
SELECT concat('s',CAST(s_suppkey AS STRING)), concat('A ',s_name), NULL, 2 FROM {supplier} WHERE s_acctbal < 1000
UNION ALL
SELECT concat('c',CAST(c_custkey AS STRING)), c_name, NULL, 1 FROM {customer} WHERE c_mktsegment = 'MACHINERY'""",
    # Admin status actions by id: action from the balance band.
    # The same with states and ratings, some of them not allowed.
    "shop_vendor_patch": """
SELECT vendor_id, store_name, location, CAST(NULL AS STRING) status, CAST(NULL AS DECIMAL(3,2)) rating, seq FROM {shop_vendor_update}
UNION ALL SELECT vendor_id, CAST(NULL AS STRING), CAST(NULL AS STRING),
 CASE WHEN rating < 1 THEN 'Inactive' WHEN rating < 2 THEN 'Closed' END, CAST(7 - rating AS DECIMAL(3,2)), 3
FROM {shop_vendor} WHERE rating < 3""",
    "shop_vendor_status_request": """
SELECT concat('s',CAST(s_suppkey AS STRING)) vendor_id,
 CASE WHEN s_acctbal < -500 THEN 'activate' WHEN s_acctbal < 3000 THEN 'deactivate' ELSE 'toggle' END action,
 s_suppkey seq
FROM {supplier} WHERE s_acctbal < 6000""",
    # Role grants: onboarding customers get the vendor bit, rich customers admin.
    "shop_role_grant": """
SELECT concat('c',CAST(c_custkey AS STRING)) user_id, 2 bits FROM {customer} WHERE c_mktsegment = 'BUILDING'
UNION ALL SELECT concat('c',CAST(c_custkey AS STRING)), 4 FROM {customer} WHERE c_acctbal > 9000
UNION ALL SELECT concat('c',CAST(c_custkey AS STRING)), 1 FROM {customer} WHERE c_acctbal > 9000""",
    # Profile edits by machinery customers: new nickname, address unchanged; rich ones edit again.
    "shop_profile_update": """
SELECT concat('c',CAST(c_custkey AS STRING)) user_id, upper(c_name) nick_name, CAST(NULL AS STRING) address,
 CASE WHEN c_acctbal < 0 THEN concat('+0-', CAST(c_custkey AS STRING)) END phone_number, 1 seq
FROM {customer} WHERE c_mktsegment = 'MACHINERY'
UNION ALL
SELECT concat('c',CAST(c_custkey AS STRING)), concat('!',c_name), 'moved', NULL, 2
FROM {customer} WHERE c_mktsegment = 'MACHINERY' AND c_acctbal > 3000""",
    # New listings: big parts re-offered under doubled ids (some collide).
    "shop_new_product": """
SELECT concat('p',CAST(p_partkey * 2 AS STRING)) product_id, upper(p_name) name, p_type description,
 CAST(p_retailprice AS DECIMAL(10,2)) price, p_size stock, p_type category,
 concat('img/new/',CAST(p_partkey AS STRING)) image_url,
 concat('s',CAST(p_partkey % (SELECT count(*) FROM {supplier}) AS STRING)) vendor_id,
 concat(p_type, ', ', lower(split_part(p_name,' ',2)), ' , ', upper(p_type), ', ', p_brand) tags_text,
 p_partkey * 2 created_seq
FROM {part} WHERE p_size > 45""",
    # Product edits claimed by a vendor: owners of medium parts re-price and
    # re-tag; a second claim per part comes from the next vendor id; owners of
    # big parts then sell out.  Empty parts come in as OutOfStock with stock.
    "shop_product_update": """
SELECT concat('p',CAST(p_partkey AS STRING)) product_id,
 concat('s',CAST(p_partkey % (SELECT count(*) FROM {supplier}) AS STRING)) vendor_id,
 concat(p_name,' v2') name, CAST(NULL AS STRING) description, CAST(p_retailprice + 1 AS DECIMAL(10,2)) price,
 p_size + 5 stock, p_type category, concat('img/v2/',CAST(p_partkey AS STRING)) image_url,
 concat(p_brand, ',', split_part(p_name,' ',1)) tags_text,
 CASE WHEN p_size = 1 THEN 'OutOfStock' ELSE 'Active' END status, 1 seq
FROM {part} WHERE p_type = 'MEDIUM'
UNION ALL
SELECT concat('p',CAST(p_partkey AS STRING)),
 concat('s',CAST((p_partkey + 1) % (SELECT count(*) FROM {supplier}) AS STRING)),
 concat(p_name,' v3'), 'stolen', CAST(1 AS DECIMAL(10,2)), 0, p_type, NULL, 'spam', 'Inactive', 2
FROM {part} WHERE p_type = 'MEDIUM'
UNION ALL
SELECT concat('p',CAST(p_partkey AS STRING)), concat('s',CAST(p_partkey % (SELECT count(*) FROM {supplier}) AS STRING)),
 concat('A ',p_name), 'sold out', CAST(p_retailprice AS DECIMAL(10,2)), 0, p_type, NULL, p_brand, 'Active', 3
FROM {part} WHERE p_type = 'MEDIUM' AND p_size > 40""",
}

ALL_VIEWS: dict[str, str] = {**FIXTURE_VIEWS, **DERIVED_VIEWS}

_REF = re.compile(r"(?<!\{)\{(\w+)\}(?!\})")


def deps(name: str) -> list[str]:
    return sorted(set(_REF.findall(ALL_VIEWS[name])))


def plain_sql(name: str) -> str:
    """View text with its relations as plain names (oracle form)."""
    return _REF.sub(lambda m: m.group(1), ALL_VIEWS[name]).replace("{{", "{").replace("}}", "}")


def with_views(sql: str) -> str:
    """Prefix ``sql`` with the CTEs of every shop view it reads (transitively)."""
    order: list[str] = []

    def visit(n: str) -> None:
        if n in order:
            return
        for d in deps(n):
            if d in ALL_VIEWS:
                visit(d)
        order.append(n)

    for n in ALL_VIEWS:
        if re.search(r"\b%s\b" % n, sql):
            visit(n)
    if not order:
        return sql
    ctes = ",\n".join(f"{n} AS ({plain_sql(n).strip()})" for n in order)
    body = sql.strip()
    if re.match(r"(?is)^with\s+recursive\s", body):
        return f"WITH RECURSIVE {ctes},\n{body[4:].lstrip()[9:].lstrip()}"
    if re.match(r"(?is)^with\s", body):
        return f"WITH {ctes},\n{body[4:].lstrip()}"
    return f"WITH {ctes}\n{body}"
