"""Cart and order flow (D) on the seed: the reference's end-to-end scenario."""

import re
from collections import Counter

from pyspark.sql import functions as F
from seed import with_stock

from marketgrid.operators import orders as O


def _cart(spark, rows):
    return spark.createDataFrame(rows, "cart_id long, line_no int, product_id string, quantity int")


def _split(spark, seed):
    lines = _cart(spark, [(1, 1, "p1", 2), (1, 2, "p2", 1), (1, 3, "p3", 1)])
    return O.split_orders(lines, seed["product"], seed["vendor"])


def test_split_totals_and_properties(spark, seed):
    s = _split(spark, seed)
    o = s.orders.first()
    assert float(o.total_amount) == 14196.00
    subs = {r.merchant_id: r for r in s.sub_orders.collect()}
    assert len(subs) == 2  # one sub-order per vendor
    assert float(subs["u4"].sub_total_amount) == 13297.00 and subs["u4"].item_count == 2
    assert float(subs["u5"].sub_total_amount) == 899.00 and subs["u5"].item_count == 1
    # properties: sum(items) = sub_total, sum(sub_totals) = total
    per_sub = {r.sub_order_id: r.t for r in s.items.groupBy("sub_order_id").agg(F.sum("total_price").alias("t")).collect()}
    assert all(per_sub[r.sub_order_id] == r.sub_total_amount for r in s.sub_orders.collect())
    assert sum(r.sub_total_amount for r in s.sub_orders.collect()) == o.total_amount


def test_remove_then_cancel(spark, seed):
    s = _split(spark, seed)
    stock = O.checkout_stock(seed["product"], s.items)
    assert {r.product_id: r.stock_after for r in stock.collect()}["p1"] == 48
    product = with_stock(seed["product"], stock)
    orders = s.orders.withColumn("customer_id", F.lit("u2"))
    p1_item = s.items.filter(F.col("product_id") == "p1").select("order_item_id")
    st = O.remove_order_items(orders, s.sub_orders, s.items, product, p1_item)
    assert float(st.orders.first().total_amount) == 2198.00  # the total falls after a removal
    subs = {r.merchant_id: r for r in st.sub_orders.collect()}
    assert float(subs["u4"].sub_total_amount) == 1299.00 and subs["u4"].status == "pending"
    assert {r.product_id: r.stock for r in st.product.collect()}["p1"] == 50
    # removing the same item again is refused
    again = O.remove_order_items(st.orders, st.sub_orders, st.items, st.product, p1_item)
    assert again.outcomes.first().removed is False

    c = O.cancel_orders(st.orders, st.sub_orders, st.items, st.product, st.orders.select("order_id"))
    assert c.outcomes.first().outcome == "cancelled"
    assert c.orders.first().status == "cancelled"
    assert {r.status for r in c.sub_orders.collect()} == {"cancelled"}  # cancelled order -> cancelled sub-orders
    assert {r.item_status for r in c.items.collect()} == {"removed"}
    stock_now = {r.product_id: r.stock for r in c.product.collect()}
    assert stock_now["p2"] == 50 and stock_now["p3"] == 50 and stock_now["p1"] == 50  # back to before the order


def test_cancel_refused_when_shipped(spark, seed):
    s = _split(spark, seed)
    subs = s.sub_orders.withColumn("shipping_status", F.when(F.col("merchant_id") == "u5", "shipped")
                                   .otherwise(F.col("shipping_status")))
    c = O.cancel_orders(s.orders, subs, s.items, seed["product"], s.orders.select("order_id"))
    assert c.outcomes.first().outcome == "refused"
    assert c.orders.first().status == "pending"


def test_cancel_restores_each_product_once_per_unit(spark, seed):
    # Q2: two items of one product: restore the summed quantity
    lines = _cart(spark, [(7, 1, "p1", 2), (7, 2, "p1", 3)])
    s = O.split_orders(lines, seed["product"], seed["vendor"])
    c = O.cancel_orders(s.orders, s.sub_orders, s.items, seed["product"], s.orders.select("order_id"))
    assert {r.product_id: r.stock for r in c.product.collect()}["p1"] == 55
    assert c.outcomes.first().restored_units == 5


def test_removal_cascade_cancels_sub_order_and_order(spark, seed):
    s = _split(spark, seed)
    st = O.remove_order_items(s.orders, s.sub_orders, s.items, seed["product"], s.items.select("order_item_id"))
    assert {r.status for r in st.sub_orders.collect()} == {"cancelled"}
    assert st.orders.first().status == "cancelled" and float(st.orders.first().total_amount) == 0.0


def test_checkout_first_bad_line(spark, seed):
    product = seed["product"].withColumn("status", F.when(F.col("product_id") == "p3", "OutOfStock")
                                         .otherwise(F.col("status")))
    lines = _cart(spark, [(1, 1, "p1", 1), (1, 2, "p9", 1), (1, 3, "p3", 1),
                          (2, 1, "p1", 99), (2, 2, "p3", 1), (3, 1, "p2", 1)])
    v = {r.cart_id: (r.verdict, r.failed_line_no) for r in O.checkout_validation(lines, product, seed["vendor"]).collect()}
    assert v == {1: ("missing", 2), 2: ("insufficient_stock", 1), 3: ("ok", 0)}


def test_cart_merge_caps_at_stock(spark, seed):
    adds = _cart(spark, [(1, 1, "p7", 10), (1, 2, "p7", 10), (1, 3, "p2", 1), (1, 4, "p9", 5)])
    got = {r.product_id: r.quantity for r in O.cart_merge(adds, seed["product"], seed["vendor"]).collect()}
    assert got == {"p7": 12, "p2": 1}


def test_place_orders_takes_accepted_carts_only(spark, seed):
    product = seed["product"]
    lines = _cart(spark, [(1, 1, "p1", 1), (1, 2, "p3", 1), (2, 1, "p1", 10**6), (3, 1, "p2", 1), (4, 1, "p2", 1)])
    head = spark.createDataFrame(
        [(1, "u2", "2024-01-01", " Road 1 "), (2, "u2", "2024-01-01", "Road 1"), (3, "u2", "2024-01-01", " \t"),
         (4, "u2", "2024-01-01", None)], "cart_id long, customer_id string, order_date string, shipping_address string")
    s = O.place_orders(lines, head, product, seed["vendor"])
    assert [(r.order_id, r.customer_id, r.shipping_address) for r in s.orders.collect()] == [("o1", "u2", "Road 1")]
    assert {r.order_id for r in s.items.collect()} == {r.order_id for r in s.sub_orders.collect()} == {"o1"}


def test_remove_sub_order_products(spark, seed):
    items = _split(spark, seed).items
    gone = items.filter("product_id = 'p1'").select("sub_order_id", "product_id")
    pairs = gone.unionByName(gone).unionByName(
        spark.createDataFrame([("none", "p2"), (None, "p3")], "sub_order_id string, product_id string"))
    assert {r.product_id for r in O.remove_sub_order_products(items, pairs).collect()} == {"p2", "p3"}


def test_sub_order_fields_change_independently(spark, seed):
    subs = _split(spark, seed).sub_orders
    ids = sorted(r.sub_order_id for r in subs.collect())
    ch = spark.createDataFrame([(ids[0], "status", "shipped", 1), (ids[0], "status", "cancelled", 2),
                                (ids[1], "shipping_status", "delivered", 1)],
                               "sub_order_id string, field string, value string, seq int")
    got = {r.sub_order_id: (r.status, r.shipping_status) for r in O.apply_sub_order_changes(subs, ch, ["seq"]).collect()}
    assert got == {ids[0]: ("cancelled", "pending"), ids[1]: ("pending", "delivered")}


def test_order_visibility(spark, seed):
    s = _split(spark, seed)
    orders = s.orders.withColumn("customer_id", F.lit("u2"))
    req = spark.createDataFrame([("u1", "backend", "o1"), ("u4", "backend", "o1"), ("u2", "customer", "o1"),
                                 ("u3", "customer", "o1"), ("u2", "customer", "o9")],
                                "viewer_id string, login_type string, order_id string")
    users = seed["users"]
    rows = O.order_visibility(req, users, orders, s.sub_orders).collect()
    by = {}
    for r in rows:
        by.setdefault((r.viewer_id, r.order_id), set()).add((r.access, r.sub_order_id))
    assert by[("u1", "o1")] == {("admin", "o1-u4"), ("admin", "o1-u5")}
    assert by[("u4", "o1")] == {("vendor", "o1-u4")}
    assert by[("u2", "o1")] == {("customer", "o1-u4"), ("customer", "o1-u5")}
    assert by[("u3", "o1")] == {("denied", None)}
    assert by[("u2", "o9")] == {("not_found", None)}


def _visibility_rows(spark):
    """Repeated and null keys on every side; o3 has no sub-orders."""
    req = spark.createDataFrame(
        [("a", "backend", "o1"), ("v1", "backend", "o1"), ("v1", "customer", "o1"), ("v2", "backend", "o2"),
         ("v1", "backend", "o3"), ("c1", "customer", "o1"), ("c1", "customer", "o1"), ("c2", "customer", "o1"),
         ("c2", "customer", "o2"), ("nobody", "backend", "o1"), (None, "customer", "o1"), ("c1", None, "o2"),
         ("c1", "customer", None), ("v1", "backend", "o9")], "viewer_id string, login_type string, order_id string")
    users = spark.createDataFrame(
        [("a", 4), ("a", 2), ("v1", 2), ("v1", 2), ("v2", 3), ("c1", 1), ("c2", 1), ("c2", None), (None, 4), (None, 4)],
        "user_id string, role_bits int")
    orders = spark.createDataFrame([("o1", "c1"), ("o2", "c2"), ("o2", "c2"), ("o3", None), (None, "c1")],
                                   "order_id string, customer_id string")
    subs = spark.createDataFrame(
        [("o1", "o1-v1", "v1"), ("o1", "o1-v1", "v1"), ("o1", "o1-x", None), ("o1", None, "v3"), ("o2", "o2-v1", "v1"),
         (None, "none", "v1")], "order_id string, sub_order_id string, merchant_id string")
    return req, users, orders, subs


def test_order_visibility_keeps_repeats_and_nulls(spark):
    req, users, orders, subs = _visibility_rows(spark)
    got = Counter(tuple(r) for r in O.order_visibility(req, users, orders, subs).collect())
    whole = {"o1": ["o1-v1", "o1-v1", "o1-x", None], "o2": ["o2-v1"], "o3": []}
    own = {("v1", "o1"): ["o1-v1", "o1-v1"], ("v2", "o2"): [], ("v1", "o3"): [], ("a", "o1"): []}
    want = Counter()
    for q in req.collect():
        for bits in [u.role_bits or 0 for u in users.collect() if q.viewer_id and u.user_id == q.viewer_id] or [0]:
            found = [o for o in orders.collect() if q.order_id and o.order_id == q.order_id]
            for o in found or [None]:
                if o is None:
                    access, subs_of = "not_found", []
                elif bits & 4:
                    access, subs_of = "admin", whole[q.order_id]
                elif q.login_type == "backend" and bits & 2:
                    subs_of = own[(q.viewer_id, q.order_id)]
                    access = "denied" if not subs_of and whole[q.order_id] else "vendor"
                elif q.viewer_id is not None and o.customer_id == q.viewer_id:
                    access, subs_of = "customer", whole[q.order_id]
                else:
                    access, subs_of = "denied", []
                want.update((q.viewer_id, q.order_id, access, s) for s in subs_of or [None])
    assert got == want


def test_order_visibility_deals_requests_by_order_once(spark):
    """However large the tables, requests are planned once and each table is shuffled by order once."""
    req, users, orders, subs = _visibility_rows(spark)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = O.order_visibility(req, users, orders, subs)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    keys = re.findall(r"Exchange hashpartitioning\((\w+?)#", plan)
    assert sorted(keys) == ["_order", "order_id", "order_id", "order_id", "viewer_id", "viewer_id"], plan
    # the requests lie by order anyway: a broadcast of the orders would save nothing and grow with them
    few = spark.sql("SELECT concat('o', id) order_id, concat('c', id) customer_id FROM range(9)")
    plan = O.order_visibility(req, users, few, subs)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [order_id" in plan and "BroadcastHashJoin [order_id" not in plan


def test_history_json_bad_text_and_cancel(spark):
    hist = spark.createDataFrame(
        [("u2", "history"), ("u3", '[{"Order_ID": "o1", "Status": "pending", "Order_Date": "2024-01-01"},'
                                   ' {"Order_ID": "o2", "Status": "pending", "Order_Date": "2024-01-02"}]')],
        "user_id string, order_history string")
    req = spark.createDataFrame([("u3", "o2")], "customer_id string, order_id string")
    rows, text = O.cancel_in_history(hist, req)
    got = {(r.user_id, r.order_id): r.status for r in rows.collect()}
    assert got == {("u2", None): None, ("u3", "o1"): "pending", ("u3", "o2"): "Cancelled"}
    t = {r.user_id: r.order_history for r in text.collect()}
    assert t["u2"] == "[]" and '"Status":"Cancelled"' in t["u3"]


def test_latest_status_change_wins(spark):
    orders = spark.createDataFrame([("o1", "pending", "unpaid")], "order_id string, status string, payment_status string")
    ch = spark.createDataFrame([("o1", "status", "shipped", 2), ("o1", "status", "completed", 3),
                                ("o1", "payment_status", "paid", 1)],
                               "order_id string, field string, value string, seq int")
    r = O.apply_order_status(orders, ch, ["seq"]).first()
    assert (r.status, r.payment_status) == ("completed", "paid")


def test_apply_shipping_rejects_invalid(spark):
    subs = spark.createDataFrame([("s1", "o1", "u4", "pending", "pending")],
                                 "sub_order_id string, order_id string, merchant_id string, status string, shipping_status string")
    up = spark.createDataFrame([("s1", "shipped", 1), ("s1", "lost", 2)], "sub_order_id string, value string, seq int")
    nxt, rej = O.apply_shipping(subs, up, ["seq"])
    r = nxt.first()
    assert (r.status, r.shipping_status) == ("shipped", "shipped") and rej.count() == 1


def test_checkout_stock_has_no_floor(spark, seed):
    # Q5: the checkout decrement is not floored (the manual decrease is)
    lines = _cart(spark, [(1, 1, "p7", 15)])
    s = O.split_orders(lines, seed["product"], seed["vendor"])
    got = {r.product_id: r.stock_after for r in O.checkout_stock(seed["product"], s.items).collect()}
    assert got["p7"] == -3


def test_order_tree_equals_flat_joins(spark, seed):
    s = _split(spark, seed)
    orders = (s.orders.withColumn("customer_id", F.lit("u2"))
              .withColumn("order_date", F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")))
    tree = O.order_details(orders, s.sub_orders, s.items, seed["product"])
    row = tree.first()
    assert [so.merchant_id for so in row.sub_orders] == ["u4", "u5"]
    assert sorted(i.product_id for so in row.sub_orders for i in so.order_items) == ["p1", "p2", "p3"]
    flat_from_tree = O.flatten_order_details(tree)
    flat = O.order_details_flat(orders, s.sub_orders, s.items, seed["product"])
    assert flat_from_tree.exceptAll(flat).count() == 0 and flat.exceptAll(flat_from_tree).count() == 0


def test_history_fragments_parse_like_one_text(spark):
    import datetime as dt
    users = spark.createDataFrame([("u2",), ("u3",)], "user_id string")
    orders = spark.createDataFrame([("o1", "u3", dt.datetime(2024, 1, 1), "pending"),
                                    ("o2", "u3", dt.datetime(2024, 1, 2), "shipped")],
                                   "order_id string, customer_id string, order_date timestamp_ntz, status string")
    a = O.parse_history(O.order_history_text(users, orders))
    b = O.parse_history(O.order_history_fragments(users, orders))
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0 and a.count() == 3


def test_stored_history_is_edited_in_place(spark):
    odd = '[{"Order_ID":"o1","Status":"pending","Total":5.50,"Items":[1,{"a":null}]},{"Order_ID":7,"Note":"\u00e9\\"q","Status":"paid"}]'
    hist = spark.createDataFrame([("u1", odd), ("u2", "history"), ("u3", None), ("u4", "[]"), ("u5", '[ {"Order_ID" : "o9"} ]'),
                                  ("u6", '{"Order_ID":"o1"}')], "user_id string, order_history string")
    req = spark.createDataFrame([("u1", "7"), ("u1", "7"), ("u1", None), ("u2", "o1"), ("u5", "o1"), ("u6", "o1"), ("zz", "o1")],
                                "customer_id string, order_id string")
    got = {r.user_id: (r.order_history, r.cancelled) for r in O.cancel_in_stored_history(hist, req).collect()}
    import json
    edited, n = got.pop("u1")
    want = json.loads(odd)
    want[1]["Status"] = "Cancelled"
    assert json.loads(edited) == want and n == 1
    assert got == {r.user_id: (r.order_history, 0) for r in hist.collect() if r.user_id != "u1"}


def test_removal_counts_a_sub_order_over_all_its_rows(spark, seed):
    """Items of one sub-order may name several orders; a closed sub-order keeps its items."""
    items = spark.createDataFrame(
        [("i1", "s1", "o1", "p1", 2, "active"), ("i2", "s1", "o2", "p1", 1, "active"), ("i3", "s2", "o2", "p1", 4, "active"),
         ("i4", "s3", "o3", "p1", 1, "active"), ("i5", "s3", "o3", "p1", 1, "removed"), (None, "s2", None, "p1", 1, "active")],
        "order_item_id string, sub_order_id string, order_id string, product_id string, quantity int, item_status string") \
        .withColumn("total_price", F.col("quantity").cast("decimal(10,2)"))
    subs = spark.createDataFrame(
        [("s1", "o1", "pending", "pending"), ("s2", "o2", "pending", "pending"), ("s3", "o3", "pending", "shipped")],
        "sub_order_id string, order_id string, status string, shipping_status string") \
        .withColumn("sub_total_amount", F.lit(9).cast("decimal(22,2)"))
    orders = spark.createDataFrame([("o1", "pending"), ("o2", "pending"), ("o3", "pending")], "order_id string, status string") \
        .withColumn("total_amount", F.lit(9).cast("decimal(12,2)"))
    req = spark.createDataFrame([("i1",), ("i2",), ("i3",), ("i4",), ("i4",)], "order_item_id string")
    st = O.remove_order_items(orders, subs, items, seed["product"], req)
    assert {r.sub_order_id: (float(r.sub_total_amount), r.status) for r in st.sub_orders.collect()} == {
        "s1": (6.0, "cancelled"), "s2": (5.0, "pending"), "s3": (9.0, "pending")}
    assert {r.order_id: (float(r.total_amount), r.status) for r in st.orders.collect()} == {
        "o1": (7.0, "cancelled"), "o2": (4.0, "pending"), "o3": (9.0, "pending")}


def test_next_orders_do_not_derive_the_removals_again(spark, seed):
    s = _split(spark, seed)
    st = O.remove_order_items(s.orders, s.sub_orders, s.items.localCheckpoint(), seed["product"], s.items.select("order_item_id"))
    for frame in (st.orders, st.sub_orders):
        plan = frame._jdf.queryExecution().optimizedPlan().toString()
        assert "_asked" not in plan and "_left_semi" not in plan
