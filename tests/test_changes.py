"""Changes (F): the stock ledger against a step-by-step fold, tags, toggles, vendors."""

import datetime as dt
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from marketgrid.functions.scan import range_chunks
from marketgrid.operators import changes as X


def fold(stock, status, changes):
    """The reference's single-row UPDATEs applied one by one (Q3 decision: old stock)."""
    out = []
    for cid, action, amount in changes:
        old = stock
        if action == "increase":
            stock = old + amount
            manual = "Active" if status == "OutOfStock" else status
        else:
            stock = max(0, old - amount)
            manual = "OutOfStock" if (old - amount <= 0 and status == "Active") else status
        if stock == 0 and manual != "Inactive":
            status = "OutOfStock"
        elif stock > 0 and old == 0 and manual == "OutOfStock":
            status = "Active"
        else:
            status = manual
        out.append((cid, stock, status))
    return out


@pytest.mark.parametrize("chunk_rows", [3, 50, 1_000_000])
def test_ledger_equals_fold(spark, chunk_rows):
    rnd = random.Random(7)
    products, changes, expect = [], [], {}
    t0 = dt.datetime(2024, 1, 1)
    cid = 0
    for i in range(12):
        s0 = rnd.choice([0, 0, 3, 10, 40])
        st0 = rnd.choice(["Active", "Active", "OutOfStock", "Inactive"])
        pid = f"p{i}"
        products.append((pid, s0, st0))
        rows = []
        for _ in range(rnd.randint(0, 60)):
            cid += 1
            rows.append((cid, pid, rnd.choice(["increase", "decrease", "decrease"]), rnd.randint(0, 15),
                         t0 + dt.timedelta(minutes=rnd.randint(0, 60 * 24 * 5))))
        rows.sort(key=lambda r: (r[4], r[0]))
        changes += rows
        for c, stock, status in fold(s0, st0, [(r[0], r[2], r[3]) for r in rows]):
            expect[c] = (stock, status)
    product = spark.createDataFrame(products, "product_id string, stock int, status string")
    ch = spark.createDataFrame(changes, "change_id long, product_id string, action string, amount int, ts timestamp_ntz")
    got = {r.change_id: (r.stock_after, r.status_after) for r in X.stock_ledger(product, ch, rows=chunk_rows).collect()}
    assert got == expect
    final = {r.product_id: (r.stock, r.status) for r in X.stock_after_ledger(product, X.stock_ledger(product, ch, chunk_rows))
             .collect()}
    for pid, s0, st0 in products:
        rows = [c for c in changes if c[1] == pid]
        want = expect[max(rows, key=lambda r: (r[4], r[0]))[0]] if rows else (s0, st0)
        assert final[pid] == want


def test_ledger_rejects_negative_amounts(spark):
    product = spark.createDataFrame([("p1", 5, "Active")], "product_id string, stock int, status string")
    ch = spark.createDataFrame([(1, "p1", "decrease", -3, dt.datetime(2024, 1, 1)),
                                (2, "p1", "restock", 3, dt.datetime(2024, 1, 1))],
                               "change_id long, product_id string, action string, amount int, ts timestamp_ntz")
    assert X.stock_ledger(product, ch).count() == 0


def test_status_step_uses_old_stock(spark):
    # Q3: Active 50, decrease 30 -> stock 20 and still Active (not OutOfStock)
    product = spark.createDataFrame([("p1", 50, "Active")], "product_id string, stock int, status string")
    ch = spark.createDataFrame([(1, "p1", "decrease", 30)], "change_id long, product_id string, action string, amount int")
    r = X.stock_status_rule(product, ch).first()
    assert (r.new_stock, r.new_status) == (20, "Active")


def test_increase_by_five(spark):
    product = spark.createDataFrame([("p1", 50, "Active")], "product_id string, stock int, status string")
    ch = spark.createDataFrame([(1, "p1", "increase", 5, dt.datetime(2024, 1, 1))],
                               "change_id long, product_id string, action string, amount int, ts timestamp_ntz")
    assert X.stock_ledger(product, ch).first().stock_after == 55


def test_parse_tags_dedup_and_limit(spark):
    t = spark.createDataFrame([("p1", " Red, red ,, Blue,  ,Green, Extra"), ("p2", ""), ("p3", None)],
                              "product_id string, tags_text string")
    got = [(r.product_id, r.name, r.position) for r in X.parse_product_tags(t).orderBy("product_id", "position").collect()]
    assert got == [("p1", "Red", 1), ("p1", "Blue", 2), ("p1", "Green", 3)]


def test_upsert_tags_case_free(spark):
    tag = spark.createDataFrame([(1, "Red"), (5, "Blue")], "tag_id int, name string")
    names = spark.createDataFrame([("x", "red"), ("x", "Zed"), ("y", "ZED"), ("y", "amber")], "product_id string, name string")
    got = {r.tag_id: r.name for r in X.upsert_tags(tag, names).collect()}
    assert got == {1: "Red", 5: "Blue", 6: "amber", 7: "ZED"}


def test_toggle_parity(spark):
    p = spark.createDataFrame([("a", "Active"), ("b", "Inactive"), ("c", "OutOfStock"), ("d", "OutOfStock"),
                               ("e", "OutOfStock")], "product_id string, status string")
    t = spark.createDataFrame([("a",), ("b",), ("c",), ("d",), ("d",)], "product_id string")
    got = {r.product_id: r.status for r in X.toggle_products(p, t).collect()}
    assert got == {"a": "Inactive", "b": "Active", "c": "Active", "d": "Inactive", "e": "OutOfStock"}


def test_add_and_update_products(spark, seed):
    new = spark.createDataFrame(
        [("p9", "Test Product", "", Decimal("99.99"), 50, "Electronics", "img", "u4", "test,electronics", 9),
         ("p1", "Dup", "", Decimal("1.00"), 1, "Electronics", "img", "u4", "x", 10)],
        "product_id string, name string, description string, price decimal(10,2), stock int, category string, "
        "image_url string, vendor_id string, tags_text string, created_seq bigint")
    st = X.add_products(seed["product"], seed["tag"], seed["tagging"], new)
    assert {r.product_id: r.outcome for r in st.outcomes.collect()} == {"p9": "added", "p1": "rejected"}
    p9 = st.product.filter("product_id = 'p9'").first()
    assert p9.status == "Active" and float(p9.rating) == 0.0
    links = st.tagging.filter("product_id = 'p9'").join(st.tag, "tag_id").orderBy("position").collect()
    assert [(r.name, r.position) for r in links] == [("test", 1), ("electronics", 2)]

    upd = spark.createDataFrame(
        [("p3", "u4", "Headphones 2", "new", Decimal("1.00"), 7, "Audio", "i", "Inactive", "audio, gaming", 2),
         ("p3", "u4", "zzz first", "new", Decimal("1.00"), 7, "Audio", "i", "Active", "zzz", 1),
         ("p2", "u4", "Stolen", "x", Decimal("1.00"), 1, "X", "i", "Active", "x", 1)],
        "product_id string, vendor_id string, name string, description string, price decimal(10,2), stock int, "
        "category string, image_url string, status string, tags_text string, seq int")
    st2 = X.update_products(seed["product"], seed["tag"], seed["tagging"], upd, ["seq"])
    assert {r.product_id: r.outcome for r in st2.outcomes.collect()} == {"p3": "updated", "p2": "denied"}
    rows = {r.product_id: r for r in st2.product.collect()}
    assert rows["p3"].name == "Headphones 2" and rows["p3"].status == "Inactive" and rows["p2"].name != "Stolen"
    links = st2.tagging.filter("product_id = 'p3'").join(st2.tag, "tag_id").orderBy("position").collect()
    assert [(r.name, r.position) for r in links] == [("Audio", 1), ("Gaming", 2)]


def test_vendor_onboard_update_status_delete(spark, seed):
    req = spark.createDataFrame([("u2", "Shop Two", "Paris", 1), ("u2", "A later one", "A", 2), ("u2", " ", "A", 0),
                                 ("u4", "Again", "X", 1), ("u3", " ", "Y", 1), ("u9", "Ghost", "Z", 1)],
                                "user_id string, business_name string, location string, seq int")
    out, vendors, users = X.vendor_onboard(seed["vendor"], seed["users"], req, ["seq"])
    got = {r.user_id: (r.outcome, r.role_bits) for r in out.collect()}
    assert got == {"u2": ("onboarded", 3), "u4": ("exists", 2), "u3": ("invalid", 1), "u9": ("unknown_user", None)}
    assert vendors.filter("vendor_id = 'u2' AND status = 'Active' AND store_name = 'Shop Two'").count() == 1

    upd = spark.createDataFrame([("u4", "New Name", None, 1), ("u5", None, "", 1), ("u9", "x", "y", 1)],
                                "vendor_id string, store_name string, location string, seq int")
    got = {r.vendor_id: (r.outcome, r.store_name, r.location) for r in X.vendor_update(seed["vendor"], upd, ["seq"]).collect()}
    assert got == {"u4": ("updated", "New Name", "Beijing"), "u5": ("no_change", "Home Living", "Shanghai"),
                   "u9": ("not_found", None, None)}

    acts = spark.createDataFrame([("u4", "deactivate", 1), ("u4", "toggle", 2), ("u4", "toggle", 3),
                                  ("u5", "toggle", 1)], "vendor_id string, action string, seq int")
    st = {r.vendor_id: r.status for r in X.vendor_status_change(seed["vendor"], acts, [("bei", "activate")]).collect()}
    assert st == {"u4": "Active", "u5": "Inactive"}

    req = spark.createDataFrame([("u4",), ("u1",)], "vendor_id string")
    subs = spark.createDataFrame([], "merchant_id string")
    v = seed["vendor"].unionByName(spark.createDataFrame([("u1", "Empty", "X", "Active", Decimal("0"), 3)],
                                                         seed["vendor"].schema))
    got = {r.vendor_id: r.outcome for r in X.vendor_delete(v, seed["product"], subs, req).collect()}
    assert got == {"u4": "blocked", "u1": "deleted"}


def test_ownership_and_roles(spark, seed):
    claims = spark.createDataFrame([("p1", "u4"), ("p1", "u5"), ("p99", "u4")], "product_id string, vendor_id string")
    got = {(r.product_id, r.vendor_id): r.is_owner for r in X.ownership_check(seed["product"], claims).collect()}
    assert got == {("p1", "u4"): True, ("p1", "u5"): False, ("p99", "u4"): False}


def test_cascade_delete(spark, seed):
    orders = spark.createDataFrame([("o1",), ("o2",)], "order_id string")
    subs = spark.createDataFrame([("s1", "o1"), ("s2", "o2")], "sub_order_id string, order_id string")
    items = spark.createDataFrame([("i1", "s1", "p1"), ("i2", "s2", "p2")], "order_item_id string, sub_order_id string, product_id string")
    out = X.cascade_delete(orders, subs, items, seed["product"], seed["tag"], seed["tagging"],
                           del_orders=spark.createDataFrame([("o1",)], "order_id string"),
                           del_products=spark.createDataFrame([("p1",), ("p2",)], "product_id string"),
                           del_tags=seed["tag"].filter("name = 'Office'"))
    assert out["sub_orders"].count() == 1 and out["order_items"].count() == 1
    assert sorted(r.product_id for r in out["product_blocked"].collect()) == ["p2"]
    assert out["product"].filter("product_id = 'p1'").count() == 0
    left = out["tagging"]
    assert left.filter("product_id = 'p1'").count() == 0 and left.filter("tag_id = 3").count() == 0


def test_customer_profile_partial(spark):
    prof = spark.createDataFrame([("u2", "n", "a", "1")], "user_id string, nick_name string, address string, phone_number string")
    upd = spark.createDataFrame([("u2", None, "b", None, 3), ("u2", "zed", None, None, 1), ("u2", "amy", None, None, 2)],
                                "user_id string, nick_name string, address string, phone_number string, seq int")
    r = X.customer_profile_update(prof, upd, ["seq"]).first()
    assert (r.nick_name, r.address, r.phone_number) == ("amy", "b", "1")


def test_dense_numbers_equal_global_row_number(spark):
    from pyspark.sql import Window

    from marketgrid.functions.numbering import dense_numbers
    rnd = random.Random(3)
    rows = list({(rnd.choice("abcdefgh") + str(rnd.randint(0, 10 ** 6)),) for _ in range(5000)})
    df = spark.createDataFrame(rows, "k string").repartition(7)
    got = {r.k: r.rn for r in dense_numbers(df, ["k"], base=100).collect()}
    want = {r.k: r.rn for r in df.select("k", (F.row_number().over(Window.orderBy("k")) + 100).alias("rn")).collect()}
    assert got == want


def test_ledger_hot_product_across_many_chunks(spark):
    # one product holds most changes; runs of 40 rows cut it into many pieces
    rnd = random.Random(5)
    t0 = dt.datetime(2024, 1, 1)
    rows, cid = [], 0
    for pid, n in [("hot", 3000), ("a", 20), ("b", 5)]:
        for _ in range(n):
            cid += 1
            rows.append((cid, pid, rnd.choice(["increase", "decrease", "decrease"]), rnd.randint(0, 12),
                         t0 + dt.timedelta(seconds=rnd.randint(0, 10 * 24 * 3600))))
    starts = {"hot": (7, "OutOfStock"), "a": (0, "Active"), "b": (3, "Inactive")}
    product = spark.createDataFrame([(k, s, st) for k, (s, st) in starts.items()], "product_id string, stock int, status string")
    ch = spark.createDataFrame(rows, "change_id long, product_id string, action string, amount int, ts timestamp_ntz")
    got = {r.change_id: (r.stock_after, r.status_after) for r in X.stock_ledger(product, ch, rows=40).collect()}
    want = {}
    for pid, (s0, st0) in starts.items():
        seq = sorted((r for r in rows if r[1] == pid), key=lambda r: (r[4], r[0]))
        want.update({c: (s, st) for c, s, st in fold(s0, st0, [(r[0], r[2], r[3]) for r in seq])})
    assert got == want


def test_one_day_of_a_hot_product_is_spread(spark):
    """A third of all changes are one product's, all of one day: no run holds more than a few times its bound."""
    rnd = random.Random(8)
    day = dt.datetime(2024, 5, 1)
    rows = [(k, "hot" if k % 3 == 0 else f"p{k % 50}", rnd.choice(["increase", "decrease"]), rnd.randint(0, 9),
             day + dt.timedelta(seconds=rnd.randint(0, 80_000))) for k in range(6000)]
    ch = spark.createDataFrame(rows, "change_id long, product_id string, action string, amount int, ts timestamp_ntz")
    runs = range_chunks(ch, ["product_id", "ts", "change_id"], rows=300)
    sizes = [r["count"] for r in runs.groupBy("chunk").count().collect()]
    assert len(sizes) >= 15 and max(sizes) <= 900
    assert runs.filter("product_id = 'hot'").select("chunk").distinct().count() >= 5
    ids = sorted({r[1] for r in rows})
    product = spark.createDataFrame([(p, 4, "Active") for p in ids], "product_id string, stock int, status string")
    got = {r.change_id: (r.stock_after, r.status_after) for r in X.stock_ledger(product, ch, rows=300).collect()}
    want = {}
    for p in ids:
        seq = sorted((r for r in rows if r[1] == p), key=lambda r: (r[4], r[0]))
        want.update({c: (s, st) for c, s, st in fold(4, "Active", [(r[0], r[2], r[3]) for r in seq])})
    assert got == want
