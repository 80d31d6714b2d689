"""Keyset pages, the piece index, order sketches and the next vendor table."""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from marketgrid.operators import catalog as C
from marketgrid.operators import changes as X
from marketgrid.operators import listing as L
from marketgrid.operators import order_sketches as S
from marketgrid.operators import text_index as T
from marketgrid.operators import vendors as V


@pytest.fixture(scope="module")
def shop(spark):
    """90 products, several with one created_seq, some names with odd letters, one without a name."""
    names = ["Red Lamp", "blue LAMP", "50%_off", "a", "ab", "Ünïcode Lämp", "", None, "aaa", "lamps red"]
    product = spark.createDataFrame(
        [(f"p{k:02d}", names[k % 10], None, Decimal(k), k % 4, "c", "i", f"v{k % 3}", "Inactive" if k % 7 == 0 else "Active", None, k // 4)
         for k in range(90)],
        "product_id string, name string, description string, price decimal(10,2), stock int, category string, "
        "image_url string, vendor_id string, status string, rating decimal(3,2), created_seq bigint")
    vendor = spark.createDataFrame([("v0", "S0", "Active"), ("v1", "S1", "Active"), ("v2", "S2", "Inactive")],
                                   "vendor_id string, store_name string, status string")
    tag = spark.createDataFrame([(1, "Red"), (2, "re"), (3, "Lamps")], "tag_id int, name string")
    tagging = spark.createDataFrame([(f"p{k:02d}", 1 + (k + j) % 3, j + 1) for k in range(0, 90, 2) for j in range(2)],
                                    "product_id string, tag_id int, position int")
    return product, vendor, tagging, tag


def test_pages_behind_a_key_are_the_offset_pages(spark, shop, tmp_path):
    product, vendor, tagging, tag = shop
    listing = spark.read.parquet(L.write_listing(product, vendor, str(tmp_path / "listing")))
    forms = [
        (lambda **p: L.public_products_after(listing, tagging, tag, keyword="red", **p),
         lambda **p: C.public_products(*shop, keyword="red", **p)),
        (lambda **p: L.tags_any_after(listing, tagging, tag, tags=["lamp", "Re"], **p),
         lambda **p: C.tags_any(*shop, tags=["lamp", "Re"], **p)),
        (lambda **p: L.tags_all_after(listing, tagging, tag, tags=["red", "RE"], **p),
         lambda **p: C.tags_all(*shop, tags=["red", "RE"], **p)),
    ]
    for after_form, offset_form in forms:
        key, n = None, 0
        while True:
            page = after_form(after=key, limit=7)
            rows = sorted(map(tuple, page.collect()))
            assert rows == sorted(map(tuple, offset_form(limit=7, offset=n).collect()))
            if not rows:
                break
            key, n = L.last_key(page), n + 7
        assert n > 7
    assert L.last_key(listing.limit(0)) is None


def test_seek_reaches_the_scan(spark, shop, tmp_path):
    listing = spark.read.parquet(L.write_listing(shop[0], shop[1], str(tmp_path / "listing")))
    plan = L.page_after(listing, (12, "p50"), 5)._jdf.queryExecution().executedPlan().toString()
    assert "LessThanOrEqual(created_seq,12)" in plan and "TakeOrderedAndProject(limit=5" in plan


def test_large_pages_are_not_broadcast(shop):
    def hinted(limit):
        return "broadcast" in C._page(C.search_products(*shop), limit, 0)._jdf.queryExecution().logical().toString()
    assert hinted(20) and not hinted(C.BROADCAST_ROWS + 1)


@pytest.fixture(scope="module")
def index(shop, tmp_path_factory):
    return T.write_index(shop[0], shop[3], str(tmp_path_factory.mktemp("pieces") / "index"))


@pytest.mark.parametrize("terms", [["lamp"], ["a"], ["ab", "LAMPS"], ["50%_"], ["ämp"], ["%"], ["re"], ["aaaa"], ["zzz"], ["", " "], ["red", "d l"]])
def test_index_finds_what_the_scan_finds(shop, index, terms):
    got = T.search_products_index(*shop, index, tags=terms, max_price=80)
    want = C.search_products(*shop, tags=terms, max_price=80)
    assert got.columns == want.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_sketches(spark):
    """30,000 orders over 9 days; merged at once or in steps, estimates lie within three standard errors."""
    product = spark.createDataFrame([("p0", "v0"), ("p1", "v1"), ("p2", "v1")], "product_id string, vendor_id string")
    orders = spark.range(30_000).select(F.concat(F.lit("o"), "id").alias("order_id"),
                                        F.expr("timestamp'2024-01-01' + make_interval(0, 0, 0, CAST(id % 9 AS INT))").alias("order_date"))
    items = orders.select("order_id", F.when(F.col("order_id").endswith("7"), "p0").otherwise("p1").alias("product_id"))
    items = items.union(items.filter(F.col("product_id") == "p1").withColumn("product_id", F.lit("p2")))
    vendor = spark.createDataFrame([("v0",), ("v1",), ("v2",)], "vendor_id string")
    daily = S.daily_order_sketches(product, items, orders)
    got = {r.vendor_id: r.orders_estimate for r in S.vendor_orders_estimate(vendor, daily).collect()}
    assert got["v2"] == 0
    early = F.col("day") < "2024-01-05"
    steps = S.merge_sketches(daily.filter(early), "vendor_id").union(S.merge_sketches(daily.filter(~early), "vendor_id"))
    again = {r.vendor_id: r.orders_estimate for r in S.vendor_orders_estimate(vendor, steps).collect()}
    for v, n in (("v0", 3000), ("v1", 27000)):
        assert abs(got[v] - n) <= 3 * S.STANDARD_ERROR * n and abs(again[v] - n) <= 3 * S.STANDARD_ERROR * n


def test_next_vendors(spark):
    vendor = spark.createDataFrame([("a", "A", "X", "Active", Decimal("4.50"), 1), ("b", "B", "Y", "Inactive", Decimal("0.00"), 2)],
                                   "vendor_id string, store_name string, location string, status string, rating decimal(3,2), created_seq bigint")
    patch = spark.createDataFrame(
        [("a", "A2", " ", None, None, 1), ("a", None, "Z", "Closed", Decimal("6.00"), 2), ("a", "A3", None, "Inactive", Decimal("5.00"), 3),
         ("b", "", None, "Closed", Decimal("-1.00"), 1), ("c", "C", None, None, None, 1), ("b", None, None, None, None, 2)],
        "vendor_id string, store_name string, location string, status string, rating decimal(3,2), seq int")
    got = X.next_vendors(vendor, patch, ["seq"])
    assert got.schema == vendor.schema
    assert sorted(map(tuple, got.collect())) == [("a", "A3", "Z", "Inactive", Decimal("5.00"), 1), ("b", "B", "Y", "Inactive", Decimal("0.00"), 2)]
    outcomes = sorted((r.vendor_id, r.outcome) for r in X.vendor_update(vendor, patch, ["seq"]).collect())
    assert outcomes == [("a", "updated")] * 3 + [("b", "no_change")] * 2 + [("c", "not_found")]


def test_vendor_page_is_planned_once(shop):
    """The cards of a vendor page equal the cards of its products; the window is there once."""
    product, vendor, tagging, tag = shop
    page = V.vendor_products(product, vendor, tagging, tag, page=2, page_size=5)
    rows = page.collect()
    listing = product.join(vendor.select("vendor_id", "store_name"), "vendor_id")
    cards = {r.product_id: r for r in C.product_cards(listing, tagging, tag).collect()}
    assert len(rows) == 15 and all(tuple(r)[:-1] == tuple(cards[r.product_id]) for r in rows)
    assert any(r.tag_names == "" for r in rows) and any("||" in r.tag_names for r in rows)
    assert sorted((r.vendor_id, r.rn) for r in rows) == [(f"v{v}", n) for v in range(3) for n in range(6, 11)]
    plan = page._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window [row_number()") == 1
