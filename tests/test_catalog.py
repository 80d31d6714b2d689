"""Catalog (B) on the reference's seed, with its hand-worked answers."""

from pyspark.sql import functions as F
from seed import ids

from marketgrid.operators import catalog as C


def _std(seed):
    return seed["product"], seed["vendor"], seed["tagging"], seed["tag"]


def test_popular_tags_seed(seed):
    rows = [(r.name, r.usage_count) for r in C.popular_tags(*_std(seed)).collect()]
    assert rows == [("Computer", 6), ("Laptop", 3), ("Office", 3), ("Desktop", 2), ("Portable", 2),
                    ("Audio", 1), ("Ergonomic", 1), ("Gaming", 1), ("Tech", 1)]


def test_search_laptop_matches_name_or_tag(seed):
    assert ids(C.search_products(*_std(seed), keyword="laptop")) == ["p1", "p4", "p5", "p8"]


def test_search_terms_are_literal_text(seed):
    # Q12: '%' is not a wildcard
    assert ids(C.search_products(*_std(seed), keyword="%top")) == []
    assert ids(C.search_products(*_std(seed), keyword="LAP")) == ["p1", "p4", "p5", "p8"]


def test_tags_any_office(seed):
    assert ids(C.tags_any(*_std(seed), tags=["office"], limit=20)) == ["p2", "p6", "p7"]
    assert C.tags_any_count(*_std(seed), tags=[" Office ", ""]).first().total == 3


def test_tags_any_has_no_substring_match_on_tags(seed):
    # B9 matches a tag only by equality: 'desk' is no tag, so only the name 'Mini Desktop PC' hits
    assert ids(C.tags_any(*_std(seed), tags=["desk"], limit=20)) == ["p6"]  # name 'Mini Desktop PC' only
    assert ids(C.search_products(*_std(seed), tags=["desk"])) == ["p6", "p7"]  # B4: tag substring too


def test_tags_all_and_duplicate_request(seed):
    assert ids(C.tags_all(*_std(seed), tags=["computer", "laptop"])) == ["p4", "p5", "p8"]
    # Q9: a repeated request tag counts once
    assert ids(C.tags_all(*_std(seed), tags=["computer", "Laptop", "LAPTOP"])) == ["p4", "p5", "p8"]
    assert C.tags_all_count(*_std(seed), tags=["computer", "laptop"]).first().total == 3


def test_cards_and_tag_order(seed):
    cards = {r.product_id: r for r in C.product_cards(
        seed["product"].join(seed["vendor"].select("vendor_id", "store_name"), "vendor_id"),
        seed["tagging"], seed["tag"]).collect()}
    assert cards["p4"].tag_names == "Computer||Gaming||Laptop"
    assert cards["p1"].price_formatted == "$5999.00"
    assert cards["p1"].stock_status == "In Stock"


def test_page_tie_break_by_id(seed):
    # all seed rows share one timestamp: the page order falls back to product_id
    page = C.public_products(*_std(seed), limit=3, offset=2)
    assert [r.product_id for r in page.orderBy(F.col("created_seq").desc(), "product_id").collect()] == \
        ["p3", "p4", "p5"]


def test_detail_view_untagged(spark, seed):
    tagging = seed["tagging"].filter(F.col("product_id") != "p3")
    r = {x.product_id: x for x in C.product_detail_view(seed["product"], seed["vendor"], tagging,
                                                            seed["tag"]).collect()}
    assert r["p3"].tags is None and r["p3"].tag_count == 0
    assert r["p6"].tags == "Computer, Desktop, Office" and r["p6"].tag_count == 3


def test_browse_meta_buttons(seed):
    rows = C.browse_page_meta(*_std(seed), keyword="o", page=1, page_size=2).collect()
    meta = [r for r in rows if r.kind == "meta"][0]
    assert meta.total_pages == 4 and meta.start_item == 1 and meta.end_item == 2
    assert sorted((r.kind, r.target_page) for r in rows if r.kind != "meta") == \
        [("next", 2), ("page", 1), ("page", 2), ("page", 3)]


def test_card_labels_as_coded(seed):
    # Q10: an Inactive product with stock is labelled 'Active'; stock 0 is 'Out of Stock'
    p = (seed["product"].withColumn("status", F.when(F.col("product_id") == "p1", "Inactive").otherwise(F.col("status")))
         .withColumn("stock", F.when(F.col("product_id") == "p2", 0).otherwise(F.col("stock"))))
    cards = {r.product_id: r for r in C.product_cards(p.join(seed["vendor"].select("vendor_id", "store_name"), "vendor_id"),
                                                       seed["tagging"], seed["tag"]).collect()}
    assert cards["p1"].status_label == "Active" and cards["p2"].status_label == "Out of Stock"
    assert cards["p2"].stock_status == "Out of Stock"
