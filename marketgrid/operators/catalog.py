"""B: catalog browse and search over all products in one job.

Filters are Column predicates, so they reach the parquet scans; paging is a
top-k (TakeOrderedAndProject) on a unique sort key, and the tag list of a page
is aggregated only for the page's products (a broadcast of the page, if it
has at most ``BROADCAST_ROWS`` rows).  ``listing`` has the form of pages that
does not read what lies before them.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import (ACTIVE, INACTIVE, OUT_OF_STOCK, any_of, ci_contains,
                                 clean_terms, money, price_text)
from ..functions.tags import tag_list, tag_rows


BROADCAST_ROWS = 10_000  # a caller's page up to this size is broadcast


def newest_first():
    """Sort key of every product list: newest first, ties by id."""
    return [F.col("created_seq").desc(), F.col("product_id").asc()]


def _active_listing(product: DataFrame, vendor: DataFrame) -> DataFrame:
    """Active products of Active vendors, with the store name."""
    v = vendor.filter(F.col("status") == ACTIVE).select("vendor_id", "store_name")
    return product.filter(F.col("status") == ACTIVE).join(v, "vendor_id")


def _tag_hit_ids(tagging: DataFrame, tag: DataFrame, pred) -> DataFrame:
    """Distinct product ids carrying a tag whose name satisfies ``pred``."""
    return (tagging.join(tag.filter(pred), "tag_id", "left_semi")
            .select("product_id").distinct())


def search_products(product: DataFrame, vendor: DataFrame, tagging: DataFrame, tag: DataFrame,
                    keyword: str | None = None, category: str | None = None,
                    min_price: float | None = None, max_price: float | None = None,
                    tags: list[str] | None = None) -> DataFrame:
    """The public filter builder.

    Category and price are ANDed; the keyword and every tag term form ONE
    OR-group: a term matches when the product name contains it or one of the
    product's tags contains it (case-free, literal text).  Only Active products
    of Active vendors.  Price bounds become decimal literals, so they
    are pushed to the scan.
    """
    return filter_listing(_active_listing(product, vendor), tagging, tag, keyword, category, min_price, max_price, tags)


def filter_listing(p: DataFrame, tagging: DataFrame, tag: DataFrame, keyword: str | None = None,
                   category: str | None = None, min_price: float | None = None, max_price: float | None = None,
                   tags: list[str] | None = None) -> DataFrame:
    """The rows of a listing of public products that pass the B4 filter."""
    if category:
        p = p.filter(F.lower("category") == category.strip().lower())
    if min_price is not None:
        p = p.filter(F.col("price") >= F.lit(Decimal(str(min_price))))
    if max_price is not None:
        p = p.filter(F.col("price") <= F.lit(Decimal(str(max_price))))
    terms = clean_terms(([keyword] if keyword else []) + list(tags or []), lower=True)
    if terms:
        hits = _tag_hit_ids(tagging, tag, any_of([ci_contains("name", t) for t in terms]))
        p = (p.join(hits.withColumn("_tag_hit", F.lit(True)), "product_id", "left")
             .filter(any_of([ci_contains("name", t) for t in terms]) | F.col("_tag_hit").isNotNull())
             .drop("_tag_hit"))
    return p


def product_cards(listing: DataFrame, tagging: DataFrame, tag: DataFrame,
                  page_only: bool = False) -> DataFrame:
    """Card columns for product rows that carry ``store_name``.

    Labels follow the reference as coded: stock 0 or OutOfStock is
    'Out of Stock'; anything else, Inactive included, is labelled 'Active'.
    """
    tags = tag_list(tagging, tag, "||", products=listing if page_only else None)
    return listing.join(tags.select("product_id", "tags"), "product_id", "left").select(*_card_columns())


def page_cards(page: DataFrame, tagging: DataFrame, tag: DataFrame, *keep: str) -> DataFrame:
    """B5 for the rows of one page, planned once: tags are joined to the page's rows
    and gathered there, so no other product's tags are.  ``keep`` names further columns to carry."""
    names = tagging.join(tag, "tag_id").select("product_id", F.struct("position", "name").alias("_tag"))
    rest = F.struct(*[c for c in page.columns if c != "product_id"])
    ordered = F.transform(F.array_sort(F.collect_list("_tag")), lambda t: t["name"])
    rows = page.join(names, "product_id", "left").groupBy("product_id").agg(
        F.first(rest).alias("_row"), F.array_join(ordered, "||").alias("tags"))
    return rows.select("product_id", "_row.*", "tags").select(*_card_columns(), *keep)


def _card_columns():
    out_of_stock = (F.col("stock") == 0) | (F.col("status") == OUT_OF_STOCK)
    return [
        "product_id", "name",
        F.coalesce("description", F.lit("")).alias("description"),
        money("price").alias("price"), "stock", "category", "image_url", "vendor_id", "status",
        money(F.coalesce("rating", F.lit(0))).alias("rating"),
        "store_name",
        F.coalesce("tags", F.lit("")).alias("tag_names"),
        F.when(out_of_stock, "Out of Stock").otherwise("Active").alias("status_label"),
        F.when(out_of_stock, "Out of Stock").otherwise("In Stock").alias("stock_status"),
        price_text("price").alias("price_formatted"),
        "created_seq",
    ]


def _page(listing: DataFrame, limit: int, offset: int) -> DataFrame:
    ordered = listing.orderBy(*newest_first())
    if offset:
        ordered = ordered.offset(offset)
    return page_rows(ordered.limit(limit), limit)


def page_rows(page: DataFrame, limit: int) -> DataFrame:
    return F.broadcast(page) if limit <= BROADCAST_ROWS else page


def public_products(product, vendor, tagging, tag, keyword=None, category=None, min_price=None,
                    max_price=None, tags=None, limit: int = 20, offset: int = 0) -> DataFrame:
    """B2: one page of public cards, newest first (tie-break product_id)."""
    listing = search_products(product, vendor, tagging, tag, keyword, category, min_price, max_price, tags)
    return product_cards(_page(listing, limit, offset), tagging, tag, page_only=True)


def public_products_count(product, vendor, tagging, tag, keyword=None, category=None,
                          min_price=None, max_price=None, tags=None) -> DataFrame:
    """COUNT(DISTINCT product) under the B4 filter."""
    listing = search_products(product, vendor, tagging, tag, keyword, category, min_price, max_price, tags)
    return listing.agg(F.countDistinct("product_id").alias("total"))


def public_product_details(product: DataFrame, vendor: DataFrame, tagging: DataFrame, tag: DataFrame,
                           ids: DataFrame | None = None) -> DataFrame:
    """Detail rows; status != Inactive (OutOfStock shows) and vendor Active."""
    p = product.filter(F.col("status") != INACTIVE)
    if ids is not None:
        p = p.join(ids.select("product_id").distinct(), "product_id", "left_semi")
    v = vendor.filter(F.col("status") == ACTIVE).select("vendor_id", "store_name")
    p = p.join(v, "vendor_id")
    tags = tag_list(tagging, tag, "||")
    return (p.join(tags.select("product_id", "tags"), "product_id", "left")
            .select(F.col("product_id").alias("id"), F.col("name").alias("title"),
                    F.coalesce("description", F.lit("")).alias("description"),
                    money("price").alias("price"), "stock", "category",
                    F.col("image_url").alias("image"), "vendor_id", "status",
                    money(F.coalesce("rating", F.lit(0))).alias("rating"), "store_name",
                    F.coalesce("tags", F.lit("")).alias("tags")))


def product_detail_view(product: DataFrame, vendor: DataFrame, tagging: DataFrame, tag: DataFrame) -> DataFrame:
    """B1: every product LEFT JOIN vendor and its ', '-joined tags (NULL, count 0 when untagged)."""
    tags = tag_list(tagging, tag, ", ")
    v = vendor.select("vendor_id", "store_name", F.col("location").alias("vendor_location"),
                      F.col("status").alias("vendor_status"))
    return (product.join(v, "vendor_id", "left").join(tags, "product_id", "left")
            .select("product_id", "name", "description", money("price").alias("price"), "stock",
                    "category", "image_url", "vendor_id", "status", money("rating").alias("rating"),
                    "created_seq", "store_name", "vendor_location", "vendor_status", "tags",
                    F.coalesce("tag_count", F.lit(0)).cast("bigint").alias("tag_count")))


def categories(category: DataFrame) -> DataFrame:
    """Category names, sorted."""
    return category.select("name").orderBy("name")


def vendor_names(vendor: DataFrame, ids: DataFrame) -> DataFrame:
    """Store name per requested vendor id, 'Unknown' when absent."""
    v = vendor.select("vendor_id", "store_name")
    return (ids.select("vendor_id").join(v, "vendor_id", "left")
            .select("vendor_id", F.coalesce("store_name", F.lit("Unknown")).alias("store_name")))


def _tags_any_listing(product, vendor, tagging, tag, tags):
    return any_tag(_active_listing(product, vendor), tagging, tag, tags)


def any_tag(p: DataFrame, tagging: DataFrame, tag: DataFrame, tags: list[str]) -> DataFrame:
    """The rows of a listing whose tags equal, or whose name contains, one of ``tags``."""
    terms = clean_terms(tags, lower=True)
    if not terms:
        return p.limit(0)
    hits = _tag_hit_ids(tagging, tag, F.lower("name").isin(terms))
    return (p.join(hits.withColumn("_tag_hit", F.lit(True)), "product_id", "left")
            .filter(F.col("_tag_hit").isNotNull() | any_of([ci_contains("name", t) for t in terms]))
            .drop("_tag_hit"))


def tags_any(product, vendor, tagging, tag, tags: list[str], limit: int = 20, offset: int = 0) -> DataFrame:
    """Tag discovery (OR): a tag equals a term, or the name contains it.

    Unlike B4 there is no substring match on tag names.
    """
    listing = _tags_any_listing(product, vendor, tagging, tag, tags)
    return product_cards(_page(listing, limit, offset), tagging, tag, page_only=True)


def tags_any_count(product, vendor, tagging, tag, tags: list[str]) -> DataFrame:
    """B11."""
    return _tags_any_listing(product, vendor, tagging, tag, tags).agg(
        F.countDistinct("product_id").alias("total"))


def _tags_all_ids(product, vendor, tagging, tag, tags):
    return all_tags_of(_active_listing(product, vendor), tagging, tag, tags)


def all_tags_of(p: DataFrame, tagging: DataFrame, tag: DataFrame, tags: list[str]) -> DataFrame:
    """The rows of a listing that carry every one of ``tags``."""
    terms = clean_terms(tags, lower=True)  # Q9: a repeated request tag counts once
    wanted = tag.filter(F.lower("name").isin(terms)) if terms else tag.limit(0)
    have = (tagging.join(wanted, "tag_id").groupBy("product_id")
            .agg(F.countDistinct(F.lower("name")).alias("n"))
            .filter(F.col("n") == len(terms)).select("product_id"))
    return p.join(have, "product_id", "left_semi")


def tags_all(product, vendor, tagging, tag, tags: list[str], limit: int | None = None,
             offset: int = 0) -> DataFrame:
    """Products carrying every requested tag (relational division)."""
    listing = _tags_all_ids(product, vendor, tagging, tag, tags)
    if limit is not None:
        return product_cards(_page(listing, limit, offset), tagging, tag, page_only=True)
    return product_cards(listing, tagging, tag)


def tags_all_count(product, vendor, tagging, tag, tags: list[str]) -> DataFrame:
    """B12."""
    return _tags_all_ids(product, vendor, tagging, tag, tags).agg(F.count("*").alias("total"))


def popular_tags(product: DataFrame, vendor: DataFrame, tagging: DataFrame, tag: DataFrame,
                 limit: int = 20) -> DataFrame:
    """Distinct Active products per tag; usage desc, name asc, top ``limit``.

    Aggregates by tag id first (partial aggregation map-side), then attaches
    names: a hot tag is a counter, not a big group.
    """
    live = _active_listing(product, vendor).select("product_id")
    usage = (tagging.join(live, "product_id", "left_semi").groupBy("tag_id")
             .agg(F.countDistinct("product_id").alias("usage_count")))
    return (usage.join(tag, "tag_id").select("name", "usage_count")
            .orderBy(F.col("usage_count").desc(), F.col("name").asc()).limit(limit))


def product_tags(tagging: DataFrame, tag: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """(product_id, tag_id, name, position) rows, position order per product."""
    rows = tagging if ids is None else tagging.join(ids.select("product_id"), "product_id", "left_semi")
    return tag_rows(rows, tag)


def all_tags(tag: DataFrame) -> DataFrame:
    """B15."""
    return tag.select("tag_id", "name").orderBy("name")


def _product_row(p: DataFrame) -> DataFrame:
    return p.select("product_id", "name", "description", money("price").alias("price"), "stock",
                    "category", "image_url", "vendor_id", "status", money("rating").alias("rating"),
                    "created_seq")


def customer_products(product: DataFrame, tagging: DataFrame | None = None, keyword: str | None = None,
                      vendor_id: str | None = None, tag_ids: DataFrame | None = None) -> DataFrame:
    """Products by keyword / vendor / tag, no status filter.

    The tag filter is a semi join, so no DISTINCT is needed after it.
    """
    p = product
    if keyword:
        p = p.filter(ci_contains("name", keyword))
    if vendor_id is not None:
        p = p.filter(F.col("vendor_id") == vendor_id)
    if tag_ids is not None:
        tagged = tagging.join(tag_ids.select("tag_id"), "tag_id", "left_semi").select("product_id")
        p = p.join(tagged, "product_id", "left_semi")
    return _product_row(p)


def products_with_vendor(product: DataFrame, vendor: DataFrame) -> DataFrame:
    """Product rows LEFT JOIN vendor name and location."""
    v = vendor.select("vendor_id", "store_name", F.col("location").alias("vendor_location"))
    return _product_row(product).join(v, "vendor_id", "left")


def products_by_ids(product: DataFrame, vendor: DataFrame, ids: DataFrame) -> DataFrame:
    """Batch fetch by an id DataFrame (semi join, no status filter)."""
    v = vendor.select("vendor_id", F.col("store_name").alias("vendor_name"))
    return (product.join(ids.select("product_id").distinct(), "product_id", "left_semi")
            .join(v, "vendor_id")
            .select(F.col("product_id").alias("id"), F.col("name").alias("title"),
                    money("price").alias("price"), F.col("image_url").alias("image"),
                    "vendor_id", "vendor_name"))


def browse_page_meta(product, vendor, tagging, tag, keyword=None, category=None, min_price=None,
                     max_price=None, tags=None, page: int = 1, page_size: int = 20) -> DataFrame:
    """Paging facts of the browse page and its buttons.

    Tags alone go to the B11 count, anything else to B3.  Emits one 'meta'
    row (target = the current page) plus 'prev' / 'page' / 'next' button
    rows (pages within +-2).
    """
    page = max(int(page), 1)
    tag_terms = clean_terms(tags, lower=False)
    if tag_terms and not keyword and not category and min_price is None and max_price is None:
        total = tags_any_count(product, vendor, tagging, tag, tag_terms)
    else:
        total = public_products_count(product, vendor, tagging, tag, keyword, category,
                                      min_price, max_price, tag_terms or None)
    offset = (page - 1) * page_size
    meta = total.select(
        F.col("total").alias("total_products"),
        F.when(F.col("total") > 0, F.ceil(F.col("total") / F.lit(page_size))).otherwise(0)
        .cast("bigint").alias("total_pages"),
        F.when(F.col("total") > 0, F.lit(offset + 1)).otherwise(0).cast("bigint").alias("start_item"),
        F.least(F.lit(offset + page_size).cast("bigint"), F.col("total")).alias("end_item"),
        F.lit(page).cast("bigint").alias("page"))
    buttons = F.when(F.col("total_pages") > 1, F.concat(
        F.when(F.lit(page) > 1, F.array(F.struct(F.lit("prev").alias("kind"),
                                                 F.lit(page - 1).cast("bigint").alias("target"))))
        .otherwise(F.array().cast("array<struct<kind:string,target:bigint>>")),
        F.transform(F.sequence(F.greatest(F.lit(1).cast("bigint"), F.lit(page - 2).cast("bigint")),
                               F.least(F.col("total_pages"), F.lit(page + 2).cast("bigint"))),
                    lambda p: F.struct(F.lit("page").alias("kind"), p.alias("target"))),
        F.when(F.lit(page) < F.col("total_pages"),
               F.array(F.struct(F.lit("next").alias("kind"), F.lit(page + 1).cast("bigint").alias("target"))))
        .otherwise(F.array().cast("array<struct<kind:string,target:bigint>>")),
    )).otherwise(F.array().cast("array<struct<kind:string,target:bigint>>"))
    rows = F.concat(F.array(F.struct(F.lit("meta").alias("kind"),
                                     F.lit(page).cast("bigint").alias("target"))), buttons)
    return (meta.select("*", F.explode(rows).alias("b"))
            .select("total_products", "total_pages", "start_item", "end_item", "page",
                    F.col("b.kind").alias("kind"), F.col("b.target").alias("target_page"),
                    (F.col("b.target") == F.col("page")).alias("is_current")))


def vendor_table_filter(product: DataFrame, term: str | None = None, category: str | None = None) -> DataFrame:
    """The vendor product table's client-side filter, for all vendors.

    Name contains the term (both lower-cased), category equal or any.  The
    page applies the two filters one event at a time (the last one wins);
    as a batch filter they are ANDed.
    """
    p = product
    if term:
        p = p.filter(ci_contains("name", term))
    if category:
        p = p.filter(F.col("category") == category)
    return p.select("vendor_id", "product_id", "name", "category")
