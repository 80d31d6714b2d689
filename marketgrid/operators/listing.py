"""B2, B9, B10 by keyset: pages of a stored listing that start behind a key.

``write_listing`` stores the public products (Active products of Active
vendors, with the store name) in the order of every product list, newest
first, range-partitioned on (created_seq, product_id).  A page is then the
first ``limit`` rows behind the last key of the page before it: the seek
predicate is pushed to the scan, whose row groups before the key are skipped,
and no task holds more than ``limit`` rows, however deep the page lies.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .catalog import (_active_listing, all_tags_of, any_tag, filter_listing, newest_first, page_rows, product_cards)


def write_listing(product: DataFrame, vendor: DataFrame, path: str) -> str:
    """Store the public listing in list order under ``path`` (a new folder)."""
    rows = _active_listing(product, vendor)
    rows.repartitionByRange(*newest_first()).sortWithinPartitions(*newest_first()).write.mode("errorifexists").parquet(path)
    return path


def behind(listing: DataFrame, after: tuple[int, str] | None) -> DataFrame:
    """Rows that follow the key (created_seq, product_id) in list order; all rows for None."""
    if after is None:
        return listing
    seq, product_id = F.col("created_seq"), F.col("product_id")
    # the first bound alone already prunes row groups
    return listing.filter((seq <= after[0]) & ((seq < after[0]) | (product_id > after[1])))


def page_after(listing: DataFrame, after: tuple[int, str] | None, limit: int) -> DataFrame:
    return page_rows(behind(listing, after).orderBy(*newest_first()).limit(limit), limit)


def last_key(page: DataFrame) -> tuple[int, str] | None:
    """The key of a page's last row (one row to the driver); None for an empty page."""
    last = page.select("created_seq", "product_id").orderBy(F.col("created_seq").asc(), F.col("product_id").desc()).first()
    return None if last is None else (last["created_seq"], last["product_id"])


def public_products_after(listing: DataFrame, tagging: DataFrame, tag: DataFrame, after: tuple[int, str] | None = None,
                          limit: int = 20, **filters) -> DataFrame:
    """B2: the page of public cards behind ``after`` under the B4 filter."""
    return product_cards(page_after(filter_listing(listing, tagging, tag, **filters), after, limit), tagging, tag, page_only=True)


def tags_any_after(listing: DataFrame, tagging: DataFrame, tag: DataFrame, tags: list[str],
                   after: tuple[int, str] | None = None, limit: int = 20) -> DataFrame:
    """The page of tag discovery (OR) behind ``after``."""
    return product_cards(page_after(any_tag(listing, tagging, tag, tags), after, limit), tagging, tag, page_only=True)


def tags_all_after(listing: DataFrame, tagging: DataFrame, tag: DataFrame, tags: list[str],
                   after: tuple[int, str] | None = None, limit: int = 20) -> DataFrame:
    """The page of products with every tag behind ``after``."""
    return product_cards(page_after(all_tags_of(listing, tagging, tag, tags), after, limit), tagging, tag, page_only=True)
