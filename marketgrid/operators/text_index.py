"""B4 by index: substring search over product names and tags through their short pieces.

The index holds one row per (piece, id) for the distinct pieces of one to
three letters of every lower-cased name.  It is range-partitioned and sorted
by piece and id, so a lookup reads the row groups of its pieces only and a
piece found in most names is spread over files.  A term's candidates are the
ids that hold all its pieces (of three letters; a shorter term is a piece
itself), counted for all terms in one aggregate; ``contains`` on the names
confirms them, so the rows are those of the scan.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import any_of, ci_contains, clean_terms
from .catalog import _active_listing, filter_listing

LONGEST = 3


def pieces_of(term: str) -> list[str]:
    """The pieces of a lower-cased term that its postings are intersected over."""
    n = min(len(term), LONGEST)
    return sorted({term[k:k + n] for k in range(len(term) - n + 1)})


def postings(rows: DataFrame, key: str, name: str = "name") -> DataFrame:
    """(piece, id) for the distinct pieces of one to ``LONGEST`` letters of every name."""
    text = F.lower(F.col(name))
    size = F.length(text)

    def of_length(n):
        cut = F.transform(F.sequence(F.lit(1), size - (n - 1)), lambda k: F.substring(text, k, F.lit(n)))
        return F.when(size >= n, cut).otherwise(F.array().cast("array<string>"))

    pieces = F.array_distinct(F.concat(*[of_length(n) for n in range(1, LONGEST + 1)]))
    return rows.filter(F.length(name) > 0).select(F.explode(pieces).alias("piece"), F.col(key).alias("id"))


def write_index(product: DataFrame, tag: DataFrame, path: str) -> str:
    """Store the postings of product names and of tag names under ``path``/name and ``path``/tag."""
    for folder, rows in (("name", postings(product, "product_id")), ("tag", postings(tag, "tag_id"))):
        rows.repartitionByRange("piece", "id").sortWithinPartitions("piece", "id").write.mode("errorifexists").parquet(f"{path}/{folder}")
    return path


def candidates(index: DataFrame, terms: list[str]) -> DataFrame:
    """Ids that hold all pieces of at least one of the lower-cased terms."""
    pieces = {t: pieces_of(t) for t in terms}
    wanted = sorted({p for ps in pieces.values() for p in ps})
    counts = index.filter(F.col("piece").isin(wanted)).groupBy("id").agg(
        *[F.count(F.when(F.col("piece").isin(ps), 1)).alias(f"_{k}") for k, ps in enumerate(pieces.values())])
    whole = reduce(lambda a, b: a | b, [F.col(f"_{k}") == len(ps) for k, ps in enumerate(pieces.values())])
    return counts.filter(whole).select("id")


def search_products_index(product: DataFrame, vendor: DataFrame, tagging: DataFrame, tag: DataFrame, index: str,
                          keyword: str | None = None, category: str | None = None, min_price: float | None = None,
                          max_price: float | None = None, tags: list[str] | None = None) -> DataFrame:
    """The rows of ``search_products``, names and tags found through the index at ``index``."""
    listing = filter_listing(_active_listing(product, vendor), tagging, tag, None, category, min_price, max_price)
    terms = clean_terms(([keyword] if keyword else []) + list(tags or []), lower=True)
    if not terms:
        return listing
    spark = product.sparkSession
    holds = any_of([ci_contains("name", t) for t in terms])
    by_name = candidates(spark.read.parquet(f"{index}/name"), terms).withColumnRenamed("id", "product_id")
    by_name = product.select("product_id", "name").join(by_name, "product_id", "left_semi").filter(holds).select("product_id")
    by_tag = candidates(spark.read.parquet(f"{index}/tag"), terms).withColumnRenamed("id", "tag_id")
    by_tag = tag.join(by_tag, "tag_id", "left_semi").filter(holds).select("tag_id")
    by_tag = tagging.join(by_tag, "tag_id", "left_semi").select("product_id")
    return listing.join(by_name.union(by_tag), "product_id", "left_semi")
