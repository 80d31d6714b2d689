"""SimHash near-dedup with covering locality-sensitive hashing.

A text's fingerprint has a bit set where over half of its shingle hashes have
it.  Pairs within ``radius`` r bits are found without loss: each of the 64 bit
places gets a code of r + 1 bits (not zero); table v in 1..2^(r+1)-1 keeps the
places whose code has an odd number of bits in common with v.  The codes of
any r differing places leave some v with an even number in common with all of
them, so table v hides all differences and the pair collides there.

Within the colliding buckets no pairs are made.  Two members of a bucket
differ only in hidden places, and are within an even radius r exactly if some
value is within r/2 flips of both; so each member is spread over the values
within r/2 flips of hidden places, and members that meet at a value are linked
to the least of them.  All that meet are within r of each other, so no link is
false, and the spread is bounded by the table's hidden places, whatever the
bucket's size.

Documents enter by distinct fingerprint, so copies cost one row.

Defined cases: null or empty texts have fingerprint zero and are linked like
any other; a null doc_id is never a component id unless its whole component
has none; rows that repeat a doc_id are linked through their texts' own
fingerprints; an empty table gives no rows; other columns play no part.
``keep_one`` keeps one row of every component, also of those without an id and of
those that share an id with another: the least by doc_id (nulls last), then text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import python_ready, stored, text_key
from .components import components

BITS = 64


def fingerprint(text: bytes, shingle: int) -> int:
    """SimHash of a UTF-8 text: XXH64 (seed 42) over space-joined shingles of its words."""
    words = text.lower().split()  # bytes: A-Z only
    if not words:
        return 0
    if len(words) < shingle:
        grams = [b" ".join(words)]
    else:
        grams = map(b" ".join, zip(*(words[k:] for k in range(shingle))))
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(g, 42) for g in grams), np.uint64)
    counts = np.zeros(BITS, np.int64)
    for k in range(0, len(h), 255 * 64):  # sums of at most 255 rows fit in a byte
        bits = np.unpackbits(h[k:k + 255 * 64].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        full = len(bits) // 255 * 255
        if full:
            counts += bits[:full].reshape(-1, 255, BITS).sum(1, dtype=np.uint8).sum(0, dtype=np.int64)
        counts += bits[full:].sum(0, dtype=np.uint8)
    return int(np.packbits(2 * counts > len(h), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = 3, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text_key, fp) with the fingerprint as a signed long."""
    python_ready(docs.sparkSession)

    def run(batches):
        for b in batches:
            fps = [fingerprint(t.as_buffer().to_pybytes() if t.is_valid else b"", shingle) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(2), pa.array(np.array(fps, np.uint64).view(np.int64))],
                names=["doc_id", "text_key", "fp"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"),
                       text_key(F.col(text)).alias("text_key")) \
        .mapInArrow(run, "doc_id long, text_key long, fp long")


def covering_masks(radius: int) -> list[int]:
    """Kept bit places of each table; every pair within ``radius`` agrees on one of them."""
    size = 1 << (radius + 1)
    codes = [1 + (place * 0x9E3779B1 >> 7) % (size - 1) for place in range(BITS)]
    return [sum(1 << p for p, c in enumerate(codes) if bin(c & v).count("1") % 2) for v in range(1, size)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _flips(hidden: int, most: int) -> list[int]:
    """Patterns of up to ``most`` flipped bits among the hidden places."""
    places = [p for p in range(BITS) if hidden >> p & 1]
    out = level = [0]
    for _ in range(most):
        level = sorted({x | 1 << p for x in level for p in places if not x >> p & 1})
        out = out + level
    return list(dict.fromkeys(out))


def near_links(fps: DataFrame, radius: int = 2) -> DataFrame:
    """(u, v): links between distinct fingerprints that connect all pairs within ``radius`` bits.

    ``fps`` has one row per distinct fingerprint in column fp.
    """
    if radius % 2:
        raise ValueError("radius must be even: members meet half way")
    masks = covering_masks(radius)
    tables = fps.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(_signed(m))) for m in masks]))
                        .alias("table", "key"))
    shared = stored(tables.groupBy("table", "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
                    .select("table", "key"), "buckets")
    members = tables.join(shared, ["table", "key"]).select("fp", "table")
    spread = None
    for k, m in enumerate(masks):
        flips = F.array(*[F.lit(_signed(x)) for x in _flips(~m & (1 << BITS) - 1, radius // 2)])
        spread = F.when(F.col("table") == k, flips) if spread is None else spread.when(F.col("table") == k, flips)
    met = members.select("fp", F.explode(spread).alias("flip")) \
        .select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("value")).distinct()
    least = stored(met.groupBy("value").agg(F.min("fp").alias("least"), F.count(F.lit(1)).alias("n"))
                   .filter("n > 1").select("value", "least"), "meetings")
    return met.join(least, "value").filter(F.col("fp") != F.col("least")) \
        .select(F.col("fp").alias("u"), F.col("least").alias("v")).distinct()


def _rooted(marked: DataFrame, first: Column, radius: int) -> DataFrame:
    """(fp, first, root) per distinct fingerprint: ``first`` of its rows, and its component."""
    distinct = stored(marked.groupBy("fp").agg(first.alias("first")), "distinct-fps")
    roots = components(near_links(distinct.select("fp"), radius))
    return stored(distinct.join(roots, distinct["fp"] == roots["node"], "left")
                  .select("fp", "first", F.coalesce("root", "fp").alias("root")), "rooted")


def near_duplicates(docs: DataFrame, shingle: int = 3, radius: int = 2, doc_id: str = "doc_id",
                    text: str = "text") -> DataFrame:
    """(doc_id, fp, component_id) per row: smallest doc_id linked through fingerprints within ``radius`` bits."""
    marked = stored(fingerprints(docs, shingle, doc_id, text).drop("text_key"), "fingerprints")
    rooted = _rooted(marked, F.min("doc_id"), radius)
    ids = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = stored(rooted.select("fp", "root").join(ids, "root").select("fp", "component_id"), "named")
    return marked.join(named, "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, shingle: int = 3, radius: int = 2, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of ``docs`` per component, all columns: the least by doc_id (nulls last), then text key."""
    marked = stored(fingerprints(docs, shingle, doc_id, text), "fingerprints")
    # a row's key without nulls, so that plain equalities match it
    key = F.struct(F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0)).alias("id"), "text_key")
    first = _rooted(marked, F.min(key), radius).groupBy("root").agg(F.min("first").alias("first"))
    first = stored(first.select(F.col("first.none").alias("__none"), F.col("first.id").alias("__id"),
                                F.col("first.text_key").alias("__t")), "firsts")
    own = F.col(doc_id).cast("long")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), own.isNull().alias("__none"),
                       F.coalesce(own, F.lit(0)).alias("__id"), text_key(F.col(text)).alias("__t"))
    # The join leaves the rows dealt by their key, so dropping repeats moves no text again.
    kept = rows.join(first, ["__id", "__t", "__none"], "left_semi").dropDuplicates(["__id", "__t", "__none"])
    return kept.select(*[F.col(f"__row.`{c}`").alias(c) for c in docs.columns])
