"""MinHash near-dedup with circulant signatures, banding and exact verification.

A text's set is its distinct shingles.  Two permutations make the whole
signature: the first scatters the shingles over a universe of 2**32 places, the
second, shifted circularly by one place more for every coordinate, orders them;
coordinate k is the least place of the set under the second permutation shifted
by k.  The coordinates are cut into bands; sets that agree in a whole band share
a bucket.  With 32 bands of six coordinates two sets at the threshold of 0.85
miss each other with a chance of 2.6e-7, more similar ones with less.

Every set that shares a bucket is built again from its text and compared in
full.  Equal sets are one set from the start, so copies cost one row, and buckets
with the same members are compared once.  In a bucket's task no pairs are made:
each member in turn is intersected at once with all members that it is not
connected with, and only the links that connect something are returned, fewer
than members.  A bucket beyond ``block`` members is split: first its members are
compared within blocks (other blocks in every band), and the components of all
links found; then each member outside the bucket's largest component is compared
with all blocks.  Any two members that might be linked and are not yet connected
have one outside, so no link is lost, and a family of very many near copies costs
its size, not its square, once its blocks have connected it.

What moves: signatures (about 0.3 KB a row), bucket numbers, and the sets of
those that share a bucket.  Texts are read twice, and moved once, to meet the
chosen rows.

Shingles are told apart by 64-bit hashes, sets by 128-bit digests of them.

Defined cases: null texts and texts without words have the empty set, n_shingles
0, and are linked with nothing (component_id is their own doc_id); a null doc_id
is never a component_id unless its whole component has none; rows that repeat a
doc_id are linked through their own texts; an empty table gives no rows; other
columns play no part.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, _mix, pieces, python_ready, stored, text_bytes, text_key
from .components import components

BANDS, ROWS = 32, 6
PIECE_BYTES = 400_000
BLOCK = 1024


def shingle_sets(body: np.ndarray, offsets: np.ndarray, shingle: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text (fewer words: the whole sequence as one; none: empty)."""
    words = Words(body, offsets, lower=True)
    h, bounds = words.hash, words.bounds.tolist()
    chain = _mix(h + np.uint64(shingle))
    for _ in range(shingle - 1):
        chain = _mix(chain[1:] + h[:len(chain) - 1]) if len(chain) > 1 else chain[:0]
    out = []
    for a, z in zip(bounds[:-1], bounds[1:]):
        if z - a >= shingle:
            s = np.sort(chain[a:z - shingle + 1])
            out.append(s[np.concatenate(([True], s[1:] != s[:-1]))])
        elif z > a:
            whole = _mix(h[z - 1:z] + np.uint64(z - a))
            for k in range(z - 2, a - 1, -1):
                whole = _mix(whole + h[k:k + 1])
            out.append(whole)
        else:
            out.append(h[:0])
    return out


def signatures(sets: list[np.ndarray], count: int) -> np.ndarray:
    """Circulant MinHash: row k holds coordinate k of every (not empty) set."""
    place = (_mix(np.concatenate(sets)) >> np.uint64(32)).astype(np.uint32)  # first permutation
    first = np.cumsum([0, *map(len, sets[:-1])])
    out = np.empty((count, len(sets)), np.uint32)
    at, high = np.empty_like(place), np.empty_like(place)
    for k in range(count):  # the second one, shifted by k places
        np.add(place, np.uint32(k), out=at)
        for factor, shift in ((0x85EBCA6B, 15), (0xC2B2AE35, 13), (0x27D4EB2F, 16)):
            np.multiply(at, np.uint32(factor), out=at)
            np.right_shift(at, np.uint32(shift), out=high)
            np.bitwise_xor(at, high, out=at)
        np.minimum.reduceat(at, first, out=out[k])
    return out


def buckets(signature: np.ndarray, bands: int) -> np.ndarray:
    """64-bit bucket number of each set in each band (which is part of the number)."""
    rows = len(signature) // bands
    out = np.empty((signature.shape[1], bands), np.uint64)
    for b in range(bands):
        number = np.full(signature.shape[1], b, np.uint64)
        for coordinate in signature[b * rows:(b + 1) * rows]:
            number = _mix(number + coordinate)
        out[:, b] = number
    return out


def _texts(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc_id, row, text): row is a hash of a row's doc_id and text."""
    key = text_key(F.col(text))
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"),
                       F.xxhash64(F.col(doc_id).cast("long"), key).alias("row"), F.col(text).cast("string").alias("text"))


def _set_key(s: np.ndarray) -> bytes | None:
    import xxhash
    return xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None


def _sketched(texts: DataFrame, shingle: int, bands: int, rows: int) -> DataFrame:
    """(doc_id, row, n, key, buckets) per row; key stands for the set, null if empty."""
    def run(batches):
        for b in batches:
            body, offsets = text_bytes(b.column(2))
            for a, z in pieces(offsets, PIECE_BYTES):
                sets = shingle_sets(body[offsets[a]:offsets[z]], offsets[a:z + 1] - offsets[a], shingle)
                full = [s for s in sets if len(s)]
                found = iter(buckets(signatures(full, bands * rows), bands).view(np.int64) if full else ())
                part = b.slice(a, z - a)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array([len(s) for s in sets], pa.int64()),
                     pa.array([_set_key(s) for s in sets], pa.binary()),
                     pa.array([next(found) if len(s) else None for s in sets], pa.list_(pa.int64()))],
                    names=["doc_id", "row", "n", "key", "buckets"])

    return texts.mapInArrow(run, "doc_id long, row long, n long, key binary, buckets array<long>")


def _sets(texts: DataFrame, shingle: int) -> DataFrame:
    """(key, shingles): the sets of the given rows, as sorted 64-bit hashes."""
    def run(batches):
        for b in batches:
            body, offsets = text_bytes(b.column(2))
            for a, z in pieces(offsets, PIECE_BYTES):
                sets = shingle_sets(body[offsets[a]:offsets[z]], offsets[a:z + 1] - offsets[a], shingle)
                yield pa.RecordBatch.from_arrays([pa.array([_set_key(s) for s in sets], pa.binary()),
                                                  pa.array([s.tobytes() for s in sets], pa.binary())], names=["key", "shingles"])

    return texts.mapInArrow(run, "key binary, shingles binary").dropDuplicates(["key"])


def connecting_links(sets: list[np.ndarray], group: np.ndarray, asks: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links (i, j) that connect all members that similar sets connect.

    Members with one number in ``group`` are connected already; only pairs with a
    member of ``asks`` are compared.
    """
    size = np.array([len(s) for s in sets], np.int64)
    first = np.cumsum(size) - size
    _, number = np.unique(np.concatenate(sets), return_inverse=True)
    mark = np.zeros(int(number.max()) + 1, bool)
    group, links, at = group.copy(), [], np.arange(len(sets))
    for i in np.flatnonzero(asks).tolist():
        other = group != group[i]
        if not other.any():
            if (group == group[0]).all():
                break
            continue
        fits = other & (100 * np.minimum(size, size[i]) >= percent * np.maximum(size, size[i])) & (~asks | (at > i))
        near = np.flatnonzero(fits)
        if not len(near):
            continue
        own = number[first[i]:first[i] + size[i]]
        mark[own] = True
        if 4 * len(near) > len(sets):
            common = np.add.reduceat(mark[number], first, dtype=np.int64)[near]
        else:
            common = np.array([np.count_nonzero(mark[number[first[j]:first[j] + size[j]]]) for j in near.tolist()])
        mark[own] = False
        hit = near[100 * common >= percent * (size[i] + size[near] - common)]
        if len(hit):
            joined, where = np.unique(group[hit], return_index=True)
            links += [(i, int(hit[k])) for k in where]
            group[np.isin(group, joined)] = group[i]
    return links


def _compared(units: DataFrame, by: list[str], percent: int) -> DataFrame:
    """(u, v): connecting links in every unit of (key, group, asks, shingles)."""
    def run(table: pa.Table) -> pa.Table:
        keys = table.column("key").to_pylist()
        sets = [np.frombuffer(s.as_buffer(), np.uint64) for s in table.column("shingles")]
        _, group = np.unique(np.array([g.hex() for g in table.column("group").to_pylist()]), return_inverse=True)
        found = connecting_links(sets, group, table.column("asks").to_numpy(), percent)
        return pa.table({"u": pa.array([keys[i] for i, _ in found], pa.binary()),
                         "v": pa.array([keys[j] for _, j in found], pa.binary())})

    return units.groupBy(*by).applyInArrow(run, "u binary, v binary")


def _members(sketched: DataFrame, block: int) -> DataFrame:
    """(bucket, key, blocks): distinct sets of the buckets with several, one bucket of those with equal members."""
    spread = sketched.filter(F.col("key").isNotNull()).select(
        "key", F.xxhash64("key").alias("k"), F.explode("buckets").alias("bucket"))
    shared = stored(spread.groupBy("bucket").agg(F.min("k").alias("a"), F.max("k").alias("b"))
                    .filter("a < b").select("bucket"), "minhash-buckets")
    # merge joins at every size: neither side is bounded
    members = stored(spread.join(shared.hint("merge"), "bucket", "left_semi").select("bucket", "key").distinct(), "minhash-members")
    alike = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("key")).alias("x"),
                                          F.bit_xor(F.xxhash64("key", F.lit(1))).alias("y"))
    one = alike.groupBy("n", "x", "y").agg(F.min("bucket").alias("bucket"))
    one = one.select("bucket", F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    return stored(members.join(one, "bucket"), "minhash-members")


def _links(members: DataFrame, sets: DataFrame, percent: int, block: int) -> DataFrame:
    deal = F.pmod(F.xxhash64("key", "bucket"), F.col("blocks")).cast("int")
    dealt = members.withColumn("blk", deal)
    whole = dealt.join(sets, "key").withColumns({"group": F.col("key"), "asks": F.lit(True)})
    links = stored(_compared(whole, ["bucket", "blk"], percent), "minhash-links")
    large = dealt.filter("blocks > 1")
    if large.isEmpty():
        return links
    # members of the large buckets by what connects them now; all but the largest part ask all blocks
    roots = components(links)
    large = stored(large.join(roots, large["key"] == roots["node"], "left")
                   .select("bucket", "key", "blocks", "blk", F.coalesce("root", "key").alias("group")), "minhash-large")
    parts = large.groupBy("bucket", "group").agg(F.count(F.lit(1)).alias("n"))
    most = parts.groupBy("bucket").agg(F.max(F.struct("n", "group")).alias("most"), F.sum("n").alias("all"))
    most = stored(most.select("bucket", F.col("most.group").alias("main"), (F.col("all") - F.col("most.n")).alias("out"))
                  .filter("out > 0").withColumn("askers", F.ceil(F.col("out") / block).cast("int")), "minhash-main")
    both = large.join(most, "bucket").withColumn("asks", F.col("group") != F.col("main")) \
        .withColumn("ask", F.pmod(F.xxhash64("key", "bucket", F.lit(2)), F.col("askers")).cast("int"))
    asking = both.filter("asks").select("bucket", "key", "group", "asks", "ask",
                                        F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("blk"))
    asked = both.withColumn("asks", F.lit(False)).select(
        "bucket", "key", "group", "asks", F.explode(F.sequence(F.lit(0), F.col("askers") - 1)).alias("ask"), "blk")
    units = asking.unionByName(asked).join(sets, "key")
    return stored(links.unionByName(_compared(units, ["bucket", "ask", "blk"], percent)), "minhash-links")


def near_duplicates(docs: DataFrame, shingle: int = 3, percent: int = 85, bands: int = BANDS, rows: int = ROWS,
                    block: int = BLOCK, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) per row.

    Sets are linked where 100 * common >= percent * united; component_id is the
    smallest doc_id reachable, kept says whether that is the row's own.
    """
    python_ready(docs.sparkSession)
    texts = _texts(docs, doc_id, text)
    sketched = stored(_sketched(texts, shingle, bands, rows), "minhash-rows")
    firsts = stored(sketched.filter(F.col("key").isNotNull()).groupBy("key")
                    .agg(F.min("doc_id").alias("first"), F.min("row").alias("row")), "minhash-firsts")
    members = _members(sketched, block)
    chosen = stored(firsts.join(members.select("key").distinct(), "key", "left_semi").select("row").distinct(), "minhash-chosen")
    sets = stored(_sets(texts.join(chosen.hint("merge"), "row", "left_semi"), shingle), "minhash-sets")
    roots = components(_links(members, sets, percent, block))
    named = firsts.join(roots, firsts["key"] == roots["node"], "left") \
        .select("key", "first", F.coalesce("root", "key").alias("root"))
    ids = named.groupBy("root").agg(F.min("first").alias("component_id"))
    named = stored(named.join(ids, "root").select(F.col("key").alias("k"), "component_id"), "minhash-named")
    linked = sketched.join(named, sketched["key"] == named["k"], "left")
    own = F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return linked.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"),
                         F.col("doc_id").eqNullSafe(own).alias("kept"))
