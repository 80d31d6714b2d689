"""Benchmark decontamination with suffix arrays over the training documents.

Every task cuts its documents into shards of whole texts and builds a suffix
array of each shard's words: the suffixes are sorted word by word, refining
only those still tied.  A suffix whose first word is in no test text can match
nothing and is left out.  Each suffix of the test texts is then
binary-searched: the interval of shard suffixes that agree with it is narrowed
one word at a time, which gives its longest verbatim match (up to the window)
and, where the whole window matches, all its places.  Words are compared by a
64-bit hash of their bytes, and every reported match is confirmed on the words
themselves.

The tests are read in blocks of at most ``block_words`` words, each broadcast
and searched against all documents: the bound holds for any benchmark, and
more blocks mean more passes.  With one block nothing is shuffled at all.

Defined cases: null texts have no words; an item without words has no window;
an item shorter than the window is one window; items that repeat an item_id
count once; a null item_id is written as an empty string; a null doc_id is kept; rows that repeat a
doc_id are judged by their own texts; empty tables on either side give zero
hits or no rows; other columns play no part.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, pieces, python_ready, stored, text_bytes, text_key

SHARD_BYTES = 1 << 20
RESULT = "doc_id {id}, __t long, n_words long, hits array<struct<first:int,last:int>>, items array<string>"


class Tests:
    """The windows of one block of test items, as suffixes of their words (hashes and bytes)."""

    def __init__(self, rows: list[tuple[str, str]], window: int):
        body, offsets = text_bytes(pa.array([t for _, t in rows], pa.string()))
        w = Words(body, offsets, alnum=True)
        low = body.tobytes().lower()  # bytes: A-Z only
        self.words = [low[a:b] for a, b in zip(w.start.tolist(), w.end.tolist())]
        self.hash, self.items, self.window = w.hash, [i for i, _ in rows], window
        start, size, item = [], [], []
        for k in range(len(rows)):
            a, b = int(w.bounds[k]), int(w.bounds[k + 1])
            if a == b:
                continue
            length = min(window, b - a)
            for s in range(a, b - length + 1):
                start.append(s)
                size.append(length)
                item.append(k)
        self.start, self.size, self.item = (np.array(x, np.int64) for x in (start, size, item))
        self.first = np.unique(self.hash[self.start]) if len(start) else np.zeros(0, np.uint64)


def suffix_array(hashes: np.ndarray, text_end: np.ndarray, picked: np.ndarray, depth: int) -> np.ndarray:
    """Positions ``picked`` sorted by their next ``depth`` words; a text's end sorts first.

    Each pass sorts by one more word, but only the suffixes still tied.
    ``group`` holds for each place the place where its group of ties begins.
    """
    order = picked[np.argsort(hashes[picked], kind="stable")]
    live = np.arange(len(order))
    starts = np.ones(len(order), bool)
    starts[1:] = hashes[order[1:]] != hashes[order[:-1]]
    group = np.maximum.accumulate(np.where(starts, live, 0)) if len(order) else live
    for d in range(1, depth):
        g = group[live]
        same = g[1:] == g[:-1]
        live = live[np.concatenate((same, [False])) | np.concatenate(([False], same))] if len(live) else live
        if not len(live):
            break
        g = group[live]
        key = word_at(hashes, text_end, order[live], d)
        by = np.lexsort((key, g))
        order[live], key = order[live][by], key[by]
        starts = np.ones(len(live), bool)
        starts[1:] = (g[1:] != g[:-1]) | (key[1:] != key[:-1])
        group[live] = np.maximum.accumulate(np.where(starts, live, 0))
    return order


def word_at(hashes: np.ndarray, text_end: np.ndarray, suffix: np.ndarray, d: int) -> np.ndarray:
    """Hash of the d-th word of each suffix, 0 beyond its text."""
    at = suffix + d
    return np.where(at < text_end[suffix], hashes[np.minimum(at, len(hashes) - 1)], np.uint64(0))


def search(tests: Tests, hashes: np.ndarray, text_end: np.ndarray, order: np.ndarray):
    """Longest match (words) of each test suffix in the shard, and the interval of ``order`` that matches it whole.

    Returns (length, lo, hi); hi > lo only where the whole window matches.
    """
    q = len(tests.start)
    first = hashes[order]
    target = tests.hash[tests.start]
    lo, hi = np.searchsorted(first, target, "left"), np.searchsorted(first, target, "right")
    length = (hi > lo).astype(np.int64)
    for d in range(1, int(tests.size.max()) if q else 0):
        live = np.flatnonzero((length == d) & (tests.size > d))
        if not len(live):
            break
        target = tests.hash[tests.start[live] + d]
        a, b = lo[live], hi[live]
        left = _bound(hashes, text_end, order, a, b, target, d, False)
        right = _bound(hashes, text_end, order, left, b, target, d, True)
        found = right > left
        lo[live[found]], hi[live[found]] = left[found], right[found]
        length[live[found]] += 1
    hi = np.where(length == tests.size, hi, lo)
    return length, lo, hi


def _bound(hashes, text_end, order, lo, hi, target, d, after: bool):
    """First place in [lo, hi) whose d-th word is not below (after: above) the target."""
    lo, hi = lo.copy(), hi.copy()
    while True:
        open_ = np.flatnonzero(lo < hi)
        if not len(open_):
            return lo
        mid = (lo[open_] + hi[open_]) // 2
        key = word_at(hashes, text_end, order[mid], d)
        up = key <= target[open_] if after else key < target[open_]
        lo[open_[up]] = mid[up] + 1
        hi[open_[~up]] = mid[~up]


def shard_matches(body: np.ndarray, offsets: np.ndarray, tests: Tests):
    """(words per text, [(text, first word, last word, item)]) for one shard; places count within the text."""
    w = Words(body, offsets, alnum=True)
    counts = np.diff(w.bounds)
    if not len(tests.start) or not len(w.hash):
        return counts, []
    text = w.doc_of()
    text_end = w.bounds[1:][text]
    at = np.minimum(np.searchsorted(tests.first, w.hash), len(tests.first) - 1)
    order = suffix_array(w.hash, text_end, np.flatnonzero(tests.first[at] == w.hash), int(tests.size.max()))
    if not len(order):
        return counts, []
    _, lo, hi = search(tests, w.hash, text_end, order)
    found = np.flatnonzero(hi > lo)
    if not len(found):
        return counts, []
    low = body.tobytes().lower()
    starts, ends = w.start.tolist(), w.end.tolist()
    out = []
    for q in found.tolist():
        s, size, item = int(tests.start[q]), int(tests.size[q]), int(tests.item[q])
        wanted = tests.words[s:s + size]
        for p in order[lo[q]:hi[q]].tolist():
            if all(low[starts[p + k]:ends[p + k]] == wanted[k] for k in range(size)):
                t = int(text[p])
                out.append((t, p - int(w.bounds[t]), p + size - int(w.bounds[t]), item))
    return counts, out


def _blocks(benchmark: DataFrame, item_id: str, text: str, block_words: int):
    """Rows (item_id as string, text) of the tests, in blocks of about ``block_words`` words."""
    rows = benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")), F.col(text).cast("string"))
    block, words = [], 0
    for item, body in rows.filter(F.col(text).isNotNull()).toLocalIterator():
        n = len(body.split())
        if block and words + n > block_words:
            yield block
            block, words = [], 0
        block.append((item, body))
        words += n
    yield block


def find_matches(docs: DataFrame, benchmark: DataFrame, window: int = 10, block_words: int = 2_000_000,
                 doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id",
                 item_text: str = "text") -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, hits (word ranges [first, last)) and items (ids whose windows occur)."""
    spark = docs.sparkSession
    python_ready(spark)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_key(F.col(text)).alias("__t"),
                       F.col(text).cast("string").alias("text"))
    span = pa.struct([("first", pa.int32()), ("last", pa.int32())])

    def scan(shared):
        def run(batches):
            tests = Tests(shared.value, window)
            for b in batches:
                body, offsets = text_bytes(b.column(2))
                for a, z in pieces(offsets, SHARD_BYTES):
                    counts, matches = shard_matches(body[offsets[a]:offsets[z]], offsets[a:z + 1] - offsets[a], tests)
                    hits, items = [[] for _ in range(z - a)], [set() for _ in range(z - a)]
                    for t, first, last, item in sorted(set(matches)):
                        if hits[t] and first <= hits[t][-1][1]:
                            hits[t][-1] = (hits[t][-1][0], max(last, hits[t][-1][1]))
                        else:
                            hits[t].append((first, last))
                        items[t].add(tests.items[item])
                    yield pa.RecordBatch.from_arrays(
                        [b.column(0).slice(a, z - a), b.column(1).slice(a, z - a), pa.array(counts, pa.int64()),
                         pa.array([[{"first": f, "last": l} for f, l in h] for h in hits], pa.list_(span)),
                         pa.array([sorted(i) for i in items], pa.list_(pa.string()))],
                        names=["doc_id", "__t", "n_words", "hits", "items"])
        return run

    passes = [rows.mapInArrow(scan(spark.sparkContext.broadcast(block)), RESULT.format(id="long"))
              for block in _blocks(benchmark, item_id, item_text, block_words)]
    out = passes[0]
    if len(passes) > 1:
        for p in passes[1:]:
            out = out.unionByName(p)
        out = out.groupBy("doc_id", "__t", "n_words").agg(
            F.flatten(F.collect_list("hits")).alias("hits"),
            F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"),
            F.explode(F.array_repeat(F.lit(0), (F.count(F.lit(1)) / len(passes)).cast("int"))).alias("__copy"))
    return out.select("doc_id", "__t", "n_words", "hits", "items")


def report(docs: DataFrame, benchmark: DataFrame, **params) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated per row, with the hit ranges and item ids."""
    m = find_matches(docs, benchmark, **params)
    places = F.flatten(F.transform("hits", lambda h: F.sequence(h["first"], h["last"] - 1)))
    n_hit = F.size(F.array_distinct(places)).cast("long")
    return m.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
                    F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
                    (F.size("hits") > 0).alias("contaminated"), "hits", "items")


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, **params) -> DataFrame:
    """The rows of ``docs`` without any hit, all columns unchanged."""
    doc_id, text = params.get("doc_id", "doc_id"), params.get("text", "text")
    bad = find_matches(docs, benchmark, **params).filter(F.size("hits") > 0)         .select(F.col("doc_id").alias("__id"), F.col("__t").alias("__bad")).distinct()
    bad = stored(bad, "contaminated")
    return docs.join(bad, docs[doc_id].cast("long").eqNullSafe(bad["__id"]) & (text_key(docs[text]) == bad["__bad"]),
                     "left_anti")
