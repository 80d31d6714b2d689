"""Substring dedup by recompression.

Each round of recompression names the runs of equal symbols, then the pairs
(a, b) whose first symbol falls on the left and second on the right side of a
random split of the alphabet.  A name is a 64-bit hash of what it stands for,
so equal runs and pairs get equal names in every task: names are global
without a dictionary.  Whether a symbol forms depends only on a few symbols
around it; every symbol carries the span of words that forces it.  A symbol
whose span lies inside a window is the same in every occurrence of the window:
these are the window's interior symbols.

A window's anchor is the interior symbol with the least name on the highest
level that has one (a window too repetitive to have any is its own anchor), so
equal windows have equal anchors, and neighbouring windows mostly share one.
Round one of the exchange finds the anchors that occur in two documents or
more; all other windows are unique and are done.  Round two sends the windows
at shared anchors, as pairs of anchor and an independent 64-bit hash of all
their words, and answers for each whether a document with a smaller id holds
it.  Both exchanges are arrays per block and shard (see blocks).

Defined cases: a null text has no words; a null doc_id counts as larger than
all others (and rows of one doc_id never remove each other's words); texts
shorter than the window keep all words; repeated rows are judged alike; an empty
table gives no rows; other columns play no part.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import answer, answers, received, send, shard_count, to_blocks, unpack
from .common import Words, _mix, python_ready, span_hash, stored, text_bytes, union_length

WINDOW_BASE = 0xD1B54A32D192ED03  # odd
NO_ID = np.iinfo(np.int64).max


def _compress(level: int, name, start, end, first, last, edge_left, edge_right):
    """One round on a block's symbols.  first/last: span of words that forces the symbol.

    edge_left/edge_right: the symbol is the first/last of its text; a text's
    edge is not part of any window, so what depends on it reaches one word beyond.
    """
    if not len(name):
        return name, start, end, first, last, edge_left, edge_right
    # runs
    new = np.ones(len(name), bool)
    new[1:] = (name[1:] != name[:-1]) | edge_left[1:]
    a = np.flatnonzero(new)
    z = np.append(a[1:], len(name)) - 1
    size = (z - a + 1).astype(np.uint64)
    run = np.where(size > 1, _mix(name[a] + size * np.uint64(0x9FB21C651E98DF25)), name[a])
    left, right = edge_left[a], edge_right[z]
    first, last = (np.where(left, start[a] - 1, first[np.maximum(a - 1, 0)]),
                   np.where(right, end[z] + 1, last[np.minimum(z + 1, len(name) - 1)]))
    start, end, name = start[a], end[z], run
    # pairs
    side = (_mix(name ^ np.uint64(0x51_7C_C1_B7 * (2 * level + 1))) >> np.uint64(40)) & np.uint64(1) == 1  # right side
    head = np.zeros(len(name), bool)
    head[:-1] = ~side[:-1] & side[1:] & ~right[:-1]
    tail = np.concatenate(([False], head[:-1]))
    before = np.where(left, start - 1, np.concatenate((first[:1], first[:-1])))
    after = np.where(right, end + 1, np.concatenate((last[1:], last[-1:])))
    first = np.where(side & ~tail, before, first)  # a lone right symbol: its left neighbour is known not to be left
    last = np.where(~side & ~head, after, last)
    i = np.flatnonzero(~tail)
    j = i + head[i]
    pair = _mix(name[i] * np.uint64(0xC2B2AE3D27D4EB4F) + _mix(name[j] + np.uint64(level + 1)))
    return (np.where(i == j, name[i], pair), start[i], end[j], first[i], last[j], left[i], right[j])


def _least(key: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Place of the least key (the leftmost of equals) in each [lo, hi), hi > lo."""
    best = np.arange(len(key))
    out = np.zeros(len(lo), np.int64)
    size = hi - lo
    step = 1
    while True:
        now = (size >= step) & (size < 2 * step)
        l, r = best[lo[now]], best[hi[now] - step]
        out[now] = np.where(key[r] < key[l], r, l)
        if not (size >= 2 * step).any():
            return out
        ahead = best[np.minimum(np.arange(len(key)) + step, len(key) - 1)]
        best = np.where(key[ahead] < key[best], ahead, best)
        step *= 2


def anchors(w: Words, window: int, rounds: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, anchor, hash) of every window of the block's texts; place is its first word."""
    n = len(w.hash)
    sizes = np.diff(w.bounds)
    edge_left, edge_right = np.zeros(n + 1, bool), np.zeros(n + 2, bool)
    edge_left[w.bounds[:-1][sizes > 0]] = True
    edge_right[w.bounds[1:][sizes > 0]] = True  # one place later
    last_of = np.repeat(w.bounds[1:], sizes)
    place = np.flatnonzero(np.arange(n) + window <= last_of)
    full = span_hash(w.hash, place, place + window, WINDOW_BASE)
    anchor = np.zeros(len(place), np.uint64)
    open_ = np.ones(len(place), bool)
    at = np.arange(n)
    levels, state = [], (w.hash, at, at + 1, at, at + 1, edge_left[:n], edge_right[1:n + 1])
    for level in range(rounds):
        state = _compress(level, *state)
        levels.append(state)
    for level in range(rounds - 1, -1, -1):
        name, _, _, first, last, _, _ = levels[level]
        todo = np.flatnonzero(open_)
        if not len(todo):
            break
        p = place[todo]
        lo, hi = np.searchsorted(first, p, "left"), np.searchsorted(last, p + window, "right")
        inside = hi > lo
        todo, lo, hi = todo[inside], lo[inside], hi[inside]
        if len(todo):
            key = _mix(name + np.uint64(level))
            j, back = np.unique(_least(key, lo, hi), return_inverse=True)
            # the symbol together with the words that force it, which the window holds as well
            anchor[todo] = _mix(span_hash(w.hash, first[j], last[j]) ^ key[j])[back]
            open_[todo] = False
    rest = np.flatnonzero(open_)
    anchor[rest] = span_hash(w.hash, place[rest], place[rest] + window)
    return place, anchor, full


class Block:
    """A block's texts and windows."""

    def __init__(self, body, window: int, rounds: int):
        batch = unpack(body)
        self.raw, offsets = text_bytes(batch.column(1))
        self.words = Words(self.raw, offsets)
        self.ids = batch.column(0)
        ids = np.array(self.ids.fill_null(NO_ID).to_numpy(zero_copy_only=False), np.int64)
        self.place, self.anchor, self.full = anchors(self.words, window, rounds)
        self.doc = ids[self.words.doc_of()[self.place]]  # doc_id of each window

    def anchor_keys(self):
        """Distinct anchors (sorted), 1 where two doc_ids of the block hold it, and each window's place among them."""
        keys, back = np.unique(self.anchor, return_inverse=True)
        low, high = np.full(len(keys), NO_ID), np.full(len(keys), np.iinfo(np.int64).min)
        np.minimum.at(low, back, self.doc)
        np.maximum.at(high, back, self.doc)
        return keys, (high > low).astype(np.uint8), back

    def window_keys(self, shared: np.ndarray, back: np.ndarray):
        """Distinct (anchor, hash) at shared anchors, the least doc_id of each, and (window, key) of their windows."""
        at = np.flatnonzero(shared[back] > 0)
        order = at[np.lexsort((self.doc[at], self.full[at], self.anchor[at]))]
        new = np.ones(len(order), bool)
        new[1:] = (self.anchor[order[1:]] != self.anchor[order[:-1]]) | (self.full[order[1:]] != self.full[order[:-1]])
        heads = order[new]
        return self.anchor[heads], self.full[heads], self.doc[heads], order, np.cumsum(new) - 1


def _shared_anchors(_, table):
    """For each anchor of each block: 1 if two doc_ids hold it anywhere."""
    keys, lengths = received(table, "c0", np.uint64)
    multi, _ = received(table, "c1", np.uint8)
    _, back, count = np.unique(keys, return_inverse=True, return_counts=True)
    inside = np.zeros(len(count), bool)
    inside[back[multi > 0]] = True
    return answer(table, ((count > 1) | inside)[back].astype(np.uint8), lengths)


def _smaller_elsewhere(_, table):
    """For each window of each block: 1 if another block holds it in a document with a smaller id."""
    anchor, lengths = received(table, "c0", np.uint64)
    full, _ = received(table, "c1", np.uint64)
    doc, _ = received(table, "c2", np.int64)
    order = np.lexsort((doc, full, anchor))
    new = np.ones(len(order), bool)
    new[1:] = (anchor[order[1:]] != anchor[order[:-1]]) | (full[order[1:]] != full[order[:-1]])
    least = doc[order[new]][np.cumsum(new) - 1] if len(order) else doc
    out = np.zeros(len(order), np.uint8)
    out[order] = doc[order] > least
    return answer(table, out, lengths)


def remove_repeats(docs: DataFrame, window: int = 13, doc_id: str = "doc_id", text: str = "text",
                   rounds: int | None = None, with_text: bool = False) -> DataFrame:
    """Per row: doc_id, n_words, n_removed, kept_sha256, spans (word ranges removed), with_text: kept_text.

    A word goes if a window of ``window`` words around it also starts in a
    document with a smaller id; kept words are joined by one space.  ``rounds``
    (default log2(window / 3)) only steers how many anchors there are.
    """
    spark = docs.sparkSession
    python_ready(spark)
    rounds = rounds or max(1, int(np.log2(window / 3)) if window > 3 else 1)
    blocks = to_blocks(docs, doc_id, text)
    shards = shard_count(blocks)
    request = "shard long, block long, c0 binary, c1 binary"
    reply = "block long, shard long, c0 binary"

    def ask_anchors(batches):
        for b in batches:
            for block, body in zip(b.column(0).to_pylist(), b.column(1)):
                keys, multi, _ = Block(body.as_buffer(), window, rounds).anchor_keys()
                yield from send(block, keys, [multi], shards).to_batches()

    shared = blocks.select("block", "body").mapInArrow(ask_anchors, request).groupBy("shard") \
        .applyInArrow(_shared_anchors, reply)
    shared = stored(shared, "shared-anchors")

    def ask_windows(key, left, right):
        b = Block(left.column("body")[0].as_buffer(), window, rounds)
        keys, _, back = b.anchor_keys()
        anchor, full, least, _, _ = b.window_keys(answers(right, np.uint8), back)
        return send(key[0].as_py(), anchor, [full, least], shards)

    seen = blocks.groupBy("block").cogroup(shared.groupBy("block")) \
        .applyInArrow(ask_windows, request + ", c2 binary").groupBy("shard").applyInArrow(_smaller_elsewhere, reply)
    seen = stored(seen, "seen-windows")

    columns = ["doc_id", "n_words", "n_removed", "kept_sha256", "spans", "kept_text"]
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string, spans array<struct<first:int,last:int>>, kept_text string"

    def finish(key, left, right):
        b = Block(left.column("body")[0].as_buffer(), window, rounds)
        kind = right.column("kind").to_numpy()
        _, _, back = b.anchor_keys()
        _, _, least, order, of = b.window_keys(answers(right.filter(pa.array(kind == 0)), np.uint8), back)
        smaller = answers(right.filter(pa.array(kind == 1)), np.uint8)
        gone = order[(smaller[of] > 0) | (b.doc[order] > least[of])]
        mask = union_length(b.place[gone], window, len(b.words.hash))
        raw, bounds = b.raw.tobytes(), b.words.bounds.tolist()
        spans_type = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))
        removed, shas, spans, texts = [], [], [], []
        starts, ends = b.words.start, b.words.end
        for k in range(len(bounds) - 1):
            a, z = bounds[k], bounds[k + 1]
            m = mask[a:z]
            body = raw[int(starts[a]):int(ends[z - 1])] if z > a else b""
            words = body.split()
            if m.any():
                turns = np.flatnonzero(np.diff(np.concatenate(([False], m, [False])).astype(np.int8))).tolist()
                spans.append([{"first": f, "last": l} for f, l in zip(turns[::2], turns[1::2])])
                words = [words[p] for p in np.flatnonzero(~m).tolist()]
            else:
                spans.append([])
            removed.append(int(m.sum()))
            kept = b" ".join(words)
            shas.append(hashlib.sha256(kept).hexdigest())
            texts.append(kept.decode() if with_text else None)
        return pa.table([b.ids, pa.array(np.diff(b.words.bounds), pa.int64()), pa.array(removed, pa.int64()),
                         pa.array(shas, pa.string()), pa.array(spans, spans_type), pa.array(texts, pa.string())], names=columns)

    replies = shared.withColumn("kind", F.lit(0)).unionByName(seen.withColumn("kind", F.lit(1)))
    out = blocks.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(finish, schema)
    return out if with_text else out.drop("kept_text")
