"""Substring dedup against a window-by-window search."""
import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from marketgrid.llm import blocks, substrings as S
from marketgrid.llm.common import Words, text_bytes

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, window):
    words = [WORD.findall(t or "") for _, t in rows]
    rank = [float("inf") if d is None else d for d, _ in rows]
    least = {}
    for r, w in zip(rank, words):
        for i in range(len(w) - window + 1):
            k = tuple(w[i:i + window])
            least[k] = min(r, least.get(k, r))
    out = []
    for (d, _), r, w in zip(rows, rank, words):
        gone = {p for i in range(len(w) - window + 1) if least[tuple(w[i:i + window])] < r for p in range(i, i + window)}
        kept = " ".join(x for p, x in enumerate(w) if p not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest(), kept))
    return sorted(out, key=str)


@pytest.mark.parametrize("window,rounds,small", [(13, None, False), (13, 1, True), (13, 4, True), (5, None, True), (2, None, True)])
def test_remove_repeats(make_docs, hard_rows, monkeypatch, window, rounds, small):
    from samples import prose
    if small:
        monkeypatch.setattr(blocks, "BLOCK_BYTES", 2000)
        monkeypatch.setattr(blocks, "SHARD_BYTES", 3000)
    rng = random.Random(window)
    rows = [r[:2] for r in hard_rows if not small or len(r[1] or "") < 10_000]
    shared = [prose(70 + k, 60, 30) for k in range(4)]
    for k in range(80):
        s = rng.choice(shared).split()
        a = rng.randrange(40)
        rows.append((1000 - k, " ".join([prose(k, rng.randrange(0, 30), 500), *s[a:a + rng.randrange(60)], prose(k + 500, 9, 500)])))
    rows += [(2000 + k, "ab " * (10 + k) + "c d " * k + "e") for k in range(30)]  # runs of one word, windows without symbols
    rows += [(3000 + k, "x " * k) for k in range(0, 40, 3)]
    docs = make_docs(rows, extra=("block", "body", "n_words", "spans"))
    got = S.remove_repeats(docs, window=window, rounds=rounds, with_text=True).collect()
    want = brute(rows, window)
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256, r.kept_text) for r in got), key=str) == want
    assert all(r.n_removed == sum(s.last - s.first for s in r.spans) for r in got)
    assert any(0 < w[2] < w[1] for w in want)


def test_empty(make_docs):
    assert S.remove_repeats(make_docs([])).count() == 0


def test_interior_symbols_agree():
    """Equal windows in different surroundings get equal anchors."""
    rng = random.Random(4)
    passages = [[f"p{rng.randrange(9)}" for _ in range(13)] for _ in range(200)]
    texts = [" ".join([f"q{rng.randrange(9)}" for _ in range(rng.randrange(9))] + p + [f"r{rng.randrange(9)}" for _ in range(5)])
             for p in passages for _ in range(3)]
    w = Words(*text_bytes(pa.array(texts)))
    for rounds in (1, 2, 3, 5):
        place, anchor, full = S.anchors(w, 13, rounds)
        by = {}
        for a, f in zip(anchor.tolist(), full.tolist()):
            assert by.setdefault(f, a) == a
    _, counts = np.unique(full, return_counts=True)
    assert (counts >= 3).sum() >= 200


def test_shards_cover_all_keys():
    keys = np.sort(np.random.default_rng(1).integers(0, 1 << 64, 5000, np.uint64))
    t = blocks.send(7, keys, [np.arange(5000)], 13)
    assert np.array_equal(blocks.received(t, "c0", np.uint64)[0], keys)
    back, n = blocks.received(t, "c1", np.int64)
    assert np.array_equal(blocks.answers(blocks.answer(t, back, n), np.int64), np.arange(5000))
