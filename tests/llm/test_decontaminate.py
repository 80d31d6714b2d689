"""Suffix-array decontamination against a word-by-word search."""
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from marketgrid.llm import decontaminate as D
from marketgrid.llm.common import Words, text_bytes

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(rows, tests, window):
    wins = {}
    for item, t in tests:
        w = words(t)
        n = min(window, len(w))
        for i in range(len(w) - n + 1 if w else 0):
            wins.setdefault(tuple(w[i:i + n]), set()).add("" if item is None else str(item))
    out = []
    for d, t in rows:
        w, hit, items = words(t), set(), set()
        for n in {len(k) for k in wins}:
            for i in range(len(w) - n + 1):
                for item in wins.get(tuple(w[i:i + n]), ()):
                    items.add(item)
                    hit |= set(range(i, i + n))
        out.append((d, len(w), len(hit), ",".join(sorted(items)), bool(hit)))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def case(hard_rows):
    from samples import prose
    rng = random.Random(3)
    tests = [(k, prose(400 + k, rng.randrange(3, 30), 40)) for k in range(12)]
    tests += [(20, "Solo"), (21, None), (22, " ,.; "), (23, "Ünter-Über 1x"), (None, prose(402, 20, 40)), (3, prose(403, 12, 40)),
              (31, " ".join(["again"] * 14)), (32, prose(402, 20, 40))]
    rows = [r[:2] for r in hard_rows]
    for k in range(60):
        t = prose(500 + k, 40, 40) + " " + (rng.choice(tests)[1] or '').replace(" ", " - ").upper() if k % 2 and tests[k % 12][1] else prose(500 + k, 60, 40)
        rows.append((1000 + k, t))
    rows += [(2000, "again " * 40), (2001, "x SOLO y"), (2002, "ünter Über 1X"), (2003, tests[0][1]), (2003, tests[0][1])]
    return rows, tests


@pytest.mark.parametrize("window,block", [(10, 10_000), (4, 10_000), (4, 30)])
def test_matches(spark, make_docs, case, window, block):
    rows, tests = case
    bench = spark.createDataFrame(tests, "item_id long, text string")
    docs = make_docs(rows, extra=("hits", "items", "__t", "n_words", "__id", "__bad"))
    got = D.report(docs, bench, window=window, block_words=block).collect()
    import hashlib
    found = sorted(((r.doc_id, r.n_words, r.n_hit, r.items_sha256, r.contaminated) for r in got), key=str)
    want = brute(rows, tests, window)
    assert found == sorted(((d, n, h, hashlib.sha256(i.encode()).hexdigest(), c) for d, n, h, i, c in want), key=str)
    assert any(w[4] for w in want) and not all(w[4] for w in want)
    kept = D.remove_contaminated(docs, bench, window=window, block_words=block)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(w[0]) for w in want if not w[4])


def test_empty(spark, make_docs):
    none = spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    assert D.report(make_docs([]), some).count() == 0
    assert [r.n_hit for r in D.report(make_docs([(1, "a b c")]), none).collect()] == [0]


def test_suffix_array_and_longest_match():
    rng = random.Random(1)
    texts = [" ".join(rng.choice("abc") for _ in range(rng.randrange(0, 60))) for _ in range(40)]
    body, offsets = text_bytes(pa.array(texts))
    w = Words(body, offsets, alnum=True)
    end = w.bounds[1:][w.doc_of()]
    order = D.suffix_array(w.hash, end, np.arange(len(w.hash)), 12)
    tails = [[0 if p + d >= end[p] else int(w.hash[p + d]) for d in range(12)] for p in order]
    assert tails == sorted(tails) and sorted(order) == list(range(len(w.hash)))
    tests = D.Tests([("1", " ".join(rng.choice("abc") for _ in range(40)))], 12)
    length, _, _ = D.search(tests, w.hash, end, order)
    test_words = tests.hash.tolist()
    for q, s in enumerate(tests.start.tolist()):
        best = 0
        for p in range(len(w.hash)):
            n = 0
            while n < tests.size[q] and p + n < end[p] and w.hash[p + n] == test_words[s + n]:
                n += 1
            best = max(best, n)
        assert length[q] == best
