"""SimHash near-dedup against bit-by-bit fingerprints and all pairs."""
import random
import re
from collections import Counter

import pytest
import xxhash
from hypothesis import given, settings, strategies as st

from marketgrid.llm.components import components
from marketgrid.llm.simhash import covering_masks, keep_one, near_duplicates, near_links


def brute_fp(text, k=3):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    grams = [" ".join(words[i:i + k]) for i in range(len(words) - k + 1)] or [" ".join(words)]
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def classes(nodes, linked):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    nodes = list(nodes)
    for i, a in enumerate(nodes):
        for b in nodes[:i]:
            if linked(a, b):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def near(a, b):
    return bin((a ^ b) & (1 << 64) - 1).count("1") <= 2


@given(st.integers(0, 2**64 - 1), st.sets(st.integers(0, 63), max_size=4))
@settings(max_examples=200)
def test_masks_cover(x, places):
    for radius in (2, 4):
        if len(places) <= radius:
            y = x ^ sum(1 << p for p in places)
            assert any(x & m == y & m for m in covering_masks(radius))


def test_links_connect_all_pairs(spark):
    rng = random.Random(5)
    fps = {rng.getrandbits(64) for _ in range(200)}
    for f in list(fps)[:60]:  # chains and dense groups
        for _ in range(rng.randrange(1, 6)):
            f ^= 1 << rng.randrange(64) | 1 << rng.randrange(64)
            fps.add(f)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    links = near_links(spark.createDataFrame([(f,) for f in signed], "fp long"), 2)
    pairs = [(r.u, r.v) for r in links.collect()]
    assert all(near(a, b) for a, b in pairs)
    want = classes(signed, near)
    got = {n: n for n in signed} | {r.node: r.root for r in components(links).collect()}
    assert got == want


def test_odd_radius_refused(spark):
    with pytest.raises(ValueError):
        near_links(spark.createDataFrame([(1,)], "fp long"), 3)


def test_components_shapes(spark):
    chain = [(k, k + 1) for k in range(200)]
    star = [(1000, 1001 + k) for k in range(300)]
    odd = [(5000, 5000), (7, None), (None, None), (2, 1), (1, 2)]
    got = {r.node: r.root for r in components(spark.createDataFrame(chain + star + odd, "u long, v long")).collect()}
    assert got == {**{k: 0 for k in range(201)}, **{k: 1000 for k in range(1000, 1301)}}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_near_duplicates(make_docs, hard_rows):
    from samples import prose
    rows = [r[:2] for r in hard_rows] + [(50 + k, prose(7, 400) + f" tail{k}") for k in range(30)]
    rows += [(90, "One TWO"), (91, "one\ntwo"), (92, "À b c d"), (93, "à b c d")]
    got = near_duplicates(make_docs(rows, extra=("fp", "node", "root", "component_id"))).collect()
    fps = [brute_fp(t) for _, t in rows]
    mask = (1 << 64) - 1
    assert Counter((r.doc_id, r.fp & mask) for r in got) == Counter((r[0], f) for r, f in zip(rows, fps))
    root = classes(set(fps), near)
    least = {}
    for r, f in zip(rows, fps):
        if r[0] is not None:
            least[root[f]] = min(r[0], least.get(root[f], r[0]))
    assert {(r.doc_id, r.component_id) for r in got} == {(r[0], least.get(root[f])) for r, f in zip(rows, fps)}
    kept = keep_one(make_docs(rows, extra=("__id", "fp")))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(least.values()))


def test_empty(make_docs):
    assert near_duplicates(make_docs([])).count() == 0 and keep_one(make_docs([])).count() == 0


def test_keep_one_row_of_every_component(make_docs):
    """Several groups without an id, an id with two texts, exact repeats: no text is lost, none stays twice."""
    from samples import prose
    t = [prose(60 + k, 200) for k in range(7)]
    rows = [(None, t[0]), (None, t[0]), (None, t[1]), (None, t[2]), (10, t[3]), (None, t[3]), (11, t[3].upper()),
            (20, t[4]), (20, t[5]), (5, t[5]), (30, t[6]), (30, t[6])]
    docs = make_docs(rows, extra=("__id", "__row", "fp"))
    kept = keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted(
        [(None, t[0]), (None, t[1]), (None, t[2]), (10, t[3]), (20, t[4]), (5, t[5]), (30, t[6])], key=str)
