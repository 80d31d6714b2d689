"""Circulant MinHash against all pairs of full shingle sets."""

import random
import re

import numpy as np
import pytest

from marketgrid.llm import minhash as M
from marketgrid.llm.common import Words
from samples import prose


def shingles(text, k=3):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set())


def brute(rows, percent=85):
    """{row number: (n_shingles, component_id)} over all pairs."""
    sets = [shingles(r[1]) for r in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i, a in enumerate(sets):
        for j in range(i):
            b, common = sets[j], len(a & sets[j])
            if a and b and 100 * common >= percent * (len(a) + len(b) - common):
                root[find(i)] = find(j)
    groups = {}
    for i, r in enumerate(rows):
        groups.setdefault(find(i), []).append(r[0])
    out = []
    for i, r in enumerate(rows):
        ids = [x for x in groups[find(i)] if x is not None]
        out.append((r[0], len(sets[i]), min(ids) if ids else None))
    return sorted(out, key=repr)


def found(df, **kw):
    rows = M.near_duplicates(df, **kw).collect()
    assert all(r.kept == (r.doc_id == r.component_id) for r in rows)
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in rows), key=repr)


def family(seed, copies, words=80, most=6):
    rng, base = random.Random(seed), prose(seed, words).split()
    for _ in range(copies):
        w = list(base)
        for _ in range(rng.randint(0, most)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
        yield " ".join(w)


@pytest.mark.parametrize("block", [1024, 5])
def test_equals_all_pairs(make_docs, block):
    """Families whose members straddle the threshold; small blocks send large buckets through both stages."""
    texts = [t for s in range(4) for t in family(s, 30)] + [prose(100 + k, 40) for k in range(20)]
    rows = [(k, t) for k, t in enumerate(texts)] + [(500 + k, t) for k, t in enumerate(texts[:25])]
    random.Random(5).shuffle(rows)
    assert found(make_docs(rows), block=block) == brute(rows)


def test_defined_cases(make_docs, hard_rows):
    assert found(make_docs(hard_rows)) == brute(hard_rows)
    assert found(make_docs(hard_rows, extra=("n", "key", "buckets", "row", "component_id"))) == brute(hard_rows)
    assert found(make_docs([])) == []


def test_threshold_is_exact(make_docs):
    """17 of 20 shingles are linked at 85, 16 of 20 are not."""
    base = [f"w{k}" for k in range(20)]
    same, less = " ".join(base), " ".join(base[:-1])  # 18 and 17 shingles: 17 of 18
    other = " ".join(base[:-1] + ["a", "b", "c"])  # 20 shingles, 17 of them in both
    short = " ".join(base[:-2] + ["d", "e", "f", "g"])
    rows = [(1, same), (2, less), (3, other), (4, short)]
    assert found(make_docs(rows)) == brute(rows)


def test_bucket_with_most_members_unlinked(make_docs):
    """Texts with one common half share buckets but are not linked; two of them have a copy."""
    half = prose(7, 60)
    rows = [(k, f"{half} {prose(50 + k, 25)}") for k in range(40)]
    rows += [(90, rows[3][1] + " tail"), (91, rows[30][1] + " tail")]
    assert found(make_docs(rows), block=6) == brute(rows)


def test_signature_estimates_similarity():
    rng = np.random.default_rng(1)
    for share in (0.3, 0.85):
        seen = []
        for _ in range(60):
            u = rng.integers(0, 2**63, size=300, dtype=np.uint64)
            c = int(300 * share)
            rest = (300 - c) // 2
            a, b = np.sort(u[:c + rest]), np.sort(np.concatenate((u[:c], u[c + rest:c + 2 * rest])))
            s = M.signatures([a, b], 192)
            seen.append((s[:, 0] == s[:, 1]).mean())
        assert abs(np.mean(seen) - share) < 0.02


def test_long_words_cannot_be_made_to_collide():
    """Two words of 1,024 letters on which sums of powers modulo 2**64 agree."""
    a = "".join("ab"[bin(k).count("1") % 2] for k in range(1024))
    b = "".join("ba"[bin(k).count("1") % 2] for k in range(1024))
    raw = np.frombuffer(f"{a} {b}".encode(), np.uint8)
    words = Words(raw, np.array([0, len(raw)]))
    assert words.hash[0] != words.hash[1]
