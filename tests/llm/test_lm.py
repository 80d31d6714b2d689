"""LM scores against plain counting; probabilities add up to one."""
import re
import zlib
from collections import Counter
from math import isclose, log10

import pytest

from marketgrid.llm import blocks
from marketgrid.llm.lm import score_texts

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
END = "\n"


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER)) + [END]


class Plain:
    def __init__(self, rows, min_context, mu):
        self.c, self.cc, self.texts = Counter(), Counter(), 0
        for d, t in rows:
            if not held(d):
                w = tokens(t)
                self.c.update(w)
                self.cc.update(zip([None, *w], w))
                self.texts += 1
        self.n, self.v, self.k, self.mu = sum(self.c.values()), len(self.c), min_context, mu

    def unigram(self, w):
        return (self.c[w] + 1) / (self.n + self.v + 1)

    def prob(self, u, w):
        size = self.texts if u is None else self.c[u]
        if u is not None and size < self.k:
            return self.unigram(w)
        return (self.cc[u, w] + self.mu * self.unigram(w)) / (size + self.mu)


def held(d):
    return zlib.crc32(b"" if d is None else str(d).encode()) % 7 == 2


@pytest.mark.parametrize("small", [False, True])
def test_scores(make_docs, hard_rows, monkeypatch, small):
    from samples import prose
    if small:
        monkeypatch.setattr(blocks, "BLOCK_BYTES", 3000)
        monkeypatch.setattr(blocks, "SHARD_BYTES", 5000)
    rows = [r[:2] for r in hard_rows if not small or len(r[1] or "") < 10_000]
    rows += [(1000 + k, prose(k, 80, 25) + " The  END") for k in range(70)]
    got = score_texts(make_docs(rows, extra=("score", "block", "n", "v")), min_context=20, mu=30.0).collect()
    model = Plain(rows, 20, 30.0)
    assert sum(model.prob("w1", w) for w in [*model.c, "unseen"]) == pytest.approx(1)
    want = []
    for d, t in rows:
        w = tokens(t)
        want.append((str(d), held(d), len(w), sum(model.c[x] > 0 for x in w), model.n,
                     sum(log10(model.unigram(x)) for x in w), sum(log10(model.prob(u, x)) for u, x in zip([None, *w], w))))
    have = [(str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got]
    for a, b in zip(sorted(have), sorted(want), strict=True):
        assert a[:5] == b[:5] and isclose(a[5], b[5], rel_tol=1e-9) and isclose(a[6], b[6], rel_tol=1e-9)
    assert any(r.held_out for r in got)


def test_edges(make_docs):
    assert score_texts(make_docs([])).count() == 0
    only = next(d for d in range(100) if held(d))
    r = score_texts(make_docs([(only, "a b")])).first()  # nothing to learn from
    assert (r.train_tokens, r.n_known, r.n_tokens) == (0, 0, 3) and r.base_score == 0.0


def test_bigrams_help(make_docs):
    """Held-out texts with the training texts' word order score above the unigram base."""
    rows = [(k, " ".join(f"a{(k + i) % 17}" for i in range(60))) for k in range(120)]
    for r in score_texts(make_docs(rows), min_context=20, mu=50.0).collect():
        assert r.score > r.base_score / 2


def test_rare_words_are_states(make_docs):
    """By default every training bigram is an arc, also out of words that occur only twice."""
    train = [d for d in range(100) if not held(d)][:4]
    rows = [(d, f"{k // 2}x {k // 2}y {k // 2}z") for k, d in enumerate(train)]
    model = Plain(rows, 1, 500.0)
    for r, (d, t) in zip(sorted(score_texts(make_docs(rows)).collect(), key=lambda r: r.doc_id), rows, strict=True):
        w = tokens(t)
        assert r.doc_id == d and isclose(r.score, sum(log10(model.prob(u, x)) for u, x in zip([None, *w], w)), rel_tol=1e-9)
