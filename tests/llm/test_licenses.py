"""License scans against a search that aligns every template at every place."""
import random
import re

import numpy as np

from marketgrid.llm.licenses import TEMPLATES, Index, align, find_licenses, winnow

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def exact(rows, templates):
    """Whole verbatim template passages: (doc_id, template, first, last)."""
    out = set()
    for d, t in rows:
        w = words(t)
        for name, body in templates.items():
            b = words(body)
            out |= {(d, name, i, i + len(b)) for i in range(len(w) - len(b) + 1) if w[i:i + len(b)] == b}
    return out


def test_verbatim_passages(make_docs, hard_rows):
    from samples import prose
    rng = random.Random(2)
    names = sorted(TEMPLATES)
    rows = [r[:2] for r in hard_rows]
    for k in range(60):
        picked = rng.sample(names, rng.randrange(0, 3))
        rows.append((1000 + k, "\n".join([prose(k, rng.randrange(0, 90)), *[TEMPLATES[n].upper() for n in picked], prose(k + 99, 30)])))
    rows.append((2000, "All rights reserved. x y z all RIGHTS - reserved"))
    got = find_licenses(make_docs(rows, extra=("template", "span"))).collect()
    found = {(r.doc_id, r.template, r.first, r.last) for r in got if r.coverage == 1.0}
    want = exact(rows, TEMPLATES)
    assert found == want and len(want) > 50
    text = dict(rows)
    for r in got:
        assert words(r.span) == words(text[r.doc_id])[r.first:r.last]
    assert not [r for r in got if r.coverage < 1 and r.doc_id in range(9)]


def test_edited_passages(make_docs):
    """Words changed, left out and put in: coverage is the share of words kept."""
    from samples import prose
    rng = random.Random(6)
    body = TEMPLATES["mit"].split()
    rows, kept = [], {}
    for k in range(40):
        w = list(body)
        for p in sorted(rng.sample(range(5, len(w) - 5), 6), reverse=True):
            w[p:p + 1] = rng.choice([["qqq"], [], [w[p], "extra"]])
        kept[k] = (len(body) - 6) / len(body)
        rows.append((k, prose(k, 40) + " " + " ".join(w) + " " + prose(k + 60, 40)))
    got = {r.doc_id: r for r in find_licenses(make_docs(rows)).collect() if r.template == "mit"}
    assert set(got) == set(kept)
    assert all(got[k].coverage >= kept[k] - 0.02 and 38 <= got[k].first <= 42 for k in kept)
    cut = [(k, " ".join(body[:len(body) // 2])) for k in range(3)]
    assert not [r for r in find_licenses(make_docs(cut)).collect() if r.template == "mit"]


def test_winnowing_guarantee():
    """Any k + w - 1 consecutive words of a template contain a kept fingerprint."""
    for n in (1, 3, 4, 7, 50):
        h = np.random.default_rng(n).integers(0, 9, n).astype(np.uint64)
        kept = winnow(h, 4)
        assert len(kept) and all(((kept >= a) & (kept < a + 4)).any() for a in range(n - 3))


def test_align_and_empty(make_docs):
    assert align([9, 1, 2, 3, 9], [1, 2, 3], 0, 2) == (3, 1, 4)
    assert find_licenses(make_docs([])).count() == 0
    assert find_licenses(make_docs([(1, "a b")]), templates={"x": " "}).count() == 0
    assert Index({}, 3, 4).runs == {}
