"""Language ID: phrases against a plain greedy parse, accuracy on held-out rows."""
import random
import zlib

import numpy as np
from hypothesis import given, settings, strategies as st

from marketgrid.llm.langid import SEGMENT, Parser, SuffixAutomaton, identify, symbols


def greedy(body, sample):
    """Phrases of body, each the longest that occurs in sample, or one symbol that does not."""
    n, at = 0, 0
    while at < len(body):
        z = at + 1
        while z < len(body) and body[at:z + 1] in sample:
            z += 1
        n, at = n + 1, z
    return n


@given(st.text("ab c", max_size=40), st.text("abcd e", max_size=60))
@settings(max_examples=150, deadline=None)
def test_automaton_knows_all_substrings(sample, text):
    auto = SuffixAutomaton(sample)
    for a in range(len(text)):
        state, ok = 0, True
        for z in range(a, min(a + 8, len(text))):
            state = auto.next[state].get(text[z]) if ok else None
            ok = state is not None
            assert ok == (text[a:z + 1] in sample)


def test_phrases():
    rng = random.Random(3)
    samples = {k: " ".join("".join(rng.choice(v) for _ in range(rng.randrange(1, 7))) for _ in range(200))
               for k, v in {"x": "abcé", "y": "bcdo", "z": "zyxb"}.items()}
    p = Parser(samples)
    plain = {k: symbols(v, p.table).tolist() for k, v in samples.items()}
    texts = ["", "ABC é!!  b-c 12", "ωω zy", "é", *["".join(rng.choice("abcdzyx é.") for _ in range(n)) for n in (5, 255, 256, 257, 1500)]]
    syms = [symbols(t, p.table) for t in texts]
    got = p.phrases(syms)
    text_of = lambda s: "".join(chr(200 + c) if c != 1 else "?" for c in s)  # noqa: E731  "?" is in no sample
    for i, lang in enumerate(p.langs):
        for j, s in enumerate(syms):
            want = sum(greedy(text_of(s[a:a + SEGMENT]), text_of(plain[lang])) for a in range(0, len(s), SEGMENT))
            assert got[i, j] == want


def rows(n):
    rng = random.Random(7)
    syl = {"en": "th er on an re he in ed nd ha at en es of or nt ea ti".split(), "de": "en er ch der ie sch ein ung zu keit auf öß".split(),
           "es": "os ción ar ra ado mente que llo ña ita".split()}
    out = []
    for k in range(n):
        lang = rng.choice(sorted(syl))
        out.append((k, " ".join("".join(rng.choices(syl[lang], k=rng.randrange(1, 4))) for _ in range(rng.randrange(12, 200))).title(), "s", lang))
    return out


def test_held_out_accuracy(make_docs, hard_rows):
    data = rows(300)
    odd = [(1000, None, "s", "en"), (1001, "12 34 --", "s", None), (1002, "", None, "de"), (None, "ein der keit und sch", "s", "de")]
    got = identify(make_docs(data + odd, extra=("lang_pred", "score"))).collect()
    want = {r[0]: r[3] for r in data}
    assert len(got) == len(data) + 4
    held = [r for r in got if r.doc_id in want and r.held_out]
    assert len(held) > 40 and np.mean([r.lang_pred == want[r.doc_id] for r in held]) > 0.97
    assert all(0 <= r.score <= 1 and r.held_out == (zlib.crc32(str("" if r.doc_id is None else r.doc_id).encode()) % 4 == 2) for r in got)
    assert {r.doc_id: (r.lang_pred, r.score) for r in got if r.doc_id in (1000, 1001, 1002)} == {k: ("und", 0.0) for k in (1000, 1001, 1002)}
    assert [r.lang_pred for r in got if r.doc_id is None] == ["de"]


def test_nothing_learned(make_docs):
    assert identify(make_docs([])).count() == 0
    assert [r.lang_pred for r in identify(make_docs([(1, "some text", "s", None)])).collect()] == ["und"]
    assert {r.lang_pred for r in identify(make_docs([(k, "some text", "s", "en") for k in range(9)])).collect()} == {"en"}


def test_tiny_language_shortens_no_other(make_docs):
    """One short row of a rare language costs the others nothing, and is itself known again."""
    rng = random.Random(13)
    syl = {"bb": "abc def gh".split(), "cc": "cba fed hg".split(), "dd": "bda ech fg".split()}  # the same letters
    data = [(k, "Abc " + " ".join("".join(rng.choices(syl[n], k=3)) for _ in range(30)), "s", n)
            for k, n in enumerate(rng.choice(sorted(syl)) for _ in range(300))]
    tiny = next(k for k in range(5000, 5100) if zlib.crc32(str(k).encode()) % 4 != 2)
    got = identify(make_docs([*data, (tiny, "Hola", "s", "aa"), (6000, "hola", "s", None)])).collect()
    want = {r[0]: r[3] for r in data}
    held = [r for r in got if r.doc_id in want and r.held_out]
    assert len(held) > 40 and np.mean([r.lang_pred == want[r.doc_id] for r in held]) > 0.97
    assert {r.lang_pred for r in got if r.doc_id in (tiny, 6000)} == {"aa"}


def test_large_alphabets(make_docs):
    """Chinese, Japanese and Korean beside a Latin language: more letters than a byte holds."""
    rng = random.Random(11)
    han = [chr(0x4E00 + 7 * k) for k in range(900)]
    letters = {"ja": [chr(c) for c in range(0x3041, 0x3094)] + han[600:], "ko": [chr(0xAC00 + 9 * k) for k in range(900)],
               "zh": han[:800], "en": list("etaoinshrdlu")}
    data = []
    for k in range(400):
        lang = sorted(letters)[k % 4]
        data.append((k, " ".join("".join(rng.choices(letters[lang], k=rng.randrange(1, 9))) for _ in range(60)), "s", lang))
    want = {r[0]: r[3] for r in data}
    held = [r for r in identify(make_docs(data)).collect() if r.held_out]
    assert len(held) > 60 and np.mean([r.lang_pred == want[r.doc_id] for r in held]) > 0.97
