"""Quality rules and line dedup against plain Python."""
import hashlib
import re
from collections import Counter, defaultdict

from marketgrid.llm.line_dedup import dedup_lines
from marketgrid.llm.quality import keep_good, score_documents

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def key(line):
    return line.strip(" \t\n\x0b\f\r").translate(LOWER)


def brute_lines(rows, least):
    seen = Counter(k for r in rows for k in {key(x) for x in (r[1] or "").split("\n")})
    out = []
    for r in rows:
        lines = (r[1] or "").split("\n")
        kept = [x for x in lines if not (key(x) and seen[key(x)] >= least)]
        out.append((r[0], len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def brute_quality(rows, least):
    holders = defaultdict(set)
    for r in rows:
        for x in (r[1] or "").split("\n"):
            if key(x):
                holders[r[2], key(x)].add(r[1])
    out = []
    for r in rows:
        text = r[1] or ""
        words, lines = WORD.findall(text), text.split("\n")
        grams = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
        often = Counter(grams)
        rep = {p for i, g in enumerate(grams) if often[g] > 1 for p in (i, i + 1, i + 2)}
        real = [x for x in lines if WORD.search(x)]
        gone = sum(len(WORD.findall(x)) for x in lines if key(x) and len(holders[r[2], key(x)]) >= least)
        failed = len(words) < 50 or 100 * len(rep) > 50 * len(words)
        out.append((r[0], len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)),
                    len(real) - len(set(real)), len(rep), failed, gone,
                    not failed and 2 * (len(words) - gone) >= len(words)))
    return sorted(out, key=str)


def lined(rows):
    """Rows with shared lines: 12 documents hold 'Share ME', 9 hold 'rare'."""
    from samples import prose
    more = [(100 + k, "\n".join([" Share me \t" if k % 2 else "share ME", prose(k, 30), prose(k + 50, 40)]
                                + (["rare"] if k < 9 else [])), "s0") for k in range(12)]
    more += [(200 + k, "Share me\nshare me\n\nx y z", "s1") for k in range(11)]
    more += [(300, "a b c a b c a b c " * 20, "s0"), (301, "x\nx\nX\n x\n# $ % " * 30, None)]
    return [tuple(list(r) + [None] * (3 - len(r))) for r in rows] + more


def test_line_dedup(make_docs, hard_rows):
    rows = lined([r[:3] for r in hard_rows])
    docs = make_docs(rows, extra=("n_lines", "n_dropped", "__h1", "__pos", "line"))
    got = dedup_lines(docs, min_docs=10)
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars", "__h1", "__pos", "line", "n_lines", "n_dropped"]
    assert sorted(((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in got.collect()), key=str) == brute_lines(rows, 10)
    assert any(r[2] for r in brute_lines(rows, 10))


def test_line_dedup_empty(make_docs):
    assert dedup_lines(make_docs([])).count() == 0


def test_quality(make_docs, hard_rows):
    rows = lined([r[:3] for r in hard_rows])
    docs = make_docs(rows, extra=("kept", "n_words", "__gone", "__w", "__id", "__key"))
    got = score_documents(docs, line_docs=10)
    found = sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed,
                     r.n_removed_words, r.kept) for r in got.collect()), key=str)
    want = brute_quality(rows, 10)
    assert found == want
    assert any(w[5] for w in want) and any(w[7] for w in want)
    kept = keep_good(docs, line_docs=10)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(w[0]) for w in want if w[-1])


def test_depleted_rejected_exact_copies_kept(make_docs):
    """Template pages with little of their own are rejected; exact copies of a long text are one document."""
    from samples import prose
    template = [prose(900 + k, 25) for k in range(4)]
    body = [prose(800 + k, 40 + k) for k in range(3)]
    rows = [(k, "\n".join([*template, prose(k, 27)]), "host") for k in range(20)]
    rows += [(100 + k, "\n".join(body), "host") for k in range(40)]
    got = {r.doc_id: r.kept for r in score_documents(make_docs(rows)).collect()}
    assert not any(got[k] for k in range(20)) and all(got[100 + k] for k in range(40))


def test_boilerplate_is_the_longest_line(make_docs):
    """A notice longer than any own line counts by its documents, here of two hosts: ten and nine."""
    from samples import prose
    notice = prose(900, 60)
    rows = [(k, f"{notice}\n{prose(k, 5)}", "ten" if k < 10 else "nine") for k in range(19)]
    rows += [(20, f"{notice}\n{prose(20, 70)}", "ten"), (21, prose(21, 80), "ten")]
    rows += [(9, rows[9][1], "ten")] * 3 + [(18, rows[18][1], "nine")] * 3  # a repeated row is no other document
    got = {r.doc_id: (r.n_removed_words, r.kept) for r in score_documents(make_docs(rows)).collect()}
    assert all(got[k] == (60, False) for k in range(10)) and all(got[k] == (0, True) for k in range(10, 19))
    assert got[20] == (60, True) and got[21] == (0, True)
    assert {r.doc_id for r in keep_good(make_docs(rows)).collect()} == {*range(10, 19), 20, 21}


def test_quality_empty(make_docs):
    assert score_documents(make_docs([])).count() == 0 and keep_good(make_docs([])).count() == 0
