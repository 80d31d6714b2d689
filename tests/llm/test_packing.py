"""Packing: exact round trip of ids, little padding, source proportions in every window."""
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from marketgrid.llm.packing import pack, tail_sizes, window_starts
from marketgrid.llm.prefix import running_sum
from marketgrid.llm.queries import tokenizer_path


@pytest.fixture(scope="module")
def plain():
    tok = Tokenizer.from_file(tokenizer_path())
    return lambda t: [*tok.encode(t or "", add_special_tokens=False).ids, 1]


def check(got, rows, plain, window):
    ids = defaultdict(list)
    for r in rows:
        ids[r[0]].append(plain(r[1]))
    total = sum(len(x) for v in ids.values() for x in v)
    pieces = defaultdict(list)
    for r in got:
        pieces[r.doc_id].append(r)
    assert set(pieces) == set(ids)
    for d, ps in pieces.items():
        covered = Counter()
        for p in ps:
            assert any(p.doc_tokens == len(x) and zlib.crc32(np.array(x[p.start:p.start + p.length], "<u4").tobytes()) == p.ids_crc32
                       for x in ids[d])
            covered.update(range(p.start, p.start + p.length))
        assert covered == sum((Counter(range(len(x))) for x in ids[d]), Counter())
    seqs = defaultdict(list)
    for r in got:
        seqs[r.sequence_id].append((r.offset, r.length))
    for parts in seqs.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at and n > 0
            at += n
        assert at == window or at <= window and at & (at - 1) == 0
    assert sum(n for s in seqs.values() for _, n in s) == total
    assert sorted(seqs) == list(range(len(seqs)))


def test_round_trip(make_docs, hard_rows, plain):
    rows = [r[:3] for r in hard_rows] + [(40, "<|endoftext|>x <|startoftext|> y", "s9"), (41, "it's 12ª ﬁ Å ΑΣ Σ ́ é  z", "s9")]
    docs = make_docs(rows, extra=("row", "ids", "n", "T", "k", "place", "__g", "s"))
    check(pack(docs, tokenizer_path(), window=256, quantum=64).collect(), rows, plain, 256)


def test_proportions(make_docs, plain):
    from samples import prose
    rng = random.Random(8)
    rows = [(k, prose(k, rng.randrange(5, 400)), "hot" if k % 3 else f"s{k % 5}") for k in range(150)]
    got = pack(make_docs(rows), tokenizer_path(), window=512, quantum=32).collect()
    check(got, rows, plain, 512)
    total = Counter()
    for r in rows:
        total[r[2]] += len(plain(r[1]))
    whole = sum(total.values())
    held = defaultdict(Counter)
    for r in got:
        held[r.sequence_id][r.source] += r.length
    sent, goal = Counter(), 0
    for s in range(whole // 512):
        sent.update(held[s])
        goal += 512
        for src, n in total.items():
            assert abs(held[s][src] - 512 * n / whole) <= 2 * 32 + 1
            assert abs(sent[src] - goal * n / whole) <= 2 * 32  # deficits do not grow


def test_empty(make_docs):
    assert pack(make_docs([]), tokenizer_path()).count() == 0


def test_tail():
    assert tail_sizes(0) == [] and tail_sizes(1000) == [512, 256, 128, 64, 32, 8]
    assert window_starts(2048 * 3, 2048) == [6144] and window_starts(5, 4) == [4, 5]


def test_running_sum(spark):
    from pyspark.sql import functions as F
    rows = [(g, k, (k * 7) % 5) for g in (None, "a", "b") for k in range(500)]
    df = spark.createDataFrame(rows, "g string, k long, n long").repartition(7)
    got = running_sum(df, F.col("g"), ["k"], "n", "before").collect()
    for g in (None, "a", "b"):
        at = 0
        for r in sorted((r for r in got if r.g == g), key=lambda r: r.k):
            assert r.before == at
            at += r.n
