"""Prefix trie against a dictionary of prefixes, over one and many shards."""

import hashlib
import random
import zlib

import pytest

from marketgrid.llm import turn_trie as T

SCHEMA = "conv_id long, turn long, role string, text string"
FIGURES = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def brute(rows, family=100, heads=6):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append(((turn is not None, turn or 0), role or "", text or ""))
    for c, turns in own.items():
        def key(t):
            whole = f"{len(t[1].encode())}:{t[1]}{t[2]}".encode()
            return t[0], hashlib.sha256(whole).digest()[:16]
        own[c] = [(r, x) for _, r, x in sorted(turns, key=key)]
    nodes = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % heads
        seq = tuple(own.get(c - c % family, [])[:h] + turns[h:])
        for d in range(len(seq) + 1):
            node = nodes.setdefault(seq[:d], {"members": [], "ends": []})
            node["members"].append(c)
            if d == len(seq):
                node["ends"].append(c)
    out = {}
    for p, v in nodes.items():
        below = [q for q in nodes if q[:len(p)] == p]
        kids = {q: sum(1 for r in nodes if len(r) == len(q) + 1 and r[:len(q)] == q) for q in below}
        out[(len(p), min(v["members"]))] = (
            min(v["members"]), len(p), min(nodes[p[:-1]]["members"]) if p else None, len(v["members"]), kids[p],
            sum(1 for q in below if not kids[q]),
            sum((len(nodes[q]["members"]) - 1) * (len(q[-1][1]) if q else 0) for q in below),
            hashlib.sha256(",".join(map(str, sorted(v["ends"]))).encode()).hexdigest())
    return sorted(out.values(), key=lambda r: r[:2])


def got(spark, rows, **kw):
    df = spark.createDataFrame(rows, SCHEMA) if rows else spark.createDataFrame([], SCHEMA)
    found = T.trie_nodes(T.rebuilt(df), **kw)
    return sorted((tuple(r[c] for c in FIGURES) for r in found.collect()), key=lambda r: r[:2])


def sample(seed, convs, words, longest):
    rng = random.Random(seed)
    rows = []
    for c in range(convs):
        for t in range(rng.randint(1, longest)):
            rows.append((c, t, rng.choice(("user", "bot")), "é" * rng.randint(0, 2) + rng.choice(words)))
    return rows


@pytest.mark.parametrize("shard_turns", [7, 60, 10_000])
def test_equals_brute_force(spark, shard_turns):
    rows = sample(shard_turns, 130, ["a", "b"], 5)
    assert got(spark, rows, shard_turns=shard_turns) == brute(rows)


def test_copies_over_many_shards(spark):
    """Half of all conversations are one sequence, which many shards share; all deeper nodes lie behind it."""
    same = [(c, t, "user", "same") for c in range(100, 160) for t in range(7)]
    rows = same + sample(3, 60, ["x", "same", "y"], 6)
    assert got(spark, rows, shard_turns=20) == brute(rows)


def test_long_conversation_beside_short_ones(spark):
    rows = [(5, t, "user", "w%d" % (t % 3)) for t in range(200)] + [(6, t, "user", "w%d" % (t % 3)) for t in range(150)]
    rows += sample(9, 20, ["w0", "w1"], 3)[:40]
    assert got(spark, rows, shard_turns=60) == brute(rows)


def test_defined_cases(spark):
    rows = [(None, 0, "user", "lost"), (100, 1, None, "a"), (100, None, "user", None), (100, 1, "user", "b"),
            (100, 1, "user", "b"), (101, 0, "", ""), (250, 3, "user", "z")]
    assert got(spark, rows) == brute(rows)
    assert got(spark, rows, shard_turns=2) == brute(rows)
    assert got(spark, []) == []


def test_clashing_columns(spark):
    rows = sample(1, 20, ["a", "b"], 4)
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA + ", depth int, digests string")
    found = T.trie_nodes(T.rebuilt(df), shard_turns=30)
    assert sorted((tuple(r[c] for c in FIGURES) for r in found.collect()), key=lambda r: r[:2]) == brute(rows)
