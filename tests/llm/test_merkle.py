"""Merkle manifest against trees built whole, and witnesses that prove or refute a row."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from marketgrid.llm import merkle as M

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"
COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def tree(leaves, fanout):
    """(root, siblings of every leaf, level by level) of a tree built whole."""
    paths, level, owners = [[] for _ in leaves], list(leaves), [[k] for k in range(len(leaves))]
    while len(level) > 1:
        up, up_owners = [], []
        for a in range(0, len(level), fanout):
            run = level[a:a + fanout]
            for k in range(len(run)):
                for leaf in owners[a + k]:
                    paths[leaf].append("".join(run[:k] + run[k + 1:]))
            up.append(sha("".join(run)))
            up_owners.append([x for o in owners[a:a + fanout] for x in o])
        level, owners = up, up_owners
    return level[0], paths


def brute(rows, fanout=16):
    def leaf(row):
        return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append(r)
    out, heads = [], []
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    for s in order:
        found = sorted(((r[0] is not None, r[0] or 0, leaf(r), r) for r in groups[s]), key=lambda x: x[:3])
        root, paths = tree([x[2] for x in found], fanout)
        heads.append((root, [(x[3][0], s, x[2], p) for x, p in zip(found, paths)]))
    root, tops = tree([h for h, _ in heads], fanout) if heads else (None, [])
    for (sub, items), top in zip(heads, tops):
        out += [(i, s, x, sub, root, "".join(p + top)) for i, s, x, p in items]
    return sorted(out, key=repr)


def rows_of(df):
    return sorted(((r.doc_id, r.source, r.leaf, r.subroot, r.root, "".join(r.siblings)) for r in df.collect()), key=repr)


def sample(n, sources, seed=1):
    rng = random.Random(seed)
    return [(k, "hot" if rng.random() < .4 else rng.choice(sources), rng.choice(["en", None]), rng.randint(0, 9),
             rng.choice(["Alpha", "BETA é", "", None, "gamma"])) for k in range(n)]


@pytest.mark.parametrize("n", [1, 2, 16, 17, 300, 700])
def test_equals_whole_trees(spark, n):
    rows = sample(n, ["a", "b", "é", None])
    assert rows_of(M.manifest(spark.createDataFrame(rows, SCHEMA), COLUMNS)) == brute(rows)


def test_many_rounds(spark):
    """Blocks of one level: three rounds for the hot group, two for the groups' tree."""
    rows = sample(700, ["s%d" % k for k in range(40)])
    found = M.manifest(spark.createDataFrame(rows, SCHEMA), COLUMNS, block_levels=1)
    assert rows_of(found) == brute(rows) and found.filter("not verified").isEmpty()


def test_tampered_rows_are_refuted(spark):
    rows = sample(120, ["a", "b"])
    found = M.manifest(spark.createDataFrame(rows, SCHEMA), COLUMNS, tampered=(F.col("doc_id") % 3 == 0, "text")).collect()
    changed = {r[0] for r in rows if r[0] % 3 == 0 and r[4] and r[4] != r[4].lower()}
    assert changed and {r.doc_id for r in found if not r.verified} == changed
    assert all((r.folded_root == r.root) == r.verified for r in found)


def test_defined_cases(spark):
    rows = [(None, None, None, None, None), (None, None, None, None, None), (3, None, "en", 1, "x"), (3, None, "en", 1, "y"),
            (4, "", "en", 1, "x"), (5, "s", "en", 1, "word " * 50_000), (6, "s", "en", 0, "")]
    df = spark.createDataFrame(rows, SCHEMA)
    assert rows_of(M.manifest(df, COLUMNS)) == brute(rows)
    assert M.manifest(df.filter("false"), COLUMNS).collect() == []
    more = df.withColumns({"leaf": F.lit("z"), "root": F.lit(1), "grp": F.lit(2), "rank": F.lit(3), "n": F.lit(4)})
    assert rows_of(M.manifest(more, COLUMNS)) == brute(rows)


def test_appender_is_incremental():
    """A leaf's witness only ever grows, and is complete once its siblings are there."""
    leaves = [sha(str(k)) for k in range(40)]
    grown, seen = M.Appender(4), []
    for x in leaves:
        grown.append(x)
        for old, now in zip(seen, grown.witness):
            assert now[:len(old)] == old
        seen = [list(w) for w in grown.witness]
    root = grown.close(M.levels_of(40, 4))
    whole, paths = tree(leaves, 4)
    assert root == whole and [[s for _, s in w] for w in grown.witness] == paths
    assert all(M.fold(x, w) == root for x, w in zip(leaves, grown.witness))
