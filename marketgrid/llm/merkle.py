"""Merkle manifest of a dataset, with a witness for every row, built by appends.

A row's leaf hashes its columns.  Per group (a dataset's source) the leaves, in
order, are appended to a tree of ``FANOUT`` children a node; the group roots, in
order, are appended to one more tree, whose root names the whole dataset.  A
row's witness is, level by level, the texts of its run's siblings: with them the
row alone proves that it belongs to the root.

Witnesses are built while appending: each open run holds its nodes, each node
the leaves beneath it, and each leaf its partial witness.  The arrival of a
run's last sibling completes it: every leaf beneath gets the other siblings of
its node, and the new node is appended to the level above.

Distribution: leaves are ranked within their group by a range partitioning on
(group, order) plus one count per task and group, then cut into blocks of
``FANOUT ** BLOCK_LEVELS`` ranks.  An aligned block is a subtree, so each is
appended in a task of its own, and block roots are appended in the next round
just as leaves were, until every group has one node.  So a group with a third of
all rows is many blocks in many tasks, a round moves 1/4096 of the round before
(three rounds for 6.8e10 rows a group), and what a task holds is one block.
Going back, every block's rows take the witness of the block's own root as
their upper part, from a join on (group, block).  Groups are handled alike when
their roots are appended: one group of roots.

Defined cases: a null column enters the leaf as ``-``; null groups are a group
that comes first; a null key comes first in its group; rows that repeat a key
are ordered by their leaf, equal rows are leaves of their own; an empty table
gives no rows; a group of one row has that leaf as its root and an empty part of
the witness; other columns play no part (the operator selects what it hashes).
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, python_ready, stored

FANOUT = 16
BLOCK_LEVELS = 3


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


class Appender:
    """A growing tree: open runs by level, and the partial witness of every appended leaf.

    ``witness[k]`` lists (place in the run, texts of the other siblings) for each
    completed level above leaf k, lowest first.
    """

    def __init__(self, fanout: int = FANOUT):
        self.fanout = fanout
        self.open: list[list[tuple[str, int, int]]] = [[]]
        self.witness: list[list[tuple[int, str]]] = []

    def append(self, leaf: str) -> None:
        at = len(self.witness)
        self.witness.append([])
        self._arrive(0, leaf, at, at + 1)

    def _arrive(self, level: int, node: str, first: int, last: int) -> None:
        run = self.open[level]
        run.append((node, first, last))
        if len(run) == self.fanout:
            self._complete(level)

    def _complete(self, level: int) -> None:
        run, self.open[level] = self.open[level], []
        whole = "".join(node for node, _, _ in run)
        for place, (node, first, last) in enumerate(run):
            step = (place, whole[:len(node) * place] + whole[len(node) * (place + 1):])
            for leaf in range(first, last):
                self.witness[leaf].append(step)
        if level + 1 == len(self.open):
            self.open.append([])
        self._arrive(level + 1, digest(whole), run[0][1], run[-1][2])

    def close(self, levels: int) -> str:
        """Complete the last runs, also shorter ones, of ``levels`` levels; the node above them all."""
        for level in range(levels):
            if self.open[level]:
                self._complete(level)
        (root, _, _), = self.open[levels]
        return root


def levels_of(n: int, fanout: int = FANOUT) -> int:
    """Levels above ``n`` leaves until one node remains."""
    levels = 0
    while n > 1:
        n, levels = -(-n // fanout), levels + 1
    return levels


def fold(leaf: str, steps) -> str:
    """The root that a leaf and its witness prove."""
    for place, others in steps:
        at = place * len(leaf)
        leaf = digest(others[:at] + leaf + others[at:])
    return leaf


def leaf_of(columns: list[Column]) -> Column:
    """SHA-256 (hex) over the columns: ``-`` for null, else byte count, ``:``, value."""
    def part(c: Column) -> Column:
        text = c.cast("string")
        return F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))
    return F.sha2(F.concat(*[part(c) for c in columns]), 256)


GROUP = ["known", "grp"]  # a null group is (false, ""), so that it comes first and plain equalities match it


def _ranked(items: DataFrame, order: list[str]) -> DataFrame:
    """``items`` with rank (from 0, within its group by ``order``) and n, the size of its group."""
    python_ready(items.sparkSession)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in items.schema.fields) + ", pid long, place long"
    known, grp = (items.columns.index(c) for c in GROUP)
    names = [*items.columns, "pid", "place"]

    def number(batches):
        pid, last, seen = TaskContext.get().partitionId(), None, 0
        for b in batches:
            place = []
            for g in zip(b.column(known).to_pylist(), b.column(grp).to_pylist()):
                seen = seen + 1 if g == last else 0
                last = g
                place.append(seen)
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array([pid] * b.num_rows, pa.int64()), pa.array(place, pa.int64())], names=names)

    ranged = items.repartitionByRange(*GROUP, *order).sortWithinPartitions(*GROUP, *order)
    ranged = stored(ranged.mapInArrow(number, schema), "merkle-ranged")
    whole = Window.partitionBy(*GROUP)
    earlier = whole.orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    counts = ranged.groupBy(*GROUP, "pid").agg(F.count(F.lit(1)).alias("c"))
    counts = stored(counts.select(*GROUP, "pid", F.coalesce(F.sum("c").over(earlier), F.lit(0)).alias("before"),
                                  F.sum("c").over(whole).alias("n")), "merkle-counts")
    return ranged.join(counts, [*GROUP, "pid"]) \
        .select(*items.columns, (F.col("place") + F.col("before")).alias("rank"), "n")


def _appended(table: pa.Table, block_levels: int) -> tuple[pa.Table, Appender, str]:
    """A block's rows in order, the tree they were appended to, and its root."""
    table = table.sort_by("rank")
    tree = Appender()
    for leaf in table.column("digest").to_pylist():
        tree.append(leaf)
    return table, tree, tree.close(min(block_levels, levels_of(table.column("n")[0].as_py())))


def _blocks(ranked: DataFrame, block_levels: int) -> DataFrame:
    return ranked.withColumn("block", F.expr(f"rank div {FANOUT ** block_levels}"))


def _block_roots(ranked: DataFrame, block_levels: int) -> DataFrame:
    """(known, grp, rank, n, digest): the aligned blocks' roots, n of them in the group, as the next round's items."""
    def run(table: pa.Table) -> pa.Table:
        table, _, root = _appended(table, block_levels)
        n = table.column("n")[0].as_py()
        return pa.table({"known": table.column("known").slice(0, 1), "grp": table.column("grp").slice(0, 1),
                         "rank": table.column("block").slice(0, 1),
                         "n": pa.array([-(-n // FANOUT ** block_levels)], pa.int64()), "digest": pa.array([root])})

    rows = _blocks(ranked, block_levels).select(*GROUP, "block", "rank", "n", "digest")
    return rows.groupBy(*GROUP, "block").applyInArrow(run, "known boolean, grp string, rank long, n long, digest string")


def _climb(items: DataFrame, order: list[str], block_levels: int) -> tuple[list[DataFrame], list[DataFrame]]:
    """The items of every round, and the block roots that each round leaves."""
    rounds = [stored(_ranked(items, order), "merkle-items")]
    roots = []
    while True:
        roots.append(stored(_block_roots(rounds[-1], block_levels), "merkle-roots"))
        if roots[-1].filter("n > 1").isEmpty():
            return rounds, roots
        rounds.append(roots[-1].filter("n > 1"))


HEAD = "known boolean, grp string, rank long, subroot string, root string, places array<int>, siblings array<string>"


def _descend(rounds: list[DataFrame], roots: list[DataFrame], heads: DataFrame, carry: list[str],
             block_levels: int) -> DataFrame:
    """Witnesses of the first round's items: ``carry`` columns and those of HEAD.

    ``heads`` holds, per group, the roots and the witness above its own root.
    """
    above = None
    for k in range(len(rounds) - 1, -1, -1):
        ends = roots[k].filter("n = 1").join(heads, GROUP).select(
            *GROUP, "rank", "subroot", "root", "places", "siblings")
        above = ends if above is None else ends.unionByName(above)
        keep = carry if k == 0 else []
        above = _witnessed(rounds[k], above, keep, block_levels)
        if k:
            above = stored(above, "merkle-above")
    return above


def _witnessed(items: DataFrame, above: DataFrame, carry: list[str], block_levels: int) -> DataFrame:
    """Witnesses of the items of one round, under those of their blocks' roots.

    With a carried column ``now`` (the item's present digest, null: unchanged) its fold comes along.
    """
    folds = "now" in carry
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in items.select(*carry).schema.fields) + HEAD \
        + (", folded string" if folds else "")

    def run(table: pa.Table, up: pa.Table) -> pa.Table:
        table, tree, _ = _appended(table, block_levels)
        n = table.num_rows
        upper = list(zip(up.column("places")[0].as_py(), up.column("siblings")[0].as_py()))
        witness = [w + upper for w in tree.witness]
        columns = [*(table.column(c) for c in [*carry, *GROUP, "rank"]),
                   *(pa.repeat(up.column(c)[0], n) for c in ("subroot", "root")),
                   pa.array([[p for p, _ in w] for w in witness], pa.list_(pa.int32())),
                   pa.array([[s for _, s in w] for w in witness], pa.list_(pa.string()))]
        if folds:
            present = zip(table.column("now").to_pylist(), table.column("digest").to_pylist(), witness)
            columns.append(pa.array([fold(now or leaf, w) for now, leaf, w in present], pa.string()))
        return pa.table(columns, names=[*carry, *GROUP, "rank", "subroot", "root", "places", "siblings",
                                        *(["folded"] if folds else [])])

    rows = _blocks(items, block_levels).select(*dict.fromkeys([*carry, *GROUP, "block", "rank", "n", "digest"]))
    up = above.withColumnRenamed("rank", "block")
    return rows.groupBy(*GROUP, "block").cogroup(up.groupBy(*GROUP, "block")).applyInArrow(run, schema)


def append_groups(items: DataFrame, order: list[str], carry: list[str], block_levels: int = BLOCK_LEVELS) -> DataFrame:
    """Witnesses of ``items`` (known, grp, digest, ``order`` and ``carry`` columns), each group
    appended in ``order`` and the groups' roots appended in the order of the groups."""
    rounds, roots = _climb(items, order, block_levels)
    subroots = None
    for r in roots:
        one = r.filter("n = 1").select(*GROUP, "digest")
        subroots = one if subroots is None else subroots.unionByName(one)
    tops = subroots.select(F.lit(True).alias("known"), F.lit("").alias("grp"), F.col("known").alias("k"),
                           F.col("grp").alias("g"), "digest")
    top_rounds, top_roots = _climb(tops, ["k", "g"], block_levels)
    none = [F.array().cast("array<int>").alias("places"), F.array().cast("array<string>").alias("siblings")]
    root = top_roots[-1].select(*GROUP, F.lit("").alias("subroot"), F.col("digest").alias("root"), *none)
    heads = _descend(top_rounds, top_roots, root, ["k", "g", "digest"], block_levels)
    heads = stored(heads.select(F.col("k").alias("known"), F.col("g").alias("grp"), F.col("digest").alias("subroot"),
                                "root", "places", "siblings"), "merkle-heads")
    return _descend(rounds, roots, heads, carry, block_levels)


def manifest(docs: DataFrame, columns: list[str], group: str = "source", key: str = "doc_id",
             tampered: tuple[Column, str] | None = None, block_levels: int = BLOCK_LEVELS) -> DataFrame:
    """(doc_id, source, leaf, subroot, root, places, siblings, folded_root, verified) per row.

    ``siblings`` is the witness: per level, up to the group's root and then up to
    the dataset's, the joined texts of the run's other nodes; ``places`` says
    where the row's own node goes.  ``folded_root`` folds the row's present leaf
    through it.  ``tampered`` = (rows, text column) lower-cases A-Z of that column
    in these rows after the manifest is made, so their present leaf may differ.
    """
    python_ready(docs.sparkSession)
    leaf = leaf_of([F.col(c) for c in columns])
    now = F.lit(None).cast("string")
    if tampered is not None:
        rows, text = tampered
        now = F.when(rows, leaf_of([ascii_lower(F.col(c)) if c == text else F.col(c) for c in columns]))
    source = F.col(group).cast("string")
    items = docs.select(F.col(key).cast("long").alias("doc_id"), source.isNotNull().alias("known"),
                        F.coalesce(source, F.lit("")).alias("grp"), leaf.alias("digest"), now.alias("now"))
    items = stored(items, "merkle-leaves")
    proved = append_groups(items, ["doc_id", "digest"], ["doc_id", "digest", "now"], block_levels)
    return proved.select("doc_id", F.when(F.col("known"), F.col("grp")).alias("source"), F.col("digest").alias("leaf"),
                         "subroot", "root", "places", "siblings", F.col("folded").alias("folded_root"),
                         (F.col("folded") == F.col("root")).alias("verified"))
