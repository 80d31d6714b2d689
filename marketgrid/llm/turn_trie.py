"""Prefix trie of conversations from padded matrices of turn ids.

A conversation is a sequence of turns; every distinct sequence of first d turns
is a node of depth d, and conversations that start with it are its members.

The conversations are range-partitioned by their sequence of turn digests, then
conv_id, so every node is a run of neighbouring conversations, and a third of
all rows with one sequence are spread by conv_id.  A shard gives each digest a
number (in digest order), lays the sequences out as a matrix padded with zeros,
sorts it with lexsort, and ORs the columns' change masks from left to right:
where the accumulated mask is set, a node starts.  reduceat over the starts then
gives every figure of a depth, and of a subtree from the depth below.  The
matrix is handled in strips of columns that hold only the conversations that
long, so one very long conversation pads no other.

Nodes that hold a shard's first or last conversation may go on next door: these
(two paths a shard) are sent with the digest of their whole prefix and their
shard's share, and recombined by that digest.  Their children and the sums over
their subtrees follow the path: each recombined node hands its figures to its
ancestors in the first shard that holds it, as one running sum along the path.
All other nodes are finished in their shard; those under a boundary node get
their parent's conv_id from it by (shard, path, depth).

The list of members ending in a boundary node is hashed in shard order, one
share at a time: SHA-256 of one text is sequential, so a task reads the shares of
a node one after the other and holds one at a time.

What moves is 20 bytes a turn, not its text.  A conversation's turns are one row,
as a document's text is; nothing else is gathered by key.

Defined cases: rows without a conv_id belong to no conversation; null role or
text is empty; a null turn comes first, and rows that repeat a turn are turns of
their own, ordered by digest; a conversation without turns ends in the root; an
empty table has no nodes; other columns play no part.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import python_ready, stored

STRIP = 64
SHARD_TURNS = 1_000_000


def turn_digest(role: Column, text: Column) -> Column:
    """16 bytes that stand for a turn: of its role's length, role and text."""
    role, text = F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))
    whole = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    return F.unhex(F.substring(F.sha2(whole, 256), 1, 32))


def own_turns(rows: DataFrame, family: int) -> DataFrame:
    """(conv_id, base, turns): each conversation's turns in order as (digest, length of the text)."""
    turns = rows.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        turn_digest(F.col("role"), F.col("text")).alias("d"),
        F.coalesce(F.length("text"), F.lit(0)).alias("n"))
    turns = turns.withColumn("base", F.col("conv_id") - F.col("conv_id") % family)
    # dealt by family once: the grouping and the join with the family's first conversation need no other exchange
    packed = F.array_sort(F.collect_list(F.struct(F.col("turn").isNotNull().alias("t0"), F.coalesce("turn", F.lit(0)).alias("t"),
                                                  "d", "n")))
    return turns.repartition("base").groupBy("base", "conv_id").agg(packed.alias("turns"))


def rebuilt(rows: DataFrame, family: int = 100, heads: int = 6) -> DataFrame:
    """(conv_id, digests, lengths): first h turns of the family's first conversation, then the own ones after h.

    h is the CRC-32 of the decimal conv_id modulo ``heads``.
    """
    own = own_turns(rows, family)
    first = own.filter(F.col("conv_id") == F.col("base")) \
        .select("base", F.slice("turns", 1, heads - 1).alias("lead"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads).cast("int")
    both = own.join(first, "base", "left").withColumn("h", h)
    none = F.slice("turns", 1, 0)
    turns = F.concat(F.coalesce(F.slice("lead", 1, F.col("h")), none),
                     F.when(F.size("turns") > F.col("h"), F.slice("turns", F.col("h") + 1, F.size("turns"))).otherwise(none))
    return both.select("conv_id", turns.alias("turns")).select(
        "conv_id", F.col("turns.d").alias("digests"), F.col("turns.n").alias("lengths"))


# --- one shard ---------------------------------------------------------------

def _numbered(digests: np.ndarray) -> np.ndarray:
    """Number (from 1, in byte order) of each 16-byte digest."""
    hi, lo = np.ascontiguousarray(digests).view(">u8").reshape(-1, 2).astype(np.uint64).T
    order = np.lexsort((lo, hi))
    new = np.ones(len(order), bool)
    new[1:] = (hi[order][1:] != hi[order][:-1]) | (lo[order][1:] != lo[order][:-1])
    out = np.empty(len(order), np.int32)
    out[order] = np.cumsum(new)
    return out


def _strip(values: np.ndarray, start: np.ndarray, size: np.ndarray, rows: np.ndarray, at: int) -> np.ndarray:
    """Columns at..at+STRIP of the padded matrix, for the given rows."""
    column = np.arange(at, min(at + STRIP, int(size[rows].max())))
    there = column < size[rows, None]
    return np.where(there, values[np.where(there, start[rows, None] + column, 0)], 0)


def _sorted_rows(ids: np.ndarray, start: np.ndarray, size: np.ndarray, conv: np.ndarray) -> np.ndarray:
    """Order of the rows by sequence, then conv_id: lexsort of the strips, last one first."""
    order = np.argsort(conv, kind="stable")
    for at in range((int(size.max()) - 1) // STRIP * STRIP, -1, -STRIP):
        long = size[order] > at
        rows = order[long]  # those not this long have only padding here, which comes first
        order = np.concatenate((order[~long], rows[np.lexsort(_strip(ids, start, size, rows, at).T[::-1])]))
    return order


class Level:
    """The nodes of one depth, as runs of the rows that are at least this deep."""

    def __init__(self, rows, starts, parent, conv, size, last_length, depth):
        self.rows, self.starts, self.parent = rows, starts, parent
        self.conv = np.minimum.reduceat(conv[rows], starts)
        self.n_convs = np.diff(np.append(starts, len(rows)))
        self.length = last_length
        self.n_ends = np.add.reduceat((size[rows] == depth).astype(np.int64), starts)


def levels(ids: np.ndarray, lengths: np.ndarray, start: np.ndarray, size: np.ndarray, conv: np.ndarray) -> list[Level]:
    """Levels of the trie over rows that are already in order."""
    n = len(conv)
    out = [Level(np.arange(n), np.zeros(1, np.int64), np.zeros(1, np.int64), conv, size, np.zeros(1, np.int64), 0)]
    node = np.zeros(n, np.int64)  # of the level before, by row
    changed = np.zeros(n, bool)  # the OR of the change masks so far
    changed[0] = True
    deepest = int(size.max()) if n else 0
    for at in range(0, deepest, STRIP):
        rows = np.flatnonzero(size > at)
        block = _strip(ids, start, size, rows, at)
        before = np.zeros_like(block)
        near = rows[1:] == rows[:-1] + 1
        before[1:][near] = block[:-1][near]  # a shorter neighbour has only padding here
        mask = np.logical_or.accumulate(np.column_stack((changed[rows], block != before)), axis=1)[:, 1:]
        for k in range(block.shape[1]):
            depth, here = at + k + 1, block[:, k] > 0
            deep, first = rows[here], np.flatnonzero(mask[here, k])
            out.append(Level(deep, first, node[deep[first]], conv, size,
                             lengths[start[deep[first]] + depth - 1].astype(np.int64), depth))
            node[deep] = np.cumsum(mask[here, k]) - 1
        changed[rows] = mask[:, -1]
    return out


def _to_parents(parent: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Sums of the children's values for each of n parents (children lie in their order)."""
    out = np.zeros(n, np.int64)
    if len(parent):
        first = np.flatnonzero(np.concatenate(([True], parent[1:] != parent[:-1])))
        out[parent[first]] = np.add.reduceat(values, first)
    return out


NODE = ("shard long, path int, depth int, key binary, pkey binary, ppath int, conv_id long, parent_conv_id long, "
        "n_convs long, n_children long, n_leaves long, saved_tokens long, length long, ends string")


def _shard_nodes(shard: int, table: pa.Table) -> pa.Table:
    """All nodes of a shard: finished ones (path null), and its shares of boundary nodes.

    path 0 leads to the first conversation, path 1 to the last; a node on both is on path 0, and has an
    empty share on path 1.
    """
    conv = table.column("conv_id").to_numpy()
    lists = table.column("digests").combine_chunks()
    size = np.diff(lists.offsets.to_numpy()).astype(np.int64)
    flat = lists.flatten()
    body = flat.buffers()[2]  # digests lie one after the other
    raw = np.frombuffer(body, np.uint8)[16 * flat.offset:16 * (flat.offset + len(flat))].reshape(-1, 16) \
        if len(flat) else np.zeros((0, 16), np.uint8)
    lengths = table.column("lengths").combine_chunks().flatten().to_numpy(zero_copy_only=False)
    start = np.cumsum(size) - size
    ids = _numbered(raw) if len(raw) else np.zeros(1, np.int32)
    order = _sorted_rows(ids, start, size, conv) if len(raw) else np.argsort(conv, kind="stable")
    conv, size, start = conv[order], size[order], start[order]
    tree = levels(ids, lengths, start, size, conv)

    n = len(conv)
    edge = []  # by level: node number of path 0 and path 1, -1 where the path has ended
    for level in tree:
        edge.append((0 if len(level.rows) and level.rows[0] == 0 else -1,
                     len(level.starts) - 1 if len(level.rows) and level.rows[-1] == n - 1 else -1))
    inner = [np.ones(len(v.starts), bool) for v in tree]
    for v, ends in zip(inner, edge):
        for e in ends:
            if e >= 0:
                v[e] = False

    # upwards: children, leaves and saved tokens that this shard knows for certain
    kids = [np.zeros(len(v.starts), np.int64) for v in tree]
    leaves = [np.zeros(len(v.starts), np.int64) for v in tree]
    saved = [np.zeros(len(v.starts), np.int64) for v in tree]
    for d in range(len(tree) - 1, -1, -1):
        level, sure = tree[d], inner[d]
        leaves[d] += sure & (kids[d] == 0)
        saved[d] += np.where(sure, (level.n_convs - 1) * level.length, 0)
        if d:
            m = len(tree[d - 1].starts)
            kids[d - 1] += _to_parents(level.parent, sure.astype(np.int64), m)
            # a boundary node's own share goes up along its path, not here
            leaves[d - 1] += _to_parents(level.parent, np.where(sure, leaves[d], 0), m)
            saved[d - 1] += _to_parents(level.parent, np.where(sure, saved[d], 0), m)

    keys = []  # digests of the two paths' prefixes
    for row in (0, n - 1):
        chain = [b"\0" * 16]
        for k in range(int(size[row])):
            chain.append(hashlib.sha256(chain[-1] + raw[start[row] + k].tobytes()).digest()[:16])
        keys.append(chain)

    def ends_of(level: Level, k: int) -> str:
        a = int(level.starts[k])
        return ",".join(map(str, conv[level.rows[a:a + int(level.n_ends[k])]].tolist()))

    out: list[list] = [[] for _ in range(14)]

    def add(*values):
        for column, value in zip(out, values):
            column.append(value)

    blank = hashlib.sha256(b"").hexdigest()
    parts = []
    for d, level in enumerate(tree):
        first, last = edge[d]
        for path, e in ((0, first), (1, last)):
            if e < 0:
                continue
            pkey = keys[path][d - 1] if d else None
            if path == 1 and e == first:
                add(shard, 1, d, keys[1][d], pkey, None, int(level.conv[e]), None, 0, 0, 0, 0, 0, None)
                continue
            add(shard, path, d, keys[path][d], pkey, None, int(level.conv[e]), None, int(level.n_convs[e]),
                int(kids[d][e]), int(leaves[d][e]), int(saved[d][e]), int(level.length[e]),
                ends_of(level, e) if level.n_ends[e] else None)
        sure = np.flatnonzero(inner[d])
        if not len(sure):
            continue
        up, above = level.parent[sure], tree[d - 1]
        ppath = np.where(up == edge[d - 1][0], 0, np.where(up == edge[d - 1][1], 1, -1))
        ended = level.n_ends[sure] > 0
        hashes = [hashlib.sha256(ends_of(level, k).encode()).hexdigest() if e else blank for k, e in zip(sure.tolist(), ended)]
        m = len(sure)
        parts.append([pa.array([shard] * m, pa.int64()), pa.nulls(m, pa.int32()), pa.array([d] * m, pa.int32()),
                      pa.nulls(m, pa.binary()), pa.nulls(m, pa.binary()), pa.array(ppath.astype(np.int32), mask=ppath < 0),
                      pa.array(level.conv[sure]), pa.array(above.conv[up], mask=ppath >= 0),
                      pa.array(level.n_convs[sure]), pa.array(kids[d][sure]), pa.array(leaves[d][sure]),
                      pa.array(saved[d][sure]), pa.array(level.length[sure]), pa.array(hashes, pa.string())])
    types = [pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.int32(), *[pa.int64()] * 7, pa.string()]
    names = [c.split()[0] for c in NODE.split(", ")]
    tables = [pa.table([pa.array(c, t) for c, t in zip(out, types)], names=names)]
    tables += [pa.table(p, names=names) for p in parts]
    return pa.concat_tables(tables)


def _shards(convs: DataFrame, shard_turns: int) -> DataFrame:
    spark = convs.sparkSession
    total = convs.agg(F.sum(F.size("digests") + 1)).first()[0] or 0
    cores = spark.sparkContext.defaultParallelism
    count = max(-(-total // shard_turns), min(cores, -(-total // (shard_turns // 100 or 1))), 1)

    def run(batches):
        held = list(batches)
        if sum(b.num_rows for b in held):
            yield from _shard_nodes(TaskContext.get().partitionId(), pa.Table.from_batches(held)).to_batches(50_000)

    python_ready(spark)
    return convs.repartitionByRange(count, "digests", "conv_id").mapInArrow(run, NODE)


# --- boundary nodes ----------------------------------------------------------

def _hashed_ends(shares: DataFrame) -> DataFrame:
    """(key, ends_sha256) over the shares (key, shard, path, ends) of each node, in shard order."""
    def run(batches):
        key, state, out = None, None, []
        for b in batches:
            for k, text in zip(b.column(0).to_pylist(), b.column(3).to_pylist()):
                if k != key:
                    if key is not None:
                        out.append((key, state.hexdigest()))
                    key, state = k, hashlib.sha256(text.encode())
                else:
                    state.update(b"," + text.encode())
        if key is not None:
            out.append((key, state.hexdigest()))
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in out], pa.binary()), pa.array([h for _, h in out], pa.string())],
                                         names=["key", "ends_sha256"])

    return shares.repartition("key").sortWithinPartitions("key", "shard", "path") \
        .mapInArrow(run, "key binary, ends_sha256 string")


FIGURES = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def _recombined(shares: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Boundary nodes from their shares: (finished nodes, conv_id by shard, path and depth)."""
    place = F.col("shard") * 2 + F.col("path")
    whole = stored(shares.groupBy("key").agg(
        F.first("depth").alias("depth"), F.first("pkey").alias("pkey"), F.min(place).alias("home"), F.min("conv_id").alias("conv_id"),
        F.sum("n_convs").alias("n_convs"), F.sum("n_children").alias("inner"), F.sum("n_leaves").alias("leaves"),
        F.sum("saved_tokens").alias("saved"), F.max("length").alias("length")), "trie-whole")
    met = whole.filter(F.col("pkey").isNotNull()).groupBy(F.col("pkey").alias("k")).agg(F.count(F.lit(1)).alias("met"))
    whole = stored(whole.join(met, whole["key"] == met["k"], "left").drop("k")
                   .withColumn("n_children", F.col("inner") + F.coalesce("met", F.lit(0)))
                   .withColumn("leaves", F.col("leaves") + (F.col("n_children") == 0).cast("long"))
                   .withColumn("saved", F.col("saved") + (F.col("n_convs") - 1) * F.col("length")), "trie-counted")
    # every node's figures go to itself and its ancestors, along the path in its first shard
    at_home = shares.select("key", place.alias("home"), "depth").join(
        whole.select("key", "home", "leaves", "saved"), ["key", "home"], "left")
    upward = Window.partitionBy("home").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    sums = at_home.select("key", F.coalesce(F.sum("leaves").over(upward), F.lit(0)).alias("l"),
                          F.coalesce(F.sum("saved").over(upward), F.lit(0)).alias("s")) \
        .groupBy("key").agg(F.sum("l").alias("n_leaves"), F.sum("s").alias("saved_tokens"))
    ends = _hashed_ends(shares.filter(F.col("ends").isNotNull()).select("key", "shard", "path", "ends"))
    parents = whole.select(F.col("key").alias("pkey"), F.col("conv_id").alias("parent_conv_id"))
    done = (whole.drop("leaves", "saved").join(sums, "key").join(ends, "key", "left").join(parents, "pkey", "left")
            .withColumn("ends_sha256", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256))))
    names = shares.select("key", "shard", "path", "depth").join(whole.select("key", "conv_id"), "key")
    return done.select(*FIGURES), names.select("shard", "path", "depth", "conv_id")


def trie_nodes(convs: DataFrame, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """One row per node of the trie over ``convs`` (conv_id, digests, lengths).

    conv_id (smallest member), depth, parent_conv_id, n_convs, n_children,
    n_leaves (childless nodes of the subtree), saved_tokens (over the subtree,
    (n_convs - 1) times the length of the node's last turn) and ends_sha256 (of
    the comma-joined ascending conv_ids that end here).
    """
    nodes = stored(_shards(stored(convs, "trie-convs"), shard_turns), "trie-nodes")
    done, names = _recombined(nodes.filter(F.col("path").isNotNull()))
    inner = nodes.filter(F.col("path").isNull()).withColumnRenamed("ends", "ends_sha256")
    free = inner.filter(F.col("ppath").isNull()).select(*FIGURES)
    names = names.select("shard", F.col("path").alias("ppath"), (F.col("depth") + 1).alias("depth"),
                         F.col("conv_id").alias("found"))
    under = inner.filter(F.col("ppath").isNotNull()).drop("parent_conv_id").join(names, ["shard", "ppath", "depth"]) \
        .withColumnRenamed("found", "parent_conv_id").select(*FIGURES)
    return free.unionByName(under).unionByName(done).withColumn("depth", F.col("depth").cast("long"))
