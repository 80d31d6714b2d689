"""Blocks of whole texts that ask questions of a table sharded by key.

Some operators must look up very many 64-bit keys per text (windows, n-grams).
As rows, keys and answers would outweigh the texts several times.  Instead the
texts are stored as compressed blocks of a few megabytes; a block sends each
shard its distinct keys as one sorted array, and gets one array back, in the
same order.  Spark does the shuffles (by shard, then by block); a key that is
in every text is sent once per block, so no shard grows with a hot key.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces, python_ready, stored, text_bytes

BLOCK_BYTES = 4 << 20
SHARD_BYTES = 24 << 20


def pack(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_batch(batch)
    return sink.getvalue().to_pybytes()


def unpack(body) -> pa.RecordBatch:
    return next(iter(pa.ipc.open_stream(body)))


def to_blocks(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Stored table (block, size, body): body holds the doc_id and text of a few megabytes of rows."""
    python_ready(docs.sparkSession)

    def run(batches):
        block = TaskContext.get().partitionId() << 40
        for b in batches:
            _, offsets = text_bytes(b.column(1))
            out = []
            for a, z in pieces(offsets, BLOCK_BYTES):
                out.append((block, int(offsets[z] - offsets[a]), pack(b.slice(a, z - a))))
                block += 1
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(
                    zip(*out), (pa.int64(), pa.int64(), pa.binary()))], names=["block", "size", "body"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    blocks = rows.mapInArrow(run, "block long, size long, body binary")
    return stored(blocks, "blocks")


def shard_count(blocks: DataFrame) -> int:
    """Enough shards that one holds the keys of a few blocks."""
    size = blocks.agg(F.sum("size")).first()[0] or 0
    return max(blocks.sparkSession.sparkContext.defaultParallelism, -(-size // SHARD_BYTES))


def shard_bounds(keys: np.ndarray, shards: int) -> np.ndarray:
    """Where each shard's part of the sorted keys begins, and the end."""
    edges = [min((k << 64) // shards, (1 << 64) - 1) for k in range(1, shards)]
    return np.concatenate(([0], np.searchsorted(keys, np.array(edges, np.uint64)), [len(keys)])).astype(np.int64)


def send(block: int, keys: np.ndarray, columns: list[np.ndarray], shards: int) -> pa.Table:
    """Rows (shard, block, keys, column...) with each shard's part of the sorted keys; empty parts are not sent."""
    at = shard_bounds(keys, shards).tolist()
    full = [k for k in range(shards) if at[k + 1] > at[k]]
    parts = [[c[at[k]:at[k + 1]].tobytes() for k in full] for c in (keys, *columns)]
    return pa.table([pa.array(full, pa.int64()), pa.array([block] * len(full), pa.int64()),
                     *[pa.array(p, pa.binary()) for p in parts]],
                    names=["shard", "block", *[f"c{k}" for k in range(len(parts))]])


def received(table: pa.Table, column: str, dtype) -> tuple[np.ndarray, np.ndarray]:
    """The column's arrays of all rows in one, and each row's length."""
    parts = [np.frombuffer(x.as_buffer(), dtype) for x in table.column(column)]
    return (np.concatenate(parts) if parts else np.zeros(0, dtype)), np.array([len(p) for p in parts], np.int64)


def answer(table: pa.Table, values: np.ndarray, lengths: np.ndarray) -> pa.Table:
    """Rows (block, shard, c0): the values for each request row, in its order."""
    cuts = np.cumsum(lengths)[:-1]
    return pa.table([table.column("block"), table.column("shard"),
                     pa.array([p.tobytes() for p in np.split(values, cuts)] if len(lengths) else [], pa.binary())],
                    names=["block", "shard", "c0"])


def answers(table: pa.Table, dtype) -> np.ndarray:
    """The values for a block's sorted keys from its answer rows."""
    return received(table.sort_by("shard"), "c0", dtype)[0]
