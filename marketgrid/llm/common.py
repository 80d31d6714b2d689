"""Helpers shared by the training-data operators: stored tables, line keys, word hashing.

Words are the runs of bytes that are not ASCII white space, so the vectorised
helpers work on UTF-8 bytes and never split a code point.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship_library, state_root

WS = r"[\x20\x09-\x0D]+"
WS_CHARS = " \t\n\x0b\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as parquet under the shared folder and read it back.

    Cuts the lineage with a table every executor can read, and gives the
    optimizer the table's real size (so only small tables are broadcast).
    """
    spark = df.sparkSession
    path = f"{state_root(spark)}/llm/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def python_ready(spark: SparkSession) -> None:
    """Executors can import this package (needed by operators with Python tasks)."""
    ship_library(spark)


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only; other characters, also upper-case ones, stay."""
    return F.when(F.length(c) == F.octet_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def words_of(text: Column) -> Column:
    """Array of the words of a text (null: empty array)."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), WS), "")


def lines_of(text: Column) -> Column:
    """Array of the \\n-split lines (null or empty: one empty line)."""
    return F.split(F.coalesce(text, F.lit("")), "\n")


def line_key(line: Column) -> Column:
    """A line without white space at both ends, A-Z in lower case."""
    return ascii_lower(F.btrim(line, F.lit(WS_CHARS)))


def text_key(text: Column) -> Column:
    """Tells rows that share a doc_id but not a text apart."""
    return F.xxhash64(text, text.isNull())


# --- vectorised word hashing over UTF-8 bytes (numpy, inside tasks) ---------

_P = 0x9E3779B97F4A7C15 | 1  # odd, so invertible modulo 2**64
_MASK = (1 << 64) - 1


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = _mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)) | np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOW = np.arange(256, dtype=np.uint8)
_LOW[65:91] += 32
# word bytes once A-Z are lower-cased: digits, a-z and everything beyond ASCII
_OUTSIDE = np.ones(256, bool)
_OUTSIDE[48:58] = _OUTSIDE[97:123] = _OUTSIDE[128:] = False

LONG_WORD = 64

_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_tables(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = _powers.get(base, (np.ones(1, np.uint64), np.ones(1, np.uint64)))
    if len(up) < n:
        size = max(n + n // 8, 1 << 16)
        up = np.full(size, base, np.uint64)
        down = np.full(size, pow(base, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        up, down = np.multiply.accumulate(up), np.multiply.accumulate(down)
        _powers[base] = up, down
    return up, down


def span_hash(values: np.ndarray, start: np.ndarray, end: np.ndarray, base: int = _P) -> np.ndarray:
    """64-bit hash of values[start:end] for each span, from one prefix sum."""
    up, down = _power_tables(base, len(values) + 1)
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=total[1:])
    raw = (total[end] - total[start]) * down[start]
    return _mix(raw + (end - start).astype(np.uint64) * np.uint64(0xA24BAED4963EE407))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts of an Arrow column, and where each begins (null: empty)."""
    column = column.cast(pa.large_string()).fill_null("") if column.null_count else column.cast(pa.large_string())
    _, off, data = column.buffers()
    n = len(column)
    offsets = np.frombuffer(off, np.int64, n + 1, column.offset * 8)
    body = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return body[offsets[0]:offsets[-1]], offsets - offsets[0]


def pieces(offsets: np.ndarray, most: int):
    """Runs of whole texts (first, last) of about ``most`` bytes; a longer text is a run of its own."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1
        last = min(max(last, first + 1), n)
        yield first, last
        first = last


class Words:
    """Words of a run of texts: byte spans, 64-bit hashes, and each text's word range."""

    def __init__(self, body: np.ndarray, offsets: np.ndarray, lower: bool = False, alnum: bool = False):
        low = _LOW[body] if lower or alnum else body
        word = ~(_OUTSIDE if alnum else _SPACE)[low]
        cut = np.zeros(len(body) + 1, bool)  # a text begins (or the last one ends) here
        cut[offsets] = True
        before = np.concatenate(([False], word))
        after = np.concatenate((word, [False]))
        self.start = np.flatnonzero(after & (~before | cut))
        self.end = np.flatnonzero(before & (~after | cut))
        self.hash = span_hash(_BYTE[low], self.start, self.end)
        # sums of powers modulo 2**64 can be made to agree for long words; these get a hash of their bytes
        for k in np.flatnonzero(self.end - self.start > LONG_WORD).tolist():
            self.hash[k] = int.from_bytes(hashlib.blake2b(low[self.start[k]:self.end[k]].tobytes(), digest_size=8).digest(), "little")
        self.bounds = np.searchsorted(self.start, offsets)  # text k has words bounds[k]:bounds[k+1]

    def doc_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))


def union_length(starts: np.ndarray, width: int, n: int) -> np.ndarray:
    """Mask of n places covered by [s, s+width) for the sorted or unsorted starts."""
    delta = np.zeros(n + 1, np.int64)
    np.add.at(delta, starts, 1)
    np.add.at(delta, np.minimum(starts + width, n), -1)
    return np.cumsum(delta[:n]) > 0
