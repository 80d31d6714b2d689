"""Mixture-controlled packing: deficit round-robin over one token queue per source.

Every source's documents form a queue of tokens (ordered by doc_id).  In a
deficit round-robin with a quantum of q tokens, a source's deficit grows with
its share of the tokens sent and each turn sends one quantum.  A source with T
tokens is owed its k-th quantum when the share (k + 1/2) q / T of all tokens
has been sent, so the order of turns needs no sequential loop: turns are sorted
by that share over the whole cluster, and a running sum of their sizes gives
every turn its place.  No deficit exceeds a quantum, it carries over from
window to window, and, as the order is global, from partition to partition.
All queues end together, so the target proportions (the sources' own shares of
all tokens) hold in every window up to the quantum.

The turns are laid end to end and cut every ``window`` tokens.  What is left
at the end is cut into windows whose sizes are powers of two, so nothing is
padded.

Scale: texts are tokenized once; the ids are stored, two bytes each for small
vocabularies.  Queue offsets and turn places come from range-partitioned
running sums over rows without ids, so a source with a third of all documents
is spread like any other.  Only the last join moves ids, once.

Defined cases: a null or empty text is its end token alone; null is a source of
its own; rows that repeat a doc_id are packed each (their pieces share the
doc_id); an empty table gives no rows; other columns play no part.
"""

from __future__ import annotations

import gc
import zlib
from bisect import bisect_right
from itertools import chain
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _LOW, pieces, python_ready, stored, text_bytes
from .prefix import running_sum

END_ID = 1
CACHE_WORDS = 400_000  # in every Python worker
PIECE_BYTES = 2_000_000
# the tokenizer's own pattern for the parts of a word, which are encoded apart
PARTS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")


# 1: ASCII letters and digits, 2: ASCII marks but the apostrophe (which may begin a part of its own kind)
_KIND = np.zeros(256, np.uint8)
_KIND[33:127] = 2
_KIND[48:58] = _KIND[65:91] = _KIND[97:123] = 1
_KIND[39] = 0


# byte-level vocabularies write a byte as the character of its number if that is printable, else as one from 256 on
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTE_CHARS = {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in _PRINTABLE)}


class WordEncoder:
    """Ids of texts: distinct words are encoded once and their ids remembered in one ragged array.

    The tokenizer drops white space, lower-cases and never joins across white
    space, so a text's ids are its words' ids in a row.  A batch's words are
    split and numbered by Arrow, its distinct words are looked up, and the ids
    of all words are taken from the ragged array at once.  New words of letters
    go to the tokenizer's model; others are put together from their parts, or
    encoded whole where the tokenizer might change them first.  The memory is
    emptied when it is full.
    """

    def __init__(self, path: str, end_id: int):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        size = self.tokenizer.get_vocab_size()
        self.dtype = np.uint16 if size <= 1 << 16 else np.uint32
        self.end_id = end_id
        self._forget()

    def _forget(self) -> None:
        self.known: dict[bytes, bytes] = {}  # ids of words learned, also of parts
        self.slot: dict[bytes, int] = {}  # place of the words met in the ragged array
        self.ids, self.used = np.zeros(1 << 16, self.dtype), 0
        self.starts, self.sizes, self.slots = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64), 0

    def _single(self, words: list[bytes]) -> None:
        for k in range(0, len(words), 20_000):
            part = words[k:k + 20_000]
            for w, e in zip(part, self.tokenizer.encode_batch_fast([w.decode() for w in part], add_special_tokens=False)):
                self.known[w] = np.array(e.ids, self.dtype).tobytes()

    def _letters_only(self, words: list[bytes]) -> None:
        """Words of letters that the tokenizer does not change before its model sees them."""
        model, kind = self.tokenizer.model.tokenize, self.dtype
        ids = [[t.id for t in model(w.decode() if w.isascii() else w.decode("latin-1").translate(_BYTE_CHARS))] for w in words]
        raw, width = np.fromiter(chain.from_iterable(ids), kind).tobytes(), np.dtype(kind).itemsize
        a = 0
        for w, x in zip(words, ids):
            z = a + width * len(x)
            self.known[w] = raw[a:z]
            a = z

    def _learn(self, words: list[bytes]) -> None:
        """Ids of words; those of an empty one are none."""
        known, letters, other, joined = self.known, [], [], []
        known[b""] = b""
        for w in words:
            if w in known:
                continue
            text = w.decode()
            # isalpha of bytes: ASCII letters
            if w.isalpha() and w.islower() or _letters(text):
                letters.append(w)
            elif b"<|" not in w and is_normalized("NFC", text) and text.lower() == text:
                joined.append((w, [p.encode() for p in PARTS.findall(text)]))
            else:
                other.append(w)
        for _, parts in joined:
            for p in parts:
                (letters if p.isalpha() and p.islower() else other).append(p)
        for kind, encode in ((letters, self._letters_only), (other, self._single)):
            encode([w for w in dict.fromkeys(kind) if w not in known])
        for w, parts in joined:
            known[w] = b"".join([known[p] for p in parts])

    def _add(self, words: list[bytes]) -> None:
        """Give new words a place in the ragged array."""
        self._learn(words)
        found = [self.known[w] for w in words]
        new = np.frombuffer(b"".join(found), self.dtype)
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // np.dtype(self.dtype).itemsize
        for name, used, more in (("ids", self.used, len(new)), ("starts", self.slots, len(words)), ("sizes", self.slots, len(words))):
            held = getattr(self, name)
            if len(held) < used + more:
                setattr(self, name, np.concatenate((held, np.zeros(max(len(held), more), held.dtype))))
        self.ids[self.used:self.used + len(new)] = new
        here = slice(self.slots, self.slots + len(words))
        self.starts[here], self.sizes[here] = self.used + np.cumsum(sizes) - sizes, sizes
        self.slot.update(zip(words, range(self.slots, self.slots + len(words))))
        self.used, self.slots = self.used + len(new), self.slots + len(words)

    def encode(self, body: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, each with the end token, and where each text's begin.

        The texts are given by their UTF-8 bytes and where each begins.
        """
        if self.slots > CACHE_WORDS:
            self._forget()
        # Fewer distinct words: lower case first, and marks apart from letters and digits, as the tokenizer
        # parts them itself; a special token's text is left as it is written.
        lower, kind = _LOW[body], _KIND[body]
        cut = np.flatnonzero(kind[1:] + kind[:-1] == 3) + 1
        special = np.flatnonzero((body[:-1] == 60) & (body[1:] == 124))  # <|
        for k in np.unique(np.searchsorted(offsets, special, "right") - 1).tolist():
            first, last = int(offsets[k]), int(offsets[k + 1])
            lower[first:last] = body[first:last]
            cut = cut[(cut < first) | (cut >= last)]
        lower, offsets = np.insert(lower, cut, 32), offsets + np.searchsorted(cut, offsets)
        # built anew: Arrow's string kernels misread an array that is a slice of another
        texts = pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets), pa.py_buffer(lower))
        split = pc.ascii_split_whitespace(texts)
        numbered = split.flatten().dictionary_encode()
        raw, ends = text_bytes(numbered.dictionary)
        raw, ends = raw.tobytes(), ends.tolist()
        words = [raw[a:z] for a, z in zip(ends[:-1], ends[1:])]
        slots = list(map(self.slot.get, words))
        new = [w for w, s in zip(words, slots) if s is None]
        if new:
            self._add(new)
            slots = list(map(self.slot.__getitem__, words))
        at = np.array(slots, np.int64)[numbered.indices.to_numpy()] if words else np.zeros(0, np.int64)
        sizes, starts = self.sizes[at], self.starts[at]
        before = np.concatenate(([0], np.cumsum(sizes)))  # ids before each word
        bounds = split.offsets.to_numpy()
        first = before[bounds - bounds[0]] + np.arange(len(bounds))  # and one end token a text
        out = np.full(first[-1], self.end_id, self.dtype)
        taken = self.ids[np.arange(before[-1]) + np.repeat(starts - before[:-1], sizes)]
        inside = np.ones(len(out), bool)
        inside[first[1:] - 1] = False
        out[inside] = taken
        return out, first


def _letters(word: str) -> bool:
    """Letters only, which the tokenizer's normalisation leaves as they are."""
    return word.isalpha() and word.lower() == word and is_normalized("NFC", word)


_encoders: dict[tuple[str, int], WordEncoder] = {}


def encoder(path: str, end_id: int) -> WordEncoder:
    if (path, end_id) not in _encoders:
        _encoders[path, end_id] = WordEncoder(path, end_id)
    return _encoders[path, end_id]


def tokenize(docs: DataFrame, path: str, end_id: int = END_ID, doc_id: str = "doc_id", text: str = "text",
             source: str = "source") -> DataFrame:
    """(row, doc_id, source, n, ids): token ids of every text with the end token; row is unique."""
    python_ready(docs.sparkSession)

    def run(batches):
        gc.disable()  # no cycles are made here, and the collector would walk the words' memory again and again
        try:
            yield from rows(batches)
        finally:
            gc.enable()

    def rows(batches):
        enc, row = encoder(path, end_id), TaskContext.get().partitionId() << 40
        width = np.dtype(enc.dtype).itemsize
        for b in batches:
            body, places = text_bytes(b.column(2))
            for a, z in pieces(places, PIECE_BYTES):
                part = b.slice(a, z - a)
                ids, at = enc.encode(body[places[a]:places[z]], places[a:z + 1] - places[a])
                n = len(at) - 1
                packed = pa.LargeBinaryArray.from_buffers(
                    pa.large_binary(), n, [None, pa.py_buffer(at * width), pa.py_buffer(ids)]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(row, row + n)), part.column(0), part.column(1), pa.array(np.diff(at)), packed],
                    names=["row", "doc_id", "source", "n", "ids"])
                row += n

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(source).cast("string").alias("source"),
                       F.col(text).cast("string").alias("text")) \
        .mapInArrow(run, "row long, doc_id long, source string, n long, ids binary")


def tail_sizes(rest: int) -> list[int]:
    """Powers of two, largest first, that add up to the tokens after the last full window."""
    return [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def window_starts(total: int, window: int) -> list[int]:
    """First token of each window after the last full one, and the end."""
    full = total // window * window
    return np.cumsum([full, *tail_sizes(total - full)]).tolist()


def pack(docs: DataFrame, path: str, window: int = 2048, quantum: int = 256, end_id: int = END_ID,
         doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, source."""
    if not 0 < quantum <= window:
        raise ValueError("quantum must be between 1 and the window")
    tokens = stored(tokenize(docs, path, end_id, doc_id, text, source), "tokens")
    rows = running_sum(tokens.select("row", "doc_id", "source", "n"), F.col("source"), ["doc_id", "row"], "n", "at")
    sizes = stored(tokens.groupBy("source").agg(F.sum("n").alias("T")), "queues")
    total = sizes.agg(F.sum("T")).first()[0] or 0
    rows = stored(rows.select("row", "source", "n", "at"), "queued")

    # A turn is listed by the document that holds its first token.
    turns = rows.select("source", F.explode(F.expr(
        f"CASE WHEN (at + {quantum - 1}) DIV {quantum} <= (at + n - 1) DIV {quantum} "
        f"THEN sequence((at + {quantum - 1}) DIV {quantum}, (at + n - 1) DIV {quantum}) END")).alias("k"))
    turns = turns.join(sizes, turns["source"].eqNullSafe(sizes["source"])) \
        .select(turns["source"], "k", F.least(F.lit(quantum).cast("long"), F.col("T") - F.col("k") * quantum).alias("size"),
                ((F.col("k") + 0.5) * quantum / F.col("T")).alias("due"))
    turns = running_sum(turns.withColumn("s", F.xxhash64("source", F.col("source").isNull())),
                        F.lit(0), ["due", "s", "k"], "size", "place")
    turns = stored(turns.select("s", "k", "place"), "turns")

    parts = rows.select("row", "n", "at", F.xxhash64("source", F.col("source").isNull()).alias("s"), F.explode(F.expr(
        f"sequence(at DIV {quantum}, (at + n - 1) DIV {quantum})")).alias("k")).join(turns, ["s", "k"])
    first = F.greatest(F.col("at"), F.col("k") * quantum)
    last = F.least(F.col("at") + F.col("n"), (F.col("k") + 1) * quantum)
    parts = parts.select("row", F.struct((first - F.col("at")).alias("start"), (last - first).alias("length"),
                                         (F.col("place") + first - F.col("k") * quantum).alias("at")).alias("part"))
    plan = parts.groupBy("row").agg(F.sort_array(F.collect_list("part")).alias("parts"))
    cuts = window_starts(total, window)
    python_ready(docs.sparkSession)

    def run(batches):
        for b in batches:
            parts, n, ids = b.column(4), b.column(3).to_pylist(), b.column(2)
            at = parts.offsets.to_pylist()
            parts = [parts.values.field(k).to_pylist() for k in range(3)]
            rows, out, crcs = [], [], []
            for k in range(b.num_rows):
                raw = ids[k].as_buffer()
                raw = memoryview(np.frombuffer(raw, np.uint16 if len(raw) == 2 * n[k] else np.uint32).astype("<u4").tobytes())
                for piece in cut(zip(*(p[at[k]:at[k + 1]] for p in parts)), cuts, window):
                    rows.append(k)
                    out.append(piece)
                    crcs.append(zlib.crc32(raw[4 * piece[0]:4 * (piece[0] + piece[1])]))
            start, length, seq, offset = (pa.array([x[k] for x in out], pa.int64()) for k in range(4))
            rows = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(rows), b.column(1).take(rows), start, length, pa.array(crcs, pa.int64()),
                 b.column(3).take(rows), seq, offset],
                names=["doc_id", "source", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    return tokens.join(plan, "row").select("doc_id", "source", "ids", "n", "parts").mapInArrow(
        run, "doc_id long, source string, start long, length long, ids_crc32 long, doc_tokens long, "
             "sequence_id long, offset long")


def cut(parts, cuts: list[int], window: int):
    """(start, length, sequence, offset) of a document's (start, length, place) parts, cut where windows end; touching pieces are one."""
    full = cuts[0]
    held = None
    for start, left, at in parts:
        while left:
            if at < full:
                seq, begin, end = at // window, at // window * window, at // window * window + window
            else:
                j = bisect_right(cuts, at) - 1
                seq, begin, end = full // window + j, cuts[j], cuts[j + 1]
            size = min(left, end - at)
            if held and held[2] == seq and held[3] + held[1] == at - begin and held[0] + held[1] == start:
                held = (held[0], held[1] + size, seq, held[3])
            else:
                if held:
                    yield held
                held = (start, size, seq, at - begin)
            start, at, left = start + size, at + size, left - size
    if held:
        yield held

