"""Language identification by cross-parsing entropy.

A suffix automaton is built from a bounded sample of each language's labelled
texts.  A text is cut greedily into the longest phrases that occur in the
sample; the fewer phrases it needs per character, the better the language
explains it.  Samples differ in length, and a longer one holds longer phrases, so
counts are weighed as a code: a phrase costs the bits of its place in the sample
(log2 of the sample's length) and of a letter; a letter that a sample lacks costs
as much as a phrase of the longest sample, alike for all languages.  The language
that needs fewest bits wins; ties go to the first in order.

Texts are read as letters in lower case, with one separator for each run of
anything else.  All segments of a batch are parsed in step with each other,
against all languages at once.  Every letter of the samples has a symbol of its
own; the arcs of all automata stand in one hash table, so that large alphabets
(Chinese, Japanese, Korean) cost no more room than small ones.
A phrase ends at the latest at its segment's end, alike for all languages.

Sample: of each language the ``sample_rows`` training rows that come first by a
hash of doc_id, up to ``train_chars`` characters in all (fewer if there are many
languages, so that all samples have at most ``total_chars``); a language with
less text keeps what it has and shortens no other.  That bounds what is collected
and broadcast; prediction reads whole texts of all rows.

Defined cases: a null text, or one without a letter, is ``und`` with score 0; so
is every text if nothing was learned; rows without lang are not learned from;
a null doc_id counts as an empty text for the crc; repeated rows give a row
each; an empty table gives no rows; other columns play no part.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import python_ready

SEGMENT = 256
OTHER = 1  # a letter in no sample
UNKNOWN = "und"


class SuffixAutomaton:
    """All substrings of a sequence of symbols; state 0 is the root."""

    def __init__(self, symbols):
        self.next, link, length = [{}], [-1], [0]
        last = 0
        for c in symbols:
            now = len(length)
            self.next.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and c not in self.next[p]:
                self.next[p][c] = now
                p = link[p]
            if p >= 0:
                q = self.next[p][c]
                if length[q] == length[p] + 1:
                    link[now] = q
                else:
                    copy = len(length)
                    self.next.append(dict(self.next[q]))
                    length.append(length[p] + 1)
                    link.append(link[q])
                    while p >= 0 and self.next[p].get(c) == q:
                        self.next[p][c] = copy
                        p = link[p]
                    link[q] = link[now] = copy
            last = now


def letter_table(samples: list[str]) -> np.ndarray:
    """Symbol of every code point: 0 separator, 1 unknown letter, 2... the samples' letters in lower case."""
    table = np.zeros(0x110000, np.int32)
    lower = {}
    for c in range(0x110000):
        ch = chr(c)
        if ch.isalpha():
            table[c] = OTHER
            small = ch.lower()
            lower[c] = ord(small) if len(small) == 1 else c
    letters = sorted({lower[ord(c)] for s in samples for c in set(s) if ord(c) in lower})
    symbol = {c: k + 2 for k, c in enumerate(letters)}
    for c, small in lower.items():
        table[c] = symbol.get(small, OTHER)
    return table.astype(np.min_scalar_type(len(letters) + 1))


def symbols(text: str, table: np.ndarray) -> np.ndarray:
    """The text's symbols, one separator for a run, none at the ends."""
    s = table[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    keep = s > 0
    keep[1:] |= s[:-1] > 0
    s = s[keep]
    return s[:-1] if len(s) and s[-1] == 0 else s


class Arcs:
    """Hash table from a key (not negative) to a state, with linear probing; -1 for a key that is not held."""

    def __init__(self, keys: np.ndarray, to: np.ndarray):
        bits = max(4, int(3 * len(keys)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.to = np.full(1 << bits, -1, np.int64), np.full(1 << bits, -1, np.int32)
        slot, todo = self._slot(keys), np.arange(len(keys))
        while len(todo):
            free = todo[self.keys[slot[todo]] < 0]
            self.keys[slot[free]] = keys[free]
            here = self.keys[slot[todo]] == keys[todo]
            self.to[slot[todo[here]]] = to[todo[here]]
            todo = todo[~here]
            slot[todo] = (slot[todo] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).view(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        shape, keys = keys.shape, keys.ravel()
        slot = self._slot(keys)
        held = self.keys.take(slot)
        same = held == keys
        out = np.where(same, self.to.take(slot), -1)
        look = np.flatnonzero(~same & (held >= 0))
        while len(look):
            slot[look] = (slot[look] + 1) & self.mask
            held = self.keys.take(slot[look])
            same = held == keys[look]
            out[look[same]] = self.to.take(slot[look[same]])
            look = look[~same & (held >= 0)]
        return out.reshape(shape)


class Parser:
    """Automata of all languages, their arcs in one table."""

    def __init__(self, samples: dict[str, str]):
        self.langs = sorted(samples)
        self.table = letter_table(list(samples.values()))
        self.width = int(self.table.max()) + 1 if len(self.langs) else 2
        self.roots, keys, ends, sizes = [], [], [], []
        # where a phrase that begins with a symbol stands after it; a symbol without an arc is a phrase itself
        self.start = np.full((len(self.langs), self.width), -1, np.int32)
        base = 0
        for n, lang in enumerate(self.langs):
            sample = symbols(samples[lang], self.table)
            auto = SuffixAutomaton(sample.tolist())
            fan = np.fromiter(map(len, auto.next), np.int64, len(auto.next))
            c = np.fromiter((c for arcs in auto.next for c in arcs), np.int64, fan.sum())
            to = np.fromiter((z for arcs in auto.next for z in arcs.values()), np.int64, fan.sum()) + base
            keys.append((np.repeat(np.arange(len(fan)), fan) + base) * self.width + c)
            ends.append(to.astype(np.int32))
            self.start[n, c[:fan[0]]] = to[:fan[0]]
            self.roots.append(base)
            base += len(auto.next)
            sizes.append(max(len(sample), 1))
        self.arcs = Arcs(np.concatenate([np.zeros(0, np.int64), *keys]), np.concatenate([np.zeros(0, np.int32), *ends]))
        self.alone = self.start < 0
        self.start = np.where(self.alone, np.array(self.roots, np.int32)[:, None], self.start)
        # bits of a phrase of each language, and of a letter that its sample lacks
        self.cost = np.log2(np.array(sizes, float)) + np.log2(self.width)
        self.lack = self.cost.max(initial=0.0)

    def bits(self, texts: list[np.ndarray], counts: np.ndarray) -> np.ndarray:
        """(language, text) bits of the texts, given their counts of phrases."""
        lone = np.zeros_like(counts)
        for j, t in enumerate(texts):
            seen = np.bincount(t, minlength=self.width)
            lone[:, j] = self.alone @ seen
        return (counts - lone) * self.cost[:, None] + lone * self.lack

    def phrases(self, texts: list[np.ndarray]) -> np.ndarray:
        """(language, text) counts of phrases."""
        out = np.zeros((len(self.langs), len(texts)), np.int64)
        sizes = np.array([len(t) for t in texts], np.int64)
        if not sizes.sum() or not self.langs:
            return out
        body, offset = np.concatenate(texts), np.cumsum(sizes) - sizes
        per = -(-sizes // SEGMENT)
        owner = np.repeat(np.arange(len(texts)), per)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(per) - per, per)
        first = offset[owner] + nth * SEGMENT
        size = np.minimum(SEGMENT, sizes[owner] - nth * SEGMENT)
        order = np.argsort(-size, kind="stable")
        for a in range(0, len(order), 2048):
            part = order[a:a + 2048]
            counts = self._parse(body, first[part], size[part])
            np.add.at(out, (slice(None), owner[part]), counts)
        return out

    def _parse(self, body, first, size) -> np.ndarray:
        k, n = len(self.langs), len(first)
        state = np.repeat(np.array(self.roots, np.int32)[:, None], n, axis=1)
        root = np.array(self.roots, np.int32)[:, None]
        counts = np.zeros((k, n), np.int64)
        live = n
        for step in range(int(size[0])):
            while size[live - 1] <= step:
                live -= 1
            c = body[first[:live] + step]
            s = state[:, :live]
            to = self.arcs.find(s.astype(np.int64) * self.width + c)
            failed = to < 0
            # the phrase so far ends (if there is one), and another begins with this symbol
            counts[:, :live] += failed & (s != root)
            to = np.where(failed, self.start[:, c], to)
            counts[:, :live] += failed & self.alone[:, c]
            state[:, :live] = to
        return counts + (state != root)


def learn(docs: DataFrame, folds: int = 4, held: int = 2, sample_rows: int = 200, train_chars: int = 40_000,
          total_chars: int = 400_000, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> dict[str, str]:
    """Sample text of each language, from rows whose crc32(doc_id as text) mod ``folds`` is not ``held``."""
    key = F.coalesce(F.col(doc_id).cast("string"), F.lit(""))
    rows = docs.select(F.col(lang).cast("string").alias("lang"), key.alias("id"), F.col(text).alias("text")) \
        .filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.crc32(F.col("id").cast("binary")) % folds != held))
    first = Window.partitionBy("lang").orderBy(F.xxhash64("id"), "id")
    rows = rows.select("lang", "id", F.substring("text", 1, train_chars).alias("text")) \
        .withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= sample_rows)
    samples: dict[str, list[str]] = {}
    size: dict[str, int] = {}
    for r in rows.orderBy("lang", "rank").toLocalIterator():
        if size.get(r.lang, 0) < train_chars and any(c.isalpha() for c in r.text):
            samples.setdefault(r.lang, []).append(r.text)
            size[r.lang] = size.get(r.lang, 0) + len(r.text)
    most = min(train_chars, total_chars // max(len(samples), 1))
    return {k: "\n".join(v)[:most] for k, v in samples.items()}


def identify(docs: DataFrame, folds: int = 4, held: int = 2, doc_id: str = "doc_id", text: str = "text",
             lang: str = "lang", **sample) -> DataFrame:
    """Per row: doc_id, held_out, lang_pred, score (0 to 1: how far the runner-up is behind), phrases of the winner."""
    spark = docs.sparkSession
    python_ready(spark)
    shared = spark.sparkContext.broadcast(Parser(learn(docs, folds, held, doc_id=doc_id, text=text, lang=lang, **sample)))

    def run(batches):
        parser = shared.value
        names = np.array([*parser.langs, UNKNOWN], object)
        for whole in batches:
            for a in range(0, whole.num_rows, 512):
                b = whole.slice(a, 512)
                texts = [symbols(t.as_py() or "", parser.table) for t in b.column(1)]
                counts = parser.phrases(texts)
                n = len(texts)
                bits = parser.bits(texts, counts)
                best = bits.argmin(0) if len(counts) else np.zeros(n, np.int64)
                least = bits[best, np.arange(n)] if len(counts) else np.zeros(n)
                phrases = counts[best, np.arange(n)] if len(counts) else np.zeros(n, np.int64)
                second = np.partition(bits, 1, axis=0)[1] if len(counts) > 1 else least * 2
                score = np.where(second > 0, 1 - least / np.where(second > 0, second, 1), 0.0)
                none = np.array([not len(t) for t in texts]) | (len(counts) == 0)
                ids = b.column(0).to_pylist()
                out = [zlib.crc32(b"" if d is None else str(d).encode()) % folds == held for d in ids]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), pa.array(out), pa.array(names[np.where(none, len(names) - 1, best)].tolist(), pa.string()),
                     pa.array(np.where(none, 0.0, score)), pa.array(np.where(none, 0, phrases))],
                    names=["doc_id", "held_out", "lang_pred", "score", "phrases"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")) \
        .mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double, phrases long")
