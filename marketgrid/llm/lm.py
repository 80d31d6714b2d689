"""LM scoring with a weighted backoff automaton.

The model is a bigram model smoothed towards add-one unigrams by a Dirichlet
prior: p(w | u) = (c(uw) + mu p(w)) / (c(u) + mu), p(w) = (c(w) + 1) / (N + V + 1).
As an automaton: the root has an arc for every word (unseen words share one);
every word seen at least ``min_context`` times (1: every training word), and
the start of a text, is a state; a seen bigram is an arc from u's state with the log of its probability;
all others follow u's failure arc, which costs log(mu / (c(u) + mu)) and leads
to the root.  A text is scored in one traversal from left to right that
carries the state and adds up.

Counts cover every training text, so the model grows with the corpus and is
never held in one place.  Texts stay in blocks; each asks the shards of the
unigram counts for its words, then the shards of the bigram counts for its
bigrams out of states (see blocks: the questions carry the block's own
training counts, so counting and answering are one exchange), and builds the
part of the automaton its texts can reach.  Only N and V pass the driver.

Defined cases: a null text is its end token alone; a null doc_id is held out by
the crc of an empty text; repeated rows count and are scored each; an empty
table gives no rows; with no training text all words are unseen.
"""

from __future__ import annotations

import zlib
from math import log10

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import answer, answers, received, send, shard_count, to_blocks, unpack
from .common import Words, _mix, python_ready, stored, text_bytes

END, START = np.uint64(0x5BD1E9955BD1E995), np.uint64(0x27D4EB2F165667C5)


class BackoffAutomaton:
    """States with arcs and one failure arc each; state 0 is the root, which has an arc for every word."""

    def __init__(self, root: list[float], failure: list[float], arcs: dict[int, float], state_after: list[int]):
        self.root, self.failure, self.arcs, self.state_after = root, failure, arcs, state_after

    def score(self, words: list[int], state: int) -> float:
        """Log-probability of the words, read from ``state``."""
        width, total = len(self.root), 0.0
        root, failure, arc, after = self.root, self.failure, self.arcs.get, self.state_after
        for w in words:
            weight = arc(state * width + w)
            total += failure[state] + root[w] if weight is None else weight
            state = after[w]
        return total


class Block:
    """A block's tokens: its distinct words (sorted hashes), each token's word, and which texts are training texts."""

    def __init__(self, body, folds: int, held: int):
        batch = unpack(body)
        w = Words(*text_bytes(batch.column(1)), lower=True)
        self.ids = batch.column(0)
        n = len(self.ids)
        self.held_out = np.array([zlib.crc32(b"" if d is None else str(d).encode()) % folds == held for d in self.ids.to_pylist()], bool)
        tokens = np.insert(w.hash, w.bounds[1:], END)
        self.bounds = w.bounds + np.arange(n + 1)
        self.words, self.word = np.unique(tokens, return_inverse=True)
        self.train = np.repeat(~self.held_out, np.diff(self.bounds))

    def word_counts(self) -> np.ndarray:
        return np.bincount(self.word[self.train], minlength=len(self.words))

    def bigrams(self, counts: np.ndarray, min_context: int):
        """(sorted keys, counts in training texts, a place of each) of the bigrams out of states."""
        before = np.concatenate(([0], self.word[:-1]))
        context = self.words[before]
        first = np.zeros(len(self.word), bool)
        first[self.bounds[:-1]] = True
        context[first] = START
        at = np.flatnonzero(first | (counts[before] >= min_context))
        key = _mix(context[at] * np.uint64(0xC2B2AE3D27D4EB4F) + _mix(self.words[self.word[at]] ^ np.uint64(0x165667B19E3779F9)))
        keys, where, back = np.unique(key, return_index=True, return_inverse=True)
        return keys, np.bincount(back[self.train[at]], minlength=len(keys)), at[where], first

    def automaton(self, counts, pairs, min_context: int, mu: float, n: int, v: int, texts: int) -> BackoffAutomaton:
        """The part of the model that this block's texts can reach; words are places in ``words``."""
        width = len(self.words)
        p = (counts + 1.0) / (n + v + 1.0)
        is_state = counts >= min_context
        state_after = np.where(is_state, np.cumsum(is_state) + 1, 0)  # 0: root, 1: start of a text
        seen = np.concatenate(([0.0, texts], counts[is_state]))
        failure = np.log10(mu / (seen + mu))
        failure[0] = 0.0
        keys, _, at, first = self.bigrams(counts, min_context)
        arc = np.flatnonzero(pairs > 0)
        at = at[arc]
        state = np.where(first[at], 1, state_after[self.word[at - 1]])
        weight = np.log10((pairs[arc] + mu * p[self.word[at]]) / (seen[state] + mu))
        arcs = dict(zip((state * width + self.word[at]).tolist(), weight.tolist()))
        return BackoffAutomaton(np.log10(p).tolist(), failure.tolist(), arcs, state_after.tolist())


def _sums(_, table):
    """Total count of each key, answered to every block that sent it."""
    keys, lengths = received(table, "c0", np.uint64)
    counts, _ = received(table, "c1", np.int64)
    distinct, back = np.unique(keys, return_inverse=True)
    total = np.zeros(len(distinct), np.int64)
    np.add.at(total, back, counts)
    out = answer(table, total[back], lengths)
    rows = out.num_rows
    sums = [int(total.sum()), int((total > 0).sum())]
    # the shard's share of N and V rides on its first row
    return out.append_column("n", pa.array([s if k == 0 else 0 for k, s in enumerate([sums[0]] * rows)], pa.int64())) \
        .append_column("v", pa.array([s if k == 0 else 0 for k, s in enumerate([sums[1]] * rows)], pa.int64()))


def score_texts(docs: DataFrame, folds: int = 7, held: int = 2, min_context: int = 1, mu: float = 500.0,
                doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    The model learns from the rows whose crc32(doc_id as text) mod ``folds`` is not ``held``.
    """
    python_ready(docs.sparkSession)
    blocks = to_blocks(docs, doc_id, text)
    shards = shard_count(blocks)
    request = "shard long, block long, c0 binary, c1 binary"
    reply = "block long, shard long, c0 binary, n long, v long"

    def ask_words(batches):
        for b in batches:
            for block, body in zip(b.column(0).to_pylist(), b.column(1)):
                k = Block(body.as_buffer(), folds, held)
                yield from send(block, k.words, [k.word_counts()], shards).to_batches()

    words = stored(blocks.select("block", "body").mapInArrow(ask_words, request).groupBy("shard").applyInArrow(_sums, reply),
                   "word-counts")
    n, v = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("v"), F.lit(0))).first()

    def ask_bigrams(key, left, right):
        k = Block(left.column("body")[0].as_buffer(), folds, held)
        keys, counts, _, _ = k.bigrams(answers(right, np.int64), min_context)
        return send(key[0].as_py(), keys, [counts], shards)

    pairs = blocks.groupBy("block").cogroup(words.groupBy("block")).applyInArrow(ask_bigrams, request) \
        .groupBy("shard").applyInArrow(_sums, reply)
    pairs = stored(pairs, "bigram-counts")

    def finish(key, left, right):
        k = Block(left.column("body")[0].as_buffer(), folds, held)
        kind = right.column("kind").to_numpy()
        counts, pairs = (answers(right.filter(pa.array(kind == x)), np.int64) for x in (0, 1))
        texts = int(counts[np.searchsorted(k.words, END)])
        model = k.automaton(counts, pairs, min_context, mu, n, v, texts)
        word, bounds = k.word.tolist(), k.bounds.tolist()
        scores = [model.score(word[a:z], 1) for a, z in zip(bounds, bounds[1:])]
        known = np.add.reduceat((counts > 0)[k.word].astype(np.int64), k.bounds[:-1])
        base = np.add.reduceat(np.log10(counts + 1.0)[k.word], k.bounds[:-1])
        size = np.diff(k.bounds)
        base = base - size * log10(n + v + 1)
        return pa.table([k.ids, pa.array(k.held_out), pa.array(size, pa.int64()), pa.array(known, pa.int64()),
                         pa.array(np.full(len(size), n, np.int64)), pa.array(base), pa.array(scores, pa.float64())],
                        names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    replies = words.withColumn("kind", F.lit(0)).unionByName(pairs.withColumn("kind", F.lit(1))).drop("n", "v")
    return blocks.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(
        finish, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
