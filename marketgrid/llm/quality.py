"""Quality rules: base measures of each text and cross-document line frequency per host.

The lines of a text are normalised (trimmed, A-Z in lower case) and hashed
with their host.  A line is boilerplate of a host when at least ``line_docs``
distinct documents of that host hold it.  Documents are told apart by their
whole text, so exact copies, whatever their doc_ids, count once; texts that
differ anywhere are different documents, so the shared lines of ``line_docs``
or more near copies of one host are boilerplate.  Boilerplate lines are
removed; a document is depleted, and rejected, when fewer than ``keep_share``
of its words remain.  All on DataFrame functions.

Scale: no word is exploded or shuffled.  Repeated 3-word windows are found
inside each row: the window hashes, with the window's place in the low bits,
are sorted as longs, and equal neighbours are repeats (n log n, also for very
long texts).  Only line hashes are shuffled; counting has map-side sums, and
the join back is split by AQE when a line is hot.

Defined cases: a null text has no words and fails the base rule; a null host
is a host of its own; a null doc_id is kept as it is; rows that repeat a doc_id
and text get the same verdict; an empty table gives no rows; input columns
named like an output are replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WS, line_key, lines_of, stored, text_key, words_of

SYMBOLS = r"[#*$%&|<>]+"
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
OUTPUTS = [*MEASURES, "base_failed", "n_removed_lines", "n_removed_words", "kept"]


def with_measures(rows: DataFrame, text: str = "__text") -> DataFrame:
    """Add the base measures (long) of ``text``."""
    has_word = F.filter(lines_of(F.col(text)), lambda l: l.rlike(r"[^\x20\x09-\x0D]"))
    body = F.coalesce(F.col(text), F.lit(""))
    d = rows.withColumns({"__w": words_of(F.col(text)), "__l": has_word})
    d = d.withColumns({
        "n_words": F.size("__w").cast("long"),
        "word_chars": F.length(F.regexp_replace(body, WS, "")).cast("long"),
        "n_symbols": (F.length(body) - F.length(F.regexp_replace(body, SYMBOLS, ""))).cast("long"),
        "n_dup_lines": (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long"),
        # bits for a place in the text; the hash keeps the others
        "__b": F.ceil(F.log2(F.size("__w") + F.lit(2))).cast("int"),
    })
    d = d.withColumn("__s", F.expr(
        "CASE WHEN n_words >= 3 THEN sort_array(transform(sequence(0, CAST(n_words - 3 AS INT)), "
        "i -> shiftleft(xxhash64(__w[i], __w[i + 1], __w[i + 2]), __b) | i)) "
        "ELSE CAST(array() AS ARRAY<BIGINT>) END"))
    d = d.withColumn("__p", F.expr(
        "sort_array(transform(filter(__s, (x, k) -> "
        "shiftrightunsigned(x, __b) <=> shiftrightunsigned(get(__s, k - 1), __b) OR "
        "shiftrightunsigned(x, __b) <=> shiftrightunsigned(get(__s, k + 1), __b)), "
        "x -> x & (shiftleft(1L, __b) - 1)))"))
    d = d.withColumn("n_repeat_words", F.expr(
        "CASE WHEN size(__p) = 0 THEN 0L ELSE 3L + aggregate(transform(__p, (x, k) -> "
        "CASE WHEN k = 0 THEN 0L ELSE least(3L, x - get(__p, k - 1)) END), 0L, (a, x) -> a + x) END"))
    return d.drop("__w", "__l", "__b", "__s", "__p")


def _base_failed(min_words: int, max_repeat: float):
    return (F.col("n_words") < min_words) | (F.col("n_repeat_words") > max_repeat * F.col("n_words"))


def removed_lines(docs: DataFrame, line_docs: int = 10, doc_id: str = "doc_id", text: str = "text",
                  host: str = "source") -> DataFrame:
    """Per row with boilerplate: __id, __t, its words in __total, and the (place, words) of each boilerplate line in __gone."""
    rows = docs.select(F.col(doc_id).alias("__id"), text_key(F.col(text)).alias("__t"), F.col(host).alias("__host"),
                       lines_of(F.col(text)).alias("__lines"))
    # counted before the lines are exploded, so once per text
    rows = rows.withColumn("__total", F.aggregate("__lines", F.lit(0), lambda a, l: a + F.size(words_of(l)))) \
        .select("__id", "__t", "__host", "__total", F.posexplode("__lines").alias("__pos", "__line"))
    rows = rows.withColumn("__key", line_key(F.col("__line"))).filter(F.length("__key") > 0)
    rows = rows.select("__id", "__t", "__pos", "__total", F.size(words_of(F.col("__line"))).alias("__n"),
                       F.xxhash64(F.col("__host").isNull(), "__host", "__key").alias("__h1"),
                       F.hash("__key", "__host").alias("__h2"))
    frequent = rows.select("__h1", "__h2", "__t").distinct() \
        .groupBy("__h1", "__h2").agg(F.count(F.lit(1)).alias("__docs")).filter(F.col("__docs") >= line_docs)
    frequent = stored(frequent.select("__h1", "__h2"), "host-lines")
    return rows.join(frequent, ["__h1", "__h2"]).groupBy("__id", "__t", "__total") \
        .agg(F.collect_set(F.struct(F.col("__pos").alias("pos"), F.col("__n").alias("n"))).alias("__gone"))


def score_documents(docs: DataFrame, line_docs: int = 10, keep_share: float = 0.5, min_words: int = 50,
                    max_repeat: float = 0.5, doc_id: str = "doc_id", text: str = "text",
                    host: str = "source", carry: list[str] | None = None) -> DataFrame:
    """One row per row of ``docs``: ``carry`` columns (default doc_id), measures, removals, verdict.

    The text itself is carried only if asked for.
    """
    carry = [doc_id] if carry is None else [c for c in carry if c not in OUTPUTS]
    gone = removed_lines(docs, line_docs, doc_id, text, host)
    gone = gone.select("__id", "__t", F.size("__gone").cast("long").alias("__lines"), F.aggregate(
        "__gone", F.lit(0).cast("long"), lambda a, x: a + x["n"]).alias("__words"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in carry]).alias("__row"),
                       F.col(doc_id).alias("__rid"), text_key(F.col(text)).alias("__rt"), F.col(text).alias("__text"))
    rows = with_measures(rows).drop("__text")
    d = rows.join(gone, F.col("__rid").eqNullSafe(F.col("__id")) & (F.col("__rt") == F.col("__t")), "left")
    failed = _base_failed(min_words, max_repeat)
    words = F.coalesce("__words", F.lit(0).cast("long"))
    depleted = (F.col("n_words") - words) < keep_share * F.col("n_words")
    return d.select(*[F.col(f"__row.`{c}`").alias(c) for c in carry], *MEASURES, failed.alias("base_failed"),
                    F.coalesce("__lines", F.lit(0).cast("long")).alias("n_removed_lines"),
                    words.alias("n_removed_words"), (~failed & ~depleted).alias("kept"))


def keep_good(docs: DataFrame, line_docs: int = 10, keep_share: float = 0.5, min_words: int = 50, max_repeat: float = 0.5,
              doc_id: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """The rows of ``docs`` that pass, all their columns unchanged.

    The base rules are judged on the row itself.  Only the depleted documents,
    few of those with boilerplate, are stored (without text) and taken out by an
    anti join; Spark broadcasts them only if that table is below its threshold.
    """
    gone = removed_lines(docs, line_docs, doc_id, text, host)
    lost = F.aggregate("__gone", F.lit(0).cast("long"), lambda a, x: a + x["n"])
    bad = stored(gone.filter(F.col("__total") - lost < keep_share * F.col("__total")).select("__id", "__t"), "depleted")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), F.col(doc_id).alias("__rid"),
                       text_key(F.col(text)).alias("__rt"), F.col(text).alias("__text"))
    rows = rows.join(bad, rows["__rid"].eqNullSafe(bad["__id"]) & (rows["__rt"] == bad["__t"]), "left_anti")
    # The verdict rides with a row number, which keeps Spark from pushing the filter into the
    # measures' expressions and repeating them there.
    judged = with_measures(rows).select("__row", _base_failed(min_words, max_repeat).alias("__failed"),
                                        F.monotonically_increasing_id().alias("__n"))
    good = judged.filter(~F.col("__failed") & (F.col("__n") >= 0))
    return good.select(*[F.col(f"__row.`{c}`").alias(c) for c in docs.columns])
