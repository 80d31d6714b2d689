"""Line dedup: drop lines whose key is found in many documents.

Explode the normalised lines, hash them, count the documents of each hash
(every row is one document; a line counts once per row), join the frequent
hashes back to the line places and reassemble each text by position.  All on
DataFrame functions.

Scale: the count is a plain aggregate with map-side sums, so a line found in a
third of all documents is one counter per task; the join back is a sort-merge
join of two plain exchanges, which AQE splits when a line is hot; what returns
to a row is the set of its own dropped places (bounded by its lines).

Defined cases: a null or empty text is one empty line and stays an empty text;
empty keys are never dropped; a null doc_id is a document like any other; rows
that repeat a doc_id count as a document each; an empty table gives no rows;
other columns pass through, but those named like an output are replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import line_key, lines_of, stored, text_key


def frequent_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, text: str = "text") -> DataFrame:
    """Hashes (__h1, __h2) of the line keys found in at least ``min_docs`` rows, with that count."""
    keys = F.transform(lines_of(F.col(text)), line_key)
    hashes = F.transform(F.filter(keys, lambda k: F.length(k) >= min_chars),
                         lambda k: F.struct(F.xxhash64(k).alias("__h1"), F.hash(k).alias("__h2")))
    return (docs.select(F.explode(F.array_distinct(hashes)).alias("__h")).select("__h.*")
            .groupBy("__h1", "__h2").agg(F.count(F.lit(1)).alias("__docs"))
            .filter(F.col("__docs") >= min_docs))


def dedup_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1,
                doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with the frequent lines taken out of ``text``, plus n_lines and n_dropped (long)."""
    frequent = stored(frequent_lines(docs, min_docs, min_chars, text).select("__h1", "__h2"), "lines")
    lines = docs.select(F.col(doc_id).alias("__id"), text_key(F.col(text)).alias("__t"),
                        F.posexplode(lines_of(F.col(text))).alias("__pos", "__line"))
    lines = lines.withColumn("__key", line_key(F.col("__line"))).filter(F.length("__key") >= min_chars) \
        .select("__id", "__t", "__pos", F.xxhash64("__key").alias("__h1"), F.hash("__key").alias("__h2"))
    gone = lines.join(frequent, ["__h1", "__h2"]).groupBy("__id", "__t") \
        .agg(F.collect_set("__pos").alias("__gone"))

    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"),
                       F.col(doc_id).alias("__rid"), text_key(F.col(text)).alias("__rt"))
    joined = rows.join(gone, F.col("__rid").eqNullSafe(F.col("__id")) & (F.col("__rt") == F.col("__t")), "left") \
        .withColumn("__lines", lines_of(F.col(f"__row.`{text}`")))
    n = F.size("__lines")
    kept = F.transform(F.array_except(F.sequence(F.lit(0), n - 1), F.coalesce("__gone", F.array().cast("array<int>"))),
                       lambda i: F.get(F.col("__lines"), i))
    out = [F.col(f"__row.`{c}`").alias(c) for c in docs.columns if c not in (text, "n_lines", "n_dropped")]
    place = [c for c in docs.columns if c not in ("n_lines", "n_dropped")].index(text)
    out.insert(place, F.array_join(kept, "\n").alias(text))
    return joined.select(*out, n.cast("long").alias("n_lines"),
                         F.coalesce(F.size("__gone"), F.lit(0)).cast("long").alias("n_dropped"))
