import pytest
from pyspark.sql.types import LongType, StringType, StructField, StructType

from samples import prose

DOCS = StructType([StructField("doc_id", LongType()), StructField("text", StringType()),
                   StructField("lang", StringType()), StructField("source", StringType()),
                   StructField("n_chars", LongType())])


@pytest.fixture(scope="session")
def make_docs(spark):
    def make(rows, extra=()):
        """rows: (doc_id, text[, source[, lang]]); extra: names of clashing extra columns."""
        full = []
        for r in rows:
            r = list(r) + [None] * (4 - len(r))
            full.append((r[0], r[1], r[3], r[2], None if r[1] is None else len(r[1]), *["x"] * len(extra)))
        schema = StructType([*DOCS.fields, *[StructField(c, StringType()) for c in extra]])
        return spark.createDataFrame(full, schema).repartition(3)
    return make


@pytest.fixture(scope="session")
def hard_rows():
    """Nulls, empty and white texts, ties, repeated rows, one very long text."""
    a, long = prose(1, 300), prose(2, 60_000)
    return [(0, a, "s0", "en"), (1, a, "s0", "en"), (1, a, "s0", "en"), (2, None, None, None), (3, "", "s1", "en"),
            (4, " \t\n \x0b", None, "de"), (None, a + " end", "s0", None), (5, long, "s0", "en"),
            (6, "ÀB é\nÀb é\n\nx", "s1", "fr"), (7, "one two", "s1", "en"), (8, a.replace("w1", "v1", 1), "s2", "en")]
