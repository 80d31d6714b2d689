"""The corpus pipeline: quality rules, line dedup, near-dedup, decontamination, packing.

Every stage takes (spark, docs, sf_dir), where docs has the columns of
documents, and returns its DataFrame; all but the last return those columns.
``run`` writes each stage's result as parquet in the shared folder and reads
it back for the next, so a lost executor costs one stage's tasks at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketgrid.llm.common import stored
from marketgrid.llm.decontaminate import remove_contaminated
from marketgrid.llm.line_dedup import dedup_lines
from marketgrid.llm.packing import pack
from marketgrid.llm.quality import keep_good
from marketgrid.llm.queries import tokenizer_path
from marketgrid.llm.simhash import keep_one


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: documents that fail the base rules or are depleted of own lines go."""
    return keep_good(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: lines found in ten documents or more go; n_chars is counted anew."""
    kept = dedup_lines(docs, min_docs=10, min_chars=1).drop("n_lines", "n_dropped")
    return kept.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: the document with the smallest doc_id of each group stays."""
    return keep_one(docs, shingle=3, radius=2)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: documents with a benchmark window go."""
    return remove_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), window=10)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: pieces of the packed training sequences."""
    return pack(docs, tokenizer_path(), window=2048)


STAGES = [("quality", quality_rules), ("line_dedup", line_dedup), ("near_dedup", near_dedup),
          ("decontaminate", decontaminate), ("packing", packing)]

# Tokenizer ids and SimHash fingerprints have no SQL form; tests/llm tests each stage's operator by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
