"""A training corpus in five stages, each of which calls one operator on all that its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from crawlens.llm import common, mixing, pieces, quality_rules, secrets, similar


#: Documents that a Python worker is handed at once, on either side of the pipe: thousands of them would fill an executor.
ROWS = 512


def _few_rows(spark: SparkSession) -> None:
    """Sets the session's batches for stages that are run after they return; smaller ones stay."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = int(spark.conf.get(key))
    spark.conf.set(key, str(min(before, ROWS) if before > 0 else ROWS))


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the current policy of quality rules rejects go."""
    _few_rows(spark)
    return quality_rules.kept(docs, "v2")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, the one with the smallest id: linked by SimHash, confirmed and completed by the Jaccard similarity of five-word shingles (0.8 or more)."""
    _few_rows(spark)
    return similar.one_of_each(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets give way to a mark; ``n_chars`` follows the text."""
    clean = secrets.redacted(docs)
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it."""
    return mixing.copied(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``(doc_id, ids, lossless)``: piece ids under merge-dropout, checked by decoding."""
    _few_rows(spark)
    return pieces.encoded(docs)


STAGES = [
    ("quality_rules", rules),
    ("simhash", near_duplicates),
    ("secrets", secret_scan),
    ("mixing", mix),
    ("pieces", tokens),
]

#: SQL can express neither the components of the second stage nor the encoding of the last; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result but the last is written to shared storage and read again."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
