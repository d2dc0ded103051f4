"""What the training-data operators share: tables, words and shared storage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

#: A word: what stands between the six ASCII blanks. ``bytes.split()`` cuts at exactly these.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``; a temporary one only where that is unset (tests)."""
    given = spark.conf.get("spark.checkpoint.dir", None)
    if not given:
        given = spark.sparkContext.getCheckpointDir()
    if not given:
        given = f"file://{tempfile.mkdtemp(prefix='crawlens-')}"
        spark.sparkContext.setCheckpointDir(given)
    return f"{given.rstrip('/')}/crawlens"


def fresh_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


@contextmanager
def freed(spark: SparkSession) -> Iterator[None]:
    """What is written here removes its shuffle files once it is written, instead of when the driver next collects garbage. Stages lost before that are run again as usual."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


@contextmanager
def small_batches(spark: SparkSession, rows: int = 512) -> Iterator[None]:
    """What runs here hands documents to Python workers in batches of few rows, so that neither side of the pipe holds thousands of texts."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def stored(df: DataFrame, tag: str, **options: str) -> DataFrame:
    """Write the rows once into shared storage and read them back: lineage ends here, and lost executors cost nothing."""
    spark, path = df.sparkSession, fresh_path(df.sparkSession, tag)
    with freed(spark):
        df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def texts(batch: pa.RecordBatch, name: str = "text") -> list[bytes | None]:
    """A batch's texts as UTF-8 bytes."""
    return batch.column(name).cast(pa.binary()).to_pylist()


def utf8(text: bytes) -> bytes:
    """The text itself, or with replacement characters for what is not UTF-8 in it."""
    try:
        text.decode()
        return text
    except UnicodeDecodeError:
        return text.decode(errors="replace").encode()


def schema_of(ddl_schema) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(ddl_schema)


def crc_fold(id_col: str = "doc_id"):
    """crc32 of the id as text, modulo 5; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5
