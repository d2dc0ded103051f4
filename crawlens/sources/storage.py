"""Shared storage for results that several branches of a plan read."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which all executors share; a temporary one only where it is unset (tests)."""
    given = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not given:
        given = f"file://{tempfile.mkdtemp(prefix='crawlens-')}"
        spark.sparkContext.setCheckpointDir(given)
    return f"{given.rstrip('/')}/crawlens"


def stored(df: DataFrame, tag: str) -> DataFrame:
    """Written once and read back: branches share the work and lost executors cost nothing."""
    path = f"{folder(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
