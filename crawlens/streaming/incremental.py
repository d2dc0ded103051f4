"""Extension: audit pages as they arrive. Each micro-batch is parsed and checked once, and its hits are appended."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from crawlens.operators import checks
from crawlens.plans import audit


def page_hits(pages: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """``pages`` is a stream of crawled pages; hits of single-page checks go to ``target``, one folder per batch, so that a batch that is run again replaces itself."""

    def batch(rows: DataFrame, number: int) -> None:
        checks.page_hits(audit.prepared(rows)).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return pages.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream(spark: SparkSession, folder: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).parquet(folder)
