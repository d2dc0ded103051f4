"""Connected components by alternating large-star and small-star steps over a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from crawlens.llm.common import stored


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").bitwiseAND(F.lit((1 << 40) - 1)).cast("decimal(28,0)")).alias("s")).head()
    return row["n"], row["s"]


def components(edges: DataFrame) -> DataFrame:
    """``edges(a, b)`` of longs → ``(node, label)`` for every node of an edge; the label is the smallest node reachable.

    Each step is a grouped minimum (combined before its shuffle) and a join; the edges of a round are
    written to shared storage, so neither a hub's edges nor the links reach one task or the driver.
    """
    e = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = _mark(e)
    while before[0]:
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(e.select("b", "a"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        e = stored(small.where("a <> b").distinct(), "edges")
        after = _mark(e)
        if after == before:
            break
        before = after
    return e.select(F.col("a").alias("node"), F.col("b").alias("label")).union(e.select("b", "b").distinct())
