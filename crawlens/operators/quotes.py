"""Where quotations stand: an index of character trigrams per site, so that a quotation meets only pages that may hold it.

A page holds a quotation only if it holds all its trigrams. Pages keep those of their trigrams that some quotation of their site has (a page is
read once for all of them); of each quotation the RAREST are looked up, by the number of pages that have them, and only pages
that have all of these are searched for the text itself. Quotations of fewer than three characters are one gram.

Where a site has more than FEW quotations, their trigrams would travel with each of its pages. There a quotation is looked up by its first or last
characters instead, whichever fewer pages have: as many of them as the largest of WIDTHS that fits. Pages give all their runs of these widths, which meet the
quotations by equality; runs that are whole quotations need no search.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from crawlens.sources.storage import stored

SIZE, RAREST = 3, 3
FEW, WIDTHS = 64, (1, 2, 3, 5, 8, 13, 21)


def grams(text: str) -> set[str]:
    return {text[i : i + SIZE] for i in range(max(1, len(text) - SIZE + 1))} if text else set()


def _cut(quotes: DataFrame) -> DataFrame:
    """``(site_id, kind, quote, gram)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = [sorted(grams(q)) for q in b.column("quote").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("site_id"), b.column("kind"), b.column("quote"), pa.array(own, pa.list_(pa.string()))], names=["site_id", "kind", "quote", "grams"])

    return quotes.select("site_id", "kind", "quote").distinct().mapInArrow(run, "site_id string, kind string, quote string, grams array<string>").select("site_id", "kind", "quote", F.explode("grams").alias("gram"))


def postings(texts: DataFrame, cut: DataFrame) -> DataFrame:
    """``(site_id, kind, url, gram)``: the trigrams of quotations that each text has. ``texts(site_id, url, kind, text)``."""
    wanted = cut.groupBy("site_id", "kind").agg(F.collect_set("gram").alias("wanted"))  # of the quotations of one site, of which a review has a fixed number

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [sorted({t[i : i + n] for n in {len(g) for g in w} for i in range(len(t) - n + 1)}.intersection(w)) for t, w in zip(b.column("text").to_pylist(), b.column("wanted").to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column("site_id"), b.column("kind"), b.column("url"), pa.array(found, pa.list_(pa.string()))], names=["site_id", "kind", "url", "grams"])

    met = texts.where("text IS NOT NULL").join(wanted, ["site_id", "kind"]).select("site_id", "kind", "url", "text", "wanted")
    return met.mapInArrow(run, "site_id string, kind string, url string, grams array<string>").select("site_id", "kind", "url", F.explode("grams").alias("gram"))


def candidates(cut: DataFrame, posted: DataFrame) -> DataFrame:
    """``(site_id, kind, quote, url)``: the pages that have the rarest trigrams of a quotation, all of them."""
    often = posted.groupBy("site_id", "kind", "gram").agg(F.count("*").alias("pages"))
    known = cut.join(often, ["site_id", "kind", "gram"], "left").withColumn("pages", F.coalesce("pages", F.lit(0)))
    turn = F.row_number().over(W.partitionBy("site_id", "kind", "quote").orderBy("pages", "gram"))
    rare = known.withColumn("turn", turn).where(F.col("turn") <= RAREST)
    n = rare.groupBy("site_id", "kind", "quote").agg(F.count("*").alias("n"))
    met = rare.join(posted, ["site_id", "kind", "gram"]).groupBy("site_id", "kind", "quote", "url").agg(F.count("*").alias("m"))
    return met.join(n, ["site_id", "kind", "quote"]).where("m = n").select("site_id", "kind", "quote", "url")


def runs(texts: DataFrame, widths: DataFrame) -> DataFrame:
    """``(site_id, kind, url, run)``: the different runs of characters of each text, of the ``widths`` of its site."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [sorted({t[i : i + n] for n in w for i in range(len(t) - n + 1)}) for t, w in zip(b.column("text").to_pylist(), b.column("widths").to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column("site_id"), b.column("kind"), b.column("url"), pa.array(found, pa.list_(pa.string()))], names=["site_id", "kind", "url", "runs"])

    met = texts.where("text IS NOT NULL").join(widths, ["site_id", "kind"]).select("site_id", "kind", "url", "text", "widths")
    return met.mapInArrow(run, "site_id string, kind string, url string, runs array<string>").select("site_id", "kind", "url", F.explode("runs").alias("run"))


def by_ends(quotes: DataFrame, texts: DataFrame) -> DataFrame:
    """``places`` for any number of quotations a site; ``quotes`` are distinct."""
    size = F.length("quote")
    width = F.coalesce(*(F.when(size >= n, n) for n in reversed(WIDTHS)))
    ends = quotes.withColumn("width", width).withColumn("run", F.explode(F.array_distinct(F.array(F.left("quote", F.col("width")), F.right("quote", F.col("width"))))))
    widths = ends.groupBy("site_id", "kind").agg(F.collect_set("width").alias("widths"))
    posted = stored(runs(texts, widths).join(ends.select("site_id", "kind", "run").distinct(), ["site_id", "kind", "run"], "left_semi"), "runs")
    often = posted.groupBy("site_id", "kind", "run").agg(F.count("*").alias("pages"))
    rare = ends.join(often, ["site_id", "kind", "run"], "left").groupBy("site_id", "kind", "quote").agg(F.min_by("run", F.struct(F.coalesce("pages", F.lit(0)), "run")).alias("run"))
    near = rare.join(posted, ["site_id", "kind", "run"])
    longer = near.where("run <> quote").select("site_id", "kind", "quote", "url").distinct().join(texts, ["site_id", "kind", "url"]).where(F.contains("text", "quote"))
    return near.where("run = quote").select("site_id", "kind", "quote", "url").unionByName(longer.select("site_id", "kind", "quote", "url"))


def places(quotes: DataFrame, texts: DataFrame) -> DataFrame:
    """``(site_id, kind, quote, url)``: the pages whose text of the kind holds the quotation. ``quotes(site_id, kind, quote)``; both sides are normalised alike."""
    asked = quotes.where(F.coalesce("quote", F.lit("")) != "").select("site_id", "kind", "quote").distinct()
    many = asked.groupBy("site_id", "kind").agg(F.count("*").alias("n")).where(F.col("n") > FEW)
    cut = _cut(asked.join(many, ["site_id", "kind"], "left_anti"))
    near = candidates(cut, postings(texts, cut))
    few = near.join(texts, ["site_id", "kind", "url"]).where(F.contains("text", "quote")).select("site_id", "kind", "quote", "url")
    return few.unionByName(by_ends(stored(asked.join(many, ["site_id", "kind"], "left_semi"), "quotes"), texts))
