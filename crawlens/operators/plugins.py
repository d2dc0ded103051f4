"""Checks that others bring along. Each runs as a table function over the pages of one site at a time; one that fails costs its own findings on that site, and a row that says so.

A check is a class: ``page`` sees the pages of a site in crawl order, ``site`` comes after the last; both yield hits. A new object serves
each site, so that it may keep what it has seen, and pages come one by one, whatever their number. An exception of any kind
ends the check on that site alone: its earlier hits there are taken back, and nothing else changes.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame, Row, functions as F
from pyspark.sql.functions import udtf

from crawlens.operators import checks
from crawlens.sources.storage import stored

OUT = "site_id string, url string, check_id string, key string, note string, status string, failure string"
HIT = ("site_id", "url", "check_id", "key", "note", "status")


class Hit(NamedTuple):
    url: str
    note: str = ""
    key: str = ""
    status: str = "active"


class SiteCheck:
    """A check over a site's readable pages. ``needs`` names what it reads: columns of the pages, or their facts as ``f.…``."""

    name = ""
    needs: tuple[str, ...] = ("url",)
    #: As in the catalogue: title, reach rule, confidence, basis, effort.
    spec = ("A check of its own fired on %d page(s)", "template", "heuristic", "static_heuristic", "medium")

    def page(self, page: Row) -> Iterator[Hit]:
        yield from ()

    def site(self) -> Iterator[Hit]:
        yield from ()


def _function(check: type[SiteCheck]):
    """The check as a table function."""

    @udtf(returnType=OUT)
    class Runner:
        def __init__(self):
            self.check, self.where, self.failure = check(), None, None

        def _kept(self, hits):
            """Hits until one step fails; then the failure, once."""
            if self.failure is not None:
                return
            try:
                for h in hits():
                    yield self.where, h.url, check.name, h.key, h.note, h.status, None
            except Exception as e:  # whatever a check may do
                self.failure = f"{type(e).__name__}: {e}"[:200]
                yield self.where, None, check.name, None, None, None, self.failure

        def eval(self, row: Row):
            self.where = row["site_id"]
            yield from self._kept(lambda: self.check.page(row))

        def terminate(self):
            yield from self._kept(self.check.site)

    return Runner


def run(pages: DataFrame, plugged: Sequence[type[SiteCheck]]) -> tuple[DataFrame, DataFrame]:
    """``(site_id, url, check_id, key, note, status)`` of all checks on all sites, and ``(site_id, check, reason)`` of those that failed."""
    spark = pages.sparkSession
    rows = spark.createDataFrame([], OUT)
    ok = checks.readable(pages)
    for check in plugged:
        own = ok.select("site_id", "page_seq", *(F.col(c).alias(c.split(".")[-1]) for c in check.needs if c not in ("site_id", "page_seq")))
        rows = rows.unionByName(_function(check)(own.asTable().partitionBy("site_id").orderBy("page_seq")))
    rows = stored(rows, "plugged")  # so that every check runs once
    failed = rows.where("failure IS NOT NULL").select("site_id", F.col("check_id").alias("check"), F.concat(F.lit("the check failed: "), F.col("failure")).alias("reason"))
    gone = failed.select("site_id", F.col("check").alias("check_id"))
    return rows.where("failure IS NULL").select(*HIT).join(gone, ["site_id", "check_id"], "left_anti").select(*HIT), failed


# --- checks of earlier catalogues, as plug-ins ----------------------------------------------------------------------------
class SeveralFirstHeadings(SiteCheck):
    name, needs = "E6_multiple_h1", ("url", "f.h1")
    spec = ("Several first headings on %d page(s)", "template", "heuristic", "static_heuristic", "low")

    def page(self, page):
        if len(page["h1"]) > 1:
            yield Hit(page["url"], str(len(page["h1"])))


class NoAnchors(SiteCheck):
    name, needs = "X2_no_citation_anchor", ("url", "f.headings", "f.anchored_headings")
    spec = ("Sections of %d page(s) cannot be linked to", "template", "deterministic", "static_fact", "low")

    def page(self, page):
        if len(page["headings"]) >= 3 and not page["anchored_headings"]:
            yield Hit(page["url"], str(len(page["headings"])))


class FactsInImages(SiteCheck):
    name, needs = "B5_fact_locked_in_image", ("url", "f.wide_blank_images")
    spec = ("Large images without alt text on %d page(s)", "template", "heuristic", "static_heuristic", "medium")

    def page(self, page):
        if page["wide_blank_images"] >= 3:
            yield Hit(page["url"], str(page["wide_blank_images"]))


class NoPressLink(SiteCheck):
    """Of a site: no page links to its press or news; reported for the first page."""

    name, needs = "D5_no_corroboration_hooks", ("url", "f.hrefs")
    spec = ("No page links to press or news", "site_wide", "heuristic", "static_heuristic", "low")
    press = re.compile(r"(?i)(^|/)(press|newsroom|news|media-cent(er|re)|in-the-news)(/|$|\?|#)")

    def __init__(self):
        self.first, self.linked = None, False

    def page(self, page):
        self.first = self.first or page["url"]
        self.linked = self.linked or any(self.press.search(h) for h in page["hrefs"] if h)
        yield from ()

    def site(self):
        if self.first and not self.linked:
            yield Hit(self.first)


RETIRED = (SeveralFirstHeadings, NoAnchors, FactsInImages, NoPressLink)
