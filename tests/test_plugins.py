"""Plug-in checks, what they cost when they fail, and the rows of what was not looked at."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from crawlens.functions import html
from crawlens.operators import plugins, review, skips
from crawlens.plans import audit

SCHEMA = "site_id string, page_seq long, url string, final_url string, status int, role string, html string, headers map<string,string>, redirect_chain array<string>, start_url string, audited_at string"


def page(site, seq, body, status=200):
    url = f"https://{site}/{seq}"
    return (site, seq, url, url, status, "generic", f"<html lang=en><title>Page {seq}</title><h1>H</h1>{body}</html>", {}, [], f"https://{site}/", "2026-09-12 00:00:00")


class Counts(plugins.SiteCheck):
    """Yields a hit a page; breaks on one site at its third page, on another at the end."""

    name, needs = "Z_counts", ("url", "f.title", "final_url")
    spec = ("%d page(s) were counted", "all", "deterministic", "static_fact", "low")

    def __init__(self):
        self.seen = []

    def page(self, page):
        self.seen.append(page["page_seq"])
        if page["site_id"] == "b.test" and len(self.seen) == 3:
            raise ZeroDivisionError("third page")
        yield plugins.Hit(page["url"], page["title"])

    def site(self):
        assert self.seen == sorted(self.seen)
        if "c.test" in str(self.seen) or len(self.seen) == 1:
            raise KeyError("at the end")
        yield plugins.Hit(f"end-{len(self.seen)}")


@pytest.fixture(scope="module")
def pages(spark):
    more = "<h1>again</h1><h2>a</h2><h2>b</h2><h3>c</h3><img src=1><img src=2><img src=3>"
    rows = [page("a.test", i, more if i % 2 else "<a href=/press/>press</a>") for i in range(5)] + [page("b.test", i, more) for i in range(4)] + [page("c.test", 0, "<p>x</p>")] + [page("d.test", i, "gone", 503) for i in range(2)]
    return html.parsed(spark.createDataFrame(rows, SCHEMA).withColumn("audited_at", F.to_timestamp("audited_at")).repartition(3)).cache()


def test_a_failing_check_costs_one_row_on_one_site(pages):
    alone, none = plugins.run(pages, plugins.RETIRED)
    assert none.count() == 0
    hits, failed = plugins.run(pages, (*plugins.RETIRED, Counts))
    assert {(r["site_id"], r["check"], r["reason"]) for r in failed.collect()} == {("b.test", "Z_counts", "the check failed: ZeroDivisionError: third page"), ("c.test", "Z_counts", "the check failed: KeyError: 'at the end'")}
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(hits.where("check_id <> 'Z_counts'")) == rows(alone) and alone.count()
    mine = [r for r in hits.where("check_id = 'Z_counts'").collect()]
    assert {r["site_id"] for r in mine} == {"a.test"} and sorted(r["url"] for r in mine)[-1] == "https://a.test/4" and "end-5" in {r["url"] for r in mine}


def test_plug_ins_equal_the_expressions(pages):
    cols = ("site_id", "url", "check_id", "key", "note", "status")
    rows = lambda df: sorted(map(tuple, df.select(*cols).collect()))
    assert rows(plugins.run(pages, plugins.RETIRED)[0]) == rows(review.retired_hits(pages))


def test_plugged_hits_become_findings(pages):
    plugged = (plugins.SeveralFirstHeadings, Counts)
    hits, _ = plugins.run(pages, plugged)
    with_them = {(r["site_id"], r["check_id"]): r for r in audit.graded_findings(pages, plugged=plugged, hits=hits).collect()}
    without = {(r["site_id"], r["check_id"]) for r in audit.graded_findings(pages).collect()}
    assert set(with_them) - without == {("a.test", "Z_counts"), ("a.test", "E6_multiple_h1"), ("b.test", "E6_multiple_h1")}
    assert with_them["a.test", "E6_multiple_h1"]["title"] == "Several first headings on 2 page(s)" and with_them["a.test", "Z_counts"]["severity"] == "low"


def test_rows_of_what_was_skipped(spark, pages):
    _, failed = plugins.run(pages, (Counts,))
    got = [(r["site_id"], r["check"]) for r in skips.skipped(pages, failed).collect()]
    assert len(got) == len(set(got))
    n = Counter(site for site, _ in got)
    assert n == {"a.test": 7, "b.test": 8, "c.test": 8, "d.test": 7}
    assert ("d.test", "engagement-audit") in got and ("d.test", "D6_cross_web_corroboration") not in got and ("b.test", "Z_counts") in got
    assert len([c for s, c in got if s == "a.test" and c.startswith("E_")]) == 6
    broken = pages.withColumn("parse_error", F.when(F.col("page_seq") == 0, F.lit("ValueError: x")))
    assert {r["reason"] for r in skips.skipped(broken).where("check = 'page_parse'").collect()} == {"1 page(s) could not be read: ValueError: x"}
