"""What an audit did not look at, as rows: what no crawl can see, what had no page to look at, and what failed."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from crawlens.operators import checks

#: Never assessed, whatever the site: (check, reason, what it means and how to find out).
ENGAGEMENT = (
    ("E_colour_contrast", "Not assessed: contrast of colours needs computed styles, and those need a browser.", "Measure the contrast of the main templates with an accessibility tool."),
    ("E_core_web_vitals", "Not assessed: loading and response times of real visits cannot be had from one fetch.", "See the field data that search consoles publish for the site."),
    ("E_behaviour_metrics", "Not assessed: bounces, dwell time, scrolling and conversions are observed, not read from markup.", "Compare visits that come from assistants with others in the site's analytics."),
    ("E_rendered_experience", "Not assessed: overlays, tap targets, focus and layout take styles and scripts that run.", "Walk through the main templates at phone width, by touch and by keyboard."),
    ("E_copy_quality", "Not assessed: whether copy persuades has no threshold that holds for all subjects and languages.", "Ask someone from outside what a page offers, and to whom, once they have read it aloud."),
    ("E_authenticated_flows", "Not assessed: nothing behind a login, a checkout or an account is opened.", "Go through sign-up or purchase with a test account and count its steps and fields."),
)
CORROBORATION = ("D6_cross_web_corroboration", "Not assessed: whether others agree with the site's claims takes a search of other sites.", "Look up the main facts elsewhere and count independent sources that agree.")
NO_PAGE = ("engagement-audit", "no page returned readable HTML, so no engagement check ran", "Engagement was not assessed at all: mend access first, then audit again.")
NOT_AUDITED = "this concern was not audited"


def _rows(sites: DataFrame, rows) -> DataFrame:
    literal = F.array(*(F.struct(*(F.lit(x).alias(n) for x, n in zip(r, ("check", "reason", "impact")))) for r in rows))
    return sites.select("site_id", F.explode(literal).alias("r")).select("site_id", "r.*")


def skipped(parsed: DataFrame, failed: DataFrame | None = None) -> DataFrame:
    """``(site_id, check, reason, impact)`` for all sites of ``parsed``; ``failed(site_id, check, reason)`` has the plug-ins that broke off."""
    sites = parsed.groupBy("site_id").agg(F.coalesce(F.bool_or(F.col("status").between(200, 299) & F.col("f").isNotNull()), F.lit(False)).alias("read"), F.count("parse_error").alias("bad"), F.min("parse_error").alias("why"))
    out = _rows(sites, ENGAGEMENT).unionByName(_rows(sites.where("read"), (CORROBORATION,))).unionByName(_rows(sites.where("NOT read"), (NO_PAGE,)))
    unread = F.concat(F.col("bad").cast("string"), F.lit(" page(s) could not be read: "), F.col("why"))
    out = out.unionByName(sites.where("bad > 0").select("site_id", F.lit("page_parse").alias("check"), unread.alias("reason"), F.lit("no check saw these pages").alias("impact")))
    return out if failed is None else out.unionByName(failed.select("site_id", "check", "reason", F.lit(NOT_AUDITED).alias("impact")))
