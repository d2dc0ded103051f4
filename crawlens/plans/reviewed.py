"""An audit with a reviewer's part: verified claims become findings, those that restate a scripted one go, and verdicts regrade scripted findings; all before the ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from crawlens.operators import claims as C, review, severity
from crawlens.plans import profiles
from crawlens.sources.storage import stored

CLAIM = ("title", "why", "mechanism", "hurts", "severity", "nearest_check", "affected_urls", "evidence", "suggested_action")


def page_texts(parsed: DataFrame, html: DataFrame) -> DataFrame:
    """``(site_id, url, ok, html, extracted, full, headers)``: what evidence is tested on. ``html(site_id, url, html)`` has the pages as fetched."""
    ok = F.col("status").between(200, 299) & F.col("f").isNotNull()
    p = parsed.select("site_id", "url", ok.alias("ok"), F.col("f.extracted").alias("extracted"), F.col("f.full").alias("full"), "headers")
    return p.join(html.select("site_id", "url", "html"), ["site_id", "url"], "left")


def tested(claims: DataFrame, parsed: DataFrame, texts: DataFrame) -> DataFrame:
    """The evidence of claims, held against texts and, where it names a field, against the pages' profiles."""
    wanted = claims.select("site_id", F.explode("evidence").alias("e")).where("e.type = 'field' AND e.path IS NOT NULL").select("site_id", "e.path").distinct()
    asked = parsed.select("site_id", "url").join(wanted, "site_id")  # a claim names few fields
    return C.assertions(claims, texts, profiles.fields(profiles.pages(parsed), asked))


def judged_claims(claims: DataFrame, checked: DataFrame, texts: DataFrame, scripted: DataFrame) -> DataFrame:
    """Claims with ``rejected_reason``, ``blast_radius`` and ``affected_urls``; one that restates a scripted finding is rejected for that."""
    v = stored(C.verified(claims, checked, texts.where("ok").select("site_id", "url")), "claims")
    twins = C.restated(v.where("rejected_reason IS NULL"), scripted)
    why = F.concat(F.lit("duplicates scripted check "), F.array_join("twins", ", "), F.lit(", which already reports these pages for the same gate"))
    return v.join(twins, ["site_id", "claim"], "left").withColumn("rejected_reason", F.coalesce("rejected_reason", F.when(F.col("twins").isNotNull(), why))).withColumn("restates", F.col("twins").isNotNull()).drop("twins")


def as_findings(judged: DataFrame, totals: DataFrame) -> DataFrame:
    """Accepted claims as finding rows. ``totals(site_id, total)`` has the readable pages."""
    said = F.concat(F.lit("Reviewer's explanation (not verified): "), F.col("why"), F.lit(" Checked against the crawl: "), F.array_join(F.transform("evidence", lambda e: F.concat_ws(" ", e["type"], F.coalesce(e["path"], e["header"]), e["op"], e["value"])), "; "))
    return judged.where("rejected_reason IS NULL").join(totals, "site_id", "left").select(
        "site_id", F.lit(severity.REVIEW).alias("check_id"), "title", said.alias("evidence"), "affected_urls", "blast_radius", F.lit("heuristic").alias("confidence"), F.lit("static_heuristic").alias("measurement_basis"), F.lit("active").alias("status"),
        F.coalesce("suggested_action.effort", F.lit("medium")).alias("effort"), F.coalesce("total", F.lit(0)).alias("coverage_pages"), F.col("severity").alias("proposed_severity"), F.col("mechanism").alias("proposed_mechanism"), F.col("hurts").alias("proposed_hurts"),
    )


def summary(judged: DataFrame, verdicts: DataFrame | None = None) -> DataFrame:
    """``(site_id, agent_review)``: JSON of how many claims came, held, were merged and why others were not; and of verdicts, if there are."""
    own = F.struct("claim", "title", F.col("rejected_reason").alias("reason"))
    g = judged.groupBy("site_id").agg(
        F.count("*").alias("claims_submitted"), F.count_if(F.col("rejected_reason").isNull() | F.col("restates")).alias("verified"), F.count_if(F.col("rejected_reason").isNull()).alias("merged"),
        F.array_sort(F.collect_list(F.when(F.col("rejected_reason").isNotNull(), own))).alias("rejected"),
    )
    parts = [F.lit("run").alias("status"), "claims_submitted", "verified", "merged", "rejected"]
    if verdicts is not None:
        told = F.struct("n", "check_id", F.col("rejected_reason").alias("reason"))
        v = verdicts.groupBy("site_id").agg(F.count("*").alias("verdicts_submitted"), F.count_if(F.col("rejected_reason").isNull()).alias("verdicts_applied"), F.array_sort(F.collect_list(F.when(F.col("rejected_reason").isNotNull(), told))).alias("verdicts_rejected"))
        g, parts = g.join(v, "site_id", "full"), [*parts, "verdicts_submitted", "verdicts_applied", "verdicts_rejected"]
    return g.select("site_id", F.to_json(F.struct(*parts)).alias("agent_review"))


def reviewed(scripted: DataFrame, judged: DataFrame, totals: DataFrame, verdicts: DataFrame | None = None) -> DataFrame:
    """The findings of an audit after its review, graded and ranked anew.

    ``scripted`` are ranked findings, ``judged`` claims from ``judged_claims``, ``verdicts`` those from ``review.judged``.
    """
    kept = review.applied(scripted, verdicts) if verdicts is not None else scripted.drop("rank", "id", "priority_score")
    more = severity.graded(as_findings(judged, totals))
    every = kept.drop("priority_score", "rank").unionByName(more, allowMissingColumns=True)
    return severity.ranked(severity.priority(every))
