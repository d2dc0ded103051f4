"""The gate for finished reports: constraints on a report's parts and on how they agree, all evaluated in one pass.

Each constraint is a condition over the report's row; a null counts as a breach. ``breaches`` has a row for each that fails, ``gate`` counts them with
observed metrics while the reports are written, so that a run that must be stopped costs no second look.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, functions as F

from crawlens.operators import severity

FINDING = "array<struct<id: string, title: string, check_id: string, severity: string, status: string, evidence: string, affected_urls: array<string>, affected_count: int, suggested_action: struct<summary: string, priority: string>>>"
STATUSES = ("active", "latent", "confirm_intent")
COUNTED = ("critical", "high", "medium", "low")


def constraints() -> dict[str, Column]:
    """By name, the condition. They read ``_f``, the findings as rows, beside the report's columns."""
    f, size = F.col("_f"), F.size("_f")
    every = lambda test: F.forall(f, lambda x: F.coalesce(test(x), F.lit(False)))
    n = lambda test: F.size(F.filter(f, test))
    said = lambda c: F.coalesce(F.trim(c), F.lit("")) != ""
    out = {
        "site_is_named": said(F.col("site_id")),
        "audited_at_is_a_time": F.try_to_timestamp("audited_at").isNotNull(),
        "findings_are_a_list": f.isNotNull(),
        "findings_have_all_parts": every(lambda x: said(x["id"]) & said(x["title"]) & said(x["severity"]) & x["evidence"].isNotNull()),
        "evidence_is_not_empty": every(lambda x: said(x["evidence"])),
        "severities_are_known": every(lambda x: x["severity"].isin(*severity.BANDS)),
        "statuses_are_known": every(lambda x: F.coalesce(x["status"], F.lit("active")).isin(*STATUSES)),
        "ids_are_in_order": F.forall(F.transform(f, lambda x, i: x["id"] == F.format_string("F-%03d", i + 1)), lambda ok: F.coalesce(ok, F.lit(False))),
        "addresses_occur_once": every(lambda x: F.size(F.array_distinct(x["affected_urls"])) == F.size(x["affected_urls"])),
        "total_matches": F.col("total_findings") == size,
        "active_matches": F.col("active_findings") == n(lambda x: F.coalesce(x["status"], F.lit("active")) == "active"),
        "latent_matches": F.col("latent_findings") == n(lambda x: x["status"] == "latent"),
        "confirm_intent_matches": F.col("confirm_intent_findings") == n(lambda x: x["status"] == "confirm_intent"),
        "statuses_add_up": F.col("active_findings") + F.col("latent_findings") + F.col("confirm_intent_findings") == F.col("total_findings"),
        "severities_add_up": F.col("critical") + F.col("high") + F.col("medium") + F.col("low") + F.col("info") == F.col("total_findings"),
    }
    is_active = lambda x: F.coalesce(x["status"], F.lit("active")) == "active"

    def banded(band: str) -> dict[str, Column]:
        return {f"{band}_matches": F.col(band) == n(lambda x: x["severity"] == band), f"active_{band}_matches": F.col(f"active_{band}") == n(lambda x: (x["severity"] == band) & is_active(x))}

    for b in COUNTED:
        out |= banded(b)
    return out


def _judged(reports: DataFrame) -> tuple[DataFrame, list[str]]:
    rows = reports.withColumn("_f", F.from_json("findings", FINDING))
    tests = constraints()
    return rows.select("site_id", *(F.coalesce(test, F.lit(False)).alias(name) for name, test in tests.items())), list(tests)


def breaches(reports: DataFrame) -> DataFrame:
    """``(site_id, problem)``: every constraint that a report breaks."""
    judged, names = _judged(reports)
    failed = F.array_compact(F.array(*(F.when(~F.col(n), F.lit(n)) for n in names)))
    return judged.select("site_id", F.explode(failed).alias("problem"))


def gate(reports: DataFrame, path: str) -> dict[str, int]:
    """Write the reports as JSON, one a line; how many there are, and how many break each constraint, from the same pass."""
    seen = Observation()
    rows = reports.withColumn("_f", F.from_json("findings", FINDING))
    tests = constraints()
    watched = rows.observe(seen, F.count(F.lit(1)).alias("reports"), *(F.count_if(~F.coalesce(t, F.lit(False))).alias(n) for n, t in tests.items()))
    watched.drop("_f").write.mode("overwrite").json(path)
    return seen.get


def unreplayable(one: DataFrame, two: DataFrame) -> DataFrame:
    """``(site_id, problem)``: sites whose report a second run over the same input gave otherwise, whatever the order of keys."""
    from crawlens.operators import replay

    whole = lambda df: df.select("site_id", F.to_json(F.struct(*[c for c in df.columns if c != "site_id"]), {"ignoreNullFields": "false"}).alias("report"))
    return replay.equal(whole(one), whole(two), "site_id", "report").where("NOT equal").select("site_id", F.lit("replay_not_deterministic").alias("problem"))
