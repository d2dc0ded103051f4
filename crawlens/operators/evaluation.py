"""Analytics over many audits: integrity, fire rates, before and after, verdicts and stability."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from crawlens.operators import severity

SLOW_S, REPEATS, TITLES = 300, 3, 10
RAN = ("complete", "partial")


def run_facts(runs: DataFrame) -> DataFrame:
    """``runs(slug, run_status, wall_s)`` → per status: sites, median and longest wall time."""
    return runs.groupBy("run_status").agg(F.count("*").alias("sites"), F.percentile("wall_s", F.lit(0.5)).alias("median_s"), F.max("wall_s").alias("max_s"))


def problems(runs: DataFrame, findings: DataFrame, reports: DataFrame) -> DataFrame:
    """``(slug, problem)``: runs that are missing, slow or crashed, and reports that do not add up. A run that is missing or crashed is looked at no further.

    ``reports(slug, total_findings, critical, high, medium, low, info)``, ``findings(slug, id, position, check_id, affected_urls)``.
    """
    said = lambda df, what: df.select("slug", F.lit(what).alias("problem"))
    known = severity.dimension(findings.sparkSession).select("check_id")
    crashed = F.coalesce((F.col("rc") != "0") | ~F.col("report_written"), F.lit(True))
    over = runs.where(F.col("wall_s").isNull() | crashed).select("slug")
    reports, findings = reports.join(over, "slug", "left_anti"), findings.join(over, "slug", "left_anti")
    parts = [
        said(runs.where("wall_s IS NULL"), "not_run"),
        said(runs.where(F.col("wall_s") >= SLOW_S), "over_5_minutes"),
        said(runs.where(F.col("wall_s").isNotNull() & crashed), "crash_or_no_report"),
        said(reports.where("critical + high + medium + low + info <> total_findings"), "counts_do_not_add_up"),
        said(findings.where("id <> format_string('F-%03d', position)").select("slug").distinct(), "ids_out_of_order"),
        said(findings.where("size(array_distinct(affected_urls)) <> size(affected_urls)").select("slug").distinct(), "duplicate_affected_urls"),
        said(findings.join(F.broadcast(known), "check_id", "left_anti").select("slug").distinct(), "unknown_check_id"),
        said(findings.groupBy("slug", "check_id").count().where(F.col("count") > REPEATS).select("slug").distinct(), "same_check_repeated_over_3_times"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def fire_rate(findings: DataFrame, n_readable: int, counted: str = "*") -> DataFrame:
    """Per check: findings, sites, severities, and the rate both by findings and by distinct sites. ``n_readable`` counts the sites whose run is one of RAN; ``counted="slug"`` leaves findings of no site out of both counts."""
    said = F.col("severity") if "severity" in findings.columns else F.lit(None).cast("string")
    g = findings.groupBy("check_id").agg(F.count(counted).alias("findings"), F.count_distinct("slug").alias("sites"), F.array_sort(F.collect_set(said)).alias("severities"))
    return g.withColumn("rate_by_findings", F.col("findings") / max(1, n_readable)).withColumn("rate_by_sites", F.col("sites") / max(1, n_readable))


def never_fired(findings: DataFrame) -> DataFrame:
    return severity.dimension(findings.sparkSession).select("check_id").join(findings.select("check_id").distinct(), "check_id", "left_anti")


def severe(findings: DataFrame) -> DataFrame:
    return findings.where("status = 'active' AND severity IN ('critical', 'high')").select("slug", "check_id")


def changed(before: DataFrame, after: DataFrame) -> DataFrame:
    """Multiset differences both ways: ``(columns…, change)``."""
    return before.exceptAll(after).withColumn("change", F.lit("removed")).unionByName(after.exceptAll(before).withColumn("change", F.lit("added")))


def status_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    return before.select("slug", F.col("run_status").alias("was")).join(after.select("slug", F.col("run_status").alias("now")), "slug").where("was <> now")


def tally(found: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Severe findings by hand verdict; without one they are unchecked."""
    v = verdicts.groupBy("slug", "check_id").agg(F.min("verdict").alias("verdict"))
    return found.join(v, ["slug", "check_id"], "left").groupBy(F.coalesce("verdict", F.lit("unchecked")).alias("verdict")).agg(F.count("*").alias("n"))


def precision(counts: DataFrame) -> DataFrame:
    """Correct among judged; null where nothing was judged."""
    of = lambda v: F.coalesce(F.sum(F.when(F.col("verdict") == v, F.col("n"))), F.lit(0))
    return counts.agg(of("correct").alias("correct"), of("false_positive").alias("wrong")).withColumn("precision", F.col("correct") / F.nullif(F.col("correct") + F.col("wrong"), F.lit(0)))


def outcomes(before: DataFrame, after: DataFrame, ran: DataFrame | None = None) -> DataFrame:
    """What became of the first finding of each (site, check): removed, reduced, kept, absent before, or no output.

    Both have ``(slug, check_id, position, severity, affected_urls)`` and may have ``status``; a finding is reduced by a lower severity, fewer pages,
    or a status that changed. ``ran(slug)`` has the sites whose second run gave a report.
    """

    def first(df: DataFrame, p: str) -> DataFrame:
        status = F.col("status") if "status" in df.columns else F.lit("active")
        of = lambda c, name: F.min_by(c, "position").alias(f"{p}_{name}")
        return df.groupBy("slug", "check_id").agg(of(severity.level(F.col("severity")), "level"), of(F.size("affected_urls"), "urls"), of(status, "status"))

    j = first(before, "b").join(first(after, "a"), ["slug", "check_id"], "full")
    none = F.lit(False) if ran is None else ~F.coalesce("ran", F.lit(False))
    if ran is not None:
        j = j.join(ran.select("slug", F.lit(True).alias("ran")).distinct(), "slug", "left")
    less = (F.col("a_level") < F.col("b_level")) | (F.col("a_urls") < F.col("b_urls")) | (F.col("a_status") != F.col("b_status"))
    fate = F.when(none, "no_output").when(F.col("b_level").isNull(), "absent_in_scripted").when(F.col("a_level").isNull(), "removed").when(less, "reduced").otherwise("kept")
    return j.select("slug", "check_id", fate.alias("outcome"))


def listed(findings: DataFrame) -> DataFrame:
    """Findings of medium severity or above, worst first within a site."""
    return findings.where(severity.level(F.col("severity")) >= severity.level(F.lit("medium"))).select("slug", "check_id", "severity", "title", F.row_number().over(W.partitionBy("slug").orderBy(severity.level(F.col("severity")).desc(), "position")).alias("place"))


def sums(runs: DataFrame) -> DataFrame:
    """Wall time and cost over all runs: ``runs(slug, wall_s, cost)``; a missing figure counts as none."""
    return runs.agg(F.count("*").alias("runs"), F.coalesce(F.sum("wall_s"), F.lit(0.0)).alias("wall_s"), F.percentile("wall_s", F.lit(0.5)).alias("median_s"), F.coalesce(F.sum("cost"), F.lit(0.0)).alias("cost"))


def stability(one: DataFrame, two: DataFrame) -> DataFrame:
    """Share of (site, check) with equal outcomes in two runs."""
    j = one.join(two.withColumnRenamed("outcome", "other"), ["slug", "check_id"], "full")
    return j.agg(F.count("*").alias("pairs"), F.avg(F.col("outcome").eqNullSafe(F.col("other")).cast("int")).alias("stable"))


def digest(findings: DataFrame) -> DataFrame:
    """Screening line per site: counts by band, and the titles of the TITLES worst."""
    n = lambda b: F.count_if(F.col("severity") == b).alias(b)
    turn = F.row_number().over(W.partitionBy("site_id").orderBy(severity.level(F.col("severity")).desc(), "title"))
    worst = F.array_sort(F.collect_list(F.when(F.col("severity").isin("critical", "high") & (F.col("turn") <= TITLES), F.col("title"))))
    return findings.withColumn("turn", turn).groupBy("site_id").agg(n("critical"), n("high"), n("medium"), n("low"), worst.alias("worst"))


def consecutive(pages: DataFrame, status: int = 503) -> DataFrame:
    """The longest run of one status in crawl order, per site: gaps and islands."""
    order = W.partitionBy("site_id").orderBy("page_seq")
    hit = (F.col("status") == status).cast("int")
    isle = F.row_number().over(order) - F.sum(hit).over(order.rowsBetween(W.unboundedPreceding, W.currentRow))
    runs = pages.withColumn("isle", isle).where(hit == 1).groupBy("site_id", "isle").agg(F.count("*").alias("n"))
    return runs.groupBy("site_id").agg(F.max("n").alias("longest"))


def same_report(one: DataFrame, two: DataFrame) -> DataFrame:
    """Replay determinism: whether two reports of a site are equal, by digest of their JSON in key order."""
    sign = lambda df, n: df.select("site_id", F.sha2(F.to_json(F.struct(*sorted(c for c in df.columns))), 256).alias(n))
    return sign(one, "x").join(sign(two, "y"), "site_id").select("site_id", (F.col("x") == F.col("y")).alias("equal"))
