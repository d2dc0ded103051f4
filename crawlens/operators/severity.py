"""Severity, priority, latency and rank of findings, as joins with a small dimension and rank arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

# Check, base severity, gate, mechanism.
SEVERITY = (
    ("A1_retrieval_agent_blocked", "critical", "access", "A"),
    ("A2_snippet_suppressed", "high", "access", "B"),
    ("A3_noindex", "critical", "access", "A"),
    ("A3_noindex_utility", "medium", "access", "A"),
    ("A4_redirect_chain", "low", "access", "A"),
    ("A5_canonical_problem", "medium", "access", "A"),
    ("A5_canonical_missing", "low", "access", "A"),
    ("A6_sitemap_missing", "low", "access", "A"),
    ("A7_site_unreadable", "critical", "access", "A"),
    ("A8_robots_token_unrecognised", "medium", "access", "A"),
    ("A9_broken_pages", "medium", "access", "A"),
    ("A9_key_page_broken", "high", "access", "A"),
    ("A10_meta_refresh", "low", "access", "A"),
    ("A11_soft_404", "medium", "access", "A"),
    ("B1_fact_absent", "high", "extractability", "C"),
    ("B1_fact_script_only", "medium", "extractability", "C"),
    ("B4_empty_shell", "high", "extractability", "C"),
    ("B6_filler_heavy", "low", "extractability", "F"),
    ("C1_structured_data_invalid", "high", "interpretability", "C"),
    ("C1_structured_data_absent", "low", "interpretability", "C"),
    ("C1_product_markup_absent", "medium", "interpretability", "C"),
    ("C2_markup_text_contradiction", "high", "interpretability", "D"),
    ("C3_entity_unanchored", "medium", "interpretability", "D"),
    ("C5_faq_content_unmarked", "low", "interpretability", "B"),
    ("C6_entity_name_conflict", "medium", "interpretability", "D"),
    ("C7_title_problem", "medium", "interpretability", "B"),
    ("X1_low_quotability", "low", "interpretability", "B"),
    ("D1_no_date_signals", "medium", "freshness", "D"),
    ("D2_stale_copyright", "low", "freshness", "D"),
    ("D3_content_stale", "low", "freshness", "D"),
    ("D4_internal_contradiction", "high", "freshness", "D"),
    ("E1_form_friction", "medium", "engagement", "on-site"),
    ("E1_unlabelled_input", "medium", "engagement", "on-site"),
    ("E2_vague_link_text", "low", "engagement", "on-site"),
    ("E3_unnamed_controls", "medium", "engagement", "on-site"),
    ("E4_images_missing_alt", "medium", "engagement", "C"),
    ("E5_no_lang", "low", "engagement", "on-site"),
    ("E6_heading_structure", "low", "engagement", "on-site"),
    ("E7_zoom_disabled", "medium", "engagement", "on-site"),
    ("E9_promise_payoff_mismatch", "medium", "engagement", "B"),
    ("E10_no_next_step", "medium", "engagement", "on-site"),
    ("E11_no_viewport", "medium", "engagement", "on-site"),
    ("E12_no_orientation", "low", "engagement", "on-site"),
    ("R_agent_review", "low", "review", "review"),
)
BANDS = ("info", "low", "medium", "high", "critical")
BOTH = ("B6_filler_heavy", "E4_images_missing_alt", "E9_promise_payoff_mismatch", "C2_markup_text_contradiction", "A9_broken_pages", "A9_key_page_broken", "C7_title_problem")
FLOOR = 3  # pages below which the reach of a finding is not trusted
REVIEW = "R_agent_review"
TOP = 15


def dimension(spark: SparkSession) -> DataFrame:
    """``(check_id, base, gate, mechanism)``: one row per check."""
    return spark.createDataFrame(list(SEVERITY), "check_id string, base string, gate string, mechanism string")


def level(name: Column) -> Column:
    """A band as a number; unknown ones count as info."""
    return F.greatest(F.array_position(F.array(*map(F.lit, BANDS)), name).cast("int") - 1, F.lit(0))


def band(number: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, BANDS)), number + 1)


def hurts(check: Column, gate: Column) -> Column:
    return F.when(check.isin(*BOTH), "both").when(gate == "engagement", "user_retention").otherwise("ai_discoverability")


def graded(findings: DataFrame) -> DataFrame:
    """Adds ``gate, mechanism, hurts, severity, severity_rationale`` to findings.

    Reads ``check_id, blast_radius, confidence, measurement_basis, status, coverage_pages`` and, where given, the
    ``proposed_severity``, ``proposed_mechanism`` and ``proposed_hurts`` of a reviewer's claim. The order of steps: base, reach
    (one band less on a single page, if enough pages were read), then ceilings by review, basis, confidence and status.
    """
    for c in ("proposed_severity", "proposed_mechanism", "proposed_hurts"):
        if c not in findings.columns:
            findings = findings.withColumn(c, F.lit(None).cast("string"))
    dim = dimension(findings.sparkSession)
    f = findings.join(F.broadcast(dim.withColumnRenamed("base", "_base")), "check_id", "left")  # 44 rows
    review = F.col("check_id") == REVIEW
    base = F.when(review & F.col("proposed_severity").isin(*BANDS), F.col("proposed_severity")).otherwise(F.coalesce("_base", F.lit("low")))
    f = f.withColumn("gate", F.coalesce("gate", F.lit("unknown"))).withColumn("_l0", level(base))
    own = F.coalesce("mechanism", F.lit("unspecified"))
    f = f.withColumn("mechanism", F.when(review, F.coalesce("proposed_mechanism", own)).otherwise(own))
    f = f.withColumn("hurts", F.when(review & F.col("proposed_hurts").isin("ai_discoverability", "user_retention", "both"), F.col("proposed_hurts")).otherwise(hurts(F.col("check_id"), F.col("gate"))))
    wide = F.when(F.col("blast_radius") == "site_wide", 1.0).when(F.col("blast_radius") == "template", 0.8).otherwise(0.5)
    trusted = F.col("coverage_pages") >= FLOOR
    less = trusted & (wide < 0.7) & (F.col("_l0") > 0)
    f = f.withColumn("_l1", F.when(less, F.col("_l0") - 1).otherwise(F.col("_l0")))
    steps = [
        F.when(review, F.concat(F.lit("base="), base, F.lit(" (proposed by agent review; evidence checked against the crawl)"))).otherwise(F.concat(F.lit("base="), base, F.lit(" ("), F.col("gate"), F.lit("/"), F.col("check_id"), F.lit(")"))),
        F.when(trusted, F.concat(F.lit("blast="), F.col("blast_radius"), F.lit(" x"), wide.cast("string"))).otherwise(F.concat(F.lit("coverage="), F.col("coverage_pages").cast("string"), F.lit(f"<{FLOOR}: no blast escalation"))),
        F.when(less, F.concat(F.lit("-> demoted to "), band(F.col("_l1")))),
    ]
    ceilings = (
        ("agent_review", review, "low"), ("static_heuristic", F.col("measurement_basis") == "static_heuristic", "medium"), ("heuristic", F.col("confidence") == "heuristic", "high"),
        ("latent", F.col("status") == "latent", "low"), ("confirm_intent", F.col("status") == "confirm_intent", "low"),
    )
    for i, (name, when, most) in enumerate(ceilings, 1):
        top = F.lit(BANDS.index(most))
        f = f.withColumn(f"_l{i + 1}", F.when(when, F.least(F.col(f"_l{i}"), top)).otherwise(F.col(f"_l{i}")))
        steps.append(F.when(F.col(f"_l{i + 1}") < F.col(f"_l{i}"), F.concat(F.lit(f"cap({name})-> "), band(F.col(f"_l{i + 1}")))))
    last = len(ceilings) + 1
    f = f.withColumn("severity", band(F.col(f"_l{last}")))
    f = f.withColumn("severity_rationale", F.concat(F.array_join(F.array_compact(F.array(*steps)), "; "), F.lit(" => "), F.col("severity")))
    return f.drop("_base", *(f"_l{i}" for i in range(last + 1)))


def priority(f: DataFrame) -> DataFrame:
    """Adds ``priority_score``: severity times certainty times status, by effort; a claim's effort counts as medium."""
    sure = F.when(F.col("confidence") == "deterministic", 1.0).otherwise(0.7)
    state = F.when(F.col("status") == "latent", 0.35).when(F.col("status") == "confirm_intent", 0.5).otherwise(1.0)
    effort = F.when(F.col("check_id") == REVIEW, "medium").otherwise(F.col("effort"))
    cost = F.when(effort == "low", 1.0).when(effort == "high", 2.4).otherwise(1.6)
    return f.withColumn("priority_score", F.round((level(F.col("severity")) + 1) * sure * state / cost, 3))


def ranked(f: DataFrame) -> DataFrame:
    """Adds ``rank`` and ``id`` within each site: severity, priority, then a total order."""
    order = W.partitionBy("site_id").orderBy(F.desc(level(F.col("severity"))), F.desc("priority_score"), "check_id", "title", F.array_min("affected_urls"))
    return f.withColumn("rank", F.row_number().over(order)).withColumn("id", F.format_string("F-%03d", "rank"))


def latent(findings: DataFrame, agent_blocks: DataFrame) -> DataFrame:
    """Findings whose pages no retrieval agent may read become latent; those on access, engagement and review do not.

    ``agent_blocks(site_id, agent, class, path, allowed)`` has every agent on every crawled path. A path is closed if every
    retrieval agent is refused it (relational division by counting), which takes effect only beside an agent-block finding.
    """
    closed = (
        agent_blocks.where("class = 'retrieval'").groupBy("site_id", "path").agg(F.bool_and(~F.col("allowed")).alias("shut")).where("shut")
        .groupBy("site_id").agg(F.collect_set("path").alias("paths"))
    )
    blockers = findings.where("check_id IN ('A1_retrieval_agent_blocked', 'A3_noindex')").groupBy("site_id").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.when(F.col("check_id") == "A3_noindex", F.col("affected_urls")).otherwise(F.array().cast("array<string>")))))).alias("hidden"),
        F.bool_or(F.col("check_id").startswith("A1")).alias("by_agent"), F.min("check_id").alias("blocker"),
    )
    f = findings.join(blockers, "site_id", "left").join(closed, "site_id", "left")
    from crawlens.functions.urls import path as path_of

    paths = F.transform("affected_urls", lambda u: F.coalesce(F.nullif(path_of(u), F.lit("")), F.lit("/")))
    none = F.array().cast("array<string>")
    unread = F.size(F.array_except("affected_urls", F.coalesce("hidden", none))) == 0
    shut = F.coalesce("by_agent", F.lit(False)) & (F.size(F.array_except(paths, F.coalesce("paths", none))) == 0)
    subject = ~F.col("check_id").rlike("^[AE]") & (F.col("check_id") != REVIEW) & (F.size("affected_urls") > 0)
    hidden = subject & F.col("blocker").isNotNull() & (unread | shut)
    return f.withColumn("status", F.when(hidden, "latent").otherwise(F.col("status"))).withColumn("blocked_by", F.when(hidden, F.col("blocker"))).drop("hidden", "by_agent", "blocker", "paths")


def headline(findings: DataFrame) -> DataFrame:
    """``(site_id, active, worst)``: how many findings are active, and the title of the first of the most severe."""
    return findings.where("status = 'active'").groupBy("site_id").agg(F.count("*").alias("active"), F.min_by("title", F.struct(-level(F.col("severity")), F.col("rank"))).alias("worst"))
