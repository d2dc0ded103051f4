"""Review candidates, and verdicts on scripted findings: validated, applied before ranking. Also checks that earlier catalogues had."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from crawlens.functions import text as X, urls as U
from crawlens.operators import checks
from crawlens.operators.claims import clean, norm

# Reasons with their verdicts, the checks they may judge, and what scripted check covers a candidate.
REASONS = (
    ("measurement_confirmed", "confirm", ""),
    ("overstated_impact", "downgrade", ""),
    ("access_block_unattributed", "downgrade", "^A7_"),
    ("access_block_not_bot_specific", "confirm_intent", "^A7_"),
    ("deliberate_configuration", "confirm_intent", "^A[235]_"),
    ("error_or_placeholder_page", "not_a_defect", ""),
    ("page_purpose_mismatch", "not_a_defect", ""),
    ("measurement_wrong", "not_a_defect", ""),
    ("auditor_side_failure", "not_a_defect", "^A7_"),
    ("duplicate_of_finding", "not_a_defect", ""),
)
MAX_VERDICTS, MAX_EVIDENCE = 5, 12
TRANSPORT = "connecterror|connecttimeout|readtimeout|ssl|timed out|name or service not known|remoteprotocolerror"
BY_URL = ("error_or_placeholder_page", "page_purpose_mismatch", "measurement_wrong")
CONTENT, FACT = ("home", "pricing", "product", "about", "contact", "blog"), ("pricing", "product", "about")
WALLS = "sign in|log in|access denied|verify you are human|enable cookies"
COVERED = (
    ("canonical_points_at_broken_page", "A5_canonical_problem"), ("hreflang_to_failing_page", "A9_broken_pages"), ("hreflang_to_failing_page", "A9_key_page_broken"), ("facts_only_as_pdf", "B1_fact_absent"),
    ("main_content_in_iframe", "B4_empty_shell"), ("content_only_in_noscript", "B4_empty_shell"), ("thin_content_page", "B4_empty_shell"), ("markup_type_contradicts_page", "C1_product_markup_absent"),
    ("brand_name_differs_across_pages", "C6_entity_name_conflict"), ("consent_text_leads_content", "B6_filler_heavy"), ("pricing_answer_not_in_opening", "B1_fact_absent"), ("pricing_answer_not_in_opening", "B1_fact_script_only"), ("pricing_answer_not_in_opening", "E9_promise_payoff_mismatch"),
)
PRESS = r"(?i)(^|/)(press|newsroom|news|media-cent(er|re)|in-the-news)(/|$|\?|#)"


def _met(rows: DataFrame, others: DataFrame, *keys: str, how: str) -> DataFrame:
    """A semi or anti join on the site and ``keys``; pages without a site are of one."""
    o = others.select(*(F.col(c).alias(f"o_{c}") for c in ("site_id", *keys)))
    on = F.col("site_id").eqNullSafe(F.col("o_site_id"))
    for c in keys:
        on &= F.col(c) == F.col(f"o_{c}")
    return rows.join(o, on, how)


def candidates(parsed: DataFrame, scripted: DataFrame, page: str = "url") -> DataFrame:
    """``(site_id, mechanism, item, url, affected_urls)``: pages that have the shape of a problem no scripted check reports.

    ``page`` names the column that tells pages apart, and ``scripted`` has its values as ``affected_urls``: an address may be stored twice, with a finding on one of its pages only.
    """
    f = lambda n: F.col(f"f.{n}")
    p = checks.readable(parsed).withColumn("words", X.words(f("extracted"))).withColumn("opening", F.array_join(F.slice(F.split(f("extracted"), " "), 1, 120), " "))
    home = F.regexp_replace("start_url", "/+$", "")
    content, fact = F.col("role").isin(*CONTENT), F.col("role").isin(*FACT)
    pdf = F.exists(f("anchors"), lambda a: U.path(a["href"]).rlike(r"(?i)\.pdf$"))
    framed, hidden = F.size("f.iframes") > 0, f("noscript_words") > 50

    def shape(mechanism, item, when):
        return F.when(when, F.struct(F.lit(mechanism).alias("mechanism"), F.lit(item).alias("item"), F.array("url").alias("affected_urls"), F.array(page).alias("pages")))

    own = F.array(
        shape("A", "wall_instead_of_content", content & (F.col("words") < 80) & (f("has_password") | F.lower(f("title")).rlike(WALLS))),
        shape("A", "content_redirected_to_home", (F.size("redirect_chain") > 0) & (home != "") & (F.regexp_replace("url", "/+$", "") != home) & (F.regexp_replace("final_url", "/+$", "") == home)),
        shape("B", "facts_only_as_pdf", fact & pdf & (F.col("words") < 150)),
        shape("C", "main_content_in_iframe", content & framed & (F.col("words") < 100)),
        shape("C", "content_only_in_noscript", hidden & (F.col("words") < 50)),
        shape("C", "markup_type_contradicts_page", F.col("role").isin("pricing", "product") & (F.size("f.types") > 0) & (F.size(F.array_except(f("types"), F.array(F.lit("article"), F.lit("blogposting")))) == 0)),
        shape("on-site", "consent_text_leads_content", content & F.array_join(F.slice(F.split("opening", " "), 1, 40), " ").rlike(r"(?i)\b(cookies?|consent)\b")),
        shape("on-site", "pricing_answer_not_in_opening", (F.col("role") == "pricing") & (F.col("words") >= 150) & ~F.col("opening").rlike(r"\p{Nd}")),
        shape("F", "thin_content_page", fact & (F.col("words") < 80) & (F.size("f.islands") == 0) & ~framed & ~hidden),
    )
    rows = p.select("site_id", "url", F.col(page).alias("_page"), F.explode(F.array_compact(own)).alias("c")).select("site_id", "_page", "c.mechanism", "c.item", "url", "c.affected_urls", "c.pages")
    failing = parsed.where("status <> 200").groupBy("site_id", F.col("url").alias("target")).agg(F.collect_set(page).alias("failed"))
    aim = lambda item, c: p.select("site_id", "url", F.col(page).alias("_page"), c.alias("target")).where("target IS NOT NULL AND target <> url").join(failing, ["site_id", "target"]).select("site_id", "_page", F.lit("A").alias("mechanism"), F.lit(item).alias("item"), "url", F.array("url", "target").alias("affected_urls"), F.concat(F.array("_page"), "failed").alias("pages"))
    rows = rows.unionByName(aim("canonical_points_at_broken_page", f("canonical"))).unionByName(aim("hreflang_to_failing_page", F.explode("f.hreflang")))
    named = p.where(content & (f("site_name") != "")).groupBy("site_id", F.col("f.site_name").alias("name")).agg(F.min_by(F.struct("url", F.col(page).alias("page")), "page_seq").alias("x"))
    brands = named.groupBy("site_id").agg(F.array_sort(F.collect_list(F.struct("name", "x.url", "x.page"))).alias("n")).where(F.size("n") > 1)
    rows = rows.unionByName(brands.select("site_id", F.col("n")[0]["page"].alias("_page"), F.lit("D").alias("mechanism"), F.lit("brand_name_differs_across_pages").alias("item"), F.col("n")[0]["url"].alias("url"), F.col("n.url").alias("affected_urls"), F.col("n.page").alias("pages")))
    cover = parsed.sparkSession.createDataFrame(list(COVERED), "item string, check_id string")
    told = scripted.select("site_id", "check_id", F.explode("affected_urls").alias("u")).join(F.broadcast(cover), "check_id").select("site_id", "item", "u").distinct()
    hit = _met(rows.select("site_id", "item", "_page", F.explode("pages").alias("u")), told, "item", "u", how="left_semi").select("site_id", "item", "_page").distinct()
    return _met(rows, hit, "item", "_page", how="left_anti").select("site_id", "mechanism", "item", "url", "affected_urls")


def dispositions(given: DataFrame, wanted: DataFrame, accepted: DataFrame, min_reason: int = 25, reuse: int = 3) -> DataFrame:
    """``given(site_id, n, mechanism, item, url, disposition, claim_title, reason)`` → with ``problem``; null: the candidate is disposed of."""
    g = given.join(wanted.select("site_id", "mechanism", "item", "url", "affected_urls"), ["site_id", "mechanism", "item", "url"], "left")
    a = accepted.select("site_id", norm(F.col("title")).alias("_t"), F.explode("affected_urls").alias("_u")).groupBy("site_id", "_t").agg(F.collect_set("_u").alias("_us"))
    g = g.withColumn("_t", norm(F.coalesce("claim_title", F.lit("")))).join(a, ["site_id", "_t"], "left")
    r = norm(F.coalesce("reason", F.lit("")))
    used = F.count(F.when(F.col("disposition") == "not_applicable", 1)).over(W.partitionBy("site_id", r))
    problem = (
        F.when(F.col("affected_urls").isNull(), "names no review candidate")
        .when((F.col("disposition") == "claimed") & ~F.coalesce(F.arrays_overlap("_us", "affected_urls"), F.lit(False)), "claim_title matches no verified claim on this candidate's pages").when(F.col("disposition") == "claimed", None)
        .when(~F.coalesce(F.col("disposition") == "not_applicable", F.lit(False)), "'disposition' must be 'claimed' or 'not_applicable'").when(F.length(r) < min_reason, "reason is too short")
        .when(F.col("reason").rlike(r"\b[A-EX]\d+_"), "reason cites a scripted check").when(used >= reuse, "the same reason is used on several candidates")
    )
    g = g.withColumn("problem", problem)
    turn = F.row_number().over(W.partitionBy("site_id", "mechanism", "item", "url", F.col("problem").isNull()).orderBy("n"))
    return g.withColumn("problem", F.when(F.col("problem").isNull() & (turn > 1), "a second disposition for the same candidate").otherwise(F.col("problem"))).select(*given.columns, "problem")


def judged(verdicts: DataFrame, findings: DataFrame, tested: DataFrame, sites: DataFrame) -> DataFrame:
    """Verdicts with the finding they meet, ``rejected_reason`` and ``effect``.

    ``verdicts(site_id, n, check_id, url, verdict, reason, explanation, urls)``; ``findings(site_id, id, check_id, severity, affected_urls)``;
    ``tested(site_id, n, url, kind, value, holds, positive)`` their tested evidence, ``url`` null for evidence on the site;
    ``sites(site_id, pages_ok)``.
    """
    reasons = verdicts.sparkSession.createDataFrame(list(REASONS), "reason string, goes_with string, scope string")
    v = verdicts.alias("v").join(findings.select("site_id", F.col("check_id").alias("_c"), F.col("id").alias("finding_id"), F.col("severity").alias("was"), "affected_urls").alias("f"), (F.col("v.site_id") == F.col("f.site_id")) & (F.col("v.check_id") == F.col("_c")) & (F.col("v.url").isNull() | F.array_contains("affected_urls", F.col("v.url"))), "left")
    v = v.select("v.*", "finding_id", "was", "affected_urls").withColumn("matches", F.count("finding_id").over(W.partitionBy("site_id", "n")))
    v = v.dropDuplicates(["site_id", "n"]).join(F.broadcast(reasons), "reason", "left").join(sites, "site_id", "left")
    shown = lambda c: F.collect_set(F.when(c, F.col("url")))
    good = F.col("holds") & F.col("positive")
    e = tested.groupBy("site_id", "n").agg(
        F.count("*").alias("n_evidence"), F.bool_and("holds").alias("all_hold"), shown(good).alias("positive_urls"), shown(F.col("holds")).alias("named_urls"), F.coalesce(F.bool_or(good & F.col("url").isNull()), F.lit(False)).alias("on_site"),
        F.coalesce(F.bool_or((F.col("kind") == "site_note_contains") & F.lower("value").rlike(TRANSPORT)), F.lit(False)).alias("transport"), F.coalesce(F.bool_or(F.col("kind") == "finding_exists"), F.lit(False)).alias("twin"),
    )
    v = v.join(e, ["site_id", "n"], "left").withColumn("urls", F.when(F.coalesce(F.size("urls"), F.lit(0)) > 0, F.col("urls")).otherwise(F.col("affected_urls")))
    lacks = lambda c: F.size(F.array_except("urls", F.coalesce(c, F.array().cast("array<string>")))) > 0
    some = (F.coalesce(F.size("positive_urls"), F.lit(0)) > 0) | F.col("on_site")
    r = F.col("reason")
    why = (
        F.when(F.col("n") > MAX_VERDICTS, f"over the limit of {MAX_VERDICTS} verdicts per audit").when(F.col("matches") != 1, "'finding' does not match one scripted finding").when(F.col("goes_with").isNull(), "'reason' is unknown")
        .when(F.col("goes_with") != F.col("verdict"), "reason goes with another verdict").when((F.col("scope") != "") & ~F.expr("check_id RLIKE scope"), "reason does not apply to this check")
        .when(~F.coalesce(F.length(F.trim("explanation")).between(20, 600), F.lit(False)) | ~clean(F.col("explanation"), F.regexp_replace("site_id", r"^www\.", "")), "'explanation' is not acceptable")
        .when(F.size(F.array_except("urls", "affected_urls")) > 0, "'urls' must be affected URLs of that finding").when((F.col("was") == "critical") & (r == "overstated_impact"), "a critical finding is not downgraded for scope")
        .when(~F.coalesce(F.col("n_evidence"), F.lit(0)).between(1, MAX_EVIDENCE), "'evidence' must hold 1-12 assertions").when(~F.col("all_hold"), "evidence does not hold")
        .when(r.isin("error_or_placeholder_page", "page_purpose_mismatch") & lacks(F.col("positive_urls")), "every page a verdict clears needs its own positive evidence")
        .when((r == "measurement_wrong") & (lacks(F.col("named_urls")) | (F.coalesce(F.size("positive_urls"), F.lit(0)) == 0)), "name every cleared page and give one positive assertion")
        .when((r == "auditor_side_failure") & ~F.col("transport"), "needs a crawl note naming the transport error").when((r == "auditor_side_failure") & (F.coalesce("pages_ok", F.lit(0)) > 0), "pages were read, so the audit did not fail as a whole")
        .when((r == "duplicate_of_finding") & ~F.col("twin"), "a duplicate needs 'finding_exists'").when(~r.isin("error_or_placeholder_page", "page_purpose_mismatch", "measurement_wrong", "auditor_side_failure", "duplicate_of_finding") & ~some, "add one positive assertion that shows why")
    )
    v = v.withColumn("rejected_reason", why)
    turn = F.row_number().over(W.partitionBy("site_id", "finding_id", F.col("rejected_reason").isNull()).orderBy("n"))
    v = v.withColumn("rejected_reason", F.when(F.col("rejected_reason").isNull() & (turn > 1), "that finding already has a verdict").otherwise(F.col("rejected_reason")))
    left = F.size(F.array_except("affected_urls", "urls")) > 0
    effect = F.when(F.col("rejected_reason").isNull(), F.when(F.col("verdict") != "not_a_defect", F.col("verdict")).when(r.isin(*BY_URL) & left, "clear_urls").otherwise("remove"))
    return v.withColumn("effect", effect).select("site_id", "n", "check_id", "finding_id", "verdict", "reason", "urls", "rejected_reason", "effect")


def applied(findings: DataFrame, accepted: DataFrame) -> DataFrame:
    """Findings after their verdicts, for grading anew: some go, lose pages, become questions, or drop one band."""
    from crawlens.operators import severity

    a = accepted.where("rejected_reason IS NULL").select("site_id", F.col("finding_id").alias("id"), "effect", F.col("urls").alias("cleared"), F.col("reason").alias("verdict_reason"))
    f = findings.join(a, ["site_id", "id"], "left").where("effect IS NULL OR effect <> 'remove'")
    f = f.withColumn("affected_urls", F.when(F.col("effect") == "clear_urls", F.array_except("affected_urls", "cleared")).otherwise(F.col("affected_urls"))).withColumn("status", F.when(F.col("effect") == "confirm_intent", "confirm_intent").otherwise(F.col("status")))
    again = severity.graded(f.drop("gate", "mechanism", "hurts", "severity", "severity_rationale", "priority_score", "rank"))
    lower = (F.col("effect") == "downgrade") & (severity.level(F.col("severity")) > 1)
    return again.withColumn("severity", F.when(lower, severity.band(severity.level(F.col("severity")) - 1)).otherwise(F.col("severity"))).drop("cleared", "effect", "verdict_reason", "id")


def retired_hits(parsed: DataFrame) -> DataFrame:
    """Checks of earlier catalogues: facts in images, headings without anchors, several h1, no press link."""
    p = checks.readable(parsed)
    hits = F.array(
        checks._hit("B5_fact_locked_in_image", F.col("f.wide_blank_images") >= 3, F.col("f.wide_blank_images")),
        checks._hit("X2_no_citation_anchor", (F.size("f.headings") >= 3) & (F.col("f.anchored_headings") == 0), F.size("f.headings")),
        checks._hit("E6_multiple_h1", F.size("f.h1") > 1, F.size("f.h1")),
    )
    own = p.select("site_id", "url", F.explode(F.array_compact(hits)).alias("h")).select("site_id", "url", "h.*")
    press = p.groupBy("site_id").agg(F.bool_or(F.exists("f.anchors", lambda a: a["href"].rlike(PRESS))).alias("any"), F.min_by("url", "page_seq").alias("url")).where("NOT any")
    return own.unionByName(press.select("site_id", "url", F.lit("D5_no_corroboration_hooks").alias("check_id"), F.lit("").alias("key"), F.lit("").alias("note"), F.lit("active").alias("status")))
