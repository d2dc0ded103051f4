"""Reviewers' claims and fixes: validated, tested against the crawl, matched with scripted findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from crawlens.operators import quotes, severity
from crawlens.sources.storage import stored

# What a claim may say, and which gates its mechanism speaks to.
MAX_CLAIMS, MAX_FIXES, MAX_ASSERTIONS, MAX_STEPS, MAX_STEP = 6, 5, 8, 8, 300
MIN_CONTAINS, MIN_LACKS = 6, 3
MECHANISMS = ("A", "B", "C", "D", "E", "F", "on-site")
HURTS = ("ai_discoverability", "user_retention", "both")
SEVERITIES, EFFORTS = ("high", "medium", "low"), ("low", "medium", "high")
OPS = ("eq", "ne", "contains", "lacks", "gt", "lt", "empty", "nonempty")
IDENTITY = ("url", "final_url", "status", "role", "content_type", "redirect_hops")
GATES = (("A", "access"), ("B", "interpretability"), ("B", "extractability"), ("C", "interpretability"), ("C", "extractability"), ("D", "freshness"), ("E", "engagement"), ("F", "engagement"), ("F", "extractability"), ("on-site", "engagement"))
TEMPLATE = ("E11_no_viewport", "C7_title_problem", "E5_no_lang", "E6_heading_structure", "E12_no_orientation", "C1_structured_data_absent", "A5_canonical_missing", "E4_images_missing_alt", "E1_unlabelled_input")
MARKUP = r"(?i)<\s*/?\s*[a-zA-Z!?]|javascript\s*:"
HOSTS = r"(?i)(?:https?:)?//([^\s/\"'<>]+)|(?<![\w.-])(www\.[^\s/\"'<>]+)"


def norm(text: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(text, r"(?U)\s+", " ")))


def clean(text: Column, site: Column) -> Column:
    """No markup and no host off the audited site."""
    hosts = F.transform(F.regexp_extract_all(text, F.lit(HOSTS), F.lit(0)), lambda h: F.regexp_replace(F.regexp_replace(F.lower(h), r"^(https?:)?//", ""), r"[.,;:)]+$|:\d+.*$", ""))
    near = F.forall(hosts, lambda h: (h == site) | h.endswith(F.concat(F.lit("."), site)) | site.endswith(F.concat(F.lit("."), h)))
    return ~text.rlike(MARKUP) & near


def field_holds(actual: Column, op: Column, expected: Column) -> Column:
    """A typed comparison of a profile field, given as text, with a value; null where numbers are wanted and missing."""
    a, e = norm(actual), norm(expected)
    none = actual.isNull() | actual.isin("", "0", "[]", "{}")
    blank = actual.isNull() | (actual == "") | expected.isNull() | (expected == "")
    same = F.when(blank, actual.eqNullSafe(expected)).otherwise(a == e)
    return (
        F.when(op == "empty", none).when(op == "nonempty", ~none)
        .when(op == "gt", actual.try_cast("double") > expected.try_cast("double")).when(op == "lt", actual.try_cast("double") < expected.try_cast("double"))
        .when(op == "eq", same).when(op == "ne", ~same).when(op == "contains", F.contains(F.coalesce(a, F.lit("")), e)).when(op == "lacks", ~F.contains(F.coalesce(a, F.lit("")), e))
    )


def assertions(claims: DataFrame, pages: DataFrame, fields: DataFrame) -> DataFrame:
    """``(site_id, claim, n, url, holds, positive, everywhere, problem)`` for every entry of evidence.

    ``claims(site_id, claim, evidence)``; ``pages(site_id, url, ok, html, extracted, full, headers)``; ``fields(site_id, url, path,
    value)``. Evidence that holds on every readable page of two or more proves nothing; an index of trigrams finds the pages that hold a quotation.
    """
    a = claims.select("site_id", "claim", F.posexplode("evidence").alias("n", "e")).select("site_id", "claim", "n", "e.*")
    needle = norm(F.col("value"))
    text = F.col("type").isin("html_contains", "html_lacks", "text_contains", "text_lacks", "header_contains")
    kind = F.when(F.col("type").startswith("html"), "html").when(F.col("type") == "header_contains", F.concat(F.lit("header:"), F.lower(F.coalesce("header", F.lit(""))))).when(F.col("type").startswith("text"), F.when(F.col("scope") == "full", "full").otherwise("extracted"))
    a = stored(a.withColumn("kind", kind).withColumn("quote", needle), "evidence")
    texts = pages.select("site_id", "url", F.explode(F.create_map(*(x for k in ("html", "extracted", "full") for x in (F.lit(k), norm(F.col(k)))))).alias("kind", "text"))
    told = pages.select("site_id", "url", F.explode("headers").alias("name", "said")).select("site_id", "url", F.concat(F.lit("header:"), F.lower("name")).alias("kind"), norm(F.col("said")).alias("text"))
    asked = a.where(text & (F.length("quote") >= MIN_LACKS))
    found = quotes.places(asked, texts.unionByName(told.join(asked.select("site_id", "kind").distinct(), ["site_id", "kind"], "left_semi")))
    by_text = asked.select("site_id", "claim", "n", "kind", "quote").join(found.withColumnRenamed("url", "at"), ["site_id", "kind", "quote"]).select("site_id", "claim", "n", "at")
    fo = fields.select("site_id", F.col("url").alias("at"), "path", F.col("value").alias("_fv"))
    met = a.where("type = 'field'").join(fo, ["site_id", "path"])
    held = met.where(field_holds(F.col("_fv"), F.col("op"), F.col("value"))).select("site_id", "claim", "n", "at")
    ok = pages.select("site_id", F.col("url").alias("at"), "ok")
    everywhere = by_text.unionByName(held).distinct().join(ok.where("ok"), ["site_id", "at"], "left_semi").groupBy("site_id", "claim", "n").agg(F.count("*").alias("n_found"))
    mine = by_text.unionByName(held).distinct().select("site_id", "claim", "n", F.col("at").alias("url"), F.lit(1).alias("hit"))
    asked_of = met.where("url = at").select("site_id", "claim", "n", F.lit(True).alias("has_field"), field_holds(F.col("_fv"), F.col("op"), F.col("value")).isNotNull().alias("told"))
    n_ok = pages.where("ok").groupBy("site_id").agg(F.count("*").alias("n_ok"))
    g = (
        a.join(pages.select("site_id", "url", "ok", F.lit(True).alias("crawled")), ["site_id", "url"], "left").join(mine, ["site_id", "claim", "n", "url"], "left").join(asked_of, ["site_id", "claim", "n"], "left")
        .join(everywhere, ["site_id", "claim", "n"], "left").join(n_ok, "site_id", "left")
    )
    no = lambda c: F.coalesce(c, F.lit(False))
    hit = F.coalesce("hit", F.lit(0))
    g = g.withColumns({"crawled": no("crawled"), "ok": no("ok"), "has_field": no("has_field"), "n_ok": F.coalesce("n_ok", F.lit(0)), "n_found": F.coalesce("n_found", F.lit(0)), "found": F.when(text | no("told"), hit)})
    contains = F.col("type").endswith("contains")
    weak = F.col("op").isin("gt", "lt", "nonempty", "ne", "lacks", "empty") | F.substring_index("path", ".", 1).isin(*IDENTITY) | ((F.col("op") == "eq") & (F.col("value").isNull() | (F.col("value") == "")))
    positive = F.when(text, contains).otherwise(~weak)
    holds = F.when(text & ~contains, F.col("found") == 0).otherwise(F.col("found") == 1)
    short = F.length("quote") < F.when(contains, MIN_CONTAINS).otherwise(MIN_LACKS)
    problem = (
        F.when(~F.col("crawled"), "evidence names a URL that was not crawled").when(text & F.col("value").isNull(), "needs a string 'value'").when(text & short, "value is too short to be evidence")
        .when((F.col("type") == "header_contains") & F.coalesce(F.col("header") == "", F.lit(True)), "needs a 'header' name").when(text & (F.col("type") != "header_contains") & ~F.col("ok"), "page has no readable HTML")
        .when(~text & (F.col("type") != "field"), "unknown evidence type").when(~text & (F.col("path").isNull() | ~F.coalesce(F.col("op").isin(*OPS), F.lit(False))), "'field' needs a 'path' and an 'op'")
        .when(~text & ~F.col("has_field"), "no such profile field").when(~text & F.col("op").isin("gt", "lt") & F.col("found").isNull(), "needs numbers")
        .when(holds & positive & (F.col("n_ok") >= 2) & (F.col("n_found") == F.col("n_ok")), "evidence is true of every page").when(~F.coalesce(holds, F.lit(False)), "evidence does not hold")
    )
    return g.select("site_id", "claim", "n", "url", F.coalesce(holds, F.lit(False)).alias("holds"), positive.alias("positive"), problem.alias("problem"))


def verified(claims: DataFrame, tested: DataFrame, ok_pages: DataFrame) -> DataFrame:
    """Claims with ``rejected_reason`` (the first failure; null: accepted), ``blast_radius`` and sorted ``affected_urls``.

    ``claims(site_id, claim, title, why, mechanism, hurts, severity, affected_urls, evidence, suggested_action)``.
    """
    site = F.regexp_replace("site_id", r"^www\.", "")
    size = lambda c, low, high: F.col(c).isNotNull() & F.length(F.trim(F.col(c))).between(low, high)
    oks = ok_pages.groupBy("site_id").agg(F.collect_set("url").alias("oks"))
    t = tested.groupBy("site_id", "claim").agg(F.min_by("problem", F.when(F.col("problem").isNotNull(), F.col("n"))).alias("problem"), F.bool_or(F.col("holds") & F.col("positive")).alias("shown"))
    c = claims.join(oks, "site_id", "left").join(t, ["site_id", "claim"], "left")
    stray = F.size(F.array_except("affected_urls", F.coalesce("oks", F.array().cast("array<string>")))) > 0
    uncovered = F.size(F.array_except("affected_urls", F.transform("evidence", lambda e: e["url"]))) > 0
    steps = F.col("suggested_action.how")
    reason = (
        F.when(F.col("claim") > MAX_CLAIMS, f"only the first {MAX_CLAIMS} claims are read").when(~size("title", 8, 160), "'title' must be a string of 8-160 characters").when(~clean(F.col("title"), site), "claim text contains markup or external links")
        .when(~size("why", 20, 600), "'why' must be a string of 20-600 characters").when(~clean(F.col("why"), site), "claim text contains markup or external links")
        .when(~F.coalesce(F.col("mechanism").isin(*MECHANISMS), F.lit(False)), "'mechanism' is unknown").when(~F.coalesce(F.col("hurts").isin(*HURTS), F.lit(False)), "'hurts' is unknown").when(~F.coalesce(F.col("severity").isin(*SEVERITIES), F.lit(False)), "'severity' is unknown")
        .when(F.coalesce(F.size("affected_urls"), F.lit(0)) < 1, "'affected_urls' must list at least one crawled page").when(stray, "affected_urls include pages that were not crawled successfully")
        .when(~F.coalesce(F.size("evidence"), F.lit(0)).between(1, MAX_ASSERTIONS), f"'evidence' must hold 1-{MAX_ASSERTIONS} assertions").when(uncovered, "no evidence is given for an affected URL")
        .when(~size("suggested_action.summary", 8, 200), "'summary' must be a string of 8-200 characters").when(~size("suggested_action.verify", 8, 300), "'verify' must be a string of 8-300 characters")
        .when(~F.coalesce(F.size(steps), F.lit(0)).between(1, MAX_STEPS) | F.exists(steps, lambda s: (F.trim(s) == "") | (F.length(s) > MAX_STEP)), "'how' must list 1-8 steps")
        .when(~F.coalesce("suggested_action.effort", F.lit("medium")).isin(*EFFORTS), "'effort' is unknown").when(F.col("problem").isNotNull(), F.col("problem")).when(~F.coalesce("shown", F.lit(False)), "every assertion is an absence or an identity field")
    )
    n = F.size(F.array_distinct("affected_urls"))
    blast = F.when((n == F.size("oks")) & (n >= 2), "site_wide").when(n > 1, "template").otherwise("single_page")
    c = c.withColumn("rejected_reason", reason).withColumn("blast_radius", blast).withColumn("affected_urls", F.array_sort(F.array_distinct("affected_urls")))
    twin = F.row_number().over(W.partitionBy("site_id", norm(F.col("title")), F.col("affected_urls").cast("string"), F.col("rejected_reason").isNull()).orderBy("claim"))
    return c.withColumn("rejected_reason", F.when(F.col("rejected_reason").isNull() & (twin > 1), "repeats an earlier claim").otherwise(F.col("rejected_reason"))).drop("oks", "problem", "shown")


def restated(claims: DataFrame, scripted: DataFrame) -> DataFrame:
    """Claims that restate a scripted finding on one of their pages: ``(site_id, claim, twins)``.

    By naming the check, or by sharing gate (or mechanism) and audience with a finding whose base is above low and that is no
    template check. URLs meet by equality, the rest is a condition on the pair.
    """
    spark = claims.sparkSession
    gates = spark.createDataFrame(list(GATES), "mechanism string, gate string").groupBy("gate").agg(F.collect_set("mechanism").alias("speakers"))
    dim = severity.dimension(spark).join(gates, "gate", "left").select("check_id", "base", "gate", F.col("mechanism").alias("own"), F.coalesce("speakers", F.array().cast("array<string>")).alias("speakers"))
    s = scripted.select("site_id", "check_id", F.explode("affected_urls").alias("url")).distinct().join(F.broadcast(dim), "check_id", "left")
    s = s.withColumn("s_hurts", severity.hurts(F.col("check_id"), F.col("gate")))
    c = claims.select("site_id", "claim", "mechanism", F.col("hurts").alias("c_hurts"), "nearest_check", F.explode("affected_urls").alias("url"))
    named = F.coalesce(F.col("nearest_check") == F.col("check_id"), F.lit(False))
    big = (F.coalesce("base", F.lit("low")) != "low") & ~F.col("check_id").isin(*TEMPLATE)
    audience = (F.col("s_hurts") == F.col("c_hurts")) | (F.col("s_hurts") == "both") | (F.col("c_hurts") == "both")
    concern = F.array_contains("speakers", F.col("mechanism")) | F.coalesce(F.col("own") == F.col("mechanism"), F.lit(False))
    return c.join(s, ["site_id", "url"]).where(named | (big & audience & concern)).groupBy("site_id", "claim").agg(F.array_sort(F.collect_set("check_id")).alias("twins"))


def fixes(rows: DataFrame, pages: DataFrame, findings: DataFrame) -> DataFrame:
    """``rows(site_id, fix, check_id, url, quote, site_specific)`` → with ``finding_id`` or ``rejected_reason``: the quote must stand on the page, the page in a finding of the check; one fix per finding, the first."""
    p = pages.select("site_id", "url", "ok", norm(F.col("extracted")).alias("x"), norm(F.col("full")).alias("y"))
    r = rows.join(p, ["site_id", "url"], "left").withColumn("q", norm(F.col("quote")))
    on_page = F.coalesce(F.contains("x", F.col("q")) | F.contains("y", F.col("q")), F.lit(False))
    targets = findings.select("site_id", "check_id", "rank", "id", F.explode("affected_urls").alias("url"))
    first = targets.groupBy("site_id", "check_id", "url").agg(F.min_by("id", "rank").alias("finding_id"))
    r = r.join(first, ["site_id", "check_id", "url"], "left")
    steps = F.coalesce(F.size("site_specific"), F.lit(0)).between(1, MAX_STEPS) & ~F.exists("site_specific", lambda s: (F.trim(s) == "") | (F.length(s) > MAX_STEP))
    reason = (
        F.when(F.coalesce(F.trim("check_id"), F.lit("")) == "", "'check_id' must name a finding").when(~F.coalesce("ok", F.lit(False)), "'url' must be a page that was crawled successfully")
        .when(~F.coalesce(F.length("q"), F.lit(0)).between(MIN_CONTAINS, 300), "'quote' has the wrong length").when(~on_page, "quote is not on the page").when(~steps, "'site_specific' must list 1-8 steps").when(F.col("finding_id").isNull(), "no finding of this check reports the page")
    )
    r = r.withColumn("rejected_reason", reason)
    turn = F.row_number().over(W.partitionBy("site_id", "finding_id", F.col("rejected_reason").isNull()).orderBy("fix"))
    return r.withColumn("rejected_reason", F.when(F.col("rejected_reason").isNull() & (turn > 1), "a fix was already merged into this finding").otherwise(F.col("rejected_reason"))).drop("x", "y", "q", "ok")
