"""The audit of any number of sites as one plan: parse once, check, grade, rank, report."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from crawlens.functions import html, text as X, urls as U
from crawlens.operators import checks, crawl, robots, severity
from crawlens.operators.plugins import SiteCheck
from crawlens.sources.storage import stored


NOTHING = "No blocking problems detected in the checks that ran; see proactive recommendations."


def stored_pages(spark: SparkSession, sf_dir: str, audited_at: str = "2026-09-12T00:00:00Z") -> DataFrame:
    """The ``pages`` table as crawled pages: a site is a host without ``www.``; status, headers and redirects are unknown, so they count as plain."""
    p = spread(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))
    site = U.bare_host(F.col("url"))
    return p.select(
        site.alias("site_id"), F.col("page_id").alias("page_seq"), "url", F.col("url").alias("final_url"), F.lit(200).alias("status"), "html",
        F.create_map().cast("map<string,string>").alias("headers"), F.array().cast("array<string>").alias("redirect_chain"),
        F.concat(F.lit("https://"), site, F.lit("/")).alias("start_url"), F.to_timestamp(F.lit(audited_at)).alias("audited_at"),
    )


def spread(pages: DataFrame) -> DataFrame:
    """A scan of fewer splits than there are cores is dealt out to all, because a page costs far more to parse than to move; a larger one stays where it is."""
    cores = pages.sparkSession.sparkContext.defaultParallelism
    return pages.repartition(cores) if pages.rdd.getNumPartitions() < cores else pages


def walled(pages: DataFrame) -> DataFrame:
    """Pages whose HTML is a bot challenge are not the site: they lose it, and ``error`` says whose it is."""
    wall = crawl.challenge(F.col("html"))
    p = pages if "error" in pages.columns else pages.withColumn("error", F.lit(None).cast("string"))
    return p.withColumn("error", F.coalesce("error", F.concat(F.lit("bot_challenge:"), wall))).withColumn("html", F.when(~F.coalesce("error", F.lit("")).startswith("bot_challenge:"), F.col("html")))


def prepared(pages: DataFrame) -> DataFrame:
    """Parsed pages, challenges apart, with their roles: by address and title, and by the label of the home page's link to them."""
    p = html.parsed(walled(pages))
    if "role" in p.columns:
        return p
    p = stored(p, "read")  # once for the labels, once for the pages
    home = p.where(U.is_root(F.col("url"))).withColumn("role", F.lit("home"))
    labels = crawl.homepage_links(home).where("label IS NOT NULL").select("site_id", F.col("target").alias("_target"), F.col("label").alias("_label"))
    p = p.withColumn("_target", U.normalised(F.col("url"))).join(labels, ["site_id", "_target"], "left")
    return p.withColumn("role", U.role(F.col("url"), F.col("f.title"), F.col("_label"))).drop("_target", "_label")


def graded_findings(parsed: DataFrame, sitemap: DataFrame | None = None, more: DataFrame | None = None, decided: DataFrame | None = None, plugged: Sequence[type[SiteCheck]] = (), hits: DataFrame | None = None) -> DataFrame:
    """All findings of all sites, graded and ranked.

    ``more`` adds site-level findings or claims, ``decided`` the agents' access; ``hits`` are those of the ``plugged`` checks, from ``plugins.run``.
    """
    totals = checks.readable(parsed).groupBy("site_id").agg(F.count("*").alias("total"))
    own = checks.all_hits(parsed, sitemap)
    if hits is not None:
        own = own.unionByName(hits)
    found = checks.findings(own, totals, {c.name: c.spec for c in plugged})
    if more is not None:
        found = found.unionByName(more, allowMissingColumns=True)
    if decided is not None:
        found = severity.latent(found, decided.join(F.broadcast(robots.agents(parsed.sparkSession).select("agent", "class")), "agent"))
    return severity.ranked(severity.priority(severity.graded(found)))


def site_findings(sites: DataFrame, parsed: DataFrame, report: DataFrame, odd_tokens: DataFrame) -> DataFrame:
    """A1, A6, A7 and A8 as finding rows. ``sites(site_id, start_url, run_status, sitemap_urls, sitemaps_fetched)``."""
    ok = checks.readable(parsed).groupBy("site_id").agg(F.count("*").alias("total"))
    error = F.nullif(F.col("error"), F.lit("")) if "error" in parsed.columns else F.lit(None).cast("string")
    wall = F.when(error.startswith("bot_challenge:"), F.substring_index(error, ":", -1))
    of = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ", ")  # noqa: E731  few different values
    seen = parsed.groupBy("site_id").agg(F.array_sort(F.collect_set(F.when(F.col("status") > 0, F.col("status")))).alias("statuses"), of(wall).alias("walls"), of(error).alias("errors"))
    s = sites.join(ok, "site_id", "left").join(seen, "site_id", "left").withColumn("total", F.coalesce("total", F.lit(0)))
    s = s.join(robots.block_findings(report).withColumnRenamed("status", "a1"), "site_id", "left")
    s = s.join(odd_tokens.groupBy("site_id").agg(F.array_join(F.array_sort(F.collect_set("token")), ", ").alias("tokens")), "site_id", "left")
    refused = F.filter(F.coalesce("statuses", F.array().cast("array<int>")), lambda c: c.isin(401, 403, 429, 503))
    dark = F.col("total") == 0
    blocked, met, codes = F.col("run_status") == "blocked", F.coalesce("walls", F.lit("")) != "", F.array_join(refused.cast("array<string>"), "/")
    title = F.when(blocked, None).when(met, "Site answers automated clients with a bot challenge").when(F.size(refused) > 0, F.concat(F.lit("Site refuses automated clients (HTTP "), codes, F.lit(")")))
    why = (
        F.when(blocked, "robots.txt disallows the crawl").when(met, F.concat(F.lit("a bot challenge stands in the place of the page: "), F.col("walls")))
        .when(F.size(refused) > 0, F.concat(F.lit("HTTP "), codes)).when(F.coalesce("errors", F.lit("")) != "", F.concat(F.lit("requests failed: "), F.col("errors")))
        .otherwise(F.concat(F.lit("no page returned readable HTML; HTTP status seen: "), F.coalesce(F.nullif(F.array_join(F.col("statuses").cast("array<string>"), ", "), F.lit("")), F.lit("none"))))
    )

    def row(check, when, evidence, status=F.lit("active"), confidence=None, named=F.lit(None)):
        title, reach, sure, basis, effort = checks.SPEC[check]
        return F.when(when, F.struct(F.lit(check).alias("check_id"), F.coalesce(named, F.lit(title)).alias("title"), evidence.alias("evidence"), F.lit(reach).alias("blast_radius"), (F.lit(sure) if confidence is None else confidence).alias("confidence"), F.lit(basis).alias("measurement_basis"), status.alias("status"), F.lit(effort).alias("effort")))

    rows = F.array(
        row("A7_site_unreadable", dark, why, confidence=F.when(~blocked & (met | (F.size(refused) > 0)), "heuristic").otherwise("deterministic"), named=title),
        row("A1_retrieval_agent_blocked", ~dark & F.col("a1").isNotNull(), F.array_join("agents", ", "), F.coalesce("a1", F.lit("active"))),
        row("A6_sitemap_missing", ~dark & (F.size("sitemap_urls") == 0) & (F.col("sitemaps_fetched") == 0), F.lit("no sitemap was declared or found")),
        row("A8_robots_token_unrecognised", ~dark & F.col("tokens").isNotNull(), F.coalesce("tokens", F.lit(""))),
    )
    return s.select("site_id", F.array("start_url").alias("affected_urls"), F.col("total").alias("coverage_pages"), F.explode(F.array_compact(rows)).alias("r")).select("site_id", "affected_urls", "coverage_pages", "r.*")


def report(findings: DataFrame) -> DataFrame:
    """One row per site: counts, the fifteen first actions and the findings as JSON."""
    sev = lambda b, more="true": F.count_if(F.expr(f"severity = '{b}' AND {more}")).alias(f"{'active_' * (more != 'true')}{b}")
    active = "status = 'active'"
    first = F.filter(F.array_sort(F.collect_list(F.struct("rank", "id", "title", "priority_score", "severity", "status", "hurts", "effort"))), lambda a: a["rank"] <= severity.TOP)
    items = F.array_sort(F.collect_list(F.struct("rank", "id", "check_id", "title", "severity", "severity_rationale", "status", "hurts", "gate", "mechanism", "evidence", F.slice("affected_urls", 1, 25).alias("affected_urls"), F.size("affected_urls").alias("affected_count"))))
    g = findings.groupBy("site_id").agg(
        F.count("*").alias("total_findings"), *(sev(b) for b in severity.BANDS), F.count_if(F.expr(active)).alias("active_findings"), F.count_if(F.expr("status = 'latent'")).alias("latent_findings"),
        F.count_if(F.expr("status = 'confirm_intent'")).alias("confirm_intent_findings"), *(sev(b, active) for b in severity.BANDS[1:]),
        *(F.count_if(F.expr(f"{active} AND hurts = '{h}'")).alias(f"hurts_{h}") for h in ("ai_discoverability", "user_retention", "both")),
        F.to_json(first).alias("prioritized_actions"), F.to_json(items).alias("findings"),
    )
    head = severity.headline(findings)
    text = F.when(F.col("active") > 0, F.concat(F.col("active").cast("string"), F.lit(" finding(s); most severe: "), F.col("worst"))).otherwise(NOTHING)
    return g.join(head, "site_id", "left").withColumn("headline", text).drop("active", "worst")


#: Checks whose findings decide recommendations: facts that only scripts bring, and pages that lead nowhere.
COVERED = ("B1_fact_script_only", "B4_empty_shell", "B1_fact_absent")
DECIDING = (*COVERED, "E10_no_next_step")


def proactive(parsed: DataFrame, findings: DataFrame, sites: DataFrame) -> DataFrame:
    """``(site_id, rule, applies)``: seven recommendations, conditioned on the site. ``sites(site_id, llms_txt, ai_agents_named)``; of ``findings(site_id, check_id)`` those of DECIDING are looked at, hits will do."""
    ok = checks.readable(parsed)
    name = F.regexp_extract("site_id", r"^(?:www\.)?([^.]*)", 1)
    opening = F.lower(F.array_join(F.slice(F.split(F.col("f.extracted"), " "), 1, 60), " "))
    concrete = opening.rlike(r"[\p{Nd}$€£¥]") | ((F.length(name) >= 3) & F.contains(opening, name))
    deep = ~F.col("role").isin("home", "legal") & (X.words(F.col("f.extracted")) >= 100)
    facts = ok.groupBy("site_id").agg(
        F.bool_or(F.array_contains("f.types", "faqpage")).alias("faq"), F.bool_or(checks.anchored(True)).alias("sameas"), F.bool_or(F.size("f.islands") > 0).alias("hydrated"),
        F.min_by(concrete, F.when(F.col("role") == "home", F.col("page_seq"))).alias("opens"), F.coalesce(F.bool_and(F.when(deep, F.col("f.links_out"))), F.lit(True)).alias("routes"),
    )
    fired = findings.where(F.col("check_id").isin(*DECIDING)).groupBy("site_id").agg(F.collect_set("check_id").alias("ids"))
    s = sites.join(facts, "site_id", "left").join(fired, "site_id", "left").withColumn("ids", F.coalesce("ids", F.array().cast("array<string>")))
    no = lambda c: ~F.coalesce(F.col(c), F.lit(False))
    covered = F.arrays_overlap("ids", F.array(*map(F.lit, COVERED)))
    rules = {
        "llms_txt": no("llms_txt"), "ai_policy": no("ai_agents_named"), "faq_markup": no("faq"), "citable_facts": no("sameas"), "server_render": ~no("hydrated") & ~covered,
        "first_screen": ~F.coalesce("opens", F.lit(True)), "deep_routes": F.array_contains("ids", "E10_no_next_step") | ~F.coalesce("routes", F.lit(True)),
    }
    return s.select("site_id", F.explode(F.array(*(F.struct(F.lit(k).alias("rule"), v.alias("applies")) for k, v in rules.items()))).alias("r")).select("site_id", "r.*")
