"""Readers and writers: stored site bundles, robots and sitemap tables, claims, run records, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

PAGE = "struct<url: string, final_url: string, status: int, role: string, headers: map<string,string>, html: string, elapsed_ms: int, redirect_chain: array<string>, error: string>"
AGENT = "struct<class: string, purpose: string, blocked_paths: array<string>, fully_blocked: boolean, partially_blocked: boolean, blocked_via_wildcard: boolean, deciding_rules: array<string>>"
BUNDLE = f"""bundle_schema_version int, site string, start_url string, audited_at string, user_agent string, run_status string,
coverage struct<pages_attempted: int, pages_fetched: int, pages_ok: int, pages_blocked_by_robots_for_our_ua: int, urls_discovered: int, elapsed_s: double>,
robots struct<present: boolean, status: int, sitemaps_declared: array<string>, crawl_delay_declared: double, agents: map<string,{AGENT}>, unrecognised_agent_tokens: array<struct<token: string, probably_meant: array<string>>>, sitemaps_fetched: int>,
sitemap_urls array<string>, notes array<string>, probes struct<llms_txt: struct<url: string, present: boolean, status: int>, ai_agents_named_in_robots: array<string>>,
pages array<{PAGE}>"""
ACTION = "struct<summary: string, how: array<string>, verify: string, effort: string>"
EVIDENCE = "array<struct<url: string, type: string, value: string, scope: string, header: string, path: string, op: string>>"
CLAIM = f"struct<title: string, why: string, mechanism: string, hurts: string, severity: string, nearest_check: string, affected_urls: array<string>, evidence: {EVIDENCE}, suggested_action: {ACTION}>"
CLAIMS = f"claims array<{CLAIM}>, fixes array<struct<check_id: string, url: string, quote: string, site_specific: array<string>>>, _corrupt_record string"
RUN = "slug string, url string, category string, expect string, rc string, wall_s double, finished_at string, stderr_tail array<string>, report_written boolean"


def bundles(spark: SparkSession, path: str) -> DataFrame:
    """One row per bundle file, missing keys as nulls."""
    return spark.read.schema(BUNDLE).json(path, multiLine=True)


def sites(bundle_rows: DataFrame) -> DataFrame:
    return bundle_rows.select(
        F.col("site").alias("site_id"), "start_url", F.to_timestamp("audited_at").alias("audited_at"), "run_status", "coverage", F.coalesce("sitemap_urls", F.array().cast("array<string>")).alias("sitemap_urls"),
        F.coalesce("robots.sitemaps_fetched", F.lit(0)).alias("sitemaps_fetched"), F.coalesce("probes.llms_txt.present", F.lit(False)).alias("llms_txt"), (F.coalesce(F.size("probes.ai_agents_named_in_robots"), F.lit(0)) > 0).alias("ai_agents_named"),
    )


def pages(bundle_rows: DataFrame) -> DataFrame:
    """One row per page in crawl order, header names in small letters."""
    p = bundle_rows.select(F.col("site").alias("site_id"), "start_url", F.to_timestamp("audited_at").alias("audited_at"), F.posexplode("pages").alias("page_seq", "p")).select("site_id", "start_url", "audited_at", "page_seq", "p.*")
    return tidy(p)


def tidy(p: DataFrame) -> DataFrame:
    """Header names in small letters, no null list of redirects, and a final address for every page."""
    small = F.map_from_entries(F.transform(F.map_entries(F.coalesce("headers", F.create_map().cast("map<string,string>"))), lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value"))))
    return p.withColumn("headers", small).withColumn("redirect_chain", F.coalesce("redirect_chain", F.array().cast("array<string>"))).withColumn("final_url", F.coalesce("final_url", "url"))


def sitemap_urls(bundle_rows: DataFrame) -> DataFrame:
    return bundle_rows.select(F.col("site").alias("site_id"), F.explode("sitemap_urls").alias("sitemap_url"))


def agent_access(bundle_rows: DataFrame) -> DataFrame:
    """``(site_id, agent, class, path, allowed)`` of the paths that a stored robots summary refuses."""
    a = bundle_rows.select(F.col("site").alias("site_id"), F.explode("robots.agents").alias("agent", "v"))
    return a.select("site_id", "agent", "v.class", F.explode("v.blocked_paths").alias("path")).withColumn("allowed", F.lit(False))


def claims(spark: SparkSession, path: str) -> DataFrame:
    """Claims and fixes of a file; what cannot be read stays in ``_corrupt_record``."""
    return spark.read.schema(CLAIMS).json(path, multiLine=True, mode="PERMISSIVE", columnNameOfCorruptRecord="_corrupt_record")


def runs(spark: SparkSession, path: str) -> DataFrame:
    """Run records of a batch of sites, with the folder's name as slug where it is missing."""
    r = spark.read.schema(RUN).json(path, multiLine=True).withColumn("_file", F.col("_metadata.file_path"))
    return r.withColumn("slug", F.coalesce("slug", F.regexp_extract("_file", r"/([^/]+)/[^/]+$", 1))).drop("_file")


def sitemap_locations(files: DataFrame) -> DataFrame:
    """``files(site_id, sitemap, xml)`` → ``(site_id, sitemap, at, loc, is_sitemap)`` in document order."""
    from crawlens.functions.urls import is_sitemap

    loc = F.posexplode(F.regexp_extract_all("xml", F.lit(r"(?is)<loc>\s*(.*?)\s*</loc>"), F.lit(1))).alias("at", "loc")
    return files.select("site_id", "sitemap", loc).withColumn("is_sitemap", is_sitemap(F.col("loc")))


def write_report(report: DataFrame, path: str) -> None:
    """One JSON document per site."""
    report.write.mode("overwrite").json(path)
