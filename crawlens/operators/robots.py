"""Robots rules as tables: groups and rules parsed in SQL, longest-match decisions by a per-site join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

# Crawlers and what they fetch for.
AGENTS = (
    ("OAI-SearchBot", "retrieval", "ChatGPT search index"),
    ("ChatGPT-User", "retrieval", "ChatGPT live user-initiated fetch"),
    ("Claude-SearchBot", "retrieval", "Claude search index"),
    ("Claude-User", "retrieval", "Claude live user-initiated fetch"),
    ("PerplexityBot", "retrieval", "Perplexity index"),
    ("Perplexity-User", "retrieval", "Perplexity live user-initiated fetch"),
    ("Applebot", "retrieval", "Apple / Siri retrieval"),
    ("Googlebot", "retrieval", "Google index (also serves AI Overviews)"),
    ("Bingbot", "retrieval", "Bing index (also serves Copilot)"),
    ("GPTBot", "training", "OpenAI model training"),
    ("ClaudeBot", "training", "Anthropic model training"),
    ("CCBot", "training", "Common Crawl corpus"),
    ("Google-Extended", "training", "Gemini training (does NOT affect Google Search or AI Overviews)"),
    ("Applebot-Extended", "training", "Apple model training"),
    ("Bytespider", "training", "ByteDance training"),
    ("meta-externalagent", "ambiguous", "Meta; documentation does not cleanly separate training from retrieval"),
)
INDEX_CRITICAL = ("googlebot", "bingbot", "oai-searchbot")


def agents(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(AGENTS), "agent string, class string, purpose string")


def agent_class(token: Column) -> Column:
    out = F.lit(None).cast("string")
    for kind in ("retrieval", "training", "ambiguous"):
        out = F.coalesce(out, F.when(F.lower(token).isin(*(a.lower() for a, k, _ in AGENTS if k == kind)), kind))
    return F.coalesce(out, F.lit("unknown"))


def specificity(rule_path: Column) -> Column:
    return F.length(F.regexp_replace(rule_path, r"[*$]", ""))


def pattern(rule_path: Column) -> Column:
    """A rule's path as an anchored pattern: ``*`` is any run, a closing ``$`` the end."""
    quoted = F.regexp_replace(rule_path, r"([\\.+?^${}()|\[\]])", r"\\$1")
    return F.concat(F.lit("^"), F.regexp_replace(F.regexp_replace(quoted, r"\*", ".*"), r"\\\$$", r"\$"))


def lines(texts: DataFrame) -> DataFrame:
    """``texts(site_id, text)`` → ``(site_id, at, field, value)`` in file order, comments and blanks gone."""
    rows = texts.select("site_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), r"\r\n|\r|\n")).alias("at", "line"))
    rows = rows.withColumn("line", F.trim(F.substring_index("line", "#", 1))).where(F.col("line").contains(":"))
    value = F.trim(F.expr("substring(line, instr(line, ':') + 1)"))
    return rows.select("site_id", "at", F.lower(F.trim(F.substring_index("line", ":", 1))).alias("field"), value.alias("value"))


def rules(texts: DataFrame) -> DataFrame:
    """``(site_id, grp, agents, allow, path, pattern, specificity, crawl_delay)``: one row per rule, or one without a path for a group of none.

    A group starts at a user-agent line that does not follow another one; sitemap lines do not end it.
    """
    order = W.partitionBy("site_id").orderBy("at")
    body = lines(texts).where("field IN ('user-agent', 'allow', 'disallow', 'crawl-delay')")
    is_agent = F.col("field") == "user-agent"
    body = body.withColumn("new", (is_agent & ~F.coalesce(F.lag(is_agent).over(order), F.lit(False))).cast("int"))
    body = body.withColumn("grp", F.sum("new").over(order.rowsBetween(W.unboundedPreceding, W.currentRow))).where("grp > 0")
    head = body.groupBy("site_id", "grp").agg(
        F.array_sort(F.collect_set(F.when(is_agent, F.col("value")))).alias("agents"),
        F.min_by(F.expr("CASE WHEN field = 'crawl-delay' THEN try_cast(value AS DOUBLE) END"), F.when(F.col("field") == "crawl-delay", F.col("at"))).alias("crawl_delay"),
    )
    own = body.where("field IN ('allow', 'disallow') AND value <> ''").select("site_id", "grp", (F.col("field") == "allow").alias("allow"), F.col("value").alias("path"))
    return head.join(own, ["site_id", "grp"], "left").withColumn("pattern", pattern(F.col("path"))).withColumn("specificity", specificity(F.col("path")))


def sitemaps(texts: DataFrame) -> DataFrame:
    return lines(texts).where("field = 'sitemap' AND value <> ''").select("site_id", "at", F.col("value").alias("sitemap"))


def decisions(rule_rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted(site_id, agent, path)`` → with ``allowed, rule, via_wildcard``.

    Groups that name the agent replace the wildcard group; the longest matching rule counts, an allowing one among equals;
    without a match everything is allowed. Rules and paths meet per site, never across sites.
    """
    named = rule_rows.withColumn("token", F.explode("agents")).withColumn("token", F.lower("token"))
    asked = wanted.select("site_id", "agent", "path").distinct()
    own = named.select("site_id", "token").distinct().withColumn("has", F.lit(True))
    asked = asked.join(own, (asked["site_id"] == own["site_id"]) & (F.lower("agent") == F.col("token")), "left").select(asked["site_id"], "agent", "path", F.coalesce("has", F.lit(False)).alias("specific"))
    asked = asked.withColumn("token", F.when(F.col("specific"), F.lower("agent")).otherwise(F.lit("*")))
    meeting = asked.withColumnRenamed("path", "asked").join(named.select("site_id", "token", "allow", "path", "pattern", "specificity"), ["site_id", "token"], "left")
    meeting = meeting.withColumn("hit", F.coalesce(F.expr("coalesce(try_url_decode(replace(asked, '+', '%2B')), asked) RLIKE pattern"), F.lit(False)))
    best = F.max(F.when(F.col("hit"), F.struct("specificity", F.col("allow").cast("int").alias("a"), F.col("path").alias("p"))))
    out = meeting.groupBy("site_id", "agent", F.col("asked").alias("path"), "specific").agg(best.alias("b"), F.count("token").alias("n"), F.bool_or(F.col("pattern").isNotNull()).alias("any"))
    return out.select(
        "site_id", "agent", "path",
        F.coalesce(F.col("b.a") == 1, F.lit(True)).alias("allowed"),
        F.when(F.col("b").isNotNull(), F.concat(F.when(F.col("b.a") == 1, "Allow: ").otherwise("Disallow: "), F.col("b.p"))).alias("rule"),
        (~F.col("specific") & F.col("any")).alias("via_wildcard"),
    )


def with_status(decided: DataFrame, status: DataFrame) -> DataFrame:
    """``status(site_id, status, reachable)``: an unreachable file or a server error refuses, a client error allows."""
    d = decided.join(status, "site_id", "left")
    refused = (~F.coalesce("reachable", F.lit(True))) | F.col("status").between(500, 599)
    return d.withColumn("allowed", F.when(refused, False).when(F.col("status").between(400, 499), True).otherwise(F.col("allowed"))).drop("status", "reachable")


def agent_report(decided: DataFrame, spark: SparkSession) -> DataFrame:
    """``(site_id, agent, class, blocked_paths, fully_blocked, partially_blocked, blocked_via_wildcard, deciding_rules)``."""
    d = decided.join(F.broadcast(agents(spark).drop("purpose")), "agent")
    shut = ~F.col("allowed")
    out = d.groupBy("site_id", "agent", "class").agg(
        F.count("*").alias("n"), F.count_if(shut).alias("blocked"),
        F.array_sort(F.collect_set(F.when(shut, F.col("path")))).alias("blocked_paths"),
        F.coalesce(F.bool_and(F.when(shut, F.col("via_wildcard"))), F.lit(False)).alias("blocked_via_wildcard"),
        F.array_sort(F.collect_set(F.when(shut, F.col("rule")))).alias("deciding_rules"),
    )
    return out.select("site_id", "agent", "class", "blocked_paths", (F.col("blocked") == F.col("n")).alias("fully_blocked"), ((F.col("blocked") > 0) & (F.col("blocked") < F.col("n"))).alias("partially_blocked"), "blocked_via_wildcard", "deciding_rules")


def unrecognised(rule_rows: DataFrame, spark: SparkSession) -> DataFrame:
    """``(site_id, token, probably_meant)``: tokens of four letters or more that only begin like a known crawler."""
    known = agents(spark).select(F.col("agent").alias("full"), F.lower("agent").alias("low"))
    tokens = rule_rows.select("site_id", F.explode("agents").alias("token")).distinct().withColumn("t", F.lower(F.trim("token"))).where(F.length("t") >= 4)
    near = tokens.join(F.broadcast(known), F.col("low").startswith(F.col("t")))  # 16 rows
    return near.groupBy("site_id", "token", "t").agg(F.array_sort(F.collect_set("full")).alias("probably_meant"), F.bool_or(F.col("low") == F.col("t")).alias("whole")).where("NOT whole").select("site_id", "token", "probably_meant")


def block_findings(report: DataFrame) -> DataFrame:
    """``(site_id, status, agents)``: sites that refuse retrieval agents; a question where it looks like a policy per agent."""
    r = report.where("class = 'retrieval'")
    hit = F.col("fully_blocked") | F.col("partially_blocked")
    out = r.groupBy("site_id").agg(
        F.array_sort(F.collect_set(F.when(hit, F.col("agent")))).alias("agents"),
        F.bool_and(F.when(hit, ~F.col("blocked_via_wildcard"))).alias("named"),
        F.coalesce(F.bool_or(F.when(hit, F.lower("agent").isin(*INDEX_CRITICAL))), F.lit(False)).alias("critical"),
        F.bool_or(~hit).alias("others"), F.bool_and(F.when(hit, F.col("fully_blocked"))).alias("whole"),
    ).where(F.size("agents") > 0)
    meant = F.col("named") & ~F.col("critical") & (F.col("others") | ~F.col("whole"))
    return out.select("site_id", F.when(meant, "confirm_intent").otherwise("active").alias("status"), "agents")
