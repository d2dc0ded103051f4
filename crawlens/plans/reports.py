"""The report of a site: its summary, findings and first actions, and what stands around them: profile, coverage, what was skipped, what is recommended, and the limits of any crawl."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from crawlens.operators import crawl
from crawlens.plans import audit

USER_AGENT = "crawlens/1.0"
#: rule: (title, effort, why it applies, why it does not).
RECOMMENDED = {
    "llms_txt": ("Offer an llms.txt that maps the site for AI clients", "low", "no plain-text /llms.txt was found", "/llms.txt is there"),
    "ai_policy": ("Decide on crawlers of AI services one by one, in writing", "low", "robots.txt names none of them, so the wildcard group decides", "robots.txt speaks to AI crawlers by name"),
    "faq_markup": ("Mark up questions with their answers", "medium", "no page has FAQPage structured data", "a page has FAQPage structured data"),
    "citable_facts": ("Keep one lasting page of facts that others can cite", "medium", "no organisation on the site links to its other profiles", "an organisation links to its other profiles"),
    "server_render": ("Render the facts that are quoted most on the server", "high", "pages ship a payload that a script turns into content; the facts are readable for now", "no client-side payload, or a finding covers it"),
    "first_screen": ("Answer a visitor's question on the first screen", "low", "the opening of the homepage has no figure and not the site's name", "the homepage opens with its name or a figure"),
    "deep_routes": ("Lead from every deep page to its section and to a contact", "low", "a deep page has no link in its content to the rest of the site", "deep pages lead on from their content"),
}
LIMITS = (
    "Not assessed: what visitors do. A crawl sees markup; engagement findings are risks in the structure and stop at medium.",
    "Not assessed: the rendered page, and what scripts fetch after loading. No script runs here, as with clients that do not render.",
    "Not assessed: whether copy persuades. Only structure and shared words are measured.",
    "Not assessed: anything behind a login, a checkout or an account.",
    "Not assessed: answers that assistants tailor to a person. They are made elsewhere; the site's part is to be quotable.",
    "Not assessed: whether other sites agree with this one's facts.",
    "Not assessed: problems that no check lists, unless reviewers' claims were verified; those stop at low.",
)


def stored_sites(pages: DataFrame, max_pages: int = 20) -> DataFrame:
    """A row for each site of stored pages: ``(site_id, start_url, audited_at, run_status, coverage, robots, roles_seen, llms_txt, ai_agents_named, notes, user_agent, sitemap_urls, sitemaps_fetched)``.

    Robots files, sitemaps and probes are not stored with pages, so they count as absent.
    """
    readable = F.col("status").between(200, 299) & F.col("f").isNotNull()
    told = F.coalesce("error", F.lit("")) if "error" in pages.columns else F.lit("")
    g = pages.groupBy("site_id").agg(
        F.min("start_url").alias("start_url"), F.max("audited_at").alias("audited_at"), F.count("*").alias("n"), F.count_if(F.col("status") > 0).alias("fetched"), F.count_if(readable).alias("ok"),
        F.array_sort(F.collect_set("role")).alias("roles_seen"), F.count_if(told != "").alias("failed"), F.min(F.when(told.startswith("bot_challenge:"), told)).alias("wall"),
    )
    status = F.when(F.col("ok") == 0, "failed").when((F.col("failed") > 0) | (F.col("ok") < F.col("n")), "partial").otherwise("complete")
    none = F.array().cast("array<string>")
    n = lambda c: F.col(c).cast("int")
    coverage = F.struct(n("n").alias("pages_attempted"), n("fetched").alias("pages_fetched"), n("ok").alias("pages_ok"), F.lit(0).alias("pages_blocked_by_robots_for_our_ua"), n("n").alias("urls_discovered"))
    robots = F.struct(F.lit(False).alias("present"), F.lit(None).cast("int").alias("status"), none.alias("sitemaps_declared"), F.lit(0).alias("sitemaps_fetched"))
    note = F.when(F.col("wall").isNotNull(), F.array(F.concat(F.lit("the server answered with a bot-challenge page ("), F.substring_index("wall", ":", -1), F.lit(")")))).otherwise(none)
    return g.select(
        "site_id", "start_url", "audited_at", status.alias("run_status"), coverage.alias("coverage"), robots.alias("robots"), "roles_seen", F.lit(False).alias("llms_txt"), F.lit(False).alias("ai_agents_named"), note.alias("notes"),
        F.lit(USER_AGENT).alias("user_agent"), none.alias("sitemap_urls"), F.lit(0).alias("sitemaps_fetched"),
    )


def recommendations(rules: DataFrame) -> DataFrame:
    """``rules(site_id, rule, applies)`` → ``(site_id, proactive, in_place)``: what to do, and what is done already, in the order of RECOMMENDED."""
    table = rules.sparkSession.createDataFrame([(i, k, *v) for i, (k, v) in enumerate(RECOMMENDED.items())], "place int, rule string, title string, effort string, why string, why_not string")
    r = rules.join(F.broadcast(table), "rule")
    do = F.struct("place", F.struct("rule", "title", "effort", F.col("why").alias("applies_because")).alias("x"))
    done = F.struct("place", F.struct("title", F.col("why_not").alias("because")).alias("x"))
    listed = lambda when, what: F.transform(F.array_sort(F.collect_list(F.when(when, what))), lambda y: y["x"])
    return r.groupBy("site_id").agg(listed(F.col("applies"), do).alias("proactive"), listed(~F.col("applies"), done).alias("in_place"))


def full(sites: DataFrame, findings: DataFrame, skipped: DataFrame, rules: DataFrame, access: DataFrame | None = None, review: DataFrame | None = None) -> DataFrame:
    """One row per site, one with no finding included; nested parts are JSON.

    ``sites`` as from ``stored_sites``, ``findings`` ranked, ``skipped`` from ``skips``, ``rules`` from ``audit.proactive``, ``access`` the agents' report,
    ``review(site_id, agent_review)`` JSON of a reviewer's run.
    """
    none = F.array().cast("array<string>")
    skip = skipped.groupBy("site_id").agg(F.to_json(F.array_sort(F.collect_list(F.struct("check", "reason", "impact")))).alias("checks_skipped"))
    counted = audit.report(findings)
    s = sites.join(counted, "site_id", "left").join(skip, "site_id", "left").join(recommendations(rules), "site_id", "left")
    s = s.join(crawl.ai_policy(access), "site_id", "left") if access is not None else s.withColumn("retrieval_agents_blocked", none).withColumn("training_agents_blocked", none)
    s = s.join(review, "site_id", "left") if review is not None else s.withColumn("agent_review", F.lit(None).cast("string"))
    policy = F.struct(F.coalesce("retrieval_agents_blocked", none).alias("retrieval_agents_blocked"), F.coalesce("training_agents_blocked", none).alias("training_agents_blocked"))
    profile = F.struct("start_url", F.col("coverage.pages_ok").alias("pages_crawled"), "roles_seen", F.col("robots.present").alias("robots_present"), policy.alias("ai_policy"), F.col("user_agent").alias("user_agent_used"))
    headline = F.when(F.col("run_status").isin("blocked", "failed"), "No automated client could read the site: access comes before anything else.").otherwise(F.coalesce("headline", F.lit(audit.NOTHING)))
    numbers = [c for c, kind in counted.dtypes if kind == "bigint"]
    return s.select(
        F.col("site_id"), F.col("audited_at").cast("string").alias("audited_at"), "run_status", headline.alias("headline"), *(F.coalesce(c, F.lit(0)).alias(c) for c in numbers), F.coalesce("findings", F.lit("[]")).alias("findings"),
        F.to_json(profile).alias("site_profile"), F.to_json("coverage").alias("coverage"), F.coalesce("checks_skipped", F.lit("[]")).alias("checks_skipped"), F.coalesce("agent_review", F.lit('{"status":"not_run"}')).alias("agent_review"),
        F.coalesce("prioritized_actions", F.lit("[]")).alias("prioritized_actions"), F.coalesce(F.to_json("proactive"), F.lit("[]")).alias("proactive_recommendations"), F.coalesce(F.to_json("in_place"), F.lit("[]")).alias("already_in_place"),
        F.to_json(F.array(*map(F.lit, LIMITS))).alias("limits"), F.to_json("notes").alias("notes"),
    )
