"""What a stored crawl says about itself: challenges, run status, links, frontier order and sitemap trees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from crawlens.functions import urls as U

# Challenge pages by title and by vendor, and the bounds of a sitemap walk.
CHALLENGE_TITLE = r"(?i)<title[^>]*>\s*(pardon our interruption|just a moment\.{0,3}|attention required! \| cloudflare|access denied|are you a (human|robot)\??|security check(point)?|verifying you are human|one more step)\s*</title>"
VENDORS = (
    ("Incapsula", r"(?i)_Incapsula_Resource|Incapsula incident ID"),
    ("Cloudflare", r"(?i)cf_chl_opt|cf-browser-verification"),
    ("PerimeterX", r"(?i)px-captcha|captcha\.px-cdn\.net"),
    ("DataDome", r"(?i)captcha-delivery\.com"),
    ("Akamai", r"(?i)Reference&#32;&#35;|Reference #\d+\.[0-9a-f]+"),
)
MAX_CHALLENGE, MAX_CHALLENGE_WORDS = 60_000, 60
MAX_DEPTH, MAX_FETCHED, MAX_URLS, PER_ROLE = 3, 8, 200, 2


def challenge(html: Column) -> Column:
    """The vendor of a bot-challenge page, or null: by title, or by a vendor's mark on a page of hardly any text."""
    vendor = F.lit(None).cast("string")
    for name, pattern in reversed(VENDORS):
        vendor = F.when(html.rlike(pattern), name).otherwise(vendor)
    shown = F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style|noscript)\b.*?</\1>", " "), "<[^>]+>", " ")
    few = F.regexp_count(shown, F.lit(r"\S+")) < MAX_CHALLENGE_WORDS
    small = (html != "") & (F.length(html) <= MAX_CHALLENGE)
    return F.when(small & F.substring(html, 1, 4000).rlike(CHALLENGE_TITLE), F.coalesce(vendor, F.lit("unrecognised vendor"))).when(small & few, vendor)


def run_status(pages: DataFrame, sites: DataFrame) -> DataFrame:
    """``(site_id, run_status)``. ``pages(site_id, status, html, error)``, ``sites(site_id, blocked_by_robots, urls_seen, max_pages)``."""
    ok = F.col("status").between(200, 299) & (F.coalesce("html", F.lit("")) != "")
    p = pages.groupBy("site_id").agg(F.count("*").alias("n"), F.count_if(ok).alias("ok"), F.bool_or(F.coalesce("error", F.lit("")) != "").alias("failed"))
    s = sites.join(p, "site_id", "left").withColumn("n", F.coalesce("n", F.lit(0))).withColumn("ok", F.coalesce("ok", F.lit(0)))
    return s.select("site_id", F.when((F.col("n") == 0) & F.col("blocked_by_robots"), "blocked").when(F.col("ok") == 0, "failed").when((F.col("n") < F.least("max_pages", "urls_seen")) | F.col("failed") | (F.col("ok") < F.col("n")), "partial").otherwise("complete").alias("run_status"))


def resolved(href: Column, base: Column) -> Column:
    """An address as seen from ``base``, without its fragment."""
    href = F.trim(F.substring_index(href, "#", 1))
    origin = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    folder = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(?:/[^?#]*/)?)", 1)
    return (
        F.when(href.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), href).when(href.startswith("//"), F.concat(U.scheme(base), F.lit(":"), href))
        .when(href.startswith("/"), F.concat(origin, href)).otherwise(F.concat(folder, F.when(folder.endswith("/"), "").otherwise("/"), href))
    )


def linked(anchors: DataFrame) -> DataFrame:
    """``anchors(site_id, final_url, at, href, label)`` → ``(site_id, target, label)``: pages of the same site, with the first label that says something."""
    href = F.trim(F.substring_index("href", "#", 1))
    a = anchors.where((href != "") & ~href.rlike("(?i)^(mailto|tel|javascript|data):")).withColumn("target", U.normalised(resolved(F.col("href"), F.col("final_url"))))
    a = a.where((U.bare_host(F.col("target")) == U.bare_host(F.col("final_url"))) & ~U.is_asset(F.col("target")))
    label = F.when(F.col("label") != "", F.substring("label", 1, 80))
    return a.groupBy("site_id", "target").agg(F.min_by(label, F.when(label.isNotNull(), F.col("at"))).alias("label"))


def homepage_links(parsed: DataFrame) -> DataFrame:
    """``(site_id, target, label)``: pages of the same site that the home page links to, with the first label."""
    a = parsed.where("role = 'home'").select("site_id", "page_seq", "final_url", F.posexplode("f.anchors").alias("at", "a"))
    return linked(a.select("site_id", "final_url", F.struct("page_seq", "at").alias("at"), "a.href", F.col("a.text").alias("label")))


def frontier(links: DataFrame, urls: DataFrame) -> DataFrame:
    """``urls(site_id, url, seq)`` in crawl order: two linked pages of each role that carries facts come first."""
    role = U.role(F.col("target"), anchor=F.col("label"))
    first = links.withColumn("role", role).where(F.col("role").isin(*U.PRIORITY_ROLES)).withColumn("k", F.row_number().over(W.partitionBy("site_id", "role").orderBy("target"))).where(F.col("k") <= PER_ROLE)
    turn = F.array_position(F.array(*map(F.lit, U.PRIORITY_ROLES)), F.col("role"))
    lead = first.select("site_id", F.col("target").alias("url"), F.struct(turn.alias("a"), F.col("k").cast("long").alias("b")).alias("lead"))
    once = urls.groupBy("site_id", "url").agg(F.min("seq").alias("seq"))
    both = once.join(lead, ["site_id", "url"], "full")
    order = W.partitionBy("site_id").orderBy(F.col("lead").isNull(), "lead", "seq")
    return both.withColumn("position", F.row_number().over(order)).select("site_id", "url", "position")


def sitemap_pages(files: DataFrame, roots: DataFrame) -> DataFrame:
    """``(site_id, url, seq)``: pages that nested sitemaps list, breadth first, each once, at most MAX_URLS a site.

    ``files(site_id, sitemap, xml)`` are the stored documents, ``roots(site_id, sitemap, at)`` the declared ones. The tree is
    MAX_DEPTH levels deep, so the walk is that many joins; at most MAX_FETCHED documents count per site.
    """
    from crawlens.sources.bundles import sitemap_locations

    loc = sitemap_locations(files)
    level = roots.select("site_id", "sitemap", F.array(F.col("at").cast("long")).alias("order"))
    seen = level
    for _ in range(1, MAX_DEPTH):
        level = level.join(loc.where("is_sitemap"), ["site_id", "sitemap"]).select("site_id", F.col("loc").alias("sitemap"), F.concat("order", F.array(F.col("at").cast("long"))).alias("order"))
        seen = seen.unionByName(level)
    once = seen.groupBy("site_id", "sitemap").agg(F.min(F.struct(F.size("order").alias("depth"), F.col("order"))).alias("o"))
    fetched = once.withColumn("k", F.row_number().over(W.partitionBy("site_id").orderBy("o"))).where(F.col("k") <= MAX_FETCHED)
    found = fetched.join(loc.where("NOT is_sitemap"), ["site_id", "sitemap"]).groupBy("site_id", F.col("loc").alias("url")).agg(F.min(F.struct("k", "at")).alias("o"))
    return found.withColumn("seq", F.row_number().over(W.partitionBy("site_id").orderBy("o"))).where(F.col("seq") <= MAX_URLS).select("site_id", "url", "seq")


def llms_present(status: Column, content_type: Column, body: Column) -> Column:
    return (status == 200) & ~F.lower(F.coalesce(content_type, F.lit(""))).contains("html") & (F.trim(F.coalesce(body, F.lit(""))) != "")


def ai_policy(report: DataFrame) -> DataFrame:
    """``(site_id, retrieval_agents_blocked, training_agents_blocked)`` of agents that are refused everywhere."""
    of = lambda k: F.array_sort(F.collect_set(F.when((F.col("class") == k) & F.col("fully_blocked"), F.col("agent")))).alias(f"{k}_agents_blocked")
    return report.groupBy("site_id").agg(of("retrieval"), of("training"))
