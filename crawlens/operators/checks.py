"""The check catalogue. All page checks of a page are one array expression over its parsed facts, so that any number of checks cost one scan; checks across pages are grouped sums, windows and joins within a site."""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import Column, DataFrame, functions as F

from crawlens.functions import text as X, urls as U
from crawlens.sources.storage import stored

# Fixed values of the catalogue.
GATING = ("robots", "googlebot", "bingbot", "oai-searchbot", "chatgpt-user", "claude-searchbot", "claude-user", "perplexitybot", "perplexity-user", "applebot")
VALUED = "^(max-snippet|max-image-preview|max-video-preview|unavailable_after)"
SOFT_404 = ("not found", "404", "page doesn't exist", "page does not exist", "no longer available", "seite nicht gefunden", "page introuvable", "página no encontrada")
GENERIC_TITLES = ("home", "index", "untitled", "welcome", "new page", "document", "home page")
VAGUE = ("click here", "here", "read more", "more", "learn more", "this", "link", "continue", "details", "find out more")
STOP = (
    "the", "a", "an", "and", "or", "of", "for", "to", "in", "on", "with", "your", "our", "we", "you", "is", "are", "be", "by", "at", "from", "that", "this", "it", "as", "home",
    "welcome",
)
CONVERSION = "contact|demo|quote|signup|sign-up|register|checkout|order|apply"
CONTENT_ROLES = ("home", "product", "pricing", "about", "blog", "contact")
KEY_ROLES = ("pricing", "product", "contact")
PRICING_SLUG = r"(?i)(^|[-_])(pricing|prices|price|preise|tarifs?|tarifas|precios|prezzi|prijzen)($|[-_.])"
PRICING_HEADING = r"(?i)\b(pricing|prices?|price list|subscriptions?|tariffs?|fees|membership plans|preise|tarifs?|precios|prezzi|prijzen)\b"
CONTACT_LEAF = r"(?i)contact|kontakt|contatt|contato|contacto|get-in-touch"
ORG_SUFFIX = "(organization|organisation|business|store|corporation|restaurant|company|agency|shop)$"
ORG_TYPES = (
    "dentist", "physician", "attorney", "hotel", "bakery", "cafeorcoffeeshop", "barorpub", "brand", "hospital", "pharmacy", "school", "collegeoruniversity", "library", "museum",
    "gym", "healthclub", "realestateagent", "autodealer", "autorepair", "medicalclinic", "lodgingbusiness", "foodestablishment", "professionalservice", "financialservice", "bank",
    "insuranceagency", "travelagency", "hairsalon", "beautysalon", "daycare", "veterinarycare", "hardwarestore", "clothingstore", "electronicsstore", "grocerystore",
)
MORE_ORG_TYPES = (
    "newsmediaorganization", "educationalorganization", "governmentorganization", "sportsorganization", "medicalorganization", "ngo", "airline",
)
SECTION_INDEX = "(?i)^/(blog|news|articles?|insights|press)/?$"
REFRESH = r"(?i)^\s*(\d+)\s*[;,]\s*url\s*=\s*['\"]?([^'\"]+)"
STALE_MONTHS, SHARED_TITLE, HUB_LINKS = 18, 3, 5
FILLER_PAGES, FILLER_WORDS, FILLER_SHARE, FILLER_TRIGGER = 4, 300, 0.60, 0.45

#: check: (title, reach rule, confidence, basis, effort). Reach rules: all (every page: site-wide, else template), many (one page: single, else template), or a fixed reach.
SPEC = {
    "A2_snippet_suppressed": ("%d page(s) suppress text snippets", "all", "deterministic", "static_fact", "low"),
    "A3_noindex": ("%d page(s) carry noindex", "all", "deterministic", "static_fact", "low"),
    "A3_noindex_utility": ("Confirm intent: %d page(s) outside the key templates carry noindex", "all", "deterministic", "static_fact", "low"),
    "A4_redirect_chain": ("Long redirect chains on %d URL(s)", "single_page", "deterministic", "static_fact", "low"),
    "A5_canonical_problem": ("Canonical link problems on %d page(s)", "all", "heuristic", "static_fact", "low"),
    "A5_canonical_missing": ("No canonical link on %d duplicate-prone page(s)", "all", "heuristic", "static_fact", "low"),
    "A9_broken_pages": ("%d linked page(s) are broken", "many", "deterministic", "static_fact", "low"),
    "A9_key_page_broken": ("%d linked page(s) are broken, key pages among them", "many", "deterministic", "static_fact", "low"),
    "A10_meta_refresh": ("%d page(s) redirect with a meta refresh", "many", "deterministic", "static_fact", "low"),
    "A11_soft_404": ("%d page(s) answer HTTP 200 with a not-found page", "many", "heuristic", "static_fact", "low"),
    "B1_fact_absent": ("No required fact in the HTML of %d page(s) that should carry one", "all", "deterministic", "static_fact", "medium"),
    "B1_fact_script_only": ("Key facts exist only inside script payloads on %d page(s)", "all", "deterministic", "static_fact", "medium"),
    "B4_empty_shell": ("%d page(s) serve an essentially empty HTML shell", "all", "deterministic", "static_fact", "high"),
    "B6_filler_heavy": ("Page content is mostly site-wide filler on %d page(s)", "template", "deterministic", "static_heuristic", "medium"),
    "C1_structured_data_invalid": ("Malformed JSON-LD on %d page(s)", "template", "deterministic", "static_fact", "low"),
    "C1_product_markup_absent": ("No Product structured data on %d product page(s)", "all", "deterministic", "static_fact", "medium"),
    "C1_structured_data_absent": ("No structured data on %d significant page(s)", "all", "deterministic", "static_fact", "medium"),
    "C2_markup_text_contradiction": ("Structured-data price not in the visible text of %d page(s)", "template", "heuristic", "static_heuristic", "low"),
    "C3_entity_unanchored": ("Brand identity is not anchored to any external profile", "site_wide", "deterministic", "static_fact", "low"),
    "C5_faq_content_unmarked": ("Questions without marked answers on %d page(s)", "template", "deterministic", "static_fact", "low"),
    "C6_entity_name_conflict": ("The homepage states more than one name for the brand", "site_wide", "heuristic", "static_heuristic", "low"),
    "C7_title_problem": ("Missing, generic or duplicated <title> on %d page(s)", "all", "deterministic", "static_fact", "low"),
    "X1_low_quotability": ("Passages are hard to quote standalone on %d page(s)", "template", "heuristic", "static_heuristic", "medium"),
    "D1_no_date_signals": ("No machine-readable date on %d page(s)", "template", "deterministic", "static_fact", "low"),
    "D2_stale_copyright": ("Copyright year is out of date on %d page(s)", "most", "deterministic", "static_fact", "low"),
    "D3_content_stale": ("%d page(s) have not been updated for long", "template", "deterministic", "static_fact", "low"),
    "D4_internal_contradiction": ("Items are declared at different prices on %d page(s)", "template", "heuristic", "static_heuristic", "medium"),
    "E1_form_friction": ("Long conversion forms on %d page(s)", "many", "heuristic", "static_heuristic", "low"),
    "E1_unlabelled_input": ("Form field(s) without a label in a template used on %d page(s)", "many", "heuristic", "static_heuristic", "low"),
    "E2_vague_link_text": ("Vague link text on %d page(s)", "template", "heuristic", "static_heuristic", "low"),
    "E3_unnamed_controls": ("Controls without a name on %d page(s)", "template", "heuristic", "static_heuristic", "low"),
    "E4_images_missing_alt": ("Images without alt text on %d page(s)", "template", "heuristic", "static_heuristic", "low"),
    "E5_no_lang": ("No lang attribute on %d page(s)", "all", "heuristic", "static_heuristic", "low"),
    "E6_heading_structure": ("No h1 on %d page(s)", "all", "heuristic", "static_heuristic", "low"),
    "E7_zoom_disabled": ("Pinch-zoom suppressed on %d page(s)", "all", "heuristic", "static_heuristic", "low"),
    "E9_promise_payoff_mismatch": ("Title and text share no word on %d page(s)", "template", "heuristic", "static_heuristic", "medium"),
    "E10_no_next_step": ("No next step in the content of %d page(s)", "template", "heuristic", "static_heuristic", "low"),
    "E11_no_viewport": ("No viewport meta tag on %d page(s)", "all", "deterministic", "static_fact", "low"),
    "E12_no_orientation": ("%d page(s) do not say where the visitor is", "many", "heuristic", "static_heuristic", "low"),
    "A1_retrieval_agent_blocked": ("robots.txt blocks retrieval agents", "site_wide", "deterministic", "static_fact", "low"),
    "A6_sitemap_missing": ("No usable XML sitemap discovered", "site_wide", "deterministic", "static_fact", "low"),
    "A7_site_unreadable": ("Site could not be read by an automated client", "site_wide", "deterministic", "static_fact", "medium"),
    "A8_robots_token_unrecognised": ("robots.txt names truncated user-agent tokens", "site_wide", "deterministic", "static_fact", "low"),
}

f = lambda name: F.col(f"f.{name}")


def readable(pages: DataFrame) -> DataFrame:
    return pages.where("status BETWEEN 200 AND 299 AND f IS NOT NULL")


def directives(header: Column, metas: Column) -> Column:
    """(bot, directive) pairs of a page; a scope in the header carries on to the directives after it."""
    empty = F.array().cast("array<struct<bot:string,d:string>>")

    def scan(acc, token):
        scoped = token.contains(":") & ~token.rlike(VALUED)
        bot = F.when(scoped, F.trim(F.substring_index(token, ":", 1))).otherwise(acc["bot"])
        d = F.when(scoped, F.trim(F.regexp_replace(token, "^[^:]*:", ""))).otherwise(token)
        return F.struct(bot.alias("bot"), F.when(d != "", F.array_append(acc["out"], F.struct(bot.alias("bot"), d.alias("d")))).otherwise(acc["out"]).alias("out"))

    parts = lambda v: F.filter(F.transform(F.split(F.lower(F.coalesce(v, F.lit(""))), ","), lambda t: F.trim(t)), lambda t: t != "")
    of_header = F.aggregate(parts(header), F.struct(F.lit("robots").alias("bot"), empty.alias("out")), scan, lambda a: a["out"])
    named = F.filter(metas, lambda m: (m["name"] == "robots") | m["name"].isin(*GATING) | m["name"].endswith("bot"))
    of_meta = F.flatten(F.transform(named, lambda m: F.transform(parts(m["content"]), lambda d: F.struct(m["name"].alias("bot"), d.alias("d")))))
    return F.concat(of_header, of_meta)


def zoom_blocked(content: Column) -> Column:
    """Whether a viewport suppresses zoom; the last of repeated directives counts."""
    pairs = F.filter(F.transform(F.split(content, ","), lambda p: F.struct(F.lower(F.trim(F.substring_index(p, "=", 1))).alias("k"), F.when(p.contains("="), F.lower(F.trim(F.regexp_replace(p, "^[^=]*=", "")))).otherwise("").alias("v"))), lambda p: p["k"] != "")
    last = lambda key: F.element_at(F.filter(pairs, lambda p: p["k"] == key), -1)["v"]
    has = lambda key: F.exists(pairs, lambda p: p["k"] == key)
    return F.coalesce((F.when(has("user-scalable"), last("user-scalable")).isin("no", "0")) | (F.when(has("maximum-scale"), last("maximum-scale")).try_cast("double") < 2.0), F.lit(False))


def commerce(with_markup: bool) -> Column:
    """Why a page owes a price, or null."""
    leaf = U.leaf(F.col("url"))
    out = F.when(F.lit(with_markup) & F.arrays_overlap(f("types"), F.array(*map(F.lit, ("product", "productgroup", "offer", "aggregateoffer")))), "structured data")
    return (
        out.when(F.lower(f("og_type")).contains("product"), "og:type").when(F.exists(f("forms"), lambda x: x["action"].rlike("(?i)cart|checkout|basket")), "cart form")
        .when(X.price(f("full")).isNotNull(), "price shown").when(leaf.rlike(PRICING_SLUG), "address")
        .when(F.concat_ws(" ", f("title"), F.array_join(f("h1"), " ")).rlike(PRICING_HEADING), "heading")
    )


def org_like(types: Column, narrow: bool = False) -> Column:
    return F.exists(types, lambda t: t.rlike(ORG_SUFFIX) | t.isin(*ORG_TYPES, *(() if narrow else MORE_ORG_TYPES)))


def anchored(narrow: bool = False) -> Column:
    """An organisation-like node with links to other profiles."""
    return F.exists(f("nodes"), lambda n: org_like(n["types"], narrow) & n["props"].rlike(r'"sameAs": (\[\s*[^\]\s]|"[^"])'))


def contact_page() -> Column:
    own = F.regexp_replace(U.path(F.col("url")), "/+$", "")
    onward = F.array_distinct(F.transform(F.filter(f("anchors"), lambda a: ~a["side"] & U.path(a["href"]).rlike(CONTACT_LEAF)), lambda a: F.regexp_replace(U.path(a["href"]), "/+$", "")))
    return U.leaf(F.col("url")).rlike(CONTACT_LEAF) & (F.size(F.array_remove(onward, own)) < HUB_LINKS)


def _hit(check: str, when: Column, note: Column | str = "", key: Column | str = "", status: Column | str = "active") -> Column:
    col = lambda x: F.lit(x) if isinstance(x, str) else x.cast("string")
    return F.when(when, F.struct(F.lit(check).alias("check_id"), F.coalesce(col(key), F.lit("")).alias("key"), F.coalesce(col(note), F.lit("")).alias("note"), F.coalesce(col(status), F.lit("active")).alias("status")))


def page_hits(pages: DataFrame, only: Collection[str] | None = None) -> DataFrame:
    """``(site_id, url, check_id, key, note, status)`` of all checks that look at one page alone, or of those named: others are not worked out."""
    p = readable(pages)
    hit = lambda check, *what: _hit(check, *what) if only is None or check in only else None
    pairs = directives(F.col("headers")["x-robots-tag"], f("metas"))
    p = p.withColumn("_d", F.transform(F.filter(pairs, lambda x: x["bot"].isin(*GATING)), lambda x: x["d"]))
    here, target = F.col("final_url"), F.when(f("canonical").rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), f("canonical"))
    canonical_path = F.coalesce(F.nullif(U.path(f("canonical")), F.lit("")), F.lit("/"))
    off_site = F.coalesce(U.bare_host(target) != U.bare_host(here), F.lit(False))
    to_home = (F.col("role") != "home") & (canonical_path == "/") & ~U.is_root(here) & f("canonical").rlike("^([A-Za-z]|/)")
    refresh = F.exists(f("refresh"), lambda c: c.rlike(REFRESH) & (F.trim(F.regexp_extract(c, REFRESH, 2)) != here))
    soft = F.exists(F.concat(F.array(f("title")), F.slice(f("h1"), 1, 1)), lambda t: F.exists(F.array(*map(F.lit, SOFT_404)), lambda s: F.contains(F.lower(t), s)))
    noindex = F.exists("_d", lambda d: d.isin("noindex", "none"))
    quiet = F.exists("_d", lambda d: F.regexp_replace(d, r"\s", "").isin("nosnippet", "max-snippet:0")) | f("nosnippet")

    meta_text = F.array_join(F.transform(f("metas"), lambda m: m["content"]), " | ")
    role = F.col("role")
    price_due = role.isin("pricing", "product") & commerce(True).isNotNull()
    price_tier = X.tier("price", f("full"), f("ld_text"), meta_text, f("payload"))
    contact_due = (role == "contact") & contact_page()
    blob = F.concat_ws(" | ", f("payload"), f("scripts"))
    reach = F.least(F.when(f("tel"), 0).otherwise(X.tier("phone", f("full"), f("ld_text"), meta_text, blob)), F.when(f("mailto"), 0).otherwise(X.tier("email", f("full"), f("ld_text"), meta_text, blob)))
    form_only = (F.size("f.forms") > 0) & (f("has_textarea") | f("has_email_input"))

    n_words = X.words(f("extracted"))
    shown = X.prices(f("extracted"))
    offers = F.filter(F.transform(f("nodes"), lambda n: F.struct(F.get_json_object(n["props"], "$.offers.price").alias("price"), F.lower(F.coalesce(F.get_json_object(n["props"], "$.offers.@type"), F.lit(""))).alias("kind"))), lambda o: o["price"].isNotNull() & ~o["kind"].contains("aggregateoffer"))
    declared = F.array_distinct(F.filter(F.transform(offers, lambda o: X.amount(F.trim(o["price"]))), lambda v: v.isNotNull()))
    variants = (F.size(declared) > 1) & F.arrays_overlap(declared, shown)
    questions = F.filter(f("headings"), lambda h: h.rlike(X.QUESTION))
    org_name = F.get_json_object(F.get(F.filter(f("nodes"), lambda n: org_like(n["types"]) & (F.trim(F.coalesce(F.get_json_object(n["props"], "$.name"), F.lit(""))) != "")), F.lit(0))["props"], "$.name")
    one, two = X.name_tokens(org_name), X.name_tokens(f("site_name"))

    fit = F.filter(f("paragraphs"), lambda t: X.words(t).between(25, 90))
    weak = F.filter(fit, lambda t: t.rlike(X.REFERRING))
    dated = F.filter(f("metas"), lambda m: F.coalesce(F.nullif(m["property"], F.lit("")), m["name"]).rlike("published_time|modified_time|date"))
    signals = F.array_join(F.concat(f("times"), F.transform(dated, lambda m: m["content"]), F.array(F.coalesce(X.http_day(F.col("headers")["last-modified"]), F.lit(""))), f("dates")), " ")
    days = X.every(signals, X.ISO_DATE)
    newest = F.array_min(F.transform(days, lambda d: X.months_since(F.col("audited_at"), d)))
    article = (role == "blog") & ~F.coalesce(U.path(F.col("url")).rlike(SECTION_INDEX), F.lit(False))
    year = F.array_max(X.copyright_years(f("full")))

    vague = F.filter(f("anchors"), lambda a: F.lower(a["text"]).isin(*VAGUE) & F.lower(a["label"]).isin("", *VAGUE))
    nameless = F.filter(f("controls"), lambda c: ~c["named"])
    blank = F.filter(f("images"), lambda i: i["alt"].isNull())
    heavy = F.filter(f("forms"), lambda x: x["ident"].rlike(CONVERSION) & ((F.size(F.filter(x["fields"], lambda y: y["required"])) > 5) | (F.size(x["fields"]) > 8)))
    promise = F.lower(F.concat_ws(" ", f("title"), F.when(f("has_description"), F.coalesce(f("description"), F.lit("None"))).otherwise("")))
    terms = F.array_except(F.array_distinct(X.every(promise, "[a-z]{4,}")), F.array(*map(F.lit, [w for w in STOP if len(w) >= 4])))
    body = F.lower(f("extracted"))
    unkept = (F.size(terms) > 0) & (n_words > 50) & ~F.exists(terms, lambda t: F.contains(body, t))

    hits = [
        hit("A2_snippet_suppressed", quiet),
        hit("A3_noindex", noindex, role),
        hit("A4_redirect_chain", F.size("redirect_chain") > 2, F.size("redirect_chain")),
        hit("A5_canonical_problem", f("canonical").isNotNull() & (off_site | to_home), f("canonical")),
        hit("A5_canonical_missing", f("canonical").isNull() & role.isin("product", "pricing", "blog")),
        hit("A10_meta_refresh", refresh),
        hit("A11_soft_404", soft, f("title")),
        hit("B1_fact_absent", price_due & (price_tier == 3), role, "price"),
        hit("B1_fact_absent", contact_due & (reach == 3), role, F.when(form_only, "phone/email, form only").otherwise("phone/email"), F.when(form_only, "confirm_intent").otherwise("active")),
        hit("B1_fact_script_only", (price_due & (price_tier == 2)) | (contact_due & (reach == 2)), role),
        hit("B4_empty_shell", (n_words < 30) & (F.size("f.mounts") > 0), F.get(f("mounts"), F.lit(0))),
        hit("C1_structured_data_invalid", f("malformed") > 0, f("malformed")),
        hit("C1_product_markup_absent", (f("malformed") == 0) & (role == "product") & ~F.array_contains(f("types"), "product") & commerce(False).isNotNull()),
        hit("C1_structured_data_absent", (f("malformed") == 0) & ~((role == "product") & ~F.array_contains(f("types"), "product") & commerce(False).isNotNull()) & (F.size("f.nodes") == 0) & role.isin("home", "pricing", "about", "blog"), role),
        hit("C2_markup_text_contradiction", (F.size(shown) > 0) & ~variants & F.exists(declared, lambda v: ~F.array_contains(shown, v)), F.array_join(declared.cast("array<string>"), ", ")),
        hit("C5_faq_content_unmarked", (role != "blog") & (F.size(questions) >= 3) & ~F.arrays_overlap(f("types"), F.array(F.lit("faqpage"), F.lit("question"))), F.size(questions)),
        hit("C6_entity_name_conflict", (role == "home") & org_name.isNotNull() & (f("site_name") != "") & (F.size(one) > 0) & (F.size(two) > 0) & ~F.arrays_overlap(one, two), F.concat_ws(" / ", org_name, f("site_name"))),
        hit("C7_title_problem", f("title") == "", F.when(f("has_title"), "empty <title>").otherwise("no <title>")),
        hit("C7_title_problem", F.lower(f("title")).isin(*GENERIC_TITLES), F.concat(F.lit("generic title '"), f("title"), F.lit("'"))),
        hit("X1_low_quotability", (F.size(fit) > 0) & (F.size(weak) >= F.greatest(F.lit(2), F.floor(F.size(fit) / 3))), F.size(weak)),
        hit("D1_no_date_signals", article & (F.size(days) == 0)),
        hit("D2_stale_copyright", year < F.year("audited_at") - 1, year),
        hit("D3_content_stale", article & (newest > STALE_MONTHS), F.bround(newest).cast("int")),
        hit("E1_form_friction", F.size(heavy) > 0, F.size(heavy)),
        hit("E2_vague_link_text", (F.size("f.anchors") > 0) & (F.size(vague) >= F.greatest(F.lit(3.0), F.size("f.anchors") * 0.15)), F.size(vague)),
        hit("E3_unnamed_controls", F.size(nameless) >= 3, F.size(nameless)),
        hit("E4_images_missing_alt", (F.size("f.images") > 0) & (F.size(blank) >= F.greatest(F.lit(3.0), F.size("f.images") * 0.3)), F.size(blank)),
        hit("E5_no_lang", F.trim(f("lang")) == ""),
        hit("E6_heading_structure", F.size("f.h1") == 0),
        hit("E7_zoom_disabled", zoom_blocked(f("viewport")), f("viewport")),
        hit("E9_promise_payoff_mismatch", unkept, f("title")),
        hit("E10_no_next_step", (role != "legal") & (n_words >= 200) & ~f("onward"), n_words),
        hit("E11_no_viewport", f("viewport").isNull()),
    ]
    return p.select("site_id", "url", F.explode(F.array_compact(F.array(*(h for h in hits if h is not None)))).alias("h")).select("site_id", "url", "h.*")


def noindex_status(hits: DataFrame, totals: DataFrame) -> DataFrame:
    """A3 hits of a site become a question where no key page and at most half of the pages carry them."""
    mine = hits.where("check_id = 'A3_noindex'").groupBy("site_id").agg(F.count("*").alias("n"), F.bool_or(F.col("note").isin(*CONTENT_ROLES)).alias("key_page"))
    asked = mine.join(totals, "site_id").where(~F.col("key_page") & (F.col("n") * 2 <= F.col("total")) & (F.col("n") < F.col("total"))).select("site_id", F.lit("A3_noindex").alias("check_id"), F.lit(True).alias("asked"))
    h = hits.join(asked, ["site_id", "check_id"], "left")
    return h.withColumn("check_id", F.when(F.col("asked"), "A3_noindex_utility").otherwise(F.col("check_id"))).withColumn("status", F.when(F.col("asked"), "confirm_intent").otherwise(F.col("status"))).drop("asked")


def shared_titles(pages: DataFrame) -> DataFrame:
    """C7: one title on three pages of a site or more."""
    t = readable(pages).where((f("title") != "") & ~F.lower(f("title")).isin(*GENERIC_TITLES)).select("site_id", "url", f("title").alias("title"))
    many = t.groupBy("site_id", "title").agg(F.count("*").alias("n")).where(F.col("n") >= SHARED_TITLE)  # and joined back, so that no site is one task
    note = F.concat(F.lit("title '"), F.col("title"), F.lit("' shared by "), F.col("n").cast("string"), F.lit(" pages"))
    return t.join(many, ["site_id", "title"]).select("site_id", "url", F.lit("C7_title_problem").alias("check_id"), F.lit("").alias("key"), note.alias("note"), F.lit("active").alias("status"))


def filler(pages: DataFrame) -> DataFrame:
    """B6: sentences that most pages of a site share make up much of a page. Sentences are counted once a page."""
    p = readable(pages).select("site_id", "url", "role", X.words(f("extracted")).alias("words"), X.sentences(f("extracted")).alias("own"))
    sites = p.groupBy("site_id").agg(F.count("*").alias("n")).where(F.col("n") >= FILLER_PAGES)
    each = p.select("site_id", "url", F.explode(F.array_distinct("own")).alias("s")).groupBy("site_id", "s").agg(F.count("*").alias("pages"))
    common = each.join(sites, "site_id").where(F.col("pages") >= F.greatest(F.lit(2), F.floor(F.col("n") * FILLER_SHARE))).select("site_id", "s")
    long = p.where((F.col("role") != "home") & (F.col("words") >= FILLER_WORDS)).select("site_id", "url", "words", F.explode("own").alias("s"))
    share = long.join(common, ["site_id", "s"], "left_semi").groupBy("site_id", "url", "words").agg((F.sum(X.words(F.col("s"))) / F.col("words")).alias("share"))
    return share.where(F.col("share") > FILLER_TRIGGER).select("site_id", "url", F.lit("B6_filler_heavy").alias("check_id"), F.lit("").alias("key"), F.bround(F.col("share") * 100).cast("int").cast("string").alias("note"), F.lit("active").alias("status"))


def conflicting_prices(pages: DataFrame) -> DataFrame:
    """D4: one item, named by its sku or the like, at different sets of prices on different pages."""
    n = readable(pages).select("site_id", "url", "page_seq", F.explode("f.nodes").alias("n")).where(F.array_contains("n.types", "product"))
    get = lambda k: F.nullif(F.lower(F.trim(F.regexp_replace(F.get_json_object("n.props", f"$.{k}"), r"\s+", " "))), F.lit(""))
    ident = F.coalesce(*(F.when(get(k).isNotNull(), F.concat(F.lit(f"{k}:"), get(k))) for k in ("sku", "gtin", "gtin13", "mpn", "name")))
    raw = F.get_json_object("n.props", "$.offers")
    offers = F.when(raw.startswith("["), F.from_json(raw, "array<struct<price: string, `@type`: string>>")).otherwise(F.array(F.from_json(raw, "struct<price: string, `@type`: string>")))
    price = X.amount(F.col("o.price"))
    items = n.select("site_id", "url", "page_seq", ident.alias("item"), F.explode(offers).alias("o")).where(F.col("item").isNotNull() & ~F.lower(F.coalesce(F.col("o.`@type`"), F.lit(""))).contains("aggregateoffer") & price.isNotNull())
    sets = items.groupBy("site_id", "item", "url", "page_seq").agg(F.array_sort(F.collect_set(price)).alias("prices"))
    bad = sets.groupBy("site_id", "item").agg(F.count("*").alias("n"), F.count_distinct("prices").alias("k"), F.collect_list("url").alias("urls")).where("n > 1 AND k > 1")
    return bad.select("site_id", F.explode("urls").alias("url"), F.lit("D4_internal_contradiction").alias("check_id"), F.lit("").alias("key"), F.col("item").alias("note"), F.lit("active").alias("status"))


def unlabelled(pages: DataFrame) -> DataFrame:
    """E1: fields without a label, one finding per form template (its action and field names)."""
    x = readable(pages).select("site_id", "url", "page_seq", F.explode("f.forms").alias("x"))
    bad = F.filter("x.fields", lambda y: (y["state"] == "unlabelled") | ((y["state"] == "placeholder-only") & y["required"]))
    key = F.concat_ws(",", F.col("x.action"), F.array_sort(F.transform("x.fields", lambda y: y["name"])))
    return x.where(F.size(bad) > 0).select("page_seq", "site_id", "url", F.lit("E1_unlabelled_input").alias("check_id"), key.alias("key"), F.array_join(F.transform(bad, lambda y: y["name"]), ", ").alias("note"), F.lit("active").alias("status")).distinct().drop("page_seq")


def orientation(pages: DataFrame) -> DataFrame:
    """E12: deep pages without title and h1, or three or more under the homepage's h1."""
    p = readable(pages)
    home = (F.col("role") == "home") | (F.regexp_replace("url", "/+$", "") == F.regexp_replace(F.coalesce("start_url", F.lit("")), "/+$", ""))
    h1 = F.coalesce(F.get(f("h1"), F.lit(0)), F.lit(""))
    p = p.select("site_id", "url", home.alias("home"), h1.alias("h1"), f("title").alias("title"), X.words(f("extracted")).alias("words"), "page_seq")
    first = p.where("home AND h1 <> ''").groupBy("site_id").agg(F.min_by("h1", "page_seq").alias("home_h1"))
    deep = p.where("NOT home AND words >= 100").join(first, "site_id", "left")
    same = F.coalesce(F.col("h1") == F.col("home_h1"), F.lit(False))
    deep = deep.withColumn("same", same)
    alike = deep.where("same").groupBy("site_id").agg(F.count("*").alias("n"))
    lost = deep.join(alike, "site_id", "left").where("(title = '' AND h1 = '') OR (same AND n >= 3)")
    return lost.select("site_id", "url", F.lit("E12_no_orientation").alias("check_id"), F.lit("").alias("key"), F.when(F.col("same"), F.col("h1")).otherwise("no title and no h1").alias("note"), F.lit("active").alias("status"))


def broken(pages: DataFrame, sitemap: DataFrame | None = None) -> DataFrame:
    """A9: pages that answer 404, 410 or a server error; a key page among them raises the whole finding."""
    p = pages.where("status IN (404, 410) OR status BETWEEN 500 AND 599")
    keys = p.where(F.col("role").isin(*KEY_ROLES)).select(F.col("site_id").alias("_site"), F.lit(True).alias("has_key")).distinct()
    key = F.coalesce("has_key", F.lit(False))
    p = p.join(keys, F.col("site_id").eqNullSafe(F.col("_site")), "left").drop("_site")  # pages without a site are one
    p = p.withColumn("listed", F.lit(False)) if sitemap is None else p.join(sitemap.select("site_id", F.col("sitemap_url").alias("url"), F.lit(True).alias("listed")).distinct(), ["site_id", "url"], "left")
    note = F.concat_ws(" ", F.concat(F.lit("HTTP "), F.col("status").cast("string")), F.when(F.col("listed"), "(listed in the sitemap)"))
    return p.select("site_id", "url", F.when(key, "A9_key_page_broken").otherwise("A9_broken_pages").alias("check_id"), F.lit("").alias("key"), note.alias("note"), F.lit("active").alias("status"))


def unanchored(pages: DataFrame) -> DataFrame:
    """C3: no page of a site has an organisation with links to other profiles; reported for its home page, or its first."""
    home = F.struct((F.col("role") != "home").cast("int"), F.col("page_seq"))
    g = readable(pages).groupBy("site_id").agg(F.bool_or(anchored()).alias("any"), F.min_by("url", home).alias("url")).where("NOT any")
    return g.select("site_id", "url", F.lit("C3_entity_unanchored").alias("check_id"), F.lit("").alias("key"), F.lit("").alias("note"), F.lit("active").alias("status"))


def all_hits(pages: DataFrame, sitemap: DataFrame | None = None) -> DataFrame:
    totals = readable(pages).groupBy("site_id").agg(F.count("*").alias("total"))
    own = noindex_status(stored(page_hits(pages), "hits"), totals)  # all expressions once, and the hits twice
    for part in (shared_titles, filler, conflicting_prices, unlabelled, orientation, unanchored):
        own = own.unionByName(part(pages))
    return own.unionByName(broken(pages, sitemap))


def findings(hits: DataFrame, totals: DataFrame, more: dict[str, tuple] | None = None) -> DataFrame:
    """Hits by site, check, key and status, with what SPEC (and ``more``, in its form) says of the check.

    ``(site_id, check_id, title, evidence, affected_urls, blast_radius, confidence, measurement_basis, status, effort, coverage_pages)``."""
    spark = hits.sparkSession
    spec = spark.createDataFrame([(k, *v) for k, v in (SPEC | (more or {})).items()], "check_id string, title string, reach string, confidence string, measurement_basis string, effort string")
    g = hits.groupBy("site_id", "check_id", "key", "status").agg(F.array_sort(F.collect_set("url")).alias("affected_urls"), F.array_join(F.slice(F.array_sort(F.collect_set(F.when(F.col("note") != "", F.col("note")))), 1, 3), "; ").alias("sample"))
    g = g.join(F.broadcast(spec), "check_id").join(totals, "site_id", "left").withColumn("n", F.size("affected_urls")).withColumn("total", F.coalesce("total", F.lit(0)))
    r = F.col("reach")
    wide = (
        F.when(r == "all", F.when(F.col("n") >= F.col("total"), "site_wide").otherwise("template"))
        .when(r == "many", F.when(F.col("n") == 1, "single_page").otherwise("template"))
        .when(r == "most", F.when(F.col("n") >= F.col("total") * 0.8, "site_wide").otherwise("template"))
        .otherwise(r)
    )
    title = F.replace(F.col("title"), F.lit("%d"), F.col("n").cast("string"))
    evidence = F.concat_ws(": ", title, F.nullif(F.concat_ws(", ", F.nullif("key", F.lit("")), F.nullif("sample", F.lit(""))), F.lit("")))
    return g.select("site_id", "check_id", title.alias("title"), evidence.alias("evidence"), "affected_urls", wide.alias("blast_radius"), "confidence", "measurement_basis", "status", "effort", F.col("total").alias("coverage_pages"))
