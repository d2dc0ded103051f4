"""URL expressions: hosts, paths, normal forms, and the role a page's address gives away."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# File types that are never pages, sitemap addresses, roles by path, and the words of a role.
ASSET = r"(?i)\.(css|m?js|json|xml|rss|atom|txt|ico|png|jpe?g|gif|svg|webp|avif|bmp|woff2?|ttf|otf|eot|mp4|webm|mov|mp3|wav|zip|gz|pdf)$"
SITEMAP = r"(?i)\.xml(\.gz)?$|sitemap[^/]*\.xml"
ROLE_PATHS = (
    ("pricing", r"(?i)/(pricing|plans?|subscribe|buy)(/|$|\?)"),
    ("contact", r"(?i)/(contact|contact-us|get-in-touch)(/|$|\?)"),
    ("product", r"(?i)/(products?|items?|shop|store|p)/"),
    ("about", r"(?i)/(about|company|who-we-are|our-story)(/|$|\?)"),
    ("blog", r"(?i)/(blog|news|articles?|insights|press)(/|$)"),
    ("legal", r"(?i)/(privacy|terms|legal|cookies?|imprint|impressum|datenschutz|agb|gdpr)(-(policy|notice|statement|of-service|of-use|and-conditions|conditions|settings|preferences|information))?(/|$|\?)"),
    ("search", r"(?i)/(search|results?|recherche)(/|$|\?)|[?&](q|s|query)="),
    ("utility", r"(?i)/(log-?in|sign-?in|sign-?up|register|account|cart|basket|checkout|preview|thank-?you|thanks|unsubscribe|print|amp|404|error|sitemap)(/|$|\?)"),
)
ROLE_WORDS = (
    ("pricing", ("pricing", "prices", "price", "plans", "plan", "subscribe", "subscriptions", "buy", "preise", "tarifs", "tarifas", "precios", "prezzi", "prijzen", "priser", "cennik", "precos")),
    ("contact", ("contact", "kontakt", "contacto", "contatti", "contato", "contactez", "touch")),
    ("about", ("about", "company", "story", "who", "über", "ueber", "nosotros", "somos", "siamo", "sommes")),
)
CONNECTORS = ("and", "our", "us", "the", "we", "are", "get", "in", "sales", "team", "nous", "uns", "quienes", "chi", "qui", "de", "la", "le", "page")
TITLE_PARTS = r"\s[|–—·:-]\s"
PRIORITY_ROLES = ("pricing", "contact", "about", "product")


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))


def host(url: Column) -> Column:
    """Between ``//`` and the path, in small letters; empty if there is none."""
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))


def bare_host(url: Column) -> Column:
    """The host without a leading ``www.``: the two are one site."""
    return F.regexp_replace(host(url), r"^www\.", "")


def path(url: Column) -> Column:
    return F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)?([^?#]*)", 1)


def query_string(url: Column) -> Column:
    return F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)


def normalised(url: Column) -> Column:
    """Small-letter host, no parameters or fragment, no closing slash; the query string stays."""
    p = F.regexp_replace(path(url), r";[^/]*$", "")
    p = F.when(p == "", "/").when((F.length(p) > 1) & p.endswith("/"), p.substr(F.lit(1), F.length(p) - 1)).otherwise(p)
    q = query_string(url)
    return F.concat(scheme(url), F.lit("://"), host(url), p, F.when(q != "", F.concat(F.lit("?"), q)).otherwise(""))


def is_root(url: Column) -> Column:
    return path(url).isin("", "/")


def is_asset(url: Column) -> Column:
    return path(url).rlike(ASSET)


def is_sitemap(url: Column) -> Column:
    return path(url).rlike(SITEMAP)


def leaf(url: Column) -> Column:
    return F.element_at(F.split(F.regexp_replace(path(url), "/+$", ""), "/"), -1)


def role_of_words(label: Column) -> Column:
    """The role that a label names: every word belongs to it or connects, and one belongs to it; else null."""
    tokens = F.array_distinct(F.regexp_extract_all(F.lower(label), F.lit(r"[\p{L}\p{M}]+"), F.lit(0)))
    found = F.lit(None).cast("string")
    for role, words in reversed(ROLE_WORDS):
        own = F.array(*map(F.lit, words))
        near = F.array(*map(F.lit, words + CONNECTORS))
        found = F.when(F.arrays_overlap(tokens, own) & (F.size(F.array_except(tokens, near)) == 0), role).otherwise(found)
    return found


def role(url: Column, title: Column | None = None, anchor: Column | None = None) -> Column:
    """From the address, then its last segment's words, the title's parts and the label of the link to it."""
    labels = F.array(F.regexp_replace(leaf(url), "[-_]", " "))
    if title is not None:
        labels = F.concat(labels, F.split(F.coalesce(title, F.lit("")), TITLE_PARTS))
    if anchor is not None:
        labels = F.concat(labels, F.array(F.coalesce(anchor, F.lit(""))))
    by_words = F.get(F.filter(F.transform(labels, role_of_words), lambda x: x.isNotNull()), F.lit(0))
    out = F.when(is_root(url), "home")
    for name, pattern in ROLE_PATHS:
        out = out.when(url.rlike(pattern), name)
    return out.otherwise(F.coalesce(by_words, F.lit("generic")))
