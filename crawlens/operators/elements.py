"""Questions about elements as joins within a page: what stands inside of what, refers to what, and comes first. Equal to the facts of the one pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from crawlens.functions import urls as U
from crawlens.functions.elements import TEXT, attr, inside, same_page, texts, without
from crawlens.functions.html import BOUND, LEAD_WORDS
from crawlens.functions.tree import SIDE
from crawlens.operators import checks

KEYS = ("site_id", "page_seq")


def _live(table: DataFrame) -> DataFrame:
    """Elements that are no part of a template."""
    return without(table.where((F.col("tag") != TEXT) & (F.col("tag") != "template")), table.where("tag = 'template'"))


def canonical(table: DataFrame) -> DataFrame:
    """``(site_id, page_seq, canonical)``: the first link with that relation and an address."""
    links = table.where((F.col("tag") == "link") & F.col("attrs")["href"].isNotNull() & F.array_contains(F.split(F.lower(attr("rel")), r"\s+"), "canonical"))
    first = links.groupBy(*KEYS).agg(F.min_by(F.trim(attr("href")), "at").alias("canonical"))
    return first.where("canonical <> ''")


def content_anchors(table: DataFrame) -> DataFrame:
    """Live links with an address that no navigation, header, footer or aside holds."""
    return without(_live(table).where((F.col("tag") == "a") & (attr("href") != "")), table.where(F.col("tag").isin(*SIDE)))


def contact_links(table: DataFrame, pages: DataFrame) -> DataFrame:
    """``(site_id, page_seq, url, onward)``: different contact pages, the page itself apart, that a page's content links to; a page with few that is named for contact is one. ``pages(site_id, page_seq, url)``."""
    bare = lambda url: F.regexp_replace(U.path(url), "/+$", "")
    to = content_anchors(table).where(U.path(attr("href")).rlike(checks.CONTACT_LEAF)).select(*KEYS, bare(attr("href")).alias("to"))
    far = to.join(pages.select(*KEYS, bare(F.col("url")).alias("own")), list(KEYS)).where("to <> own").groupBy(*KEYS).agg(F.count_distinct("to").alias("onward"))
    return pages.select(*KEYS, "url").join(far, list(KEYS), "left").withColumn("onward", F.coalesce("onward", F.lit(0).cast("long")))


def contact_pages(table: DataFrame, pages: DataFrame) -> DataFrame:
    return contact_links(table, pages).where(U.leaf(F.col("url")).rlike(checks.CONTACT_LEAF) & (F.col("onward") < checks.HUB_LINKS)).select(*KEYS)


def hidden_content(table: DataFrame) -> DataFrame:
    """``(site_id, page_seq)``: pages where an element that asks for no snippet is, holds or stands around the main part, the first heading or the first long paragraph."""
    asks = table.where(F.col("attrs")["data-nosnippet"].isNotNull())
    paragraphs = table.where("tag = 'p'")
    long = texts(table, paragraphs).where(F.size(F.split("shown", r"(?U)\s+")) >= LEAD_WORDS)
    lead = long.groupBy(*KEYS).agg(F.min("at").alias("at")).withColumn("own", F.lit(True))
    marks = table.where("tag IN ('main', 'article', 'h1')").select(*KEYS, "at", F.col("tag").isin("main", "article").alias("own"))
    marks = marks.unionByName(lead)
    held = asks.alias("y").join(marks.alias("x"), same_page("x", "y") & (inside("x", "y") | (F.col("x.own") & (F.col("x.at") == F.col("y.at")))))
    return held.select("y.site_id", "y.page_seq").distinct()


def _ids(table: DataFrame) -> DataFrame:
    """The first live element of each id."""
    return _live(table).where(attr("id") != "").groupBy(*KEYS, attr("id").alias("id")).agg(F.min("at").alias("at"))


def referred(table: DataFrame, of: DataFrame) -> DataFrame:
    """``(site_id, page_seq, at, said)``: what the elements say that ``aria-labelledby`` of others names, in the order named."""
    wanted = of.where(F.trim(attr("aria-labelledby")) != "").select(*KEYS, F.col("at").alias("from"), F.posexplode(F.split(F.trim(attr("aria-labelledby")), r"\s+")).alias("turn", "id"))
    met = wanted.join(_ids(table), [*KEYS, "id"])
    named = table.join(met.select(*KEYS, "at").distinct(), [*KEYS, "at"], "left_semi")
    said = met.join(texts(table, named), [*KEYS, "at"])
    order = F.array_sort(F.collect_list(F.struct("turn", "shown")))
    return said.groupBy(*KEYS, F.col("from").alias("at")).agg(F.array_join(F.transform(order, lambda x: x["shown"]), " ").alias("said"))


def _first_inside(of: DataFrame, some: DataFrame, value: Column, name: str) -> DataFrame:
    """``(site_id, page_seq, at, name)``: the value of the first of ``some`` inside of each node."""
    x = some.select(*KEYS, "at", value.alias(name)).alias("x")
    held = of.select(*KEYS, "at", "until").alias("y").join(x, same_page("x", "y") & inside("x", "y"))
    return held.groupBy("y.site_id", "y.page_seq", "y.at").agg(F.min_by(f"x.{name}", "x.at").alias(name))


def controls(table: DataFrame) -> DataFrame:
    """Buttons, links and pressable inputs whose name no framework binds and that are not taken out of sight or order."""
    kind = F.lower(attr("type"))
    is_one = (F.col("tag") == "button") | ((F.col("tag") == "a") & (attr("href") != "")) | ((F.col("tag") == "input") & kind.isin("submit", "button", "image"))
    bound = F.exists(F.map_keys("attrs"), lambda k: _any(k.startswith(b) for b in BOUND))
    away = (F.lower(attr("aria-hidden")) == "true") | (F.trim(attr("tabindex")) == "-1")
    return _live(table).where(is_one & ~bound & ~away)


def _any(conditions) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return out


def names(table: DataFrame, of: DataFrame) -> DataFrame:
    """``(site_id, page_seq, at, tag, name)``: what assistive technology calls each element, empty if nothing.

    In this order: its own label or title, what it refers to, an input's value, the first picture's text, the first caption, the first labelled part, its text.
    """
    said = lambda c: F.nullif(F.trim(c), F.lit(""))
    elements = table.where(F.col("tag") != TEXT)
    captions = table.where("tag = 'title'")
    captions = captions.join(texts(table, captions).withColumnRenamed("shown", "caption"), [*KEYS, "at"], "left")
    out = of
    for part in (
        referred(table, of),
        _first_inside(of, elements.where("tag = 'img'"), attr("alt"), "picture"),
        _first_inside(of, captions, F.coalesce("caption", F.lit("")), "titled"),
        _first_inside(of, elements.where(F.col("attrs")["aria-label"].isNotNull()), attr("aria-label"), "part"),
        texts(table, of).withColumnRenamed("shown", "own"),
    ):
        out = out.join(part, [*KEYS, "at"], "left")
    value = F.when(F.col("tag") == "input", said(attr("value")))
    name = F.coalesce(said(attr("aria-label")), said(attr("title")), said(F.col("said")), value, said(F.col("picture")), said(F.col("titled")), said(F.col("part")), said(F.col("own")), F.lit(""))
    return out.select(*KEYS, "at", "tag", name.alias("name"))


def label_states(table: DataFrame) -> DataFrame:
    """``(site_id, page_seq, form, at, state)`` of the fields of live forms: labelled by an attribute, a reference, a label for it or around it; else only a placeholder, or nothing."""
    forms = _live(table).where("tag = 'form'").select(*KEYS, F.col("at"), "until")
    fields = table.where(F.col("tag").isin("input", "select", "textarea") & ~F.lower(attr("type")).isin("hidden", "submit", "button", "image", "reset"))
    held = fields.alias("x").join(forms.alias("y"), same_page("x", "y") & inside("x", "y")).select("x.*", F.col("y.at").alias("form"))
    labels = table.where("tag = 'label'")
    targets = _live(table).where((F.col("tag") == "label") & (attr("for") != "")).select(*KEYS, attr("for").alias("id")).distinct().withColumn("aimed", F.lit(True))
    around = fields.alias("x").join(labels.select(*KEYS, "at", "until").alias("y"), same_page("x", "y") & inside("x", "y"), "left_semi").select(*KEYS, "at").withColumn("held", F.lit(True))
    said = referred(table, fields).where("trim(said) <> ''").select(*KEYS, "at", F.lit(True).alias("told"))
    f = held.withColumn("id", attr("id")).join(targets, [*KEYS, "id"], "left").join(around, [*KEYS, "at"], "left").join(said, [*KEYS, "at"], "left")
    known = (F.trim(attr("aria-label")) != "") | (F.trim(attr("title")) != "") | F.col("aimed").isNotNull() | F.col("held").isNotNull() | F.col("told").isNotNull()
    return f.select(*KEYS, "form", "at", F.when(known, "labelled").when(F.trim(attr("placeholder")) != "", "placeholder-only").otherwise("unlabelled").alias("state"))


def homepage_links(table: DataFrame, pages: DataFrame) -> DataFrame:
    """``(site_id, target, label)``: pages of the same site that home pages link to, with the first label. ``pages(site_id, page_seq, final_url, role)``."""
    from crawlens.operators import crawl

    home = pages.where("role = 'home'").select(*KEYS, "final_url")
    anchors = _live(table).where((F.col("tag") == "a") & (attr("href") != "")).join(home, list(KEYS))
    shown = anchors.join(texts(table, anchors), [*KEYS, "at"], "left").select("site_id", "final_url", F.struct("page_seq", "at").alias("at"), attr("href").alias("href"), F.coalesce("shown", F.lit("")).alias("label"))
    return crawl.linked(shown)
