"""Bundles, replays, the gate, quotations, reviewed audits, streams and criteria."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from crawlens.functions import html
from crawlens.operators import conformance, criteria, evaluation, quotes, replay, skips
from crawlens.plans import audit, profiles, reports, reviewed
from crawlens.sources import bundle_source, bundles
from crawlens.streaming import site_state

PAGE = "site_id string, page_seq int, url string, status int, html string, headers map<string,string>"


# --- bundles ------------------------------------------------------------------------------------------------------------
def some_sites(spark, n=3):
    sites = spark.createDataFrame([(f"s{i}.test", f"https://s{i}.test/", "2026-09-12T00:00:00Z", "complete") for i in range(n)], "site_id string, start_url string, audited_at string, run_status string")
    pages = spark.createDataFrame([(f"s{i}.test", k, f"https://s{i}.test/{k}", 200, f"<p>é {k}\n\"quoted\"", {"X-A": "1"}) for i in range(n - 1) for k in range(12)], PAGE)
    return sites, pages


def test_bundles_there_and_back(spark, tmp_path):
    sites, pages = some_sites(spark)
    path = f"file://{tmp_path}/out"
    bundle_source.write(sites, pages.repartition(4), path)
    assert sorted(os.listdir(tmp_path / "out")) == [f"s{i}.test.bundle.json" for i in range(3)]
    text = (tmp_path / "out" / "s0.test.bundle.json").read_text()
    keys = [line.split('"')[1] for line in text.splitlines() if line.startswith(' "')]
    assert keys == sorted(keys) and "é" in text
    rows = bundle_source.read(spark, path)
    back = bundle_source.pages(rows)
    want = sorted((r["site_id"], r["page_seq"], r["url"], r["html"]) for r in pages.collect())
    assert sorted((r["site_id"], r["page_seq"], r["url"], r["html"]) for r in back.collect()) == want
    assert back.head()["headers"] == {"x-a": "1"}
    again = bundles.pages(bundles.bundles(spark, path))  # the JSON reader sees the same
    assert sorted((r["site_id"], r["page_seq"], r["url"], r["html"]) for r in again.collect()) == want
    bundle_source.write(sites, pages, f"file://{tmp_path}/two")
    assert text == (tmp_path / "two" / "s0.test.bundle.json").read_text()


def test_conditions_on_sites_open_few_files(spark, tmp_path):
    sites, pages = some_sites(spark, 5)
    path = f"file://{tmp_path}/out"
    bundle_source.write(sites, pages, path)
    rows = bundle_source.read(spark, path)
    one = rows.where("site_id = 's1.test'")
    assert one.rdd.getNumPartitions() == 1 and one.count() == 13
    assert rows.where("site_id IN ('s1.test', 's2.test') AND page_seq = -1").count() == 2 and rows.where("site_id = 'none'").count() == 0


def test_a_failed_write_leaves_nothing(spark, tmp_path):
    sites, pages = some_sites(spark)
    path = f"file://{tmp_path}/out"
    with pytest.raises(Exception, match="no head"):
        bundle_source.write(sites.limit(1), pages, path)
    assert not os.path.exists(tmp_path / "out") or os.listdir(tmp_path / "out") == []
    bundle_source.write(sites, pages, path)
    before = {n: (tmp_path / "out" / n).read_text() for n in os.listdir(tmp_path / "out")}
    bad = pages.withColumn("page_seq", F.when(F.col("url").endswith("/5"), F.raise_error(F.lit("lost"))).otherwise(F.col("page_seq")))
    with pytest.raises(Exception, match="lost"):
        bundle_source.write(sites, bad, path, "overwrite")
    assert {n: (tmp_path / "out" / n).read_text() for n in os.listdir(tmp_path / "out")} == before
    with pytest.raises(Exception, match="do not lie together|several tasks|have no head"):
        bundle_source.register(spark)
        bundle_source.laid_out(sites, pages).repartition(7).write.format(bundle_source.NAME).mode("append").save(path)
    bundle_source.write(sites.limit(1), pages.where("site_id = 's0.test' AND page_seq < 2"), path, "overwrite")
    assert os.listdir(tmp_path / "out") == ["s0.test.bundle.json"]


# --- replays ------------------------------------------------------------------------------------------------------------
def shuffled(rng, x):
    if isinstance(x, dict):
        items = list(x.items())
        rng.shuffle(items)
        return {k: shuffled(rng, v) for k, v in items}
    return [shuffled(rng, v) for v in x] if isinstance(x, list) else x


def made(rng, depth):
    if depth == 0 or rng.random() < 0.2:
        return rng.choice([None, True, 1, 1.5, "x", "é", "", {}, []])
    if rng.random() < 0.5:
        return {rng.choice("abcdefgh") + str(i): made(rng, depth - 1) for i in range(rng.randint(1, 4))}
    return [made(rng, depth - 1) for _ in range(rng.randint(1, 4))]


def leaves(x, path="$"):
    if isinstance(x, dict) and x:
        return [y for k, v in x.items() for y in leaves(v, f"{path}.{k}")]
    if isinstance(x, list) and x:
        return [y for i, v in enumerate(x) for y in leaves(v, f"{path}[{i}]")]
    return [(path, json.dumps(x, ensure_ascii=False))]


def test_documents_are_equal_whatever_the_order_of_keys(spark):
    rng = random.Random(4)
    docs = [made(rng, 6) for _ in range(60)] + [{"a": [{"b": {"c": [1, {"d": 2}]}}]}]
    other = [shuffled(rng, d) if i % 3 else made(rng, 6) for i, d in enumerate(docs)]
    df = lambda xs: spark.createDataFrame([(i, json.dumps(x)) for i, x in enumerate(xs)], "id int, d string")
    got = {r["id"]: r["equal"] for r in replay.equal(df(docs), df(other), "id", "d").collect()}
    same = lambda a, b: sorted(map(repr, leaves(a))) == sorted(map(repr, leaves(b)))
    assert got == {i: same(a, b) for i, (a, b) in enumerate(zip(docs, other))}
    diff = {(r["id"], r["path"]): (r["one"], r["two"]) for r in replay.differences(df(docs), df(other), "id", "d").collect()}
    want = {}
    for i, (a, b) in enumerate(zip(docs, other)):
        x, y = dict(leaves(a)), dict(leaves(b))
        want |= {(i, p): (x.get(p), y.get(p)) for p in x.keys() | y.keys() if x.get(p) != y.get(p)}
    assert diff == want


def test_one_changed_leaf_is_named(spark):
    a, b = '{"x": {"y": [1, {"z": "old"}]}, "k": null}', '{"k": null, "x": {"y": [1, {"z": "new"}]}}'
    df = lambda *xs: spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "id int, d string")
    assert [tuple(r) for r in replay.differences(df(a, a, None, "{"), df(b, a, "1", "{"), "id", "d").orderBy("id").collect()] == [(0, "$.x.y[1].z", '"old"', '"new"'), (2, "$", None, "1")]
    assert len(replay.tree('{"a":' * 900 + "1" + "}" * 900)) == 901 and len(replay.tree("[" * 100_000)) == 1


# --- the gate -----------------------------------------------------------------------------------------------------------
@pytest.fixture(scope="module")
def report(spark):
    body = "<html><title>Some title</title><h1>H</h1><p>text</p></html>"
    p = spark.createDataFrame([(s, i, f"https://{s}/{i}", f"https://{s}/{i}", 200, body, {}, [], f"https://{s}/") for s in ("a.test", "b.test") for i in range(3)], "site_id string, page_seq long, url string, final_url string, status int, html string, headers map<string,string>, redirect_chain array<string>, start_url string")
    p = audit.prepared(p.withColumn("audited_at", F.to_timestamp(F.lit("2026-09-12 00:00:00")))).cache()
    found = audit.graded_findings(p).cache()
    sites = reports.stored_sites(p)
    return p, found, reports.full(sites, found, skips.skipped(p), audit.proactive(p, found, sites)).cache()


def test_whole_reports(report):
    p, found, full = report
    r = full.where("site_id = 'a.test'").head()
    assert json.loads(r["site_profile"])["pages_crawled"] == 3 and json.loads(r["coverage"])["pages_ok"] == 3 and r["run_status"] == "complete"
    assert [x["check"] for x in json.loads(r["checks_skipped"])] == sorted(x["check"] for x in json.loads(r["checks_skipped"])) and len(json.loads(r["checks_skipped"])) == 7
    assert len(json.loads(r["proactive_recommendations"])) + len(json.loads(r["already_in_place"])) == 7 and json.loads(r["agent_review"]) == {"status": "not_run"}
    assert len(json.loads(r["findings"])) == r["total_findings"] > 0


def test_the_gate(spark, report, tmp_path):
    _, _, full = report
    assert conformance.breaches(full).count() == 0
    counts = conformance.gate(full, f"file://{tmp_path}/r")
    assert counts["reports"] == 2 and sum(counts.values()) == 2 and spark.read.json(f"file://{tmp_path}/r").count() == 2
    on = lambda c, v: full.withColumn(c, F.when(F.col("site_id") == "a.test", v).otherwise(F.col(c)))
    broken = {
        "low": (F.col("low") + 1, {"low_matches", "severities_add_up"}), "audited_at": (F.lit(None).cast("string"), {"audited_at_is_a_time"}), "active_medium": (F.lit(99), {"active_medium_matches"}),
        "findings": (F.regexp_replace("findings", '"id":"F-001"', '"id":"F-007"'), {"ids_are_in_order"}),
    }
    for column, (value, names) in broken.items():
        assert {(r["site_id"], r["problem"]) for r in conformance.breaches(on(column, value)).collect()} == {("a.test", n) for n in names}
    worse = on("findings", F.regexp_replace("findings", '"status":"active"', '"status":"odd"'))
    assert {"statuses_are_known", "active_matches"} <= {r["problem"] for r in conformance.breaches(worse).collect()}
    other = on("headline", F.lit("another"))
    assert [tuple(r) for r in conformance.unreplayable(full, other).collect()] == [("a.test", "replay_not_deterministic")] and conformance.unreplayable(full, full).count() == 0


# --- profiles -----------------------------------------------------------------------------------------------------------
def test_profiles_keep_null_and_missing_apart(spark):
    head = '<title> A  title </title><meta name=description content="d"><meta property="og:title" content="o"><meta name=GoogleBot content="noindex"><link rel="alternate" hreflang=de href="/de"><link rel=canonical href="x">'
    body = '<h1>One</h1><h1>Two</h1><a href="/in">i</a><a href="https://o.test/f.PDF">o</a><a href="tel:1">t</a><a href="#x">x</a><form action=/f><input required><input type=password><input type=hidden></form><img><img alt=a><iframe src=q></iframe><noscript>a b c</noscript>'
    ld = '<script type="application/ld+json">{"@type":"Product","name":"P","offers":[{"price":1,"priceCurrency":"EUR"},{"price":"2"}]}</script>'
    rows = [("s", 0, "https://s.test/a/b", 200, f"<html lang=en>{head}{body}{ld}</html>", {"x-robots-tag": "none"}), ("s", 1, "https://s.test/gone", 404, None, {})]
    p = spark.createDataFrame(rows, PAGE).withColumns({"final_url": F.col("url"), "role": F.lit("product"), "redirect_chain": F.array(F.lit("r"))})
    made = profiles.pages(html.parsed(p)).cache()
    ask = ["title", "meta.og:title", "meta.og:type", "canonical", "meta_refresh", "h1.1", "h1.2", "links.pdf.0", "links.internal", "links.tel", "forms.0.fields", "forms.0.has_password", "images.missing_alt", "jsonld.offers.1.price", "robots_directives", "hreflang.0.href", "noscript_words", "redirect_hops", "title.x"]
    got = {(r["page_seq"], r["path"]): (r["x"]["found"], r["x"]["value"]) for r in made.withColumn("path", F.explode(F.array(*map(F.lit, ask)))).select("page_seq", "path", profiles.field(F.col("profile"), F.col("path")).alias("x")).collect()}
    want = {
        "title": "A title", "meta.og:title": "o", "canonical": "https://s.test/a/x", "h1.1": "Two", "links.pdf.0": "https://o.test/f.PDF", "links.internal": "1", "links.tel": "1", "forms.0.fields": "2", "forms.0.has_password": "true", "images.missing_alt": "1",
        "jsonld.offers.1.price": "2", "robots_directives": '["x-robots-tag: none","googlebot: noindex"]', "hreflang.0.href": "https://s.test/de", "noscript_words": "3", "redirect_hops": "1", "meta_refresh": None,
    }
    assert {k: v for (i, k), (found, v) in got.items() if i == 0 and found} == want
    assert {k: v for (i, k), (found, v) in got.items() if i == 1 and found} == {"redirect_hops": "1"}


# --- quotations and reviews ---------------------------------------------------------------------------------------------
def test_quotations_are_found_where_they_stand(spark):
    rng = random.Random(9)
    texts = [(s, f"u{i}", kind, "".join(rng.choice("abc é") for _ in range(rng.randint(0, 60)))) for s in "xy" for i in range(12) for kind in ("html", "full")]
    asked = [(s, kind, t[a : a + n]) for s, _, kind, t in texts for a, n in ((0, 1), (2, 2), (1, 4), (3, 9))] + [("x", "html", "zzzz"), ("z", "html", "abc"), ("x", "full", "")]
    got = quotes.places(spark.createDataFrame(asked, "site_id string, kind string, quote string"), spark.createDataFrame(texts, "site_id string, url string, kind string, text string"))
    want = {(s, kind, q, u) for s, kind, q in asked if q for s2, u, k2, t in texts if s == s2 and kind == k2 and q in t}
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want


def test_a_review_in_an_audit(spark, report):
    p, found, _ = report
    texts = reviewed.page_texts(p, p.select("site_id", "url", F.lit("<p>text</p><i>only here</i>").alias("html"))).withColumn("full", F.when(F.col("url").endswith("/0"), "some title one special remark").otherwise(F.col("full")))
    ev = lambda **k: [tuple(dict(url="https://a.test/0", **k).get(c) for c in ("url", "type", "value", "scope", "header", "path", "op"))]
    act = ("Say it sooner", ["Do it"], "Look at the page", "low")
    claim = lambda n, title, near, e: ("a.test", n, title, "A long enough reason to state here", "on-site", "ai_discoverability", "high", near, ["https://a.test/0"], e, act)
    rows = [claim(1, "One remark is special", None, ev(type="text_contains", value="special  REMARK", scope="full")), claim(2, "No viewport on phones", "E11_no_viewport", ev(type="text_contains", value="special remark", scope="full")), claim(3, "Two headings at once", None, ev(type="field", path="h1.0", op="eq", value="h")), claim(4, "Too many images", None, ev(type="field", path="images.total", op="gt", value="3"))]
    c = spark.createDataFrame(rows, f"site_id string, claim int, title string, why string, mechanism string, hurts string, severity string, nearest_check string, affected_urls array<string>, evidence {bundles.EVIDENCE}, suggested_action {bundles.ACTION}")
    judged = reviewed.judged_claims(c, reviewed.tested(c, p, texts), texts, found).cache()
    why = {r["claim"]: r["rejected_reason"] for r in judged.collect()}
    assert why[1] is None and why[2].startswith("duplicates scripted check E11_no_viewport") and why[3] == "evidence is true of every page" and why[4] == "evidence does not hold"
    totals = spark.createDataFrame([("a.test", 3), ("b.test", 3)], "site_id string, total int")
    verdicts = found.where("check_id = 'E11_no_viewport' AND site_id = 'a.test'").select("site_id", F.lit(1).alias("n"), "check_id", F.col("id").alias("finding_id"), F.lit("confirm_intent").alias("verdict"), F.lit("deliberate_configuration").alias("reason"), F.array().cast("array<string>").alias("urls"), F.lit(None).cast("string").alias("rejected_reason"), F.lit("confirm_intent").alias("effect"))
    after = {(r["site_id"], r["check_id"]): r for r in reviewed.reviewed(found, judged, totals, verdicts).collect()}
    before = {(r["site_id"], r["check_id"]): r for r in found.collect()}
    assert set(after) - set(before) == {("a.test", "R_agent_review")} and after["a.test", "R_agent_review"]["severity"] == "low" and after["a.test", "R_agent_review"]["hurts"] == "ai_discoverability"
    assert after["a.test", "E11_no_viewport"]["status"] == "confirm_intent" and after["a.test", "E11_no_viewport"]["severity"] == "low" and after["b.test", "E11_no_viewport"]["severity"] == before["b.test", "E11_no_viewport"]["severity"]
    assert sorted(r["rank"] for k, r in after.items() if k[0] == "a.test") == list(range(1, len([k for k in after if k[0] == "a.test"]) + 1))
    told = json.loads(reviewed.summary(judged, verdicts).head()["agent_review"])
    assert (told["claims_submitted"], told["verified"], told["merged"], told["verdicts_applied"]) == (4, 2, 1, 1) and [x["claim"] for x in told["rejected"]] == [2, 3, 4]


def test_labels_of_links_give_roles_and_challenges_are_no_pages(spark):
    rows = [("t.test", 0, "https://t.test/", "<title>T</title><a href='/zz'>Plans and pricing</a>"), ("t.test", 1, "https://t.test/zz", "<title>Something</title>"), ("t.test", 2, "https://t.test/wall", "<title>Just a moment...</title><p>x</p>")]
    p = spark.createDataFrame(rows, "site_id string, page_seq long, url string, html string").withColumn("final_url", F.col("url"))
    got = {r["url"]: (r["role"], r["error"], r["f"] is None) for r in audit.prepared(p).collect()}
    assert got == {"https://t.test/": ("home", None, False), "https://t.test/zz": ("pricing", None, False), "https://t.test/wall": ("generic", "bot_challenge:unrecognised vendor", True)}


# --- streams ------------------------------------------------------------------------------------------------------------
@pytest.mark.parametrize("files, delay, by", [(3, "60 days", "hash"), (5, "1 minute", "time")])
def test_a_stream_gives_what_the_table_gives(spark, tmp_path, files, delay, by):
    rng = random.Random(files)
    rows = [(s, i, rng.choice([503, 503, 200, 404]), 1_700_000_000 + 60 * i + s) for s in range(6) for i in range(rng.randint(1, 40))]
    e = spark.createDataFrame(rows, "site_id long, page_seq long, status int, t long").select("site_id", "page_seq", "status", F.timestamp_seconds("t").alias("at"))
    twice = e.unionByName(e.where("page_seq % 3 = 0"))
    (twice.repartition(files) if by == "hash" else twice.repartitionByRange(files, "at")).sortWithinPartitions("at").write.parquet(f"{tmp_path}/in")
    site_state.use_rocksdb(spark)
    source = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(f"{tmp_path}/in")
    q = site_state.latest(site_state.states(source, delay), f"file://{tmp_path}/out", f"file://{tmp_path}/ck")
    q.awaitTermination()
    got = {r["site_id"]: (r["longest"], r["pages"], r["ok"]) for r in site_state.newest(spark, f"file://{tmp_path}/out").collect()}
    longest = {r["site_id"]: r["longest"] for r in evaluation.consecutive(e).collect()}
    assert got == {s: (longest.get(s, 0), sum(r[0] == s for r in rows), sum(r[0] == s and r[2] == 200 for r in rows)) for s in {r[0] for r in rows}}


# --- criteria -----------------------------------------------------------------------------------------------------------
def test_criteria_and_views(spark):
    o = spark.createDataFrame([("d", "s1", "A", "removed"), ("d", "s2", "B", "kept"), ("h", "s3", "A", "reduced"), ("r", "s1", "A", "removed"), ("r", "s2", "B", "reduced")], "tag string, slug string, check_id string, outcome string")
    t = spark.createDataFrame([("dev", "knowable_false", "s1", "A"), ("dev", "strict_true", "s2", "B"), ("held", "reduce", "s3", "A"), ("held", "keep", "s4", "A")], "part string, kind string, slug string, check_id string")
    r = spark.createDataFrame([("d", "s1", 100.0, 5, 5, True), ("h", "s3", 230.0, 5, 4, True)], "tag string, slug string, wall_s double, submitted int, applied int, valid boolean")
    f = spark.createDataFrame([("s", "F-001", "A", "high", "active", "both", "t"), ("s", "F-002", "B", "low", "latent", "both", "t"), ("u", "F-001", "A", "high", "active", "user_retention", "t")], "site_id string, id string, check_id string, severity string, status string, hurts string, title string")
    v = spark.createDataFrame([("s", "F-002", "correct")], "site_id string, id string, verdict string")
    criteria.register(spark, outcomes=o, truth=t, runs=r, findings=f, verdicts=v)
    got = {x["criterion"]: (x["reached"], x["passed"]) for x in spark.sql("SELECT * FROM criteria(held => 'h', dev => 'd', rep => 'r')").collect()}
    assert got == {"catch": (1.0, False), "keep": (0.0, True), "unknowable": (0.0, True), "held_out": (0.5, False), "stability": (0.5, False), "acceptance": (0.9, True), "runtime": (165.0, True), "valid": (0.0, True)}
    assert "stability" not in {x["criterion"] for x in spark.sql("SELECT * FROM criteria(dev => 'd', held => 'h')").collect()}
    assert {(x["site_id"], x["id"]) for x in spark.sql("SELECT * FROM shown_findings(hurts => 'both', status => 'active')").collect()} == {("s", "F-001")}
    assert spark.sql("SELECT * FROM shown_findings()").count() == 3
    assert {(x["id"], x["verdict"]) for x in spark.sql("SELECT * FROM verdict_export(site => 's')").collect()} == {("F-001", "unjudged"), ("F-002", "correct")}
