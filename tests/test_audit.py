"""The audit engine over built pages: recognisers, robots, checks, severity, claims and reports."""

import json

import pytest
from pyspark.sql import functions as F

from crawlens.functions import html, text as X, urls as U
from crawlens.operators import checks, claims, evaluation, robots, severity
from crawlens.plans import audit
from crawlens.sources import bundles


def page(url, body="", role=None, status=200, head="<title>A page about things</title><meta name=viewport content='width=device-width'>", lang="en", headers=None, chain=(), site="t.test", seq=0):
    return {"site_id": site, "page_seq": seq, "url": url, "final_url": url, "status": status, "role": role or "generic", "html": f'<html lang="{lang}"><head>{head}</head><body><h1>Heading</h1>{body}</body></html>' if status == 200 else None, "headers": headers or {}, "redirect_chain": list(chain), "start_url": f"https://{site}/", "audited_at": "2026-09-12 00:00:00"}


SCHEMA = "site_id string, page_seq long, url string, final_url string, status int, role string, html string, headers map<string,string>, redirect_chain array<string>, start_url string, audited_at string"


@pytest.fixture
def crawl(spark):
    def make(*pages):
        rows = [dict(p, page_seq=i) for i, p in enumerate(pages)]
        df = spark.createDataFrame([tuple(r[c.split()[0]] for c in SCHEMA.split(", ")) for r in rows], SCHEMA)
        return html.parsed(df.withColumn("audited_at", F.to_timestamp("audited_at")))

    return make


def fired(parsed):
    out = {}
    for r in checks.all_hits(parsed).collect():
        out.setdefault(r["check_id"], set()).add(r["url"])
    return out


def ld(data):
    return f'<script type="application/ld+json">{json.dumps(data)}</script>'


def test_amounts_prices_phones_addresses(spark):
    of = lambda fn, xs: [r[1] for r in spark.createDataFrame([(x,) for x in xs], "a string").select("a", fn(F.col("a")).alias("v")).collect()]
    assert of(X.amount, ["1.299,00", "1,299.00", "49,00", "1.299", "1,29,999", "x"]) == [1299.0, 1299.0, 49.0, 1299.0, 129999.0, None]
    assert [bool(p) for p in of(X.price, ["Nur 49,00 €", "CHF 49", "Rs. 499", "49 kr", "20 ft", "1 299 €"])] == [True] * 4 + [False, True]
    assert of(X.prices, ["Article No. 700403 ₹3,990.00"]) == [[3990.0, 700403.0]]
    assert of(X.phone, ["+44 20 7946 0958", "555-0100", "© 2025 2026", "100012345", "1200 546", "2026-01-02"]) == ["+44 20 7946 0958", "555-0100", None, None, None, None]
    assert of(X.email, ["hello@acme.co.uk", "logo@2x.png", "@django@fosstodon.org"]) == ["hello@acme.co.uk", None, None]
    assert of(X.http_day, ["Wed, 09 Sep 2026 11:04:24 GMT", "soon"]) == ["2026-09-09", None]
    assert of(X.name_tokens, ["Acme Robotics, Inc."]) == [["acme", "robotics"]]


def test_urls_and_roles(spark):
    rows = [("https://A.test/x/", "", "https://a.test/x"), ("http://a.test", "", "http://a.test/"), ("https://a.test/p;v=1?q=2#top", "", "https://a.test/p?q=2")]
    assert [r[0] == r[1] for r in spark.createDataFrame(rows, "u string, t string, n string").select(U.normalised(F.col("u")), "n").collect()] == [True] * 3
    roles = {"/plans-and-pricing": "pricing", "/preise": "pricing", "/support/contact-sales": "contact", "/how-to-buy-a-house": "generic", "/blog/x": "blog", "/privacy-policy": "legal", "/cookieless-web-analytics": "generic", "/shop/x": "product", "/": "home", "/über-uns": "about"}
    d = spark.createDataFrame([(f"https://a.test{p}", "", r) for p, r in roles.items()] + [("https://a.test/zz", "Plans & Pricing | Acme", "pricing")], "u string, t string, r string")
    assert [(x["g"], x["r"]) for x in d.select(U.role(F.col("u"), F.col("t")).alias("g"), "r").collect() if x["g"] != x["r"]] == []


def test_structured_data():
    root = html.tree(ld({"@context": "x", "@graph": [{"@type": "http://schema.org/Organization", "@id": "o"}, {"@type": ["schema:WebSite"], "name": "n"}]}) + '<script type="application/ld+json">{not json</script><script type="application/ld+json"> </script>')
    s = html.structured(root)
    assert [n["types"] for n in s["nodes"]] == [["organization"], ["website"]] and (s["malformed"], s["empty"], s["blocks"]) == (1, 1, 3)
    f = html.facts("<p>a<b>c</p><div>d</div><nav>n</nav><script>var t='</p>';</script><template><form></form></template>", "")
    assert f["extracted"] == "a c d" and f["full"] == "a c d n" and f["forms"] == []


def test_robots(spark):
    text = "User-agent: *\nDisallow: /private/\nAllow: /private/public/\nDisallow: /*.pdf$\n\nUser-agent: GPTBot\nUser-agent: Foo\nDisallow: /\n\nUser-agent: Claude\nCrawl-delay: 2\nDisallow: /a+b\nSitemap: https://t.test/s.xml"
    rules = robots.rules(spark.createDataFrame([("t.test", text)], "site_id string, text string")).cache()
    asked = [("Googlebot", "/private/x", False), ("Googlebot", "/private/public/y", True), ("Googlebot", "/a.pdf", False), ("Googlebot", "/a.pdf.html", True), ("GPTBot", "/private/public/y", False), ("gptbot", "/", False), ("ClaudeBot", "/a+b", True), ("Claude", "/a+b", False), ("Googlebot", "/private%2Fx", False)]
    got = {(r["agent"], r["path"]): (r["allowed"], r["via_wildcard"]) for r in robots.decisions(rules, spark.createDataFrame([("t.test", a, p) for a, p, _ in asked], "site_id string, agent string, path string")).collect()}
    assert [(a, p, got[a, p][0]) for a, p, _ in asked] == asked
    assert got["Googlebot", "/private/x"][1] and not got["GPTBot", "/private/public/y"][1]
    assert [(r["token"], r["probably_meant"]) for r in robots.unrecognised(rules, spark).collect()] == [("Claude", ["Claude-SearchBot", "Claude-User", "ClaudeBot"])]
    assert [r["sitemap"] for r in robots.sitemaps(spark.createDataFrame([("t.test", text)], "site_id string, text string")).collect()] == ["https://t.test/s.xml"]
    none = robots.decisions(robots.rules(spark.createDataFrame([("t.test", "")], "site_id string, text string")), spark.createDataFrame([("t.test", "Googlebot", "/")], "site_id string, agent string, path string"))
    status = lambda n: spark.createDataFrame([("t.test", n, True)], "site_id string, status int, reachable boolean")
    assert [robots.with_status(none, status(n)).head()["allowed"] for n in (200, 404, 503)] == [True, True, False]


def test_access_checks(crawl):
    got = fired(crawl(
        page("https://t.test/1", headers={"x-robots-tag": "googlebot-news: noindex"}), page("https://t.test/2", headers={"x-robots-tag": "max-snippet: 0, noindex"}, role="pricing"),
        page("https://t.test/3", head="<title>Page not found</title><meta name=viewport content=x>"), page("https://t.test/4", head='<title>Some title here</title><link rel="canonical" href="https://other.test/4">'),
        page("https://t.test/5", head='<title>Some title here</title><link rel=canonical href="https://www.t.test/5"><meta http-equiv=refresh content="0; url=https://t.test/6">'), page("https://t.test/6", status=404, role="contact"), page("https://t.test/7", chain=["a", "b", "c"]),
        page("https://t.test/8", head='<title>Some title here</title><link rel="canonical" href="/">'), page("https://t.test/9", '<main data-nosnippet>x</main>'),
    ))
    u = lambda *n: {f"https://t.test/{x}" for x in n}
    assert got["A3_noindex"] == u(2) and got["A2_snippet_suppressed"] == u(2, 9) and got["A11_soft_404"] == u(3) and got["A5_canonical_problem"] == u(4, 8)
    assert got["A10_meta_refresh"] == u(5) and got["A9_key_page_broken"] == u(6) and got["A4_redirect_chain"] == u(7) and "A3_noindex_utility" not in got


def test_utility_noindex_is_a_question(crawl):
    pages = [page(f"https://t.test/{i}", head="<title>Title number one</title>" + ('<meta name="robots" content="NOINDEX">' if i == 0 else "")) for i in range(4)]
    assert fired(crawl(*pages)).get("A3_noindex_utility") == {"https://t.test/0"}


def test_fact_tiers(crawl):
    payload = '<script id="__NEXT_DATA__" type="application/json">{"p":"$49"}</script>'
    got = fired(crawl(page("https://t.test/pricing", "only $49 a month", "pricing"), page("https://t.test/pricing-payload", payload, "pricing"), page("https://t.test/pricing-absent", "ask us", "pricing"), page("https://t.test/contact", "<form><input name=a type=email></form>", "contact"), page("https://t.test/kontakt", "<a href='tel:1'>Call</a>", "contact")))
    assert got["B1_fact_script_only"] == {"https://t.test/pricing-payload"} and got["B1_fact_absent"] == {"https://t.test/pricing-absent", "https://t.test/contact"}


def test_markup_checks(crawl):
    product = lambda name, price, shown="": ld({"@type": "Product", "name": name, "offers": {"@type": "Offer", "price": price}}) + shown
    got = fired(crawl(
        page("https://t.test/p/1", product("One", "10.00"), "product"), page("https://t.test/p/2", product("One", "12.00"), "product"), page("https://t.test/p/3", product("Two", "9", "now $8"), "product"), page("https://t.test/p/4", product("Three", "7", "now $7"), "product"),
        page("https://t.test/", ld({"@type": "Organization", "name": "Acme"}), "home", head="<title>Acme home of robots</title><meta property='og:site_name' content='Zenith'>"), page("https://t.test/q", "<h2>What is it?</h2><h2>Why now?</h2><h3>How much?</h3>"), page("https://t.test/bad", '<script type="application/ld+json">{x</script>'),
    ))
    assert got["D4_internal_contradiction"] == {"https://t.test/p/1", "https://t.test/p/2"} and got["C2_markup_text_contradiction"] == {"https://t.test/p/3"}
    assert "C6_entity_name_conflict" in got and "C3_entity_unanchored" in got and got["C5_faq_content_unmarked"] == {"https://t.test/q"} and got["C1_structured_data_invalid"] == {"https://t.test/bad"}


def test_freshness_and_titles(crawl):
    got = fired(crawl(*[page(f"https://t.test/blog/{i}", b, "blog", head=h) for i, (b, h) in enumerate([("", "<title>Same title</title>"), ('<time datetime="2020-01-05">x</time>', "<title>Same title</title>"), ('<time datetime="2026-08-05T10:00:00+00:00">x</time>', "<title>Same title</title>"), ("<footer>© 2019 - 2021 Acme</footer>", "<title>Home</title>")])]))
    u = lambda *n: {f"https://t.test/blog/{x}" for x in n}
    assert got["D1_no_date_signals"] == u(0, 3) and got["D3_content_stale"] == u(1) and got["D2_stale_copyright"] == u(3) and got["C7_title_problem"] == u(0, 1, 2, 3)


def test_engagement(crawl):
    field = lambda n, more="": f"<input name=f{n} {more}>"
    filled = "Heading about things " + "word " * 210
    got = fired(crawl(
        page("https://t.test/1", "<form action=/contact>" + "".join(field(i, "required aria-label=x") for i in range(6)) + "</form>"), page("https://t.test/2", "<form action=/n><input name=mail></form>"), page("https://t.test/3", "<form action=/n><input name=mail></form>"),
        page("https://t.test/4", "<a href=/a>Click here</a><a href=/b>here</a><a href=/c>more</a><a href=/d>Good name</a>"), page("https://t.test/5", "<button></button><a href=/x><img src=i></a><input type=submit>"), page("https://t.test/6", "<img src=a><img src=b><img src=c><img src=d alt=''>"),
        page("https://t.test/7", lang=" "), page("https://t.test/8", head="<title>About things in a page</title><meta name=viewport content='user-scalable=yes, maximum-scale=1.0'>"), page("https://t.test/9", head="<title>About things in a page</title>"),
        page("https://t.test/10", filled + "<a href='#top'>t</a><a href='javascript:x'>j</a><nav><a href=/n>n</a></nav>"), page("https://t.test/11", filled + "<a href=/other>o</a>"), page("https://t.test/12", "word " * 60, head="<title>A B</title><meta name=viewport content=x><meta name=description content='Nothing matches'>"),
    ))
    u = lambda *n: {f"https://t.test/{x}" for x in n}
    assert got["E1_form_friction"] == u(1) and got["E1_unlabelled_input"] == u(2, 3) and got["E2_vague_link_text"] == u(4) and got["E3_unnamed_controls"] == u(5) and got["E4_images_missing_alt"] == u(6)
    assert got["E5_no_lang"] == u(7) and got["E7_zoom_disabled"] == u(8) and got["E11_no_viewport"] == u(9) and got["E10_no_next_step"] == u(10) and u(12) <= got["E9_promise_payoff_mismatch"]


def test_filler(crawl):
    shared = "This sentence stands on every single page of the site and says nothing at all. " * 20
    own = lambda i: f"Only page number {i} has this particular sentence about its own subject. "
    got = fired(crawl(*[page(f"https://t.test/{i}", f"<p>{shared}</p><p>{own(i) * 2}</p>") for i in range(4)]))
    assert len(got["B6_filler_heavy"]) == 4


def test_severity(spark):
    rows = [("A1_retrieval_agent_blocked", "site_wide", "deterministic", "static_fact", "active", 5, "critical"), ("A1_retrieval_agent_blocked", "single_page", "deterministic", "static_fact", "active", 5, "high"), ("A1_retrieval_agent_blocked", "single_page", "deterministic", "static_fact", "active", 1, "critical"), ("B1_fact_absent", "template", "deterministic", "static_heuristic", "active", 5, "medium"), ("B1_fact_absent", "template", "deterministic", "static_fact", "latent", 5, "low"), ("nothing", "site_wide", "heuristic", "static_fact", "active", 5, "low")]
    got = severity.graded(spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, check_id string, blast_radius string, confidence string, measurement_basis string, status string, coverage_pages int, want string"))
    assert [(r["check_id"], r["severity"]) for r in got.orderBy("i").collect()] == [(r[0], r[-1]) for r in rows]
    why = got.where("i = 4").head()["severity_rationale"]
    assert why == "base=high (extractability/B1_fact_absent); blast=template x0.8; cap(latent)-> low => low"


def test_latency(spark, crawl):
    pages = crawl(page("https://t.test/pricing", "ask", "pricing"), page("https://t.test/x", lang=""), page("https://t.test/y"))
    ask = spark.createDataFrame([("t.test", a, p) for a, _, _ in robots.AGENTS for p in ("/pricing", "/x", "/y")], "site_id string, agent string, path string")

    def run(text):
        rules = robots.rules(spark.createDataFrame([("t.test", text)], "site_id string, text string"))
        decided = robots.decisions(rules, ask).cache()
        sites = spark.createDataFrame([("t.test", "https://t.test/", "complete", ["https://t.test/x"], 1)], "site_id string, start_url string, run_status string, sitemap_urls array<string>, sitemaps_fetched int")
        more = audit.site_findings(sites, pages, robots.agent_report(decided, spark), robots.unrecognised(rules, spark))
        return {r["check_id"]: r["status"] for r in audit.graded_findings(pages, more=more, decided=decided).collect()}

    one, every = run("User-agent: PerplexityBot\nDisallow: /"), run("User-agent: *\nDisallow: /")
    assert one["A1_retrieval_agent_blocked"] == "confirm_intent" and one["B1_fact_absent"] == "active"
    assert every["A1_retrieval_agent_blocked"] == "active" and every["B1_fact_absent"] == "latent" and every["E5_no_lang"] == "active"


def test_ranked_report(spark, crawl):
    f = audit.graded_findings(crawl(page("https://t.test/", role="home"), page("https://t.test/2", lang=""), page("https://t.test/3", status=500))).cache()
    rows = f.orderBy("rank").collect()
    assert [r["id"] for r in rows] == [f"F-{i:03d}" for i in range(1, len(rows) + 1)]
    levels = [severity.BANDS.index(r["severity"]) for r in rows]
    assert levels == sorted(levels, reverse=True) and {r["check_id"] for r in rows} <= {c for c, *_ in severity.SEVERITY}
    rep = audit.report(f).head()
    assert rep["total_findings"] == len(rows) == rep["active_findings"] + rep["latent_findings"] + rep["confirm_intent_findings"] == sum(rep[b] for b in severity.BANDS)
    assert len(json.loads(rep["findings"])) == len(rows) and rep["headline"].startswith(str(rep["active_findings"]))


def test_unreadable_site(spark, crawl):
    pages = crawl(page("https://t.test/", status=403))
    sites = spark.createDataFrame([("t.test", "https://t.test/", "failed", [], 0)], "site_id string, start_url string, run_status string, sitemap_urls array<string>, sitemaps_fetched int")
    decided = robots.decisions(robots.rules(spark.createDataFrame([("t.test", "")], "site_id string, text string")), spark.createDataFrame([("t.test", "Googlebot", "/")], "site_id string, agent string, path string"))
    got = audit.site_findings(sites, pages, robots.agent_report(decided, spark), robots.unrecognised(robots.rules(spark.createDataFrame([("t.test", "")], "site_id string, text string")), spark)).collect()
    assert [(r["check_id"], r["confidence"]) for r in got] == [("A7_site_unreadable", "heuristic")]


def test_claims(spark):
    pages = spark.createDataFrame([("t.test", "https://t.test/a", True, "<p>Forty days to ship</p>", "Forty days to ship", "Forty days to ship", {"server": "x"}), ("t.test", "https://t.test/b", True, "<p>Forty</p>", "Forty and else", "Forty and else", {})], "site_id string, url string, ok boolean, html string, extracted string, full string, headers map<string,string>")
    fields = spark.createDataFrame([("t.test", "https://t.test/a", "h1_count", "0"), ("t.test", "https://t.test/b", "h1_count", "2"), ("t.test", "https://t.test/a", "status", "200")], "site_id string, url string, path string, value string")
    ok = {"type": "text_contains", "value": "forty  DAYS", "url": "https://t.test/a"}

    def claim(n, evidence, title="Shipping takes forty days", urls=("https://t.test/a",), **more):
        e = [tuple(x.get(k) for k in ("url", "type", "value", "scope", "header", "path", "op")) for x in evidence]
        base = {"mechanism": "B", "hurts": "both", "severity": "low", "nearest_check": None}
        base.update(more)
        return ("t.test", n, title, "A long enough reason to state here", *base.values(), list(urls), e, ("Say it sooner", ["Do it"], "Look at the page", "low"))

    rows = [claim(1, [ok]), claim(2, [ok]), claim(3, [dict(ok, value="days of forty")], "Another claim altogether"), claim(4, [dict(ok, value="and else", type="text_lacks")], "Only an absence here"), claim(5, [dict(ok, value="forty ", scope="full"), {"url": "https://t.test/a", "type": "field", "path": "status", "op": "eq", "value": "200"}], "Identity fields are weak"), claim(6, [{"url": "https://t.test/a", "type": "field", "path": "h1_count", "op": "eq", "value": "0"}], "See https://evil.test for it")]
    c = spark.createDataFrame(rows, f"site_id string, claim int, title string, why string, mechanism string, hurts string, severity string, nearest_check string, affected_urls array<string>, evidence {bundles.EVIDENCE}, suggested_action {bundles.ACTION}")
    tested = claims.assertions(c, pages, fields).cache()
    got = {r["claim"]: r["rejected_reason"] for r in claims.verified(c, tested, pages.where("ok")).collect()}
    assert got[1] is None and got[2] == "repeats an earlier claim" and got[3] == "evidence does not hold" and got[4].startswith("every assertion") and got[6].startswith("claim text contains")
    assert got[5] is not None
    scripted = spark.createDataFrame([("t.test", "C6_entity_name_conflict", ["https://t.test/a"]), ("t.test", "E11_no_viewport", ["https://t.test/a"])], "site_id string, check_id string, affected_urls array<string>")
    twins = {r["claim"]: r["twins"] for r in claims.restated(c.where("claim = 1"), scripted).collect()}
    assert twins == {1: ["C6_entity_name_conflict"]}
    ranked = spark.createDataFrame([("t.test", "B1_fact_absent", 1, "F-001", ["https://t.test/a"])], "site_id string, check_id string, rank int, id string, affected_urls array<string>")
    wanted = spark.createDataFrame([("t.test", 1, "B1_fact_absent", "https://t.test/a", "forty days", ["x"]), ("t.test", 2, "B1_fact_absent", "https://t.test/a", "forty days", ["y"]), ("t.test", 3, "B1_fact_absent", "https://t.test/a", "sixty days", ["y"])], "site_id string, fix int, check_id string, url string, quote string, site_specific array<string>")
    fixed = {r["fix"]: (r["finding_id"], r["rejected_reason"]) for r in claims.fixes(wanted, pages, ranked).collect()}
    assert fixed[1] == ("F-001", None) and fixed[2][1].startswith("a fix was already") and fixed[3][1] == "quote is not on the page"


def test_evaluation(spark):
    b = spark.createDataFrame([("s1", "A", 1, "high", ["u", "v"]), ("s1", "B", 2, "low", ["u"]), ("s2", "C", 1, "high", ["u"])], "slug string, check_id string, position int, severity string, affected_urls array<string>")
    a = spark.createDataFrame([("s1", "A", 1, "high", ["u"]), ("s2", "C", 1, "high", ["u"]), ("s2", "D", 2, "low", ["u"])], b.schema)
    got = {(r["slug"], r["check_id"]): r["outcome"] for r in evaluation.outcomes(b, a).collect()}
    assert got == {("s1", "A"): "reduced", ("s1", "B"): "removed", ("s2", "C"): "kept", ("s2", "D"): "absent_in_scripted"}
    p = evaluation.precision(spark.createDataFrame([("correct", 3), ("false_positive", 1), ("unchecked", 9)], "verdict string, n long")).head()
    assert p["precision"] == 0.75
    assert evaluation.consecutive(spark.createDataFrame([("s", i, c) for i, c in enumerate([503, 200, 503, 503, 503, 200])], "site_id string, page_seq int, status int")).head()["longest"] == 3


def test_bundle_source(spark, tmp_path):
    doc = {"site": "t.test", "start_url": "https://t.test/", "audited_at": "2026-09-12T00:00:00Z", "run_status": "complete", "sitemap_urls": ["https://t.test/"], "robots": {"agents": {"Googlebot": {"class": "retrieval", "blocked_paths": ["/x"]}}}, "pages": [{"url": "https://t.test/", "final_url": "https://t.test/", "status": 200, "role": "home", "headers": {"X-Robots-Tag": "noindex"}, "html": "<html><title>T</title>"}]}
    (tmp_path / "a.bundle.json").write_text(json.dumps(doc, indent=1))
    rows = bundles.bundles(spark, f"file://{tmp_path}")
    assert bundles.sites(rows).head()["ai_agents_named"] is False and bundles.pages(rows).head()["headers"] == {"x-robots-tag": "noindex"} and bundles.agent_access(rows).head()["path"] == "/x"
    assert fired(audit.prepared(bundles.pages(rows)))["A3_noindex"] == {"https://t.test/"}


def test_crawl_operators(spark, crawl):
    from crawlens.operators import crawl as C

    html_of = lambda t, b="": f"<html><title>{t}</title>{b}</html>"
    rows = [(html_of("Just a moment..."), "unrecognised vendor"), (html_of("Fine", "<script>cf_chl_opt</script>"), "Cloudflare"), (html_of("Fine", "<script>cf_chl_opt</script>" + "w " * 80), None), ("", None), (html_of("Just a moment") + "x" * 70000, None)]
    assert [r["v"] for r in spark.createDataFrame([(i, h) for i, (h, _) in enumerate(rows)], "i int, h string").orderBy("i").select(C.challenge(F.col("h")).alias("v")).collect()] == [v for _, v in rows]
    links = C.homepage_links(crawl(page("https://t.test/", "<a href='/pricing'>Plans</a><a href='pricing#x'>P</a><a href='//www.t.test/about/'>About</a><a href='/a.css'>c</a><a href='https://o.test/'>o</a><a href='mailto:x'>m</a><a href='/contact-sales'></a>", "home")))
    assert sorted((r["target"], r["label"]) for r in links.collect()) == [("https://t.test/contact-sales", None), ("https://t.test/pricing", "Plans"), ("https://www.t.test/about", "About")]
    order = C.frontier(links, spark.createDataFrame([("t.test", f"https://t.test/{u}", i) for i, u in enumerate(["blog/1", "pricing", "z", "blog/1"])], "site_id string, url string, seq int"))
    assert [r["url"].split(".test/")[1] for r in order.orderBy("position").collect()] == ["pricing", "contact-sales", "about", "blog/1", "z"]
    files = spark.createDataFrame([("t.test", "r.xml", "<loc>https://t.test/s1.xml</loc><loc>https://t.test/a</loc>"), ("t.test", "https://t.test/s1.xml", "<loc> https://t.test/b </loc><loc>https://t.test/a</loc><loc>https://t.test/s2.xml</loc>"), ("t.test", "https://t.test/s2.xml", "<loc>https://t.test/c</loc>")], "site_id string, sitemap string, xml string")
    got = C.sitemap_pages(files, spark.createDataFrame([("t.test", "r.xml", 0)], "site_id string, sitemap string, at int"))
    assert [r["url"] for r in got.orderBy("seq").collect()] == ["https://t.test/a", "https://t.test/b", "https://t.test/c"]
    sites = spark.createDataFrame([(s, s == "b", 5, 2) for s in "abcd"], "site_id string, blocked_by_robots boolean, urls_seen int, max_pages int")
    pages = spark.createDataFrame([("a", 200, "x", None), ("a", 200, "x", None), ("c", 403, None, None), ("d", 200, "x", None)], "site_id string, status int, html string, error string")
    assert {r["site_id"]: r["run_status"] for r in C.run_status(pages, sites).collect()} == {"a": "complete", "b": "blocked", "c": "failed", "d": "partial"}


def test_review(spark, crawl):
    from crawlens.operators import review

    pages = crawl(page("https://t.test/pricing", "word " * 160, "pricing"), page("https://t.test/about", "Short", "about"), page("https://t.test/x", head='<title>T</title><link rel=canonical href="https://t.test/gone">'), page("https://t.test/gone", status=404))
    none = spark.createDataFrame([], "site_id string, check_id string, affected_urls array<string>")
    got = {(r["item"], r["url"][15:]) for r in review.candidates(pages, none).collect()}
    assert got == {("pricing_answer_not_in_opening", "pricing"), ("thin_content_page", "about"), ("canonical_points_at_broken_page", "x")}
    told = spark.createDataFrame([("t.test", "B1_fact_absent", ["https://t.test/pricing"])], none.schema)
    assert len(review.candidates(pages, told).collect()) == 2
    found = spark.createDataFrame([("t.test", "F-001", "B1_fact_absent", "high", ["u1", "u2"], "template", "deterministic", "static_fact", "active", 5), ("t.test", "F-002", "A3_noindex", "critical", ["u1"], "site_wide", "deterministic", "static_fact", "active", 5)], "site_id string, id string, check_id string, severity string, affected_urls array<string>, blast_radius string, confidence string, measurement_basis string, status string, coverage_pages int")
    say = "A long enough explanation of it"
    verdicts = spark.createDataFrame([("t.test", 1, "B1_fact_absent", None, "not_a_defect", "page_purpose_mismatch", say, ["u1"]), ("t.test", 2, "A3_noindex", None, "confirm_intent", "deliberate_configuration", say, None), ("t.test", 3, "A3_noindex", None, "downgrade", "overstated_impact", say, None), ("t.test", 4, "B1_fact_absent", None, "confirm", "overstated_impact", say, None)], "site_id string, n int, check_id string, url string, verdict string, reason string, explanation string, urls array<string>")
    tested = spark.createDataFrame([("t.test", n, "u1", "text_contains", "x", True, True) for n in (1, 2, 3, 4)], "site_id string, n int, url string, kind string, value string, holds boolean, positive boolean")
    out = review.judged(verdicts, found, tested, spark.createDataFrame([("t.test", 3)], "site_id string, pages_ok int")).cache()
    assert {r["n"]: (r["effect"], r["rejected_reason"]) for r in out.collect()} == {1: ("clear_urls", None), 2: ("confirm_intent", None), 3: (None, "a critical finding is not downgraded for scope"), 4: (None, "reason goes with another verdict")}
    after = {r["check_id"]: (r["severity"], r["status"], r["affected_urls"]) for r in review.applied(found, out).collect()}
    assert after == {"B1_fact_absent": ("high", "active", ["u2"]), "A3_noindex": ("low", "confirm_intent", ["u1"])}


def test_streaming(spark, tmp_path):
    from crawlens.streaming import incremental

    rows = [tuple(page("https://t.test/1", lang="")[c.split()[0]] for c in SCHEMA.split(", "))]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("audited_at", F.to_timestamp("audited_at"))
    df.write.parquet(f"{tmp_path}/in")
    q = incremental.page_hits(incremental.stream(spark, f"{tmp_path}/in", df.schema), f"{tmp_path}/out", f"{tmp_path}/ck")
    q.awaitTermination(120)
    assert "E5_no_lang" in {r["check_id"] for r in spark.read.parquet(f"{tmp_path}/out").collect()}


def test_scoped_directives(spark):
    """A scope ends at its first colon; a value may have one of its own."""
    from crawlens.operators import checks

    rows = [("googlebot: max-snippet:0", [("googlebot", "max-snippet:0")]), ("otherbot: noindex, nofollow", [("otherbot", "noindex"), ("otherbot", "nofollow")]), ("max-snippet:0, noindex", [("robots", "max-snippet:0"), ("robots", "noindex")]), ("bingbot:nosnippet, googlebot: unavailable_after: 2026", [("bingbot", "nosnippet"), ("googlebot", "unavailable_after: 2026")]), (None, [])]
    df = spark.createDataFrame([(i, h) for i, (h, _) in enumerate(rows)], "i int, h string").withColumn("metas", F.array().cast("array<struct<name: string, property: string, content: string>>"))
    for r in df.select("i", checks.directives(F.col("h"), F.col("metas")).alias("d")).collect():
        assert [(x["bot"], x["d"]) for x in r["d"]] == rows[r["i"]][1]


def test_pages_from_the_wild():
    """Deep structured data, paragraphs without end tags, deep nesting and megabytes."""
    import time

    from crawlens.functions import html as H

    deep = '{"a":' * 50_000 + "1" + "}" * 50_000
    f = H.facts(f'<script type="application/ld+json">{deep}</script><script type="application/ld+json">{{"@type": "Product", "name": "x"}}</script>', "")
    assert (f["blocks"], f["malformed"], f["types"]) == (2, 1, ["product"])
    start = time.time()
    f = H.facts("<ul>" + "<li>item <p>some words of a paragraph" * 20_000 + "</ul>", "")
    assert len(f["paragraphs"]) == 20_000 and set(f["paragraphs"]) == {"some words of a paragraph"}
    f = H.facts("<div>" * 20_000 + "<p>inside" + "<table><tr><td>a<td>b<tr><td>c</table>" + "x" * 3_000_000, "")
    assert f["extracted"].startswith("inside a b c x") and len(f["extracted"]) == 3_000_013
    assert time.time() - start < 60
    f = H.facts("<p>one <b>bold<p>two</p><p>three<div>four</div><button><p>five</button><ul><li>a<ul><li>b</ul><li>c</ul>", "")
    assert f["paragraphs"] == ["one bold", "two", "three", "five"] and f["extracted"].startswith("one bold two three four")


def test_outcomes_of_a_second_run(spark):
    from crawlens.operators import evaluation

    schema = "slug string, check_id string, position int, severity string, affected_urls array<string>, status string"
    before = [("s", "a", 1, "high", ["u", "v"], "active"), ("s", "b", 2, "high", ["u"], "active"), ("s", "c", 3, "low", ["u", "v"], "active"), ("s", "d", 4, "low", ["u"], "active"), ("t", "a", 1, "low", ["u"], "active"), ("s", "f", 5, "high", ["u"], "active")]
    after = [("s", "a", 1, "high", ["u", "v"], "confirm_intent"), ("s", "b", 2, "medium", ["u"], "active"), ("s", "c", 3, "low", ["u"], "active"), ("s", "e", 4, "low", ["u"], "active"), ("s", "f", 5, "critical", ["u", "v"], "active")]
    ran = spark.createDataFrame([("s",)], "slug string")
    got = {(r["slug"], r["check_id"]): r["outcome"] for r in evaluation.outcomes(spark.createDataFrame(before, schema), spark.createDataFrame(after, schema), ran).collect()}
    assert got == {("s", "a"): "reduced", ("s", "b"): "reduced", ("s", "c"): "reduced", ("s", "d"): "removed", ("s", "e"): "absent_in_scripted", ("s", "f"): "kept", ("t", "a"): "no_output"}
    listed = evaluation.listed(spark.createDataFrame(before, schema).withColumn("title", F.col("check_id"))).collect()
    assert sorted((r["slug"], r["check_id"]) for r in listed) == [("s", "a"), ("s", "b"), ("s", "f")]
    runs = spark.createDataFrame([("s", 3.0, 0.5), ("t", None, None)], "slug string, wall_s double, cost double")
    assert evaluation.sums(runs).head().asDict() == {"runs": 2, "wall_s": 3.0, "median_s": 3.0, "cost": 0.5}


def test_integrity_of_runs(spark):
    from crawlens.operators import evaluation

    runs = spark.createDataFrame([("fine", 10.0, "0", True), ("slow", 301.0, "0", True), ("none", None, None, None), ("crash", 9.0, "1", True), ("lost", 9.0, "0", False)], "slug string, wall_s double, rc string, report_written boolean")
    reports = spark.createDataFrame([(s, 2, 0, 0, 1, 0, 0) for s in ("fine", "crash", "lost")] + [("slow", 1, 0, 0, 1, 0, 0)], "slug string, total_findings int, critical int, high int, medium int, low int, info int")
    found = spark.createDataFrame([("crash", "F-009", 1, "no_such_check", ["u", "u"]), ("slow", "F-002", 1, "no_such_check", ["u", "u"])], "slug string, id string, position int, check_id string, affected_urls array<string>")
    got = {(r["slug"], r["problem"]) for r in evaluation.problems(runs, found, reports).collect()}
    assert got == {("slow", "over_5_minutes"), ("none", "not_run"), ("crash", "crash_or_no_report"), ("lost", "crash_or_no_report"), ("fine", "counts_do_not_add_up"), ("slow", "ids_out_of_order"), ("slow", "unknown_check_id"), ("slow", "duplicate_affected_urls")}
    f = spark.createDataFrame([("s", "high", f"t{i:02}") for i in range(30)] + [("s", "low", "z")], "site_id string, severity string, title string")
    d = evaluation.digest(f).head()
    assert d["high"] == 30 and d["worst"] == [f"t{i:02}" for i in range(10)]
