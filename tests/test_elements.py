"""The tree of a page, its facts, and the table of its elements with the same questions as joins."""

import random
import time

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from crawlens.functions import elements as T, html as H
from crawlens.operators import checks, crawl, elements as E

PARTS = (
    "<p>", "</p>", "<div>", "</div>", "<nav>", "</nav>", '<a href="/x">', '<a href="#t" aria-label=l>', "</a>", "<button>", "</button>", '<button aria-labelledby="i1 i2">', "<span id=i1>", "<b id=i2>", "</span>", "word ", "twenty " * 21, "<img src=a.png>", "<img src=pixel.gif alt=z>", "<img width=1px>",
    "<svg><title>t</title></svg>", "<template>", "</template>", "<noscript>", "</noscript>", "<form action=/contact>", "</form>", "<input name=q id=f1>", "<input placeholder=p>", "<label for=f1>", "<label>", "</label>", "<input type=submit value=go>", "<select><option>a<option>b</select>", "<ul><li>", "<li>", "</ul>",
    "<table><tr><td>", "<td>", "<tr>", "</table>", "<main>", "</main>", "<section data-nosnippet>", "</section>", "<h1>", "</h1>", "<h2 id=z>", "</h2>", "<link rel=canonical href=/c>", '<script>var a="<p>"</script>', '<a href="mailto:x">', "<footer>", "</footer>", "<dl><dt>", "<dd>", "</dl>", "<b>", "</b>", "<br>", "&amp;",
    '<a href="/contact-us">c</a>', "<a href=/kontakt/2>k</a>", "<a href=/contact/3>k</a>", "<a href=/contact/4>k</a>", "<a href=/contact/5>k</a>", "<a href=/contact/6>",
)


@pytest.fixture(scope="module")
def odd(spark):
    rng = random.Random(5)
    rows = [("t.test", i, f"https://t.test/{'contact' if i % 3 == 0 else i}", "".join(rng.choice(PARTS) for _ in range(rng.randint(1, 60)))) for i in range(300)]
    p = spark.createDataFrame(rows, "site_id string, page_seq long, url string, html string").withColumn("final_url", F.col("url")).withColumn("role", F.lit("home")).repartition(3)
    return p.cache(), H.parsed(p).cache(), T.elements(p).cache()


def same(a, b):
    a, b = sorted(map(repr, map(tuple, a.collect()))), sorted(map(repr, map(tuple, b.collect())))
    assert a and a == b


def test_joins_give_the_facts_of_the_one_pass(odd):
    pages, parsed, table = odd
    same(E.canonical(table).select("page_seq", "canonical"), parsed.where("f.canonical IS NOT NULL").select("page_seq", "f.canonical"))
    same(E.contact_pages(table, pages).select("page_seq"), parsed.where(checks.contact_page()).select("page_seq"))
    same(E.hidden_content(table).select("page_seq"), parsed.where("f.nosnippet").select("page_seq"))
    same(E.homepage_links(table, pages), crawl.homepage_links(parsed))


def test_names_and_labels_by_joins(odd):
    _, parsed, table = odd
    named = E.names(table, E.controls(table)).groupBy("page_seq").agg(F.count("*").alias("n"), F.count_if(F.col("name") != "").alias("m"))
    same(named, parsed.where("size(f.controls) > 0").select("page_seq", F.size("f.controls").cast("long"), F.size(F.filter("f.controls", lambda c: c["named"])).cast("long")))
    own = parsed.select("page_seq", F.explode("f.forms").alias("x")).select("page_seq", F.explode("x.fields").alias("y"))
    same(E.label_states(table).groupBy("page_seq", "state").count(), own.groupBy("page_seq", "y.state").count())


def test_texts_by_joins(odd):
    _, parsed, table = odd
    keys = ["site_id", "page_seq", "at"]
    p = E._live(table).where("tag = 'p'")
    shown = p.join(T.texts(table, p), keys, "left").groupBy("page_seq").agg(F.array_sort(F.collect_list(F.struct("at", F.coalesce("shown", F.lit("")).alias("t")))).alias("x"))
    same(shown.select("page_seq", F.transform("x", lambda v: v["t"])), parsed.where("size(f.paragraphs) > 0").select("page_seq", "f.paragraphs"))


def test_name_precedence(spark):
    rows = ["<button aria-label=one title=two>x</button>", "<button title=two aria-labelledby=i>x</button><i id=i>three</i>", "<button aria-labelledby='j i'>x</button><i id=i>three</i><i id=j>four</i>", "<input type=submit value=five>", "<a href=/><img alt=six>x</a>", "<button><svg><title>seven</title></svg>x</button>", "<button><b aria-label=eight></b>x</button>", "<button> nine <script>no</script></button>", "<button></button>", "<button :title=t></button>"]
    table = T.elements(spark.createDataFrame([("s", i, h) for i, h in enumerate(rows)], "site_id string, page_seq long, html string"))
    got = {r["page_seq"]: r["name"] for r in E.names(table, E.controls(table)).collect()}
    assert [got.get(i) for i in range(10)] == ["one", "two", "four three", "five", "six", "seven", "eight", "nine", "", None]


def test_intervals_nest(spark):
    nodes = [dict(zip(("at", "until", "parent", "depth", "tag"), x[:5])) for x in T._nodes("<div>a<p>b<p>c<ul><li>d<li>e</ul></div>f")]
    by = {n["at"]: n for n in nodes}
    assert sorted(by) == list(range(1, len(nodes) + 1))
    for n in nodes:
        assert n["parent"] == 0 or by[n["parent"]]["at"] < n["at"] < n["until"] <= by[n["parent"]]["until"]
    assert [(n["tag"], n["depth"]) for n in sorted(nodes, key=lambda n: n["at"]) if n["tag"] != T.TEXT] == [("div", 1), ("p", 2), ("p", 2), ("ul", 2), ("li", 3), ("li", 3)]


def test_depth_has_no_bound():
    start = time.time()
    deep = "<div>" * 20_000
    f = H.facts(f"{deep}<nav>menu words</nav><form action=/a><input name=x></form><template><form><input></form>hidden</template>text", "")
    assert f["extracted"] == "text" and f["full"] == "menu words text" and [x["action"] for x in f["forms"]] == ["/a"]
    f = H.facts("<button>" * 8_000 + "<a href=/x>" * 2_000, "")
    assert len(f["controls"]) == 10_000 and not any(c["named"] for c in f["controls"])
    f = H.facts("<button>" * 8_000 + "go", "")
    assert all(c["named"] for c in f["controls"])
    f = H.facts("<li>" * 30_000 + "<p>" * 30_000 + "</div>" * 30_000, "")
    assert len(f["paragraphs"]) == 30_000
    assert time.time() - start < 30


def test_numbers_that_are_none():
    assert [H.pixels(x) for x in ("2", " 1.5px ", "²", "", "auto", "1e3", "-1")] == [2.0, 1.5, None, None, None, None, -1.0]
    f = H.facts('<img src=a width="²"><img src=b width=151><img src=c><img src=d width=1>', "")
    assert f["wide_blank_images"] == 2 and [i["src"] for i in f["images"]] == ["a", "b", "c"]


def test_one_bad_page_costs_no_other(spark, monkeypatch):
    lone = '<script type="application/ld+json">{"@type": "Product", "name": "\\ud800 x \\ud83d\\ude00"}</script>'
    rows = [("s", 0, "https://s.test/", lone), ("s", 1, "http://[bad", "<a href='http://[worse'>x</a>"), ("s", 2, "https://s.test/2", "<p>fine</p>"), ("s", 3, "u", None)]
    got = {r["page_seq"]: r for r in H.parsed(spark.createDataFrame(rows, "site_id string, page_seq long, url string, html string")).collect()}
    assert "� x \U0001f600" in got[0]["f"]["nodes"][0]["props"] and got[2]["f"]["paragraphs"] == ["fine"] and got[3]["f"] is None and got[3]["parse_error"] is None
    assert got[1]["f"] is None and got[1]["parse_error"].startswith("ValueError") or got[1]["f"] is not None
    before = H.structured

    def breaks(root):
        if root.of("object"):
            raise RuntimeError("no such thing")
        return before(root)

    monkeypatch.setattr(H, "structured", breaks)
    rows = [("s", 0, "u", "<object></object>"), ("s", 1, "u", "<p>fine</p>")]
    got = {r["page_seq"]: r for r in H.parsed(spark.createDataFrame(rows, "site_id string, page_seq long, url string, html string")).collect()}
    assert got[0]["f"] is None and got[0]["parse_error"] == "RuntimeError: no such thing" and got[1]["f"]["paragraphs"] == ["fine"]


def test_graph_nodes():
    data = {"@context": "x", "@graph": [{"@type": "A", "part": {"@type": "B", "inner": [{"@type": "C"}, {"name": "none"}]}}, {"@type": ["s:D", 3]}], "name": "own"}
    assert [H.bare_types(n) for n in H.typed_objects(data)] == [[], ["a"], ["b"], ["c"], ["d"]]
    deep = {"@type": "T0"}
    at = deep
    for i in range(1, 9):
        at["x"] = {"@type": f"T{i}"}
        at = at["x"]
    assert [H.bare_types(n)[0] for n in H.typed_objects(deep)] == [f"t{i}" for i in range(7)]


def test_workers_hold_few_pages_at_once(spark, monkeypatch):
    """Facts take many times the bytes of their page: a batch of pages is turned into facts slice by slice."""
    sizes = [n for _, n in H.slices(pa.array(["x"] * 1000))]
    assert max(sizes) <= H.ROWS and sum(sizes) == 1000
    assert list(H.slices(pa.array(["x" * H.BYTES, None, "y" * H.BYTES * 2, "z", ""]))) == [(0, 1), (1, 2), (3, 2)] and list(H.slices(pa.array([], pa.string()))) == []
    monkeypatch.setattr(H, "ROWS", 2)
    rows = [("s", i, "http://[bad" if i == 3 else "u", None if i == 4 else f"<p>{i}</p>" + "<a href='http://[worse'>x</a>" * (i == 3)) for i in range(7)]
    got = H.parsed(spark.createDataFrame(rows, "site_id string, page_seq long, url string, html string").coalesce(1)).collect()
    assert [r["page_seq"] for r in got] == list(range(7)) and got[4]["f"] is None
    assert all(r["f"]["paragraphs"] == [str(i)] for i, r in enumerate(got) if i not in (3, 4))
