"""Quotations of sites with few and with many of them, against a plain search."""

import random

from crawlens.operators import quotes


def test_many_quotations_do_not_travel_with_every_page(spark, monkeypatch):
    rng = random.Random(3)
    text = lambda n: "".join(rng.choice("abé 😀") for _ in range(n))
    pages = [(s, f"{s}{i}", "title", text(rng.randint(0, 40))) for s in ("few", "many") for i in range(40)] + [("many", "none", "title", None)]
    cut = lambda t: [t[i : i + n] for n in (1, 2, 4, 5, 9, 30) if len(t or "") >= n for i in [rng.randint(0, len(t) - n)]]
    asked = {(s, k, q) for s, _, k, t in pages for q in cut(t)} | {("many", "title", "zz"), ("many", "title", ""), ("many", "title", None)}
    asked = [x for x in sorted(asked, key=str) if x[0] == "many"] + [x for x in sorted(asked, key=str) if x[0] == "few"][:20]
    given, postings = [], quotes.postings
    monkeypatch.setattr(quotes, "postings", lambda texts, cut: given.append(cut) or postings(texts, cut))
    got = quotes.places(spark.createDataFrame(asked, "site_id string, kind string, quote string"), spark.createDataFrame(pages, "site_id string, url string, kind string, text string")).collect()
    wanted = {(s, k, q, u) for s, k, q in asked if q for t_s, u, t_k, t in pages if (s, k) == (t_s, t_k) and t is not None and q in t}
    assert sorted(map(tuple, got)) == sorted(wanted) and {s for s, *_ in wanted} == {"few", "many"}
    assert {r["site_id"] for r in given[0].select("site_id").distinct().collect()} == {"few"}
