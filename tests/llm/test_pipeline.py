"""The pipeline's stages on a small corpus, each against brute force on its own input."""

import random
import re

import corpus_pipeline
from crawlens.llm import common, mixing, pieces, quality_rules
from tests.llm.test_operators import base, prose

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    rng = random.Random(11)
    texts = [prose(rng, rng.randint(60, 300)) for _ in range(40)]
    texts += [texts[0], texts[1] + ".", texts[2].replace("ba", "be", 1), "too short", None, "", ("SHOUT WORDS!! " * 80).strip(), "again and " * 100, "bad### word*** soup&&& " * 40]
    texts += [prose(rng, 80) + " password=b7db7aa4a5fcc78305 " + prose(rng, 30) + " token: abcdefghijkl"]
    return [(i, t, "en", f"s{i % 4}", None if t is None else len(t)) for i, t in enumerate(texts)]


def rejected(text):
    m = dict(zip(quality_rules.MEASURES, quality_rules.measure(None if text is None else text.encode())))
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    upper, letters = sum(map(str.isupper, text or "")), sum(map(str.isalpha, text or ""))
    top = max((w.count(x) for x in set(w)), default=0)
    symbols = sum((text or "").count(c) for c in "#*$%&|<>")
    chars = sum(map(len, w))
    return (
        len(w) < 50 or 100 * m["n_repeat_words"] > 50 * len(w) or 10 * symbols > 3 * len(w) or 2 * upper > letters > 0
        or chars < 2 * len(w) or chars > 15 * len(w) or len(w) >= 20 and 10 * top > 4 * len(w)
    )


def test_stages(spark, tmp_path):
    rows = corpus()
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"file://{tmp_path}/documents.parquet")
    sf, docs = f"file://{tmp_path}", None
    seen, columns = [], [c.split()[0] for c in SCHEMA.split(", ")]
    docs = common.table(spark, sf, "documents")
    for name, stage in corpus_pipeline.STAGES:
        docs = common.stored(stage(spark, docs, sf), f"test-{name}")
        seen.append(docs)
    kept, unique, clean, mixed, encoded = seen
    assert all(s.columns == columns for s in seen[:4])
    ids = lambda df: sorted(r["doc_id"] for r in df.collect())
    assert ids(kept) == [i for i, t, *_ in rows if not rejected(t)]
    assert set(ids(kept)) - set(ids(unique)) >= {40} and 0 in ids(unique)
    texts = {r["doc_id"]: r["text"] for r in unique.collect()}
    for r in clean.collect():
        text, at, out = texts[r["doc_id"]], 0, []
        for a, _, b in base(text):
            out += [text[at:a], "[secret]"] if a >= at else []
            at = max(at, b)
        assert r["text"] == "".join(out) + text[at:] and r["n_chars"] == len(r["text"])
    copies = {r["doc_id"]: r["copies"] for r in mixing.mixed(clean).collect()}
    assert ids(mixed) == sorted(i for i, n in copies.items() for _ in range(n))
    final = {r["doc_id"]: r["text"] for r in clean.collect()}
    assert encoded.where("NOT lossless").count() == 0
    assert sorted((r["doc_id"], r["text"]) for r in pieces.decoded(encoded).collect()) == sorted((i, final[i]) for i in ids(mixed))
    assert corpus_pipeline.run(spark, sf).count() == encoded.count()
