"""Names that clash, bytes that are no text, long texts; the discriminant and the mix against independent solutions."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from crawlens.llm import mixing, pieces, quality_model, quality_rules, secrets, similar, simhash, substrings, suffixes

CLASH = ("row", "text", "doc_id", "_secret_text", "_secret_base", "_secret_spans", "_mix_id", "copies", "copy", "_gone", "node", "first", "label", "_row", "_text", "key", "size", "source", "fail_bits", "words", "n", "counts")


@pytest.fixture(scope="module")
def clashing(spark):
    rng = random.Random(2)
    prose = [" ".join(rng.choice(["ba", "do", "ki", "lu", "men", "or", "ti", "su"]) + str(rng.randrange(90)) for _ in range(80)) for _ in range(8)]
    texts = [*prose, prose[0], prose[1] + " more", "password=abcdefghijklmnop1", None, ""]
    df = spark.createDataFrame([(i, t, f"s{i % 2}") for i, t in enumerate(texts)], "doc_id long, text string, source string")
    return df.select("doc_id", "text", "source", *(F.concat(F.lit(c), F.col("doc_id").cast("string")).alias(c) for c in CLASH if c not in ("doc_id", "text", "source"))).cache()


def test_stages_keep_columns_of_any_name(clashing):
    given = {r["doc_id"]: r for r in clashing.collect()}
    for stage in (quality_rules.kept, similar.one_of_each, secrets.redacted, mixing.copied):
        out = stage(clashing)
        assert out.columns == clashing.columns
        rows = out.collect()
        assert rows and all(r[c] == given[r["doc_id"]][c] for r in rows for c in clashing.columns if c != "text")
    assert {r["doc_id"]: r["text"] for r in secrets.redacted(clashing).collect()}[10] == "[secret]"
    assert 8 not in {r["doc_id"] for r in similar.one_of_each(clashing).collect()}
    assert secrets.scanned(clashing).count() == clashing.count()


def test_bytes_that_are_no_text(spark):
    """Latin-1 and halves of characters, between words."""
    raw = [b"caf\xe9 au lait " * 30, b"\xff\xfe\x00", b"ok words " * 40 + b"\xc3", "fine é".encode()]
    docs = spark.createDataFrame([(i, bytearray(x)) for i, x in enumerate(raw)], "doc_id long, raw binary").select("doc_id", F.col("raw").cast("string").alias("text"), F.lit("s").alias("source"))
    labels = spark.createDataFrame([(0, 1), (2, 0)], "doc_id long, quality int")
    n = docs.count()
    assert quality_rules.ledger(docs).count() == n and quality_model.scored(docs, labels).count() == n and simhash.near_duplicates(docs).count() == n and substrings.removed(docs).count() == n and suffixes.removed(docs).count() == n
    assert secrets.redacted(docs).count() == n and similar.one_of_each(docs).count() == n and mixing.mixed(docs).count() == n and quality_rules.kept(docs, ()).count() == n
    assert all(r["lossless"] for r in pieces.encoded(docs).collect())


def test_long_texts(spark):
    long = " ".join(hashlib.sha256(str(i).encode()).hexdigest()[: 3 + i % 9] for i in range(180_000))
    docs = spark.createDataFrame([(1, long), (2, "short one"), (3, long)], "doc_id long, text string").withColumn("source", F.lit("s"))
    assert {r["doc_id"]: r["n_words"] for r in quality_rules.ledger(docs).collect()} == {1: 180_000, 2: 2, 3: 180_000} if "n_words" in quality_rules.MEASURES else quality_rules.ledger(docs).count() == 3
    assert {r["doc_id"]: r["size"] for r in mixing.mixed(docs).collect()} == {1: 180_000, 2: 2, 3: 180_000}
    assert {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(docs).collect()} == {1: 1, 2: 2, 3: 1}
    assert {r["doc_id"]: r["n_removed"] for r in substrings.removed(docs).collect()} == {1: 0, 2: 0, 3: 180_000}
    assert {r["doc_id"]: r["n_removed"] for r in suffixes.removed(docs).collect()} == {1: 0, 2: 0, 3: len(long)}
    assert sorted(r["doc_id"] for r in similar.one_of_each(docs).collect()) == [1, 2]
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    assert quality_model.scored(docs, labels).count() == 3


def test_keys_in_paths(spark):
    rng = random.Random(6)
    key = lambda alphabet, n: "".join(rng.choice(alphabet) for _ in range(n))
    alnum, caps = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "0123456789ABCDEF"
    plain = [f"see /docs/{rng.choice(['users', 'people', 'orders'])}/list/of/all{i} and reports/for_the_year/{i}" for i in range(300)]
    keys = [("services/T00/B00/", key(alnum, 24)) for _ in range(60)] + [("blob/", key(caps, 40)) for _ in range(60)] + [("", key(alnum, 40)) for _ in range(60)]
    rows = secrets.scanned(spark.createDataFrame(list(enumerate([f"use {a}{k} now" for a, k in keys] + plain)), "doc_id int, text string")).cache()
    least = secrets.threshold(rows)
    hit = {r["doc_id"]: [(s["start"], s["end"]) for s in r["s"]] for r in rows.select("doc_id", secrets.all_spans(least).alias("s")).collect()}
    full = lambda i: any(a <= 4 + len(keys[i][0]) and b >= 4 + len(keys[i][0]) + len(keys[i][1]) for a, b in hit[i])
    found = [sum(full(i) for i in range(a, a + 60)) for a in (0, 60, 120)]
    assert min(found) >= 0.9 * 60, found
    assert sum(bool(hit[i]) for i in range(180, 480)) <= 6
    assert all(not (a[0] <= b[0] and b[1] <= a[1] and a != b) for spans in hit.values() for a in spans for b in spans)


def test_discriminant_is_that_of_the_definition(spark):
    """Against class statistics from the whole rows in numpy, densities through inverses and determinants."""
    rng = np.random.default_rng(4)
    d = quality_model.DIM
    mix = rng.normal(size=(2, d, d))
    x = np.concatenate([rng.normal(size=(300, d)) @ mix[0] + 0.4, rng.normal(size=(200, d)) @ mix[1]])
    y = np.repeat([1, 0], [300, 200])
    train = spark.createDataFrame([(int(a), [float(v) for v in b]) for a, b in zip(y, x)], "label int, x array<double>").repartition(5)
    model = quality_model.fitted(train)
    n = np.array([200, 300])
    means = [x[y == k].mean(axis=0) for k in (0, 1)]
    covs = [np.cov(x[y == k].T, bias=True) for k in (0, 1)]
    pooled = (200 * covs[0] + 300 * covs[1]) / 500
    scale = np.sqrt(np.diagonal(pooled) + 1e-6)
    at, density = rng.normal(size=(50, d)), []
    for k in (0, 1):
        z = (x[y == k] - means[k]) / scale
        s = z.T @ z / n[k]
        mu = np.trace(s) / d
        noise = sum(((np.outer(v, v) - s) ** 2).sum() for v in z) / n[k] ** 2
        a = min(1.0, max(0.02, noise / ((s - mu * np.eye(d)) ** 2).sum()))
        shrunk = (1 - a) * ((1 - quality_model.POOL) * s + quality_model.POOL * pooled / np.outer(scale, scale)) + a * max(mu, 0.05) * np.eye(d)
        assert abs(a - model.shrinkage[k]) < 1e-9
        v = (at - means[k]) / scale
        density.append(-0.5 * np.einsum("ij,jk,ik->i", v, np.linalg.inv(shrunk), v) - 0.5 * np.linalg.slogdet(shrunk)[1])
    want = 1 / (1 + np.exp(-np.clip((density[1] - density[0]) / quality_model.TEMPERATURE + np.log(300 / 200), -40, 40)))
    assert np.allclose(model.score(at), want, atol=1e-9)


def test_the_mix_solves_its_dual(spark):
    """Rates against a bisection in numpy, targets against water filling by hand, copies against the rates."""
    rng = random.Random(8)
    rows = [(i, " ".join(["w"] * int(rng.lognormvariate(3, 1.2))), src) for i, src in enumerate(rng.choices(["a", "b", "c", None], [1, 8, 3, 1], k=900))]
    got = mixing.mixed(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    size, of = {r[0]: len(r[1].split()) for r in rows}, {r[0]: r[2] for r in rows}
    names = ["a", "b", "c", None]
    total = {s: sum(size[i] for i in size if of[i] == s) for s in names}
    weight = dict(zip(names, (5, 2, 1, 5)))
    target, open_, left = {}, set(names), sum(total.values())
    while open_:
        share = {s: left * weight[s] / sum(weight[t] for t in open_) for s in open_}
        full = {s for s in open_ if share[s] > 3 * total[s]}
        if not full:
            target |= share
            break
        target |= {s: 3.0 * total[s] for s in full}
        left -= sum(3 * total[s] for s in full)
        open_ -= full
    for s in names:
        mine = [r for r in got if of[r["doc_id"]] == s]
        assert abs(mine[0]["target"] - target[s]) < 1e-6 * target[s] and mine[0]["source_size"] == total[s]
        w = np.array([r["size"] for r in mine], float)
        z = np.sqrt(w / w.mean())
        rate = lambda lam: np.minimum(3, np.exp(lam * z))
        if target[s] < 3 * total[s]:
            lo, hi = -60.0, 60.0
            for _ in range(200):
                mid = (lo + hi) / 2
                lo, hi = (mid, hi) if (w * rate(mid)).sum() < target[s] else (lo, mid)
            assert np.allclose([r["rate"] for r in mine], rate(lo), rtol=1e-4, atol=1e-9)
        assert sum(abs(r["copies"] - r["rate"]) >= 1 for r in mine) <= mixing.REPAIRS and all(0 <= r["copies"] <= 3 and r["taken"] == r["copies"] * r["size"] for r in mine)
        assert abs(sum(r["taken"] for r in mine) - target[s]) <= max(w.min(), 0.01 * target[s])
