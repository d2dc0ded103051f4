"""The pipeline's near-duplicates against brute-force Jaccard."""

import random
from itertools import combinations

import corpus_pipeline
import numpy as np
import pytest
from crawlens.llm import similar


def shingled(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def components(sets):
    of = list(range(len(sets)))

    def top(i):
        while of[i] != i:
            i = of[i]
        return i

    for a, b in combinations(range(len(sets)), 2):
        if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
            a, b = sorted((top(a), top(b)))
            of[b] = a
    return [top(i) for i in range(len(sets))]


def edited(rng, text, n):
    words = text.split()
    for i in rng.sample(range(len(words)), n):
        words[i] = f"new{rng.randrange(10**6)}"
    return " ".join(words)


def corpus():
    rng = random.Random(3)
    fresh = lambda n: " ".join(f"w{rng.randrange(500)}" for _ in range(n))
    texts = [fresh(rng.randint(60, 250)) for _ in range(30)]
    texts += [edited(rng, t, k) for t in texts[:20] for k in (1, 3, 5, 8)]
    texts += [edited(rng, texts[20], rng.randint(1, 6)) for _ in range(60)]
    texts += [texts[21] + " " + fresh(rng.randint(10, 40)) for _ in range(20)] + [texts[3].upper(), None, "", " \n", "one two", "One  two", "one"]
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize("dense, long", [(64, 1000), (4, 120)])
def test_stage_is_brute_force(spark, monkeypatch, dense, long):
    monkeypatch.setattr(similar, "DENSE", dense)
    monkeypatch.setattr(similar, "LONG", long)
    texts = corpus()
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, source string").repartition(3)
    got = corpus_pipeline.near_duplicates(spark, docs, "")
    assert got.columns == docs.columns
    want = {c for c in components([shingled(t) for t in texts])}
    assert 0 < len(want) < len(texts) - 60
    assert sorted(r["doc_id"] for r in got.collect()) == sorted(want)


def test_odd_ids(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(80)) for x in "abc")
    rows = [(1, a), (2, b), (2, a + " end"), (2, b), (3, b + " end"), (None, a), (4, c)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(str, similar.one_of_each(docs).collect())) == sorted(map(str, spark.createDataFrame([(1, a), (2, b), (None, a), (4, c)], docs.schema).collect()))
    assert similar.one_of_each(docs.limit(0)).count() == 0


def test_sketches_rule_out_no_pair_at_the_bound():
    rng = np.random.default_rng(5)
    for n in (1, 7, 90, 900, 20_000):
        own = np.unique(rng.integers(0, 1 << 64, n, np.uint64))
        for share in (0.0, 0.02, 0.1, 0.3):
            other = np.unique(np.concatenate([own[int(share * n) :], rng.integers(0, 1 << 64, int(share * n), np.uint64)]))
            for words in (similar.WORDS, similar.WIDE):
                differ = sum(int(x).bit_count() for x in (similar.sketch(own, words) ^ similar.sketch(other, words)).view(np.uint64))
                assert differ <= len(np.setxor1d(own, other))
                assert bool(differ) == bool(share * n >= 1)
