"""The randomness battery, its p-value and the step-up procedure against plain Python."""

import math
import random

import pytest
from crawlens.llm import secrets

L, D = "abcdefghijklmnopqrstuvwxyz", "0123456789"
SORTS = {"HEX": D + "ABCDEF", "base32": L.upper() + "234567", "base36": D + L, "BASE36": D + L.upper(), "alphanumeric": D + L + L.upper(), "base64": L + L.upper() + D + "+/", "base64url": L + L.upper() + D + "-_"}
PLAIN = ["thisisaverylongcompoundwordindeed2", "2024-01-02-some-long-page-slug-name", "zzzzzzzzzzzzzzzzzzzzzzzzz1", "THISISALLCAPSANDLONG22", "aCamelCaseNameForAThing2", "0000000000000000000000000000000000000a", "x" * 2000 + "1", "a1" * 20]


def battery(body):
    """(weight, p or None where the draws are not uniform) of one candidate."""
    body = body.rstrip("=")
    alphabet, rate = next((a, r) for _, a, r in secrets.ALPHABETS if set(body) <= set(a))
    v, n, k = [alphabet.index(c) for c in body], len(body), len(alphabet)
    squares = sum(v.count(x) ** 2 for x in set(v))
    chi = k / n * squares - n
    z1 = (chi - (k - 1)) / math.sqrt(2 * (k - 1) * (n - 1) / n)
    high = [2 * x >= k for x in v]
    n1 = sum(high)
    mixed = 2 * n1 * (n - n1)
    mean = sum(v) / n
    spread = sum((x - mean) ** 2 for x in v)
    weight = min(n, 64) / 32
    uniform = spread > 0 and mixed > n
    if uniform:
        runs = 1 + sum(a != b for a, b in zip(high, high[1:]))
        z2 = (runs - mixed / n - 1) / math.sqrt(mixed * (mixed - n) / (n * n * (n - 1)))
        z3 = (sum((a - mean) * (b - mean) for a, b in zip(v, v[1:])) / spread + 1 / n) * math.sqrt(n)
        uniform = max(abs(z1), abs(z2), abs(z3)) <= secrets.LIMIT
    equal, usual = sum(v.count(x) * (v.count(x) - 1) // 2 for x in set(v)), secrets.KAPPA * n * (n - 1) / 2
    even = (usual - equal) / math.sqrt(usual + secrets.CLUMPS * n**3)
    kind = [0 if c in D else 1 if c in L else 2 if c in L.upper() else 3 for c in body]
    near = [(a, b) for a, b in zip(kind, kind[1:]) if 3 not in (a, b)]
    turns, pairs = sum(a != b for a, b in near), len(near)
    tail = sum(math.comb(pairs, t) * rate**t * (1 - rate) ** (pairs - t) for t in range(turns, pairs + 1)) if turns > pairs * rate else 1.0
    u = [float(c in "aeiouyAEIOUY") for c in body]
    m = sum(u) / n
    sway, swing = sum((x - m) ** 2 for x in u), sum((a - m) * (b - m) for a, b in zip(u, u[1:]))
    serial = (math.atanh(max(-0.99, min(0.99, swing / sway))) - math.atanh(secrets.RHO)) * math.sqrt(n - 3) if sway > 1e-12 else 0.0
    normal = lambda z: 0.5 * math.exp(-z * z / 2) if z > 0 else 1.0
    s = -(math.log(max(tail, 1e-300)) + math.log(max(normal(even), 1e-300)) + math.log(max(normal(serial), 1e-300)))
    return weight, math.exp(-s) * (1 + s + s * s / 2) if uniform else None


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(6)
    keys = [(name, n, "".join(rng.choice(a) for _ in range(n))) for name, a in SORTS.items() for n in (24, 32, 40, 64) for _ in range(12)]
    keys = [k for k in keys if set(k[2]) & set(D) and set(k[2]) - set(D) and k[2].strip("=+/_-") == k[2]]
    table = keys + [("text", 0, t) for t in PLAIN]
    df = spark.createDataFrame([(i, f"use {t} now") for i, (_, _, t) in enumerate(table)], "doc_id int, text string")
    return table, secrets.scanned(df).select("doc_id", secrets.BASE, secrets.TESTED).cache()


def test_battery_and_threshold(rows):
    table, scanned = rows
    seen = {}
    for r in scanned.collect():
        text = f"use {table[r['doc_id']][2]} now"
        for x in r[secrets.TESTED]:
            seen[r["doc_id"], text[x["start"] : x["end"]]] = x
    assert len(seen) >= len(table) - 20
    loose, all_ = 0, []
    for (_, body), x in seen.items():
        weight, p = battery(body)
        assert x["weight"] == pytest.approx(weight)
        want = -1 if p is None else max(0, min(secrets.BINS - 1, math.floor(-50 * (math.log10(max(p, 1e-79)) - math.log10(weight)))))
        # Tails are bounds in SQL and exact here: the operator is never the bolder one, and near it.
        assert (want == -1) == (x["bin"] == -1) and x["bin"] <= want + 1
        loose = max(loose, (want - x["bin"]) if want < 1000 else 0)
        all_.append((p, weight))
    assert loose <= 25  # half a decade
    bins = [x["bin"] for x in seen.values()]
    whole = sum(x["weight"] for x in seen.values())
    fit = [b for b in set(bins) if b >= 0 and 10 ** (-b / 50) <= secrets.RATE * sum(c >= b for c in bins) / whole]
    assert secrets.threshold(scanned) == min(fit)
    # The plain procedure on exact p-values finds what the bins find, and hardly more.
    order = sorted((p / w, w) for p, w in all_ if p is not None)
    most = max(i + 1 for i, (q, _) in enumerate(order) if q <= secrets.RATE * (i + 1) / whole)
    found = sum(b >= min(fit) for b in bins)
    assert 0.9 * most <= found <= most


def test_recall_by_alphabet_and_length(rows):
    table, scanned = rows
    least = secrets.threshold(scanned)
    hit, of = {}, {}
    for r in scanned.select("doc_id", secrets.all_spans(least).alias("s")).collect():
        name, n, _ = table[r["doc_id"]]
        of[name, n] = of.get((name, n), 0) + 1
        hit[name, n] = hit.get((name, n), 0) + any(x["kind"] == 3 or name != "text" for x in r["s"])  # two of the plain ones are hex, a base kind
    assert hit["text", 0] == 0
    assert sum(hit[x] for x in hit if x[1] >= 32) >= 0.9 * sum(of[x] for x in of if x[1] >= 32)
    assert all(hit[x] >= 0.8 * of[x] for x in of if x[1] == 64)


def test_no_candidates_and_an_empty_table(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "plain words")], "doc_id int, text string")
    assert secrets.threshold(secrets.scanned(df)) == secrets.BINS
    assert secrets.threshold(secrets.scanned(df.limit(0))) == secrets.BINS


def test_a_text_of_megabytes(spark):
    rng = random.Random(9)
    key = "".join(rng.choice(SORTS["alphanumeric"]) for _ in range(48))
    text = "some plain words of text " * 60_000 + key + " password=abcdefghijklmnop " + "y" * 500_000
    r = secrets.scanned(spark.createDataFrame([(1, text)], "doc_id int, text string")).head()
    assert {text[x["start"] : x["end"]] for x in r[secrets.TESTED]} == {key}
    assert [text[x["start"] : x["end"]] for x in r[secrets.BASE]] == ["password=abcdefghijklmnop"]
