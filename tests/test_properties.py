"""Many generated cases in one job each, against an independent reading of the rules."""

import random
import re

from pyspark.sql import functions as F

from crawlens.functions import text as X, urls as U
from crawlens.operators import robots


def matches(rule: str, path: str) -> bool:
    """A rule as a walk over its parts: literal runs in order, anchored at the start, at the end only after ``$``."""
    end = rule.endswith("$")
    parts = (rule[:-1] if end else rule).split("*")
    if not path.startswith(parts[0]):
        return False
    at = len(parts[0])
    for i, part in enumerate(parts[1:], 1):
        if end and i == len(parts) - 1:
            return len(path) - len(part) >= at and path.endswith(part)
        found = path.find(part, at)
        if found < 0:
            return False
        at = found + len(part)
    return not end or at == len(path)


def test_longest_match(spark):
    rng = random.Random(7)
    files, asked, want = [], [], {}
    for n in range(60):
        site = f"s{n}"
        rules = [(rng.random() < 0.5, "/" + "".join(rng.choice("ab*/.") for _ in range(rng.randint(0, 4))) + rng.choice(["", "", "$"])) for _ in range(rng.randint(1, 5))]
        files.append((site, "User-agent: *\n" + "\n".join(("Allow: " if a else "Disallow: ") + p for a, p in rules)))
        for _ in range(8):
            path = "/" + "".join(rng.choice("ab/.") for _ in range(rng.randint(0, 5)))
            hits = [(len(p.replace("*", "").replace("$", "")), a) for a, p in rules if matches(p, path)]
            want[site, path] = max(hits)[1] if hits else True
            asked.append((site, "Googlebot", path))
    got = robots.decisions(robots.rules(spark.createDataFrame(files, "site_id string, text string")), spark.createDataFrame(asked, "site_id string, agent string, path string"))
    assert {(r["site_id"], r["path"]): r["allowed"] for r in got.collect()} == want


def test_amounts_in_either_notation(spark):
    rng = random.Random(8)
    rows = []
    for _ in range(300):
        whole, cents = rng.randint(0, 10 ** rng.randint(1, 8)), rng.randint(0, 99)
        grouped = f"{whole:,}"
        rows += [(f"{grouped}.{cents:02d}", whole + cents / 100), (grouped.replace(",", ".") + f",{cents:02d}", whole + cents / 100), (grouped, float(whole)), (grouped.replace(",", " ") + f",{cents:02d}", whole + cents / 100)]
    got = spark.createDataFrame(rows, "a string, want double").select("a", "want", X.amount(F.col("a")).alias("got")).collect()
    assert [r for r in got if abs((r["got"] if r["got"] is not None else -1) - r["want"]) > 0.005] == []


def test_normal_forms_are_fixed_points(spark):
    rng = random.Random(9)
    urls = [f"{rng.choice(['http', 'https'])}://{rng.choice(['A.b', 'www.C.d:80', 'x'])}{'/'.join([''] + [rng.choice(['a', 'B', 'c;p=1', '']) for _ in range(rng.randint(0, 3))])}{rng.choice(['', '?q=1', '?', '#f', '?q=1#f'])}" for _ in range(300)]
    d = spark.createDataFrame([(u,) for u in urls], "u string").select("u", U.normalised(F.col("u")).alias("n")).withColumn("again", U.normalised(F.col("n")))
    for r in d.collect():
        assert not re.search("#|//.*[A-Z].*?(/|$)", r["n"].split("?")[0].split("/", 3)[2]) and "#" not in r["n"]
        if ";" not in r["u"] and "//" not in r["u"].split("://")[1] and not r["n"].split("?")[0].endswith("/"):
            assert r["n"] == r["again"]


def test_roles_of_single_words(spark):
    for role, words in U.ROLE_WORDS:
        d = spark.createDataFrame([(f"Our {w}",) for w in words] + [(f"{w} of mountains",) for w in words], "t string").select("t", U.role_of_words(F.col("t")).alias("r"))
        assert all(r["r"] == (None if "mountains" in r["t"] else role) for r in d.collect())
