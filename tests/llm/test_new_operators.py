"""Prefix trie, spelling variants and decontamination against brute force, and on odd tables."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F, types as T

from crawlens.llm import decontamination, prefix_trie, spellings

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# --- prefix trie ------------------------------------------------------------------------------------------------------
TURNS = "conv_id long, turn long, role string, text string, words string, place long, node string"


def said(role, text):
    role, text = (role or "").encode(), (text or "").encode()
    return hashlib.sha256(f"{len(role)}:".encode() + role + text).digest()


def brute_trie(rows, shared=True):
    convs = defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        if conv is not None:
            convs[conv].append(((turn is not None, turn or 0), said(role, text), role or "", text or ""))
    own = {c: [(r, t) for _, _, r, t in sorted(x)] for c, x in convs.items()}
    paths = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4 if shared else 0
        base = own.get(c - int(c - 20 * int(c / 20)), []) if shared else []
        paths[c] = tuple(base[:h] + turns[h:])
    members = defaultdict(list)
    for c in sorted(paths):
        for d in range(len(paths[c]) + 1):
            members[paths[c][:d]].append(c)
    kids = Counter(n[:-1] for n in members if n)
    out = []
    for node, ids in members.items():
        below = [n for n in members if n[: len(node)] == node]
        ends = ",".join(str(c) for c in ids if paths[c] == node)
        out.append((
            ids[0], len(node), members[node[:-1]][0] if node else None, len(ids), kids[node], sum(not kids[n] for n in below),
            sum((len(members[n]) - 1) * len(WORD.findall(n[-1][1])) for n in below if n), hashlib.sha256(ends.encode()).hexdigest(),
        ))
    return sorted(out, key=repr)


def trie_rows(df):
    cols = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)


def conversations(seed=3):
    rng = random.Random(seed)
    lines = ["hello there", "", None, "what is  it", "a\tb\nc", "é ü 漢字", "x"]
    rows = []
    for c in [*range(0, 45), 60, 61, 2040, 99_999, -5, -20, -40]:
        for turn in range(rng.randint(1, 6)):
            rows.append((c, turn if rng.random() < 0.9 else None, rng.choice(["user", "assistant", None]), rng.choice(lines), "w", 7, "n"))
    rows += [(7, 0, "user", "same turn", "w", 7, "n")] * 3 + [(None, 0, "user", "no conversation", "w", 7, "n"), (8, 2**62, "user", "late", "w", 7, "n")]
    return rows


def test_trie_is_the_brute_force_trie(spark):
    rows = conversations()
    turns = prefix_trie.placed(spark.createDataFrame(rows, TURNS).repartition(3)).cache()
    convs = turns.select("conv_id").distinct()
    assert trie_rows(prefix_trie.trie(convs, prefix_trie.rebuilt(turns))) == brute_trie(rows)
    assert trie_rows(prefix_trie.trie(convs, turns)) == brute_trie(rows, shared=False)


def test_trie_of_many_equal_and_of_long_conversations(spark):
    """3,000 copies of one conversation (several ranges of ids), and two of 1,500 turns that part at the end."""
    rows = [(c * 7, t, "user", f"copy {t}", "", 0, "") for c in range(3000) for t in range(2)]
    rows += [(c, t, "user", f"turn {t}" if t < 1499 else f"last {c}", "", 0, "") for c in (50_001, 50_002) for t in range(1500)]
    turns = prefix_trie.placed(spark.createDataFrame(rows, TURNS)).cache()
    got = {(r["depth"], r["conv_id"]): r for r in prefix_trie.trie(turns.select("conv_id").distinct(), turns).collect()}
    ids = ",".join(str(c * 7) for c in range(3000))
    assert got[2, 0]["n_convs"] == 3000 and got[2, 0]["ends_sha256"] == hashlib.sha256(ids.encode()).hexdigest()
    assert got[0, 0]["n_leaves"] == 3 and got[0, 0]["n_convs"] == 3002 and got[0, 0]["n_children"] == 2
    assert got[0, 0]["saved_tokens"] == 2999 * 4 + 1499 * 2
    assert got[1, 50_001]["saved_tokens"] == 1499 * 2 and got[1000, 50_001]["saved_tokens"] == 500 * 2
    assert got[1499, 50_001]["n_children"] == 2 and got[1500, 50_002]["parent_conv_id"] == 50_001


def test_turnless_conversations_are_members_of_the_root(spark):
    """A conversation whose own turns all lie before the shared part, and whose family has no first conversation."""
    conv = next(c for c in range(21, 40) if zlib.crc32(str(c).encode()) % 4 == 3)
    rows = [(conv, 0, "user", "gone", "", 0, ""), (41, 0, "user", None, "", 0, "")]
    turns = prefix_trie.placed(spark.createDataFrame(rows, TURNS))
    got = trie_rows(prefix_trie.trie(turns.select("conv_id").distinct(), prefix_trie.rebuilt(turns)))
    assert got == brute_trie(rows)
    assert any(r[1] == 0 and r[7] != hashlib.sha256(b"").hexdigest() for r in got)


def test_trie_of_nothing(spark):
    turns = prefix_trie.placed(spark.createDataFrame([], TURNS))
    assert prefix_trie.trie(turns.select("conv_id").distinct(), prefix_trie.rebuilt(turns)).count() == 0


# --- spelling variants --------------------------------------------------------------------------------------------------
DOCS = "doc_id long, text string, word string, n long, _text string, _row string, near string"


def edit(a, b):
    """Exactly one inserted, deleted or replaced character."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_variants(n):
    out = {}
    for w in n:
        close = sorted((x for x in n if edit(w, x)), key=lambda x: (-n[x], x))
        best = close[0] if close and n[close[0]] >= 2 * n[w] else None
        out[w] = [best, w, n[w], len(close), n[best] if best else None]
    for w in out:
        while (f := out[out[w][1]][0]) is not None:
            out[w][1] = f
    return {(w, *x) for w, x in out.items()}


def variant_rows(df):
    return {(r["word"], r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect()}


@pytest.mark.parametrize("seed, alphabet, longest", [(1, "ab", 8), (2, "abé", 7), (3, "abcdefÿ", 6), (4, "a", 12)])
def test_variants_are_those_of_brute_force(spark, seed, alphabet, longest):
    rng = random.Random(seed)
    n = {"".join(rng.choice(alphabet) for _ in range(rng.randint(5, longest))): rng.randint(3, 60) for _ in range(260)}
    assert variant_rows(spellings.variants(spark.createDataFrame(list(n.items()), "word string, n long"))) == brute_variants(n)


def test_words_with_hardly_a_common_prefix(spark):
    rng = random.Random(8)
    base = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyzàé") for _ in range(9)) for _ in range(40)]
    n = Counter()
    for w in base:
        n[w] += 50
        for _ in range(5):
            i, c = rng.randrange(9), rng.choice("abcxyzé")
            n[rng.choice([w[:i] + w[i + 1 :], w[:i] + c + w[i:], w[:i] + c + w[i + 1 :]])] += rng.randint(3, 30)
    assert variant_rows(spellings.variants(spark.createDataFrame(list(n.items()), "word string, n long"))) == brute_variants(n)


def test_a_word_with_a_neighbour_at_each_place_and_character(spark):
    n = {w: 3 for i in range(6) for c in "abcdefghijklmnopqrstuvwxyz" for w in ("mmmmmm"[:i] + c + "mmmmmm"[i + 1 :], "mmmmmm"[:i] + c + "mmmmmm"[i:])} | {"mmmmm": 3, "mmmmmm": 100}
    got = variant_rows(spellings.variants(spark.createDataFrame(list(n.items()), "word string, n long")))
    assert got == brute_variants(n)
    assert next(r for r in got if r[0] == "mmmmmm")[4] == len(n) - 1


def test_spellings_of_texts(spark):
    texts = ["Colour colour COLOUR colour color color color", "colours colours colours," + " färben FÄRBEN färben" * 3, None, "", "12 ab", "naïve naïve naïve naive naive naive " * 4, "long " * 300_000 + "strasse strasse strasse straße straße straße"]
    rows = [(i, t, "w", 1, "t", "r", "n") for i, t in enumerate(texts)] + [(None, "colour colour", "w", 1, "t", "r", "n")] * 2
    n = Counter()
    for i, t, *_ in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = re.sub("[A-Z]", lambda m: m[0].lower(), w)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            n[w if h % 97 else w[: h % len(w)] + w[h % len(w) + 1 :]] += 1
    n = {w: k for w, k in n.items() if len(w) >= 5 and k >= 3}
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    counted = spellings.counted(docs, change=spellings.spoiled)
    assert {r["word"]: r["n"] for r in counted.collect()} == n
    assert variant_rows(spellings.variants(counted)) == brute_variants(n)
    broken = spark.range(1).select(F.lit(1).cast("long").alias("doc_id"), F.unhex(F.lit("776f726473ff776f726473")).cast("string").alias("text"))
    assert [r["n"] for r in spellings.counted(broken, times=2).collect()] == [2]


def test_spellings_of_nothing(spark):
    assert spellings.variants(spellings.counted(spark.createDataFrame([], DOCS))).count() == 0


# --- decontamination ----------------------------------------------------------------------------------------------------
def cut(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_hits(docs, items, window=10):
    out = []
    for i, t, *_ in docs:
        w, hit, own = cut(t), set(), set()
        for item, text in items:
            x = cut(text)
            m = min(len(x), window)
            for a in range(len(x) - m + 1 if m else 0):
                for p in range(len(w) - m + 1):
                    if w[p : p + m] == x[a : a + m]:
                        hit |= set(range(p, p + m))
                        own.add("" if item is None else str(item))
        out.append((i, len(w), len(hit), len(own), sorted(own), bool(hit)))
    return sorted(out, key=repr)


def brute_longest(docs, items, window=10):
    out = {}
    for item, text in items:
        x = cut(text)
        for a in range(len(x)):
            need = window if len(x) >= window else len(x) if a == 0 else len(x) + 1
            best = 0
            for i, t, *_ in docs:
                w = cut(t)
                for p in range(len(w)):
                    k = 0
                    while a + k < len(x) and p + k < len(w) and w[p + k] == x[a + k]:
                        k += 1
                    best = max(best, k)
            if best >= need:
                out["" if item is None else str(item), a] = best
    return out


def contamination():
    rng = random.Random(12)
    vocabulary = ["ba", "do", "KI", "lu", "Men", "or", "ti", "été", "x1"]
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, prose(rng.randint(10, 60))) for i in range(8)] + [(20, "one two three"), (21, "Alone"), (22, "one two three"), (23, None), (24, "—!"), (None, prose(14)), (3, prose(12))]
    items.append((30, prose(5) + " " + items[1][1]))
    docs = [(i, prose(rng.randint(0, 80))) for i in range(12)]
    docs += [(12, prose(5) + ". " + items[1][1].upper() + "; " + prose(5)), (13, items[2][1].replace(" ", ", ")), (14, "so one, Two; THREE four"), (15, "alone"), (16, None), (17, ""), (18, "漢字 " * 30), (2, items[5][1] + " z " + items[5][1]), (None, items[0][1])]
    docs.append((19, "word " * 200_000 + items[4][1]))
    words = items[6][1].split()
    docs.append((40, " ".join(words[:9]) + " stop " + " ".join(words[-9:])))
    return [(*d, "w", 1, "t", "r", "n") for d in docs], items


def scores(df):
    return sorted(((r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], r["items"], r["contaminated"]) for r in df.collect()), key=repr)


@pytest.mark.parametrize("size, shard", [(decontamination.SLICE, decontamination.SHARD), (150, 100), (1, 1)])
def test_hits_are_those_of_brute_force(spark, size, shard):
    rows, items = contamination()
    short = [r for r in rows if r[0] != 19]
    docs, benchmark = spark.createDataFrame(short, DOCS).repartition(3), spark.createDataFrame(items, "item_id long, text string")
    assert scores(decontamination.scored(docs, benchmark, size=size, shard=shard)) == brute_hits(short, items)
    got = {(r["item_id"], r["place"]): r["words"] for r in decontamination.matches(docs, benchmark, size=size, shard=shard).collect()}
    by_id = brute_longest([r for r in short if r[0] is not None], [x for x in items if x[0] != 3])
    assert {k: v for k, v in got.items() if k[0] != "3"} == by_id


def test_longest_matches_name_a_place(spark):
    rows, items = contamination()
    docs, benchmark = spark.createDataFrame(rows, DOCS), spark.createDataFrame([x for x in items if x[0] != 3], "item_id long, text string")
    texts, own = {r[0]: cut(r[1]) for r in rows if r[0] != 2}, {"" if i is None else str(i): cut(t) for i, t in items if i != 3}
    found = decontamination.matches(docs.where("doc_id <> 2"), benchmark).collect()
    assert found
    for r in found:
        assert texts[r["doc_id"]][r["at"] : r["at"] + r["words"]] == own[r["item_id"]][r["place"] : r["place"] + r["words"]]


def test_long_documents_and_clean_ones(spark):
    rows, items = contamination()
    docs, benchmark = spark.createDataFrame(rows, DOCS).repartition(2), spark.createDataFrame(items, "item_id long, text string")
    one = next(r for r in decontamination.scored(docs, benchmark).collect() if r["doc_id"] == 19)
    assert one["contaminated"] and one["n_words"] == 200_000 + len(cut(items[4][1])) and one["n_hit"] == len(cut(items[4][1]))
    kept = decontamination.clean(docs, benchmark)
    assert kept.columns == docs.columns
    bad = {r[0] for r in brute_hits([r for r in rows if r[0] != 19], items) if r[5]} | {19}
    assert sorted((r["doc_id"] for r in kept.collect()), key=repr) == sorted((r[0] for r in rows if r[0] is None or r[0] not in bad), key=repr)


def test_decontamination_of_nothing(spark):
    rows, items = contamination()
    none, benchmark = spark.createDataFrame([], DOCS), spark.createDataFrame(items, "item_id long, text string")
    assert decontamination.scored(none, benchmark).count() == 0 and decontamination.matches(none, benchmark).count() == 0
    some = spark.createDataFrame(rows[:3], DOCS)
    got = decontamination.scored(some, spark.createDataFrame([], "item_id string, text string"))
    assert {(r["n_hit"], r["n_items"], r["contaminated"]) for r in got.collect()} == {(0, 0, False)}
    text_ids = some.withColumn("doc_id", F.concat(F.lit("d"), "doc_id"))
    assert isinstance(decontamination.scored(text_ids, benchmark).schema["doc_id"].dataType, T.StringType)
    broken = spark.range(1).select(F.lit(1).alias("doc_id"), F.unhex(F.lit("61ff62")).cast("string").alias("text"))
    assert decontamination.scored(broken, benchmark).head()["n_words"] == 1
