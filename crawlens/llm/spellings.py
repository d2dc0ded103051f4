"""Spelling variants by errata-trie merging: which words of a corpus are one edit apart, and which is the usual form.

The words stand in a trie. At each node the child with most words below it is the heavy one, the others are light, and so is
a word that ends there. Merging what is light at a node, with one character skipped or replaced, into the rest of the node's subtree
finds every pair of words one edit apart, where two terminals coincide:

* two words that differ in their character at the node: both light, they meet under (prefix, suffix); one heavy, the light word
  with the heavy character in place of its own is looked up;
* a longer and a shorter word: if the additional character is light, the longer word is looked up without it; if it is
  the heavy one, the shorter word is light there and is looked up with it.

An additional character that repeats its neighbours counts at the last of them, so that each pair is found once, at one
node. A word is light at no more than log2 of the number of words nodes of its path (small to large), so that this is the number of its
records, not its length.

A node is a prefix, and the trie is a table of them: weights are counts by (prefix, next character), combined before their shuffle,
and a word meets the heavy characters of its path by a join. The prefixes that a large share of words has are the short ones; those of up to SHORT characters are at most
the alphabet to that power and are broadcast. Words under one (prefix, suffix) are no more than the alphabet.

Defined cases: null and empty texts have no words; a null id counts as the empty text; repeated rows and ids count as given; bytes that are not
UTF-8 end a word; texts of any length are read whole; ties between near words go to the smallest in code-point order; without words the result is
empty; other columns, whatever their names, are not looked at.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from crawlens.llm.common import stored, table, texts

RUN = re.compile("[A-Za-zÀ-ÿ]+")
ALPHABET = 26 + 64  # different characters of a word, at most
LENGTH, TIMES, GAIN = 5, 3, 2
SHORT = 2
HELD = 200_000  # different words that a worker counts before it hands them on
RATE = 97


def spoiled(doc: str, word: str) -> str:
    """One in RATE words of a document loses a character, by a checksum of both."""
    h = zlib.crc32(f"{doc}:{word}".encode())
    if h % RATE:
        return word
    at = h % len(word)
    return word[:at] + word[at + 1 :]


def counted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, times: int = TIMES, change: Callable[[str, str], str] | None = None) -> DataFrame:
    """``(word, n)``: the words of at least ``length`` characters and ``times`` occurrences, only A-Z lower-cased. ``change(id, word)`` may replace a document's word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[str] = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["word", "n"])

        for b in batches:
            for doc, text in zip(b.column("_id").to_pylist(), texts(b, "_text")):
                for word, n in Counter(RUN.findall((text or b"").lower().decode(errors="replace"))).items():
                    word = change(doc, word) if change else word
                    if len(word) >= length:
                        total[word] += n
                if len(total) >= HELD:
                    yield out()
                    total.clear()
        if total:
            yield out()

    own = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    return own.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= times)


def _heavy(words: DataFrame) -> DataFrame:
    """``(prefix, heavy)`` of the nodes where words part."""
    step = words.select("word", F.explode(F.sequence(F.lit(0), F.length("word"))).alias("at"))
    edges = step.select(F.left("word", F.col("at")).alias("prefix"), F.substring("word", F.col("at") + 1, F.lit(1)).alias("next"))
    weights = edges.groupBy("prefix", "next").agg(F.count("*").alias("weight"))
    most = F.max(F.when(F.col("next") != "", F.struct("weight", "next")))
    return weights.groupBy("prefix").agg(F.count("*").alias("ways"), most["next"].alias("heavy")).where("ways > 1").select("prefix", "heavy")


def _light(words: DataFrame, heavy: DataFrame) -> DataFrame:
    """``(word, n, prefix, own, rest, heavy)`` for each node of its path where a word is light; ``own`` is empty where the word ends."""
    step = words.select("word", "n", F.explode(F.sequence(F.lit(0), F.length("word"))).alias("at")).select("word", "n", "at", F.left("word", F.col("at")).alias("prefix"))
    top = step.where(F.col("at") <= SHORT).join(F.broadcast(heavy.where(F.length("prefix") <= SHORT)), "prefix")
    deep = step.where(F.col("at") > SHORT).join(heavy.where(F.length("prefix") > SHORT), "prefix")
    own, rest = F.substring("word", F.col("at") + 1, F.lit(1)), F.substring("word", F.col("at") + 2, F.length("word"))
    return top.unionByName(deep).select("word", "n", "prefix", own.alias("own"), rest.alias("rest"), "heavy").where("own <> heavy")


def near(words: DataFrame) -> DataFrame:
    """``(word, n_near, near_n, near)`` for the words with others one edit away: how many, and the most frequent of them. ``words(word, n)``, distinct."""
    light = stored(_light(words, stored(_heavy(words), "heavy")), "light")
    inner = F.col("own") != ""
    targets = F.array(
        F.when(inner, F.concat("prefix", "heavy", "rest")),
        F.when(inner & (F.left("rest", F.lit(1)) != F.col("own")), F.concat("prefix", "rest")),
        F.concat("prefix", "heavy", "own", "rest"),
    )
    asked = light.select("word", "n", F.explode(F.array_compact(targets)).alias("other"))
    met = stored(asked.join(words.select(F.col("word").alias("other"), F.col("n").alias("other_n")), "other"), "met")
    one = F.lit(1).cast("long").alias("k")
    pairs = met.select("word", one, F.col("other_n").alias("m"), F.col("other").alias("near")).unionByName(met.select(F.col("other").alias("word"), one, F.col("n").alias("m"), F.col("word").alias("near")))
    member = F.struct((-F.col("n")).alias("less"), "word")
    groups = light.where(inner).groupBy("prefix", "rest").agg(F.array_sort(F.collect_list(member)).alias("all")).where(F.size("all") > 1)  # ALPHABET members at most
    each = groups.select("all", F.posexplode("all").alias("i", "own")).select("all", "own", F.when(F.col("i") == 0, F.col("all")[1]).otherwise(F.col("all")[0]).alias("best"))
    merged = each.select("own.word", (F.size("all") - 1).cast("long").alias("k"), (-F.col("best.less")).alias("m"), F.col("best.word").alias("near"))
    best = F.min(F.struct((-F.col("m")).alias("less"), "near"))
    return pairs.unionByName(merged).groupBy("word").agg(F.sum("k").alias("n_near"), best.alias("best")).select("word", "n_near", (-F.col("best.less")).alias("near_n"), F.col("best.near").alias("near"))


def _roots(forms: DataFrame) -> DataFrame:
    """``(word, root)``: forms followed to the last, twice as far in each round. Each form is GAIN times as frequent as its word, so that ways are short."""
    roots = stored(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        further = roots.select(F.col("word").alias("root"), F.col("root").alias("further"))
        roots = stored(roots.join(further, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        if not roots.where("moved").limit(1).count():
            return roots.select("word", "root")
        roots = roots.select("word", "root")


def variants(words: DataFrame, gain: int = GAIN) -> DataFrame:
    """``(word, form, root, n, n_near, form_n)`` for all of ``words(word, n)``: a word's form is its most frequent near word, if that is ``gain`` times as frequent."""
    words = stored(words, "words")
    known = words.join(near(words), "word", "left")
    is_form = F.col("near_n") >= gain * F.col("n")
    known = stored(known.select("word", F.when(is_form, F.col("near")).alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(is_form, F.col("near_n")).alias("form_n")), "forms")
    roots = _roots(known.where("form IS NOT NULL"))
    return known.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def query(spark, sf_dir):
    return variants(counted(table(spark, sf_dir, "documents"), change=spoiled))


#: crc32 bit by bit over UTF-8 bytes; pairs from all words with one character left out or blanked.
ORACLE = r"""
WITH RECURSIVE runs AS (
  SELECT doc_id, w, count(*) AS k FROM (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{C0}-\x{FF}]+')) AS w FROM documents)
  GROUP BY ALL
), bytes AS (SELECT w, k, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || w)) AS x FROM runs),
sums AS (
  SELECT w, k, xor(list_reduce(list_transform(range(length(x) // 2), lambda i: CAST('0x' || substr(x, 2 * i + 1, 2) AS BIGINT)),
    lambda a, b: list_reduce(list_prepend(xor(a, b), CAST(range(8) AS BIGINT[])), lambda y, i: xor(y >> 1, (y & 1) * 3988292384)), 4294967295), 4294967295) AS h FROM bytes
), words AS (
  SELECT word, CAST(sum(k) AS BIGINT) AS n
  FROM (SELECT CASE WHEN h % 97 = 0 THEN left(w, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word, k FROM sums)
  WHERE length(word) >= 5 GROUP BY word HAVING sum(k) >= 3
), cut AS (SELECT word, n, i, left(word, i) || substr(word, i + 2) AS less, left(word, i) || '*' || substr(word, i + 2) AS blank FROM (SELECT word, n, unnest(range(length(word))) AS i FROM words)),
pairs AS (
  SELECT a.word, b.word AS other, b.n AS m FROM cut a JOIN cut b USING (blank) WHERE a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM cut a JOIN words b ON a.less = b.word
  UNION SELECT b.word, a.word, a.n FROM cut a JOIN words b ON a.less = b.word
), best AS (SELECT word, count(*) AS n_near, min_by(other, struct_pack(m := -m, o := encode(other))) AS other, max(m) AS m FROM pairs GROUP BY word),
forms AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 2 * n THEN other END AS form, CASE WHEN m >= 2 * n THEN m END AS form_n FROM words w LEFT JOIN best USING (word)),
way(word, now) AS (SELECT word, word FROM forms UNION ALL SELECT way.word, f.form FROM way JOIN forms f ON f.word = way.now WHERE f.form IS NOT NULL),
roots AS (SELECT way.word, way.now AS root FROM way JOIN forms f ON f.word = way.now WHERE f.form IS NULL)
SELECT word, form, root, n, CAST(n_near AS BIGINT) AS n_near, CAST(form_n AS BIGINT) AS form_n FROM forms JOIN roots USING (word)
"""
