"""Quality rules as a bitmask ledger.

Every rule is measured once per document. The ledger holds the measurements and one
bit per failed rule, so that policies (masks of rejecting rules) and ablations are
bitwise expressions over the ledger and never read a text again.

Defined cases: a null or empty text has no words and fails ``short``; one very long
text is handled in one pass of linear memory; repeated rows give repeated ledger rows;
an empty table gives an empty ledger; other columns of the input are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from crawlens.llm.common import texts

BLANKS = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"
ASCII = bytes(range(128))
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters", "top_word")


@dataclass(frozen=True)
class Rule:
    """``fails`` is SQL over the measurements; ``bit`` never changes once published."""

    name: str
    bit: int
    fails: str


RULES = (
    Rule("short", 0, "n_words < 50"),
    Rule("repeated_windows", 1, "100 * n_repeat_words > 50 * n_words"),
    Rule("symbols", 2, "10 * n_symbols > 3 * n_words"),
    Rule("repeated_lines", 3, "n_lines >= 4 AND 10 * n_dup_lines > 3 * n_lines"),
    Rule("shouting", 4, "n_letters > 0 AND 2 * n_upper > n_letters"),
    Rule("word_length", 5, "n_words > 0 AND (word_chars < 2 * n_words OR word_chars > 15 * n_words)"),
    Rule("one_word", 6, "n_words >= 20 AND 10 * top_word > 4 * n_words"),
)
BASE = ("short", "repeated_windows")
#: Versioned policies: the rules whose failure rejects a document.
POLICIES = {
    "v1": BASE,
    "v2": ("short", "repeated_windows", "symbols", "repeated_lines", "shouting", "word_length", "one_word"),
}


def mask(names, rules=RULES) -> int:
    bits = {r.name: r.bit for r in rules}
    return sum(1 << bits[n] for n in names)


def numbered(words: list[bytes]) -> np.ndarray:
    """The words as numbers in the order of first occurrence."""
    seen: dict[bytes, int] = {}
    return np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))


def repeated_words(ids: np.ndarray, width: int = 3) -> int:
    """Words that lie in a window of ``width`` words that occurs twice or more in the text."""
    n = len(ids) - width + 1
    if n < 2:
        return 0
    span = int(ids.max()) + 1
    key, size = ids[:n], span
    for i in range(1, width):
        if size * span >= 2**62:  # renumber before the key would overflow
            key = np.unique(key, return_inverse=True)[1]
            size = int(key.max()) + 1
        key, size = key * span + ids[i : i + n], size * span
    order = key.argsort(kind="stable")
    ranked = key[order]
    same = ranked[1:] == ranked[:-1]
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(len(ids), bool)
    for i in range(width):
        covered[i : i + n] |= twice
    return int(covered.sum())


def measure(text: bytes | None) -> tuple[int, ...]:
    """The measurements of one text, in the order of MEASURES."""
    text = text or b""
    ids = numbered(text.split())
    lines = [x for x in text.split(b"\n") if x.strip(BLANKS)]
    of = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    wide = text.translate(None, ASCII).decode(errors="replace")
    upper = int(of[65:91].sum()) + sum(map(str.isupper, wide))
    return (
        len(ids),
        len(text) - int(of[0x80:0xC0].sum()) - int(of[list(BLANKS)].sum()),
        int(of[list(SYMBOLS)].sum()),
        len(lines) - len(set(lines)),
        repeated_words(ids),
        len(lines),
        upper,
        int(of[65:91].sum() + of[97:123].sum()) + sum(map(str.isalpha, wide)),
        int(np.bincount(ids).max()) if len(ids) else 0,
    )


def _bits(rules: tuple[Rule, ...]) -> Column:
    bits = F.lit(0).cast("long")
    for r in rules:
        bits = bits.bitwiseOR(F.when(F.expr(r.fails), F.lit(1 << r.bit)).otherwise(F.lit(0)).cast("long"))
    return bits


def ledger(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its id, every measurement, and ``fail_bits``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = np.array([measure(t) for t in texts(b, "_text")], np.int64).reshape(-1, len(MEASURES))
            yield pa.RecordBatch.from_arrays([b.column("_id"), *(pa.array(rows[:, i]) for i in range(len(MEASURES)))], names=["doc_id", *MEASURES])

    kind = docs.schema[id_col].dataType.simpleString()
    ddl = f"doc_id {kind}, " + ", ".join(f"{m} long" for m in MEASURES)
    measured = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).mapInArrow(run, ddl)
    return measured.withColumn("fail_bits", _bits(rules))


def kept(docs: DataFrame, policy: str | tuple[str, ...] = "v2", rules: tuple[Rule, ...] = RULES, text_col: str = "text") -> DataFrame:
    """The documents that the policy keeps, with their own columns; no join, so repeated rows and null ids are no matter."""
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = b.column("_row").field(text_col).cast(pa.binary()).to_pylist()
            rows = np.array([measure(t) for t in own], np.int64).reshape(-1, len(MEASURES))
            yield pa.RecordBatch.from_arrays([b.column("_row"), *(pa.array(rows[:, i]) for i in range(len(MEASURES)))], names=["_row", *MEASURES])

    measured = whole.mapInArrow(run, T.StructType([*whole.schema.fields, *(T.StructField(m, T.LongType()) for m in MEASURES)]))
    return measured.withColumn("fail_bits", _bits(rules)).where(passes(policy, rules)).select("_row.*")


def passes(policy: str | tuple[str, ...], rules: tuple[Rule, ...] = RULES) -> Column:
    """True for ledger rows that no rule of the policy rejects."""
    names = POLICIES[policy] if isinstance(policy, str) else policy
    return F.col("fail_bits").bitwiseAND(F.lit(mask(names, rules))) == 0


def ablation(rows: DataFrame, policy: str | tuple[str, ...], rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Per rule of the policy: documents it fails, fails alone, and what the policy keeps without it; one aggregation of the ledger's bits."""
    names = POLICIES[policy] if isinstance(policy, str) else policy
    whole = mask(names, rules)
    counted = rows.groupBy(F.col("fail_bits").bitwiseAND(F.lit(whole)).alias("bits")).agg(F.count("*").alias("n"))
    one = F.array(*(F.struct(F.lit(n).alias("rule"), F.lit(mask([n], rules)).alias("bit")) for n in names))
    bit = F.col("r.bit")
    return (
        counted.select("bits", "n", F.explode(one).alias("r"))
        .groupBy(F.col("r.rule").alias("rule"))
        .agg(
            F.sum(F.when(F.col("bits").bitwiseAND(bit) != 0, F.col("n")).otherwise(0)).alias("n_failed"),
            F.sum(F.when(F.col("bits") == bit, F.col("n")).otherwise(0)).alias("n_failed_alone"),
            F.sum(F.when(F.col("bits").bitwiseAND(F.bitwise_not(bit)) == 0, F.col("n")).otherwise(0)).alias("n_kept_without"),
        )
    )


def query(spark, sf_dir):
    from crawlens.llm.common import table

    rows = ledger(table(spark, sf_dir, "documents"))
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (~passes(BASE)).alias("base_failed"), passes("v2").alias("kept"), "fail_bits",
    )


_FAIL_BITS = " + ".join(f"CASE WHEN {r.fails.replace('top_word', 'coalesce(top_word, 0)')} THEN {1 << r.bit} ELSE 0 END" for r in RULES)
ORACLE = rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines FROM documents
), tri AS (SELECT doc_id, p, w[p] || ' ' || w[p + 1] || ' ' || w[p + 2] AS s FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 2)) AS p FROM d)
), twice AS (SELECT doc_id, p FROM (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, s) AS n FROM tri) WHERE n > 1
), rep AS (SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, unnest([p, p + 1, p + 2]) AS q FROM twice) GROUP BY doc_id
), top AS (SELECT doc_id, max(n) AS n FROM (SELECT doc_id, x, count(*) AS n FROM (SELECT doc_id, unnest(w) AS x FROM d) GROUP BY 1, 2) GROUP BY 1
), m AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words, CAST(len(lines) AS BIGINT) AS n_lines, top.n AS top_word,
         length(regexp_replace(t, '[^\p{{Lu}}]', '', 'g')) AS n_upper, length(regexp_replace(t, '[^\p{{L}}]', '', 'g')) AS n_letters
  FROM d LEFT JOIN rep USING (doc_id) LEFT JOIN top USING (doc_id)
), b AS (SELECT *, CAST({_FAIL_BITS} AS BIGINT) AS fail_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, fail_bits & {mask(BASE)} <> 0 AS base_failed, fail_bits & {mask(POLICIES["v2"])} = 0 AS kept, fail_bits FROM b
"""
