"""Secret scans in DataFrame operations only: three base kinds, and a randomness test battery for what they miss.

Base kinds: ``assign`` (a credential name, a separator and a value of 12 characters or more), ``access`` (``AKIA`` ids of
18 or more) and ``hex`` (16 or more hex digits). All matches of a kind are leftmost and do not overlap.

The battery looks at runs of 20 or more characters of ``[A-Za-z0-9+/_=-]`` that no base span overlaps and that hold
letters and digits. A run is cut at every '=' but the padding at its end, and a piece that no alphabet fits at '/' and '+', at '_' and '-',
and at all four; each part of 20 characters or more is a candidate of its own, and candidates may overlap. The encoding is inferred from the characters (hex, base32, base 36,
alphanumeric, base64 or its URL form). The battery's three tests are asked twice.

* Could these be uniform draws from the alphabet? Chi-squared uniformity, runs above and below the middle, and lag-one
  serial correlation must each stay within LIMIT standard deviations (together one in a thousand).
* Would ordinary text look so random? Uniformity: text repeats its letters, so that at least KAPPA of the pairs of characters are equal (the chi-squared statistic
  is a function of that count). Runs: neighbours of text seldom change between digits, small letters and capitals (RATES, by encoding; marks
  part words, so neighbours of a mark do not count). Serial correlation: vowels and consonants of text alternate, so that the
  lag-one correlation of being a vowel is RHO or less. Upper bounds on the three tails (normal, binomial, normal after Fisher's
  transform) make one p-value by Fisher's method.

Benjamini-Hochberg with weights in proportion to the length (long random strings are expected, short ones are mostly
words), over all candidates of all documents, controls the false discoveries; candidates that fail the first question
count as tests and are never found. The threshold comes from counts in bins of log p, so only one number reaches the driver.

Positions count code points, ends are exclusive. Defined cases: a null or empty text has no span; equal texts get equal
spans; long texts are scanned whole; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from crawlens.llm.common import table

KINDS = ("assign", "access", "hex", "random")
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = "AKIA[A-Z0-9]+"
HEX = "[0-9a-f]{16,}"  # the runs of [0-9a-f]+ that are long enough
TOKEN, LEAST = "[A-Za-z0-9+/_=-]{20,}", 20
#: What a run is cut into, each part with the padding if it is the last; and what of that some alphabet fits.
PIECE, FITS = "[^=]+(?:=+$)?", "^(?:[A-Za-z0-9+/]+|[A-Za-z0-9_-]+)=*$"
PARTS = ("[A-Za-z0-9_-]+(?:=+$)?", "[A-Za-z0-9+/]+(?:=+$)?", "[A-Za-z0-9]+(?:=+$)?")
#: What each inferred encoding may use, in the order of its values; the first that fits counts. Then how often text in it changes between classes.
ALPHABETS = (
    ("hex", "0123456789abcdef", 0.08),
    ("HEX", "0123456789ABCDEF", 0.08),
    ("base32", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 0.08),
    ("base36", "0123456789abcdefghijklmnopqrstuvwxyz", 0.08),
    ("BASE36", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ", 0.08),
    ("alphanumeric", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", 0.2),
    ("base64", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", 0.2),
    ("base64url", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_", 0.2),
)
#: Columns added on the way; a column of an input with such a name gives way to ours in ``scanned`` and is kept in ``redacted``.
TEXT, BASE, TESTED, SPANS = "_secret_text", "_secret_base", "_secret_tested", "_secret_spans"
LIMIT = 3.59  # standard deviations: one in a thousand for three tests
KAPPA, CLUMPS = 0.06, 0.002  # of an ordinary text: equal pairs of characters, and how far letters' shares clump them
RHO = -0.2  # of an ordinary text's vowels
RATE = 0.05  # of false discoveries
BINS = 4000  # of 1/50 of a decade


def _spans(text: Column, pattern: str, kind: int, group: int = 0) -> Column:
    """All matches as structs (start, kind, end, body); body is the text of the group."""
    p = F.lit(pattern)
    whole, gaps = F.regexp_extract_all(text, p, F.lit(0)), F.split(text, pattern, -1)
    body = whole if group == 0 else F.regexp_extract_all(text, p, F.lit(group))
    none = F.expr("CAST(array() AS ARRAY<STRUCT<start: INT, kind: INT, end: INT, body: STRING>>)")
    start = F.struct(F.lit(0).alias("at"), none.alias("out"))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + F.length(x["gap"])
        end = begin + F.length(x["whole"])
        return F.struct(end.alias("at"), F.array_append(acc["out"], F.struct(begin.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), x["body"].alias("body"))).alias("out"))

    zipped = F.arrays_zip(F.slice(gaps, F.lit(1), F.size(whole)).alias("gap"), whole.alias("whole"), body.alias("body"))
    return F.when(F.size(whole) > 0, F.aggregate(zipped, start, step, lambda a: a["out"])).otherwise(none)


def base_spans(text: Column) -> Column:
    """The spans of the three base kinds, by start, then kind; matches that are too short are dropped after matching."""
    none = F.expr("CAST(array() AS ARRAY<STRUCT<start: INT, kind: INT, end: INT, body: STRING>>)")
    assign = F.when(text.contains("=") | text.contains(":"), F.filter(_spans(text, ASSIGN, 0, 2), lambda s: F.length(s["body"]) >= 12)).otherwise(none)
    access = F.when(text.contains("AKIA"), F.filter(_spans(text, ACCESS, 1), lambda s: s["end"] - s["start"] >= 18)).otherwise(none)
    return F.array_sort(F.concat(assign, access, _spans(text, HEX, 2)))


def _within(span: Column, pattern: str) -> Column:
    """The parts of a span that match and are long enough, as spans of the text."""
    parts = F.filter(_spans(span["body"], pattern, 3), lambda x: F.length(x["body"]) >= LEAST)
    return F.transform(parts, lambda x: F.struct((span["start"] + x["start"]).alias("start"), x["kind"].alias("kind"), (span["start"] + x["end"]).alias("end"), x["body"].alias("body")))


def _candidates(text: Column) -> Column:
    """Runs cut into what an alphabet fits; and where one fits a whole path, its parts as well."""
    pieces = F.flatten(F.transform(_spans(text, TOKEN, 3), lambda c: _within(c, PIECE)))
    inner = lambda c: F.when(c["body"].contains("/"), F.array_remove(_within(c, PARTS[2]), c)).otherwise(F.array_remove(F.array(c), c))
    return F.flatten(F.transform(pieces, lambda c: F.when(c["body"].rlike(FITS), F.concat(F.array(c), inner(c))).otherwise(F.array_distinct(F.concat(*(_within(c, p) for p in PARTS))))))


_MARK = "CASE WHEN c BETWEEN '0' AND '9' THEN 0 WHEN c BETWEEN 'a' AND 'z' THEN 1 WHEN c BETWEEN 'A' AND 'Z' THEN 2 ELSE 3 END"
_FITTING = [(f"x.body RLIKE '^[{a.replace('-', '')}{'-' * ('-' in a)}]+=*$'", a, r) for _, a, r in ALPHABETS]
_ALPHABET = "CASE " + " ".join(f"WHEN {w} THEN '{a}'" for w, a, _ in _FITTING) + " END"
_RATE = "CASE " + " ".join(f"WHEN {w} THEN {r}D" for w, _, r in _FITTING) + " END"
_STEPWISE = "aggregate(sequence(1, size(x.v) - 1), 0D, (a, i) -> a + {})"
#: Each step adds to the struct of a candidate what the next one needs; k letters in the alphabet, n characters, u the vowels.
_STEPS = (
    f"transform({{}}, x -> struct(x.start, x.end, {_ALPHABET} AS alphabet, {_RATE} AS rate, filter(split(rtrim('=', x.body), ''), c -> c <> '') AS chars))",
    f"""transform(filter({{}}, x -> x.alphabet IS NOT NULL AND size(x.chars) > 3), x -> struct(x.start, x.end, x.rate, CAST(length(x.alphabet) AS DOUBLE) AS k, CAST(size(x.chars) AS DOUBLE) AS n,
        transform(x.chars, c -> instr(x.alphabet, c) - 1D) AS v, transform(x.chars, c -> {_MARK}) AS mark, transform(x.chars, c -> if(c RLIKE '[AEIOUYaeiouy]', 1D, 0D)) AS u))""",
    f"""transform({{}}, x -> struct(x.start, x.end, x.rate, x.k, x.n, x.v, x.u,
        aggregate(array_distinct(x.v), 0D, (a, y) -> a + pow(size(filter(x.v, z -> z = y)), 2)) AS squares,
        CAST(size(filter(x.v, y -> 2 * y >= x.k)) AS DOUBLE) AS high,
        aggregate(x.v, 0D, (a, y) -> a + y) / x.n AS mean, aggregate(x.u, 0D, (a, y) -> a + y) / x.n AS vowels,
        1 + {_STEPWISE.format("if((2 * x.v[i] >= x.k) <> (2 * x.v[i - 1] >= x.k), 1, 0)")} AS runs,
        {_STEPWISE.format("if(x.mark[i] < 3 AND x.mark[i - 1] < 3, 1, 0)")} AS pairs,
        {_STEPWISE.format("if(x.mark[i] < 3 AND x.mark[i - 1] < 3 AND x.mark[i] <> x.mark[i - 1], 1, 0)")} AS turns))""",
    f"""transform({{}}, x -> struct(x.start, x.end, x.n, x.k, x.rate, x.pairs, x.turns, x.runs, x.squares, 2 * x.high * (x.n - x.high) AS mixed,
        aggregate(x.v, 0D, (a, y) -> a + (y - x.mean) * (y - x.mean)) AS spread,
        {_STEPWISE.format("(x.v[i] - x.mean) * (x.v[i - 1] - x.mean)")} AS lagged,
        x.n * x.vowels * (1 - x.vowels) AS sway, {_STEPWISE.format("(x.u[i] - x.vowels) * (x.u[i - 1] - x.vowels)")} AS swing,
        (x.squares - x.n) / 2 AS equal, x.n * (x.n - 1) / 2 * {KAPPA} AS usual))""",
    f"""transform({{}}, x -> struct(x.start, x.end, x.n, x.rate, x.pairs, x.turns,
        x.spread > 0 AND x.mixed > x.n AND abs((x.k / x.n * x.squares - x.n - (x.k - 1)) / sqrt(2 * (x.k - 1) * (x.n - 1) / x.n)) <= {LIMIT}
          AND abs((x.runs - x.mixed / x.n - 1) / sqrt(x.mixed * (x.mixed - x.n) / (x.n * x.n * (x.n - 1)))) <= {LIMIT}
          AND abs((x.lagged / x.spread + 1 / x.n) * sqrt(x.n)) <= {LIMIT} AS uniform,
        (x.usual - x.equal) / sqrt(x.usual + {CLUMPS} * pow(x.n, 3)) AS even,
        if(x.sway > 0, (atanh(greatest(-0.99D, least(0.99D, x.swing / x.sway))) - atanh({RHO}D)) * sqrt(x.n - 3), 0D) AS serial))""",
)


def _log_factorial(x: str) -> str:
    return f"(({x} + 0.5) * ln({x} + 0.5) - ({x} + 0.5) + {0.5 * math.log(2 * math.pi)} - 1 / (24 * ({x} + 0.5)))"


def _log_normal(z: str) -> str:
    """ln of a bound on the upper normal tail."""
    return f"if({z} > 0, {math.log(0.5)} - {z} * {z} / 2, 0D)"


#: ln of a bound on the binomial tail: the first term, and the rest as a geometric series.
_LOG_TURNS = (
    f"if(x.turns <= x.pairs * x.rate OR x.pairs = 0, 0D, least(0D, {_log_factorial('x.pairs')} - {_log_factorial('x.turns')} - {_log_factorial('(x.pairs - x.turns)')}"
    " + x.turns * ln(x.rate) + (x.pairs - x.turns) * ln(1 - x.rate) + ln((x.turns + 1) * (1 - x.rate) / (x.turns + 1 - (x.pairs + 1) * x.rate))))"
)
#: Fisher's method for three; then the bin of p by weight, and the weight.
_LAST = (
    f"transform({{}}, x -> struct(x.start, x.end, x.uniform, least(x.n, 64D) / 32 AS weight, -({_LOG_TURNS} + {_log_normal('x.even')} + {_log_normal('x.serial')}) AS s))",
    f"transform({{}}, x -> struct(x.start, x.end, x.weight, if(x.uniform, CAST(greatest(0D, least({BINS - 1}D, floor(50 / {math.log(10)} * (x.s - ln(1 + x.s + x.s * x.s / 2) + ln(x.weight))))) AS INT), -1) AS bin))",
)


def _tested(frame: DataFrame) -> DataFrame:
    """Adds ``tested``: the candidates with the bin of their p-value (-1: not uniform). Reads ``_text`` and ``base``."""
    text = F.col(TEXT)
    has = F.when(text.rlike(TOKEN), F.filter(_candidates(text), lambda c: c["body"].rlike("[0-9]") & c["body"].rlike("[A-Za-z]")))
    none = F.expr("CAST(array() AS ARRAY<STRUCT<start: INT, kind: INT, end: INT, body: STRING>>)")
    frame = frame.withColumn(TESTED, F.filter(F.coalesce(has, none), lambda c: ~F.exists(BASE, lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"]))))
    for step in (*_STEPS, *_LAST):
        frame = frame.withColumn(TESTED, F.expr(step.format(TESTED)))
    return frame


def scanned(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The input's columns with ``base`` (spans of the base kinds) and ``tested`` (the candidates with their bins)."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    frame = docs.select(*(f"`{c}`" for c in docs.columns if c not in (TEXT, BASE, TESTED)), text.alias(TEXT)).withColumn(BASE, base_spans(F.col(TEXT)))
    slim = f"transform({BASE}, s -> struct(s.start, s.kind, s.end))"
    return _tested(frame).withColumn(BASE, F.expr(slim)).drop(TEXT)


def threshold(rows: DataFrame, rate: float = RATE) -> int:
    """The smallest bin that the weighted step-up procedure accepts; BINS if none. ``rows`` has ``tested``."""
    bins = rows.select(F.explode(TESTED).alias("t")).groupBy("t.bin").agg(F.count("*").alias("n"), F.sum(F.col("t.weight").cast("decimal(20,6)")).alias("weight"))
    upto = F.sum("n").over(W.orderBy(F.desc("bin")))  # BINS rows at most
    level = bins.withColumn("rank", upto).withColumn("m", F.sum("weight").over(W.partitionBy()))
    row = level.where((F.col("bin") >= 0) & (F.pow(F.lit(10.0), -F.col("bin") / 50) <= rate * F.col("rank") / F.col("m"))).agg(F.min("bin").alias("bin")).head()
    return BINS if row["bin"] is None else row["bin"]


def all_spans(least: int) -> Column:
    """Base and accepted random spans as structs (start, kind, end), in order. A part goes with the accepted run that it is part of."""
    taken = F.filter(TESTED, lambda t: t["bin"] >= least)
    inner = lambda t, o: (o["start"] <= t["start"]) & (t["end"] <= o["end"]) & (o["end"] - o["start"] > t["end"] - t["start"])
    extra = F.transform(F.filter(taken, lambda t: ~F.exists(taken, lambda o: inner(t, o))), lambda t: F.struct(t["start"].alias("start"), F.lit(3).alias("kind"), t["end"].alias("end")))
    return F.array_sort(F.concat(BASE, extra))


def written(spans: Column) -> Column:
    """``kind:start:end`` of every span, joined by commas."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(docs: DataFrame, mark: str = "[secret]", text_col: str = "text") -> DataFrame:
    """The documents with every span (overlapping ones together) replaced by the mark; other columns as they are."""
    rows = scanned(docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(f"`{text_col}`").cast("string").alias("text")))
    least = threshold(rows)
    text = F.col("text")
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        apart = s["start"] >= acc["at"]
        added = F.concat(acc["out"], F.when(apart, F.concat(F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit(mark))).otherwise(F.lit("")))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), added.alias("out"))

    done = F.aggregate(SPANS, start, step, lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text))))
    rows = rows.withColumn(SPANS, all_spans(least))
    new = F.when(F.size(SPANS) > 0, done).otherwise(text)
    return rows.select(*((new if c == text_col else F.col(f"row.`{c}`")).alias(c) for c in docs.columns))


def _of_kind(k: int):
    return lambda s: s["kind"] == k


def query(spark, sf_dir):
    rows = scanned(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    from crawlens.llm.common import stored

    rows = stored(rows, "spans")
    spans = all_spans(threshold(rows))
    n = [F.size(F.filter(BASE, _of_kind(k))).cast("long").alias(f"n_{KINDS[k]}") for k in range(3)]
    return rows.select("doc_id", *n, F.sha2(written(F.col(BASE)), 256).alias("base_sha256"), written(spans).alias("spans"))
