"""Benchmark decontamination by training suffix arrays: where do passages of test items stand in the training texts, verbatim?

The documents are read in shards of SHARD words. A shard's words become numbers of the benchmark's vocabulary (0 for any
other), and a suffix array orders the suffixes that can hold a window of an item: those inside of runs whose neighbouring words are neighbours in the
benchmark too, by a table of their hashes that may let others in but keeps none out. Every test suffix is searched in it by
bisection, word by word, all suffixes side by side: the interval of rows shrinks until no row goes on with the suffix's next word. The
interval at WINDOW words has all places of that window in the shard; the last one that is not empty has the longest verbatim match and where it stands.

Suffixes with equal windows have the same interval, so that a window that many items share is followed to its places once.

The benchmark is the stated query set. It is broadcast in slices of SLICE bytes of text, one at a time, so that its size is bounded by no
assumption; an item is not cut, so that a slice has that size or is one item. With several slices a document's spans are merged afterwards.

Defined cases: only A-Z are lower-cased; null and empty texts and items have no words and nothing to find; an item of fewer words than a window is
one window as a whole; items of one id count once, and a null id is the empty text; rows that repeat a document's id are judged each for itself; a null id of
a document stays null; texts of any length are treated whole (a shard holds at least one); bytes that are not UTF-8 belong to words; empty tables
give empty results, or clean documents; other columns, whatever their names, are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, functions as F

from crawlens.llm.common import stored, table, texts

WINDOW = 10
SHARD = 2 << 20  # words
SLICE = 16 << 20  # bytes of items
#: Small letters for A-Z, a blank for what no word holds: below 0, between digits and letters, above them, up to DEL.
FOLD = bytes(c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else c + 32 if 0x41 <= c <= 0x5A else 0x20 for c in range(256))


def words(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(FOLD).split()


def _pair(text: np.ndarray, bits: int) -> np.ndarray:
    """A number of ``bits`` bits for each two neighbours."""
    x = text[:-1].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + text[1:].astype(np.uint64)
    return ((x ^ (x >> np.uint64(29))) * np.uint64(0xD1342543DE82EF95)) >> np.uint64(64 - bits)


def laid_out(items: list[tuple[str, bytes]], window: int = WINDOW) -> dict:
    """A slice of the benchmark for search: its vocabulary, its words in a row (0 after each item), and for each suffix with a window its start, words and item."""
    vocabulary: dict[bytes, int] = {}
    own = [[vocabulary.setdefault(w, len(vocabulary) + 1) for w in words(t)] for _, t in items]
    sizes = np.fromiter(map(len, own), np.int64, len(own))
    text = np.array([x for ids in own for x in (*ids, 0)], np.int64)
    begins = np.cumsum(sizes + 1) - sizes - 1
    item = np.repeat(np.arange(len(own)), sizes + 1)
    left = (begins + sizes)[item] - np.arange(len(text)) if len(text) else text
    whole = np.zeros(len(text), bool)
    whole[begins[(sizes > 0) & (sizes < window)]] = True
    start = np.flatnonzero(whole | (left >= window))
    bits = max(16, (16 * len(text)).bit_length())
    linked = np.zeros(1 << bits, bool)
    if len(text) > 1:
        linked[_pair(text, bits)[(text[:-1] > 0) & (text[1:] > 0)]] = True
    return {
        "ids": [i for i, _ in items], "vocabulary": vocabulary, "text": text, "start": start, "left": left[start], "item": item[start], "place": start - begins[item[start]] if len(start) else start,
        "need": np.minimum(left[start], window), "linked": linked, "bits": bits, "least": int(np.minimum(left[start], window).min()) if len(start) else 0, "longest": int(left[start].max()) if len(start) else 0,
    }


def slices(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text", size: int = SLICE) -> Iterator[dict]:
    """The benchmark, laid out slice by slice; the driver holds one at a time."""
    rows = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("i"), F.encode(F.coalesce(F.col(text_col).cast("string"), F.lit("")), "utf-8").alias("t"))
    held: list[tuple[str, bytes]] = []
    taken = 0
    for r in rows.toLocalIterator():
        if held and taken + len(r["t"]) > size:
            yield laid_out(held)
            held, taken = [], 0
        held.append((r["i"], bytes(r["t"])))
        taken += len(r["t"])
    yield laid_out(held)


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Places of ``text`` in the order of the ``depth`` numbers from there on, by doubling ranks."""
    n = len(text)
    bits = int(text.max()).bit_length()
    known = 62 // bits
    rank = np.zeros(n, np.int64)
    for i in range(known):
        rank <<= bits
        rank[: max(0, n - i)] |= text[i:]
    rank = np.unique(rank, return_inverse=True)[1]
    while known < depth:
        after = np.zeros(n, np.int64)
        after[: max(0, n - known)] = rank[known:] + 1
        rank = np.unique(rank * (n + 1) + after, return_inverse=True)[1]
        known *= 2
    return np.argsort(rank, kind="stable")


def _bisected(text: np.ndarray, rows: np.ndarray, depth: int, lo: np.ndarray, hi: np.ndarray, word: np.ndarray) -> np.ndarray:
    """In each interval of rows, whose suffixes are equal up to ``depth``, the first row whose next word is not below ``word``."""
    lo, hi = lo.copy(), hi.copy()
    while len(open_ := np.flatnonzero(lo < hi)):
        mid = (lo[open_] + hi[open_]) >> 1
        below = text[rows[mid] + depth] < word[open_]
        lo[open_[below]] = mid[below] + 1
        hi[open_[~below]] = mid[~below]
    return lo


def search(text: np.ndarray, tests: dict, whole: bool) -> dict[str, np.ndarray]:
    """Of each test suffix: the rows of its window (``lo``, ``hi``), and with ``whole`` the words of its longest match (``words``) and one of its rows (``row``)."""
    rows = suffix_array(text, tests["longest"] if whole else int(tests["need"].max()))
    m = len(tests["start"])
    lo, hi = np.zeros(m, np.int64), np.full(m, len(text))
    found = {"rows": rows, "lo": np.zeros(m, np.int64), "hi": np.zeros(m, np.int64), "words": np.zeros(m, np.int64), "row": np.zeros(m, np.int64)}
    active, depth = np.arange(m), 0
    until = tests["left"] if whole else tests["need"]
    while len(active):
        word = tests["text"][tests["start"][active] + depth]
        first = _bisected(text, rows, depth, lo[active], hi[active], word)
        last = _bisected(text, rows, depth, first, hi[active], word + 1)
        there = last > first
        active = active[there]
        lo[active], hi[active] = first[there], last[there]
        depth += 1
        found["words"][active], found["row"][active] = depth, lo[active]
        full = active[tests["need"][active] == depth]
        found["lo"][full], found["hi"][full] = lo[full], hi[full]
        active = active[until[active] > depth]
    return found


class Shard:
    """Documents' words as numbers, and of these the runs that may hold a window."""

    def __init__(self, tests: dict):
        self.tests, self.docs, self.parts, self.size = tests, [], [], 0

    def add(self, doc, text: bytes | None) -> None:
        own = words(text)
        self.docs.append(doc)
        self.parts.append(np.fromiter(map(self.tests["vocabulary"].get, own, repeat(0)), np.int32, len(own)))
        self.size += len(own)

    def runs(self) -> None:
        """``text``: the runs' numbers, 0 after each; ``back``: their places among all words; ``doc`` and ``place`` of each of these."""
        sizes = np.fromiter(map(len, self.parts), np.int64, len(self.parts))
        self.sizes = sizes
        every = np.zeros(int(sizes.sum()) + len(sizes), np.int64)
        begins = np.cumsum(sizes + 1) - sizes - 1
        for b, own in zip(begins.tolist(), self.parts):
            every[b : b + len(own)] = own
        linked = np.zeros(len(every), bool)  # with the word before
        pair = _pair(every, self.tests["bits"])
        linked[1:] = (every[1:] > 0) & (every[:-1] > 0) & self.tests["linked"][pair]
        at = np.flatnonzero(every > 0)
        run = np.cumsum(~linked[at]) - 1
        at = at[np.bincount(run)[run] >= self.tests["least"]] if len(at) else at
        number = np.cumsum(~linked[at]) - 1
        spot = np.arange(len(at)) + number
        self.text = np.zeros(len(at) + (int(number[-1]) + 1 if len(at) else 0), np.int64)
        self.back = np.zeros(len(self.text), np.int64)
        self.text[spot], self.back[spot] = every[at], at
        self.begins = begins

    def doc(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.begins, at, side="right") - 1

    def hits(self) -> Iterator[tuple[list, list[str]]]:
        """For each document, the spans of its hit words and the ids of the items found."""
        self.runs()
        none = ([], [])
        if not len(self.text):
            yield from repeat(none, len(self.docs))
            return
        found = search(self.text, self.tests, False)
        hit = np.flatnonzero(found["hi"] > found["lo"])
        key = np.stack([found["lo"][hit], found["hi"][hit], self.tests["need"][hit]], 1)
        windows, kind = np.unique(key, axis=0, return_inverse=True)
        kind = kind.reshape(-1)
        counts = windows[:, 1] - windows[:, 0]
        which = np.repeat(np.arange(len(windows)), counts)
        row = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts) + windows[which, 0]
        place = self.back[found["rows"][row]]
        doc = self.doc(place)
        order = np.lexsort((place, doc))
        which, place, doc = which[order], place[order], doc[order]
        by_kind = np.argsort(kind, kind="stable")
        first = np.searchsorted(kind[by_kind], np.arange(len(windows) + 1))
        items = self.tests["item"][hit][by_kind]
        cuts = np.searchsorted(doc, np.arange(len(self.docs) + 1)).tolist()
        for d, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])):
            if a == b:
                yield none
                continue
            start = place[a:b] - self.begins[d]
            end = np.maximum.accumulate(start + windows[which[a:b], 2])
            new = np.ones(b - a, bool)
            new[1:] = start[1:] > end[:-1]
            edges = np.flatnonzero(new)
            spans = [{"a": x, "b": y} for x, y in zip(start[edges].tolist(), end[np.append(edges[1:], b - a) - 1].tolist())]
            own = {i for w in np.unique(which[a:b]).tolist() for i in items[first[w] : first[w + 1]].tolist()}
            yield spans, sorted({self.tests["ids"][i] for i in own})

    def longest(self) -> Iterator[tuple]:
        """(item, place, words, document, place in it) of the longest match of each test suffix that has a window here."""
        self.runs()
        if not len(self.text):
            return
        found = search(self.text, self.tests, True)
        for s in np.flatnonzero(found["words"] >= self.tests["need"]).tolist():
            at = self.back[found["rows"][found["row"][s]]]
            d = int(self.doc(at))
            yield self.tests["ids"][self.tests["item"][s]], int(self.tests["place"][s]), int(found["words"][s]), self.docs[d], int(at - self.begins[d])


def _shards(batches: Iterator[pa.RecordBatch], tests: dict, most: int) -> Iterator[Shard]:
    shard = Shard(tests)
    for b in batches:
        for doc, text in zip(b.column("_row").to_pylist(), texts(b, "_text")):
            shard.add(doc, text)
            if shard.size >= most:
                yield shard
                shard = Shard(tests)
    if shard.docs:
        yield shard


def _found(rows: DataFrame, tests: Broadcast, shard: int) -> DataFrame:
    """``(_row, n_words, spans, items)`` of ``rows(_row, _text)``."""
    kind = rows.schema["_row"].dataType.simpleString()
    spans = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        source = iter(batches)
        head = next(source, None)
        if head is None:
            return
        of = head.column("_row").type
        for s in _shards(_again(head, source), tests.value, shard):
            where, items = zip(*s.hits())
            yield pa.RecordBatch.from_arrays([pa.array(s.docs, of), pa.array(s.sizes, pa.int64()), pa.array(where, spans), pa.array(items, pa.list_(pa.string()))], names=["_row", "n_words", "spans", "items"])

    return rows.mapInArrow(run, f"_row {kind}, n_words long, spans array<struct<a: long, b: long>>, items array<string>")


def _again(head: pa.RecordBatch, rest: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield head
    yield from rest


def _scores(spans, items) -> list:
    """From any number of slices' spans and items."""
    seen = F.aggregate(
        F.array_sort(spans), F.struct(F.lit(0).cast("long").alias("upto"), F.lit(0).cast("long").alias("n")),
        lambda s, x: F.struct(F.greatest(s["upto"], x["b"]).alias("upto"), (s["n"] + F.greatest(F.lit(0), x["b"] - F.greatest(s["upto"], x["a"]))).alias("n")),
    )["n"]
    own = F.array_sort(F.array_distinct(items))
    return [seen.alias("n_hit"), F.size(own).cast("long").alias("n_items"), own.alias("items")]


def scored(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SLICE, shard: int = SHARD) -> DataFrame:
    """``(doc_id, n_words, n_hit, n_items, items, contaminated)`` for every document."""
    sent, (ids, own) = docs.sparkSession.sparkContext.broadcast, (F.col(id_col), F.col(text_col).cast("string").alias("_text"))
    parts = slices(benchmark, size=size)
    first, second = next(parts), next(parts, None)
    if second is None:
        found = _found(docs.select(ids.alias("_row"), own), sent(first), shard).select(F.col("_row").alias("doc_id"), "n_words", *_scores("spans", "items"))
        return found.withColumn("contaminated", F.col("n_hit") > 0)
    rows = stored(docs.select(F.monotonically_increasing_id().alias("_row"), ids.alias("doc_id"), own), "rows")
    counts, hits = None, None
    for tests in _chained(first, second, parts):
        part = stored(_found(rows.select("_row", "_text"), sent(tests), shard), "found")
        counts = part.select("_row", "n_words") if counts is None else counts
        some = part.where(F.size("items") > 0).select("_row", "spans", "items")
        hits = some if hits is None else hits.unionByName(some)
    merged = hits.groupBy("_row").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.flatten(F.collect_list("items")).alias("items"))  # a row per slice
    none = F.coalesce("n_hit", F.lit(0).cast("long"))
    found = rows.select("_row", "doc_id").join(counts, "_row").join(merged.select("_row", *_scores("spans", "items")), "_row", "left")
    return found.select("doc_id", "n_words", none.alias("n_hit"), F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"), F.coalesce("items", F.array().cast("array<string>")).alias("items"), (none > 0).alias("contaminated"))


def _chained(first: dict, second: dict, rest: Iterator[dict]) -> Iterator[dict]:
    yield first
    yield second
    yield from rest


def matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SLICE, shard: int = SHARD) -> DataFrame:
    """``(item_id, place, words, doc_id, at)``: for every test suffix with a window in the corpus its longest verbatim match, in words, and where it starts.

    Of several of equal length, the one with the smallest (doc_id, at) of those that the shards name.
    """
    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("_row"), F.col(text_col).cast("string").alias("_text"))
    kind = rows.schema["_row"].dataType.simpleString()
    out = None
    for tests in slices(benchmark, size=size):
        sent = docs.sparkSession.sparkContext.broadcast(tests)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            source = iter(batches)
            head = next(source, None)
            if head is None:
                return
            kinds = (pa.string(), pa.int64(), pa.int64(), head.column("_row").type, pa.int64())
            for s in _shards(_again(head, source), sent.value, shard):
                if found := list(s.longest()):
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found), kinds)], names=["item_id", "place", "words", "doc_id", "at"])

        part = rows.mapInArrow(run, f"item_id string, place long, words long, doc_id {kind}, at long")
        out = part if out is None else out.unionByName(part)
    best = F.min(F.struct((-F.col("words")).alias("less"), "doc_id", "at")).alias("best")
    return out.groupBy("item_id", "place").agg(best).select("item_id", "place", (-F.col("best.less")).alias("words"), "best.doc_id", "best.at")


def clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without any window of the benchmark, all columns as given. Rows without an id stay, and so do rows that share an id with none that is hit."""
    bad = scored(docs, benchmark, id_col, text_col).where("contaminated").select("doc_id").distinct()
    whole = docs.select(F.col(id_col).alias("id"), F.struct(*docs.columns).alias("row"))
    return whole.join(bad, F.col("id") == F.col("doc_id"), "left_anti").select("row.*")


def query(spark, sf_dir):
    found = scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
windows AS (SELECT DISTINCT item, m, array_to_string(w[p:p + m - 1], ' ') AS s FROM (SELECT item, w, m, unnest(generate_series(1, len(w) - m + 1)) AS p FROM (SELECT item, w, least(len(w), 10) AS m FROM b WHERE len(w) > 0))),
here AS (SELECT doc_id, p, m, array_to_string(w[p:p + m - 1], ' ') AS s FROM (SELECT doc_id, w, m, unnest(generate_series(1, len(w) - m + 1)) AS p FROM d, (SELECT DISTINCT m FROM windows) WHERE len(w) >= m)),
found AS (SELECT doc_id, p, m, item FROM here JOIN windows USING (m, s)),
hits AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(generate_series(p, p + m - 1)) AS q FROM (SELECT DISTINCT doc_id, p, m FROM found)) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, item FROM found) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN items USING (doc_id)
"""
