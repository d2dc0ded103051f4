"""Suffix-array dedup: bytes covered by a long string that also starts earlier go.

The strings of LENGTH bytes that occur twice are the classes of suffixes whose common prefixes reach LENGTH. Within a
task those classes come from a Burrows-Wheeler transform by threshold-bounded interval expansion: starting from the
interval of the empty string, each round extends all intervals of length l backwards by every symbol that
precedes them; a new interval whose right end has no common-prefix value yet gives it the value l and stays in the
queue. The values come out in increasing order, and the expansion stops at LENGTH: rows without a value share
LENGTH symbols or more with the row before.

What meets in one transform is found beforehand, without loss. Each string of LENGTH bytes has an anchor, the substring
of ANCHOR bytes with the smallest hash (the leftmost of several): equal strings have equal anchors at equal places. The
strings of one anchor occurrence are a run of neighbours, whose bytes are its span. A first exchange tells for each
anchor whether it occurs again, and whether with different spans; a second which occurrence of a span is the earliest
(later ones go whole). What is left, the earliest occurrences of different spans around a common anchor, is
transformed and expanded. An anchor that more than HOT blocks share, or whose different spans have more than HEAVY bytes (by
sums that each block rounds up by a fifth at most), is not gathered, because a transform takes some hundred times the memory of its text: its strings go one
by one through the second exchange, where every block has reduced them to one record each.

Defined cases: null and empty texts have no bytes; texts of fewer than LENGTH bytes stay; matches never cross documents;
overlapping strings count; an earlier start in the same document counts; of equal documents the one with the smallest id
stays; rows with equal ids count as one document by their places; a null id counts as the largest; long texts are
treated whole; empty tables give empty results; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from crawlens.llm.blocks import BLOCKS, Block, blocks, earliest, exchange, gathered, mapped, mixed, packed, split, unpacked
from crawlens.llm.common import small_batches, stored, table

LENGTH, ANCHOR = 100, 32
HOT, HEAVY = 4096, 2 << 20
CHUNK = 1 << 20
BASE = np.uint64(0xD1342543DE82EF95)
INVERSE = np.uint64(pow(0xD1342543DE82EF95, -1, 1 << 64))
SIDE = np.uint64(255)  # bits of an anchor's mark beside its span
ALONE, SAME, OTHERS, CROWD = 0, 1, 2, 3  # what the first exchange says of an anchor


def suffix_classes(text: np.ndarray, length: int) -> np.ndarray:
    """For each place of ``text`` (symbols 1…510), a number that equal substrings of ``length`` symbols share."""
    text = np.append(text, 0).astype(np.int64)  # the end is the smallest symbol and stands once
    n = len(text)
    rank, k = np.zeros(n, np.int64), 7
    for i in range(k):
        rank <<= 9
        rank[: n - i] |= text[i:]
    rank = np.unique(rank, return_inverse=True)[1]
    while k <= length and rank.max() < n - 1:  # once all differ, longer prefixes keep the order
        after = np.zeros(n, np.int64)
        after[: max(0, n - k)] = rank[k:] + 1
        rank = np.unique(rank * (n + 1) + after, return_inverse=True)[1]
        k *= 2
    sa = np.argsort(rank, kind="stable")
    bwt = text[sa - 1].astype(np.uint16)  # narrow enough for a sort by digits
    order = np.argsort(bwt, kind="stable")
    back = np.empty(n, np.int64)
    back[order] = np.arange(n)  # the row of the suffix one symbol longer
    bucket = np.zeros(n, bool)  # first rows of the symbols
    held = np.bincount(bwt)
    bucket[(np.cumsum(held) - held)[held > 0]] = True
    known = np.zeros(n + 1, bool)  # rows whose common prefix with the row before is shorter than the rounds so far
    known[[0, n]] = True
    left, right = np.array([0]), np.array([n])
    owner = np.zeros(n, np.int64)
    for _ in range(length):
        if not len(left):
            break
        sizes = right - left
        total = int(sizes.sum())
        rows = np.arange(total) + np.repeat(left - (np.cumsum(sizes) - sizes), sizes)
        to, own = back[rows], np.repeat(np.arange(1, len(left) + 1), sizes)
        if total > n // 8:
            owner[:] = 0
            owner[to] = own
            to = np.flatnonzero(owner)
            own = owner[to]
        else:
            by = np.argsort(to)
            to, own = to[by], own[by]
        new = bucket[to].copy()
        new[0] = True
        new[1:] |= (own[1:] != own[:-1]) | (to[1:] != to[:-1] + 1)
        starts = np.flatnonzero(new)
        left, right = to[starts], to[np.append(starts[1:], total) - 1] + 1
        fresh = ~known[right]
        left, right = left[fresh], right[fresh]
        known[right] = True
    out = np.empty(n, np.int64)
    out[sa] = np.cumsum(known[:n])
    return out[:-1]


_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE ** i and BASE ** -i for i below n; a worker keeps those of its largest block."""
    if not _POWERS or len(_POWERS[0]) < n:
        _POWERS[:] = np.cumprod(np.full(n, BASE)) * INVERSE, np.cumprod(np.full(n, INVERSE)) * BASE
    return _POWERS[0][:n], _POWERS[1][:n]


class Runs:
    """A block's strings of LENGTH bytes, as runs with a common anchor."""

    def __init__(self, block: Block):
        self.data = np.frombuffer(b"".join(block.texts), np.uint8)
        n = len(self.data)
        sizes = np.fromiter(map(len, block.texts), np.int64, len(block.texts))
        self.ends = np.cumsum(sizes)
        self.doc = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
        self.begins = self.ends - sizes
        self.lo = self.hi = self.anchor = np.zeros(0, np.int64)
        self.keys = self.spans = np.zeros(0, np.uint64)
        if n < LENGTH:
            return
        symbol = np.random.default_rng(11).integers(1, 1 << 63, 256, dtype=np.uint64)
        self.up, down = _powers(n)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(symbol[self.data] * down, out=self.sums[1:])
        h = mixed((self.sums[ANCHOR:] - self.sums[:-ANCHOR]) * self.up[: n - ANCHOR + 1])
        bits = np.uint64(max(1, int(n).bit_length()))
        least = ((h >> bits) << bits) | np.arange(len(h), dtype=np.uint64)
        span, width = LENGTH - ANCHOR + 1, 1
        while 2 * width <= span:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        if span > width:
            least = np.minimum(least[: len(least) - (span - width)], least[span - width :])
        fits = np.ones(n, bool)  # bytes at which a string of the document starts
        for a, b in zip(self.begins.tolist(), self.ends.tolist()):
            fits[max(a, b - LENGTH + 1) : b] = False
        own = np.flatnonzero(fits[: len(least)])
        if not len(own):
            return
        at = (least[own] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
        new = np.ones(len(own), bool)
        new[1:] = (own[1:] != own[:-1] + 1) | (at[1:] != at[:-1])
        starts = np.flatnonzero(new)
        self.lo, self.hi, self.anchor = own[starts], own[np.append(starts[1:], len(own)) - 1], at[starts]
        self.keys = mixed(h[self.anchor])
        self.spans = mixed(self.hashed(self.lo, self.hi + LENGTH - self.lo) + (self.anchor - self.lo).astype(np.uint64) * np.uint64(0xA24BAED4963EE407))

    def hashed(self, at: np.ndarray, size) -> np.ndarray:
        return mixed((self.sums[at + size] - self.sums[at]) * self.up[at])

    def place(self, at: np.ndarray) -> np.ndarray:
        """Within the document."""
        return at - self.begins[self.doc[at]]

    def anchors(self):
        """Different keys, the runs' numbers among them, and a mark: 56 bits of the span that all of a key's runs have (0: several), 7 of the bytes of their different spans, as four times a logarithm, and the last one set if there are several runs."""
        keys, inverse, counts = np.unique(self.keys, return_inverse=True, return_counts=True)
        low, high = np.full(len(keys), ~np.uint64(0)), np.zeros(len(keys), np.uint64)
        np.minimum.at(low, inverse, self.spans)
        np.maximum.at(high, inverse, self.spans)
        order = np.lexsort((self.spans, inverse))
        new = np.ones(len(order), bool)
        new[1:] = (inverse[order][1:] != inverse[order][:-1]) | (self.spans[order][1:] != self.spans[order][:-1])
        one = order[new]
        held = np.bincount(inverse[one], self.hi[one] + LENGTH - self.lo[one], len(keys))
        size = np.ceil(4 * np.log2(held)).astype(np.uint64) if len(keys) else np.zeros(0, np.uint64)
        mark = np.where(low == high, low & ~SIDE, np.uint64(0)) | (np.minimum(size, np.uint64(127)) << np.uint64(1)) | (counts > 1).astype(np.uint64)
        return keys, inverse, mark


def _told(sent: list[bytes]) -> list[bytes | None]:
    """Of each anchor: does it occur again, and how."""
    tables = [unpacked(x) for x in sent]
    keys, marks = np.concatenate([t[0] for t in tables]), np.concatenate([t[1] for t in tables]).view(np.uint64)
    uniq, inverse, counts = np.unique(keys, return_inverse=True, return_counts=True)
    low, high = np.full(len(uniq), ~np.uint64(0)), np.zeros(len(uniq), np.uint64)
    span = marks & ~SIDE
    held = np.bincount(inverse, np.exp2(((marks & SIDE) >> np.uint64(1)).astype(np.float64) / 4), len(uniq))
    np.minimum.at(low, inverse, span)
    np.maximum.at(high, inverse, span)
    several = counts > 1
    np.logical_or.at(several, inverse, (marks & np.uint64(1)).astype(bool))
    code = np.where(~several, ALONE, np.where((low == high) & (low != 0), SAME, np.where((counts > HOT) | (held > HEAVY), CROWD, OTHERS))).astype(np.uint8)
    out = code[inverse]
    return [x.tobytes() if x.any() else None for x in np.split(out, np.cumsum([len(t[0]) for t in tables])[:-1])]


class Questions:
    """What a block asks in the second exchange: one record for each different span or string, its earliest place in the block."""

    def __init__(self, block: Block, runs: Runs, groups: int):
        keys, inverse, _ = runs.anchors()
        self.code = gathered(keys, groups, block.answers["anchors"])[inverse] if len(inverse) else np.zeros(0, np.uint8)
        whole = np.flatnonzero((self.code == SAME) | (self.code == OTHERS))
        crowd = np.flatnonzero(self.code == CROWD)
        sizes = runs.hi[crowd] - runs.lo[crowd] + 1
        single = np.arange(int(sizes.sum())) + np.repeat(runs.lo[crowd] - (np.cumsum(sizes) - sizes), sizes)
        self.run = np.concatenate((whole, np.full(len(single), -1)))  # -1: a single string
        self.at = np.concatenate((runs.lo[whole], single))
        key = np.concatenate((runs.spans[whole], mixed(runs.hashed(single, LENGTH) ^ np.uint64(0x5851F42D4C957F2D)))) if len(self.at) else np.zeros(0, np.uint64)
        doc, place = block.ids[runs.doc[self.at]], runs.place(self.at)
        order = np.lexsort((place, doc, key))
        self.run, self.at, key, doc, place = self.run[order], self.at[order], key[order], doc[order], place[order]
        self.first = np.ones(len(key), bool)
        self.first[1:] = key[1:] != key[:-1]
        # equal (document, place) of rows that repeat an id: neither is later than the other
        lead = np.maximum.accumulate(np.where(self.first, np.arange(len(key)), 0))
        self.number = np.cumsum(self.first) - 1
        self.again = (doc != doc[lead]) | (place != place[lead])
        self.keys, self.doc, self.place = key[self.first], doc[self.first], place[self.first]


def _contexts(block: Block, runs: Runs, q: Questions, groups: int):
    """Runs to be expanded: earliest occurrences of spans whose anchor has others."""
    later = gathered(q.keys, groups, block.answers["spans"]).astype(bool)
    gone = q.again | later[q.number]
    mine = q.run[q.first & ~gone & (q.run >= 0)]
    return later, gone, mine[runs_code(q, mine) == OTHERS]


def runs_code(q: Questions, runs: np.ndarray) -> np.ndarray:
    return q.code[runs]


def _earliest_of(classes: np.ndarray, doc: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Of each class the string with the smallest (document, place). Strings come in that order but where rows repeat an id; those are sorted."""
    down = np.arange(len(classes))[::-1]
    if np.any((doc[1:] < doc[:-1]) | ((doc[1:] == doc[:-1]) & (place[1:] < place[:-1]))):
        down = np.lexsort((place, doc))[::-1]
    first = np.zeros(int(classes.max(initial=-1)) + 1, np.int64)
    first[classes[down]] = down  # the last one written is the earliest
    return first


def _expanded(sent: list[bytes]) -> list[bytes | None]:
    """For each context, one bit per string: 1 where an earlier context has the same string."""
    meta, data = [], []
    for x in sent:
        n = int(np.frombuffer(x, np.int64, 1)[0])
        meta.append(np.frombuffer(x, np.int64, 5 * n, 8).reshape(5, n))
        data.append(x[8 + 40 * n :])
    owner = np.repeat(np.arange(len(sent)), [m.shape[1] for m in meta])
    key, doc, place, anchor, size = np.concatenate(meta, axis=1)
    raw = np.frombuffer(b"".join(data), np.uint8)
    start = np.cumsum(size) - size
    bits: list[np.ndarray] = [np.zeros(0, bool)] * len(key)
    order = np.argsort(key, kind="stable")
    cuts, held = [0], 0
    for i, c in enumerate(order.tolist()):  # chunks of whole anchor groups
        if held >= CHUNK and key[c] != key[order[i - 1]]:
            cuts.append(i)
            held = 0
        held += int(size[c]) + 1
    cuts.append(len(order))
    for a, b in zip(cuts[:-1], cuts[1:]):
        own = order[a:b]
        if not len(own):
            continue
        own = own[np.lexsort((place[own], doc[own]))]  # so that strings come in the order of their places
        sizes = size[own]
        begin = np.cumsum(sizes + 1) - sizes - 1
        text = np.ones(int(sizes.sum()) + len(own), np.int64)  # 1 parts the contexts
        spot = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        text[spot + np.repeat(begin, sizes)] = raw[spot + np.repeat(start[own], sizes)].astype(np.int64) + 2
        classes = suffix_classes(text, LENGTH)
        counts = sizes - LENGTH + 1
        step = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)
        which = np.repeat(np.arange(len(own)), counts)
        cls = classes[step + begin[which]]
        d, p = doc[own][which], (place[own])[which] + step
        lead = _earliest_of(cls, d, p)[cls]
        later = (d != d[lead]) | (p != p[lead])
        for c, x in zip(own.tolist(), np.split(later, np.cumsum(counts)[:-1])):
            bits[c] = x
    out = []
    for i in range(len(sent)):
        mine = np.flatnonzero(owner == i)
        x = np.concatenate([bits[c] for c in mine]) if len(mine) else np.zeros(0, bool)
        out.append(np.packbits(x).tobytes() if x.any() else None)
    return out


def removed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_bytes, n_removed, n_spans, kept)`` for every document; ``kept`` holds the bytes that stay."""
    made = blocks(docs, id_col, text_col)
    groups = made.groups

    def ask_anchors(block: Block) -> Iterator[tuple[int, bytes]]:
        keys, _, mark = Runs(block).anchors()
        for g, places in split(keys, groups):
            yield g, packed(keys[places], mark[places].view(np.int64))

    def ask_spans(block: Block) -> Iterator[tuple[int, bytes]]:
        runs = Runs(block)
        q = Questions(block, runs, groups)
        for g, places in split(q.keys, groups):
            yield g, packed(q.keys[places], q.doc[places], q.place[places])

    def ask_contexts(block: Block) -> Iterator[tuple[int, bytes]]:
        runs = Runs(block)
        _, _, mine = _contexts(block, runs, Questions(block, runs, groups), groups)
        for g, places in split(runs.keys[mine], groups):
            own = mine[places]
            lo, end = runs.lo[own], runs.hi[own] + LENGTH
            columns = np.stack([runs.keys[own].view(np.int64), block.ids[runs.doc[lo]], runs.place(lo), runs.anchor[own] - lo, end - lo])
            yield g, np.array([len(own)], np.int64).tobytes() + columns.tobytes() + b"".join(runs.data[a:b].tobytes() for a, b in zip(lo.tolist(), end.tolist()))

    def kept(block: Block) -> Iterator[pa.RecordBatch]:
        runs = Runs(block)
        q = Questions(block, runs, groups)
        later, gone, mine = _contexts(block, runs, q, groups)
        mark = np.zeros(len(runs.data) + 1, np.int64)

        def cover(first, last):
            np.add.at(mark, first, 1)
            np.add.at(mark, last + LENGTH, -1)

        whole = q.run[gone & (q.run >= 0)]
        cover(runs.lo[whole], runs.hi[whole])
        single = q.at[gone & (q.run < 0)]
        cover(single, single)
        for g, places in split(runs.keys[mine], groups):
            if g in block.answers["contexts"]:
                own = mine[places]
                counts = runs.hi[own] - runs.lo[own] + 1
                bits = np.unpackbits(np.frombuffer(block.answers["contexts"][g], np.uint8), count=int(counts.sum())).astype(bool)
                at = (np.arange(len(bits)) + np.repeat(runs.lo[own] - (np.cumsum(counts) - counts), counts))[bits]
                cover(at, at)
        out = np.cumsum(mark[:-1]) > 0
        edge = out.copy()
        edge[1:] &= ~out[:-1] | (runs.doc[1:] != runs.doc[:-1])
        n_removed, n_spans, rest = [], [], []
        for text, a, b in zip(block.texts, runs.begins.tolist(), runs.ends.tolist()):
            n_removed.append(int(out[a:b].sum()))
            n_spans.append(int(edge[a:b].sum()))
            rest.append(runs.data[a:b][~out[a:b]].tobytes() if n_removed[-1] else text)
        ids = [None if null else i for i, null in zip(block.ids.tolist(), block.nulls)]
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([len(t) for t in block.texts], pa.int64()), pa.array(n_removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(rest, pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    exchange(made, "anchors", ask_anchors, _told)
    exchange(made, "spans", ask_spans, earliest)
    exchange(made, "contexts", ask_contexts, _expanded)
    return mapped(made, kept, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def query(spark, sf_dir):
    with small_batches(spark, BLOCKS):
        return stored(removed(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256")), "kept")


#: Bytes as hex digits: a string of 100 bytes is 200 digits from an odd place. Covered starts merge into runs by islands.
ORACLE = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
win AS (SELECT doc_id, p, md5_number(substr(h, 2 * p + 1, 200)) AS s FROM (SELECT doc_id, h, unnest(generate_series(0, length(h) // 2 - 100)) AS p FROM d)),
gone AS (SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY s ORDER BY doc_id, p) AS k FROM win) WHERE k > 1),
isle AS (SELECT doc_id, p, sum(CASE WHEN p > before + 100 OR before IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY p) AS g FROM (SELECT doc_id, p, lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS before FROM gone)),
runs AS (SELECT doc_id, g, min(p) AS a, max(p) + 100 AS b FROM isle GROUP BY doc_id, g),
cut AS (SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans, list(a ORDER BY a) AS starts, list(b ORDER BY a) AS ends FROM runs GROUP BY doc_id)
SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
       sha256(unhex(CASE WHEN starts IS NULL THEN h ELSE array_to_string(list_transform(generate_series(1, len(starts) + 1),
         lambda i: substr(h, 2 * CASE WHEN i = 1 THEN 0 ELSE ends[i - 1] END + 1, 2 * (CASE WHEN i > len(starts) THEN length(h) // 2 ELSE starts[i] END - CASE WHEN i = 1 THEN 0 ELSE ends[i - 1] END))), '') END)) AS kept_sha256
FROM d LEFT JOIN cut USING (doc_id)
"""
