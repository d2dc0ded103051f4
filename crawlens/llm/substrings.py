"""Substring dedup by difference-cover anchors: words of a window that also starts in an earlier document go.

PERIOD and COVER are a perfect difference set: for any two places i and j there is a shift s < PERIOD with both i + s and
j + s, taken modulo PERIOD, in COVER. Two equal windows of WINDOW words therefore share an anchor, that is equal hashes
of the ANCHOR = WINDOW - PERIOD + 1 words at a cover place of either document. Every document hashes its anchors at cover
places only. An exchange finds the anchors that occur twice; each of them extends to the windows around it that could
have met there, and a second exchange over whole-window hashes tells which windows start in a document with a
smaller id. Everything is judged on the input.

Hashes are 64 bits of xxhash-mixed words, combined as polynomials.

Defined cases: null, empty and short texts have no window and stay; equal windows within one document stay; of equal
documents the one with the smallest id stays; rows with equal ids do not count against each other; a null id counts as
the largest; long texts are treated whole; bytes that are not UTF-8 belong to words, and are replaced in what is kept; empty tables give empty results;
other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from crawlens.llm.blocks import BLOCKS, Block, blocks, earliest, exchange, gathered, mapped, mixed, packed, split, unpacked
from crawlens.llm.common import small_batches, stored, table, utf8

WINDOW, PERIOD, COVER = 13, 7, (0, 1, 3)
ANCHOR = WINDOW - PERIOD + 1
BASE = np.uint64(0x9E3779B97F4A7C15)


def windows_hashed(w: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of ``width`` words."""
    n = len(w) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = w[:n].copy()
    for i in range(1, width):
        h = h * BASE + w[i : i + n]
    return mixed(h)


class Words:
    """A block's words as hashes, all documents in a row, with its anchors."""

    def __init__(self, block: Block, window: int = WINDOW):
        self.words = [t.split() for t in block.texts]
        sizes = np.fromiter(map(len, self.words), np.int64, len(self.words))
        self.ends = np.cumsum(sizes)
        self.hashes = np.fromiter((xxhash.xxh64_intdigest(x) for own in self.words for x in own), np.uint64, int(sizes.sum()))
        self.doc = np.repeat(np.arange(len(sizes)), sizes)
        self.left = self.ends[self.doc] - np.arange(len(self.doc)) if len(self.doc) else np.zeros(0, np.int64)  # words up to the document's end
        at = sizes[self.doc] - self.left  # place within the document
        anchor = (self.left >= ANCHOR) & (sizes[self.doc] >= window) & np.isin(at % PERIOD, COVER)
        self.anchors = np.flatnonzero(anchor)
        keys = windows_hashed(self.hashes, ANCHOR)[self.anchors] if len(self.anchors) else np.zeros(0, np.uint64)
        self.keys, self.inverse, self.counts = np.unique(keys, return_inverse=True, return_counts=True)

    def windows(self, again: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
        """(starts, hashes) of the windows around anchors that occur twice."""
        mark = np.zeros(len(self.doc) + 1, np.int64)
        hit = self.anchors[again[self.inverse].astype(bool)]
        np.add.at(mark, np.maximum(hit - PERIOD + 1, 0), 1)
        np.add.at(mark, hit + 1, -1)
        starts = np.flatnonzero((np.cumsum(mark[:-1]) > 0) & (self.left >= window))
        return starts, windows_hashed(self.hashes, window)[starts] if len(starts) else np.zeros(0, np.uint64)


def _twice(sent: list[bytes]) -> list[bytes | None]:
    """1 for keys that several blocks sent or one block has twice."""
    tables = [unpacked(x) for x in sent]
    keys, counts = np.concatenate([t[0] for t in tables]), np.concatenate([t[1] for t in tables])
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    same = k[1:] == k[:-1]
    out = np.zeros(len(k), bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    out |= counts > 1
    return [x.astype(np.uint8).tobytes() if x.any() else None for x in np.split(out, np.cumsum([len(t[0]) for t in tables])[:-1])]


def _earliest_here(block: Block, words: Words, again: np.ndarray):
    """Windows of a block: starts, their key's number, the different keys, and the smallest id of each key in the block."""
    starts, hashes = words.windows(again)
    keys, inverse = np.unique(hashes, return_inverse=True)
    least = np.full(len(keys), np.iinfo(np.int64).max)
    np.minimum.at(least, inverse, block.ids[words.doc[starts]])
    return starts, inverse, keys, least


def removed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_words, n_removed, kept)`` for every document; ``kept`` is what stays, joined by single blanks."""
    made = blocks(docs, id_col, text_col)
    groups = made.groups

    def ask_anchors(block: Block) -> Iterator[tuple[int, bytes]]:
        w = Words(block)
        for g, places in split(w.keys, groups):
            yield g, packed(w.keys[places], w.counts[places])

    def ask_windows(block: Block) -> Iterator[tuple[int, bytes]]:
        w = Words(block)
        _, _, keys, least = _earliest_here(block, w, gathered(w.keys, groups, block.answers["anchors"]))
        for g, places in split(keys, groups):
            yield g, packed(keys[places], least[places])

    def kept(block: Block) -> Iterator[pa.RecordBatch]:
        w = Words(block)
        starts, inverse, keys, least = _earliest_here(block, w, gathered(w.keys, groups, block.answers["anchors"]))
        later = gathered(keys, groups, block.answers["windows"]).astype(bool)
        gone = starts[(block.ids[w.doc[starts]] > least[inverse]) | later[inverse]]
        mark = np.zeros(len(w.doc) + 1, np.int64)
        np.add.at(mark, gone, 1)
        np.add.at(mark, gone + WINDOW, -1)
        out = np.cumsum(mark[:-1]) > 0
        n_removed, text, a = [], [], 0
        for own, b in zip(w.words, w.ends.tolist()):
            cut = out[a:b]
            n_removed.append(int(cut.sum()))
            text.append(b" ".join(own) if not n_removed[-1] else b" ".join([x for x, c in zip(own, cut.tolist()) if not c]))
            a = b
        ids = [None if null else i for i, null in zip(block.ids.tolist(), block.nulls)]
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([len(x) for x in w.words], pa.int64()), pa.array(n_removed, pa.int64()), pa.array([utf8(x) for x in text], pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "n_removed", "kept"])

    exchange(made, "anchors", ask_anchors, _twice)
    exchange(made, "windows", ask_windows, earliest)
    return mapped(made, kept, "doc_id long, n_words long, n_removed long, kept string")


def query(spark, sf_dir):
    with small_batches(spark, BLOCKS):
        return stored(removed(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256")), "kept")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), win AS (
  SELECT doc_id, p, array_to_string(w[p:p + 12], ' ') AS s FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 12)) AS p FROM d)
), gone AS (
  SELECT DISTINCT doc_id, unnest(generate_series(p, p + 12)) AS p
  FROM win JOIN (SELECT s, min(doc_id) AS least FROM win GROUP BY s) USING (s) WHERE doc_id > least
), cut AS (SELECT doc_id, list(p) AS ps FROM gone GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(ps), 0) AS BIGINT) AS n_removed,
       sha256(array_to_string(CASE WHEN ps IS NULL THEN w ELSE list_transform(list_filter(generate_series(1, len(w)), lambda i: NOT list_contains(ps, i)), lambda i: w[i]) END, ' ')) AS kept_sha256
FROM d LEFT JOIN cut USING (doc_id)
"""
