"""URL filters over a sorted digest array.

Rules are strings ``host/path``. Their 64-bit xxhash keys are sorted into one file that holds digests, offsets and
the full strings. Spark ships the file to every executor, which memory-maps it; the candidates of a URL (each
suffix of its host with each prefix of its path that some rule could have) are probed by vectorised binary
search, and a hit counts only if the stored string is the candidate, so that colliding digests never match.

Defined cases: a null URL or one without ``://`` has an empty host and path and no rule; empty tables give empty
results; repeated rows are answered row by row; very long URLs cost no more than the longest rule; other columns of
the input are not looked at. Of equal rules the first one given counts. Rule files are bounded by MAX_BYTES.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame, functions as F

from crawlens.llm.common import table

#: (verdict, rule); the list of the query.
RULES = (
    ("block", "com/en/"),
    ("allow", "example.com/en/7"),
    ("allow", "net/de/"),
    ("block", "example.net/de/8"),
    ("block", "org/es/"),
)
MAX_BYTES = 1 << 30
SEED = 0


def digest(key: bytes) -> int:
    return xxhash.xxh64_intdigest(key, SEED)


def built(rules) -> bytes:
    """The file: counts, digests in order, offsets of the strings, verdicts (1: block), path lengths in use, strings."""
    first: dict[bytes, int] = {}
    for verdict, rule in rules:
        host, _, path = rule.partition("/")
        first.setdefault(host.lower().encode() + b"/" + path.encode(), int(verdict == "block"))
    keys = sorted(first, key=lambda k: (digest(k), k))
    digests = np.array([digest(k) for k in keys], np.uint64)
    ends = np.cumsum([0, *map(len, keys)]).astype(np.int64)
    lengths = np.array(sorted({len(k) - k.index(b"/") for k in keys}), np.int64)
    verdicts = np.array([first[k] for k in keys], np.int64)
    out = np.array([len(keys), len(lengths)], np.int64).tobytes() + digests.tobytes() + ends.tobytes() + verdicts.tobytes() + lengths.tobytes() + b"".join(keys)
    if len(out) > MAX_BYTES:
        raise ValueError(f"the rules take {len(out)} bytes; the bound is {MAX_BYTES}")
    return out


@dataclass
class DigestArray:
    """The memory-mapped file."""

    path: str

    def __post_init__(self):
        raw = np.memmap(self.path, np.uint8, "r")
        n, m = raw[:16].view(np.int64)
        cut = np.cumsum([16, 8 * n, 8 * (n + 1), 8 * n, 8 * m])
        self.digests, self.ends, self.block = raw[cut[0] : cut[1]].view(np.uint64), raw[cut[1] : cut[2]].view(np.int64), raw[cut[2] : cut[3]].view(np.int64)
        self.lengths, self.strings = raw[cut[3] : cut[4]].view(np.int64).tolist(), raw[cut[4] :]

    def find(self, keys: list[bytes]) -> np.ndarray:
        """The place of each key, or -1."""
        out = np.full(len(keys), -1, np.int64)
        if not keys or not len(self.digests):
            return out
        h = np.fromiter(map(digest, keys), np.uint64, len(keys))
        at = np.searchsorted(self.digests, h)
        live = np.flatnonzero((at < len(self.digests)) & (self.digests[np.minimum(at, len(self.digests) - 1)] == h))
        for i in live.tolist():  # hits only; walk over digests that collide
            k = int(at[i])
            while k < len(self.digests) and self.digests[k] == h[i]:
                if self.strings[self.ends[k] : self.ends[k + 1]].tobytes() == keys[i]:
                    out[i] = k
                    break
                k += 1
        return out


def candidates(host: bytes, path: bytes, lengths: list[int]) -> list[bytes]:
    """Every rule that could fit, the longest first."""
    if not host or not path:
        return []
    labels = host.split(b".")
    hosts = [b".".join(labels[i:]) for i in range(len(labels))]
    return sorted({h + path[:n] for h in hosts for n in lengths if n <= len(path)}, key=lambda k: (-len(k), k))


def judged(pages: DataFrame, rules=RULES, default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """``(page_id, host, path, rule, verdict)`` for every page; ``default`` where no rule fits."""
    spark = pages.sparkSession
    name = f"rules-{uuid.uuid4().hex}.bin"
    local = os.path.join(tempfile.mkdtemp(), name)
    with open(local, "wb") as f:
        f.write(built(rules))
    spark.sparkContext.addFile(local)  # the driver serves it to executors, also to those that join later

    url = F.col(url_col)
    rest = F.when(F.instr(url, "://") > 0, F.substring_index(F.expr(f"substring(`{url_col}`, instr(`{url_col}`, '://') + 3)"), "#", 1))
    rest = F.coalesce(F.substring_index(rest, "?", 1), F.lit(""))
    host = F.substring_index(rest, "/", 1)
    parts = pages.select(
        F.col(id_col).alias("page_id"),
        F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz").alias("host"),
        rest.substr(F.length(host) + 1, F.length(rest)).alias("path"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        array = DigestArray(SparkFiles.get(name))
        for b in batches:
            keys, owner = [], []
            for i, (h, p) in enumerate(zip(b.column("host").cast(pa.binary()).to_pylist(), b.column("path").cast(pa.binary()).to_pylist())):
                own = candidates(h, p, array.lengths)
                keys += own
                owner += [i] * len(own)
            found = array.find(keys)
            rule, verdict = [None] * b.num_rows, [default] * b.num_rows
            for j in np.flatnonzero(found >= 0)[::-1].tolist():  # candidates stand longest first: the last written counts
                rule[owner[j]] = keys[j].decode()
                verdict[owner[j]] = "block" if array.block[found[j]] else "allow"
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("host"), b.column("path"), pa.array(rule, pa.string()), pa.array(verdict, pa.string())], names=["page_id", "host", "path", "rule", "verdict"])

    kind = pages.schema[id_col].dataType.simpleString()
    return parts.mapInArrow(run, f"page_id {kind}, host string, path string, rule string, verdict string")


def query(spark, sf_dir):
    return judged(table(spark, sf_dir, "pages"))


_FITS = " UNION ALL ".join(f"SELECT '{v}' AS verdict, '{r}' AS rule, '{r.partition('/')[0]}' AS h, '/{r.partition('/')[2]}' AS p" for v, r in RULES)
ORACLE = f"""
WITH cut AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN regexp_extract(substr(url, strpos(url, '://') + 3), '^[^?#]*') ELSE '' END AS rest FROM pages
), parts AS (
  SELECT page_id, translate(split_part(rest, '/', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         substr(rest, length(split_part(rest, '/', 1)) + 1) AS path FROM cut
), fits AS ({_FITS}), hit AS (
  SELECT page_id, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict
  FROM parts JOIN fits ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM parts LEFT JOIN hit USING (page_id)
"""
