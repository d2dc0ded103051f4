"""SimHash near-duplicates, linked by the generalised pigeonhole principle.

Fingerprint bits are grouped into partitions, correlated bits together. Unequal thresholds t_i with
sum(t_i) = d - m + 1 are dealt to the m partitions by dynamic programming on the estimated number of
candidates: two fingerprints within d bits then agree up to t_i bits in some partition i. A partition with
t_i = -1 is never probed. Each fingerprint goes to the buckets of its partition values (with every choice of
t_i bits blanked), and members of one bucket are verified.

A bucket of more than DENSE members is not paired: its members are joined through the points that lie one
flip away (two members share such a point exactly if they differ in two bits or fewer), 65 rows a member
however large the bucket is. So no link is lost and nothing grows with the square of a group.

Defined cases: a null, empty or blank text has fingerprint zero, linked like any other; texts of fewer words than
a shingle are one shingle; long texts are summed in slices; equal texts share a fingerprint and are linked once;
repeated rows are answered row by row; null ids never become a component's id unless nothing else is there;
an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from crawlens.llm.common import stored, table, texts
from crawlens.llm.components import components

SLICE = 16384
DENSE = 64


def fingerprint(text: bytes | None, width: int = 3, seed: int = 42) -> int:
    """The fingerprint as a signed 64-bit number."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    joined, size = b" ".join(words), np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(size + 1) - 1
    starts = ends - size
    n = max(1, len(words) - width + 1)
    starts, ends, h = starts[:n], ends[-n:], xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    for i in range(0, n, SLICE):
        part = np.fromiter((h(joined[a:b], seed) for a, b in zip(starts[i : i + SLICE].tolist(), ends[i : i + SLICE].tolist())), np.uint64, min(SLICE, n - i))
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n).view(np.int64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, seed: int = 42) -> DataFrame:
    """``(doc_id, fp)``, one row per document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = pa.array([fingerprint(t, width, seed) for t in texts(b, "_text")], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("_id"), fps], names=["doc_id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).mapInArrow(run, f"doc_id {kind}, fp long")


def bit_counts(fps: DataFrame) -> np.ndarray:
    """64 x 64 counts of fingerprints that have both bits; one row of sums per task, summed in Spark."""

    def run(batches):
        total = np.zeros((64, 64), np.int64)
        for b in batches:
            v = b.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            for i in range(0, len(v), SLICE):
                x = ((v[i : i + SLICE, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)).astype(np.float32)
                total += (x.T @ x).astype(np.int64)
        i, j = np.triu_indices(64)
        yield pa.RecordBatch.from_arrays([pa.array(i * 64 + j), pa.array(total[i, j])], names=["cell", "n"])

    out = np.zeros((64, 64), np.int64)
    for r in fps.select("fp").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():  # 2080 rows at any size
        out[r["cell"] // 64, r["cell"] % 64] = out[r["cell"] % 64, r["cell"] // 64] = r["n"]
    return out


def grouped_bits(tie: np.ndarray, m: int) -> list[list[int]]:
    """m groups of near-equal size; each grows around its seed by the bits most correlated with it."""
    left, parts = set(range(64)), []
    for i in range(m):
        want = (64 - sum(map(len, parts))) // (m - i)
        part = [max(left, key=lambda b: (tie[b, list(left)].sum(), -b))]
        left.remove(part[0])
        while len(part) < want:
            part.append(max(left, key=lambda b: (tie[b, part].mean(), -b)))
            left.remove(part[-1])
        parts.append(sorted(part))
    return parts


def allocation(n: int, both: np.ndarray, d: int) -> list[tuple[list[int], int]]:
    """Partitions of bits with their thresholds: the cheapest by bucket rows plus estimated candidates."""
    p = np.diag(both) / max(n, 1)
    cov = both / max(n, 1) - np.outer(p, p)
    sd = np.sqrt(np.clip(p * (1 - p), 1e-12, None))
    tie = np.abs(cov / np.outer(sd, sd))
    np.fill_diagonal(tie, 0)
    differ = 2 * p * (1 - p)
    best: tuple[float, list] = (np.inf, [])
    for m in range(1, d + 4):
        parts = grouped_bits(tie, m)
        cost = []
        for part in parts:
            dist = np.zeros(d + 1)  # of the number of differing bits of two fingerprints
            dist[0] = 1
            for b in part:
                dist = dist * (1 - differ[b]) + np.concatenate(([0], dist[:-1])) * differ[b]
            cost.append({-1: 0.0} | {t: 4.0 * n * comb(len(part), t) + n * n / 2 * dist[: t + 1].sum() for t in range(d + 1)})
        table: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}  # thresholds spent so far → cheapest way
        for c in cost:
            step: dict[int, tuple[float, list[int]]] = {}
            for spent, (v, ts) in table.items():
                for t, x in c.items():
                    if spent + t not in step or v + x < step[spent + t][0]:
                        step[spent + t] = (v + x, [*ts, t])
            table = step
        if (found := table.get(d - m + 1)) and found[0] < best[0]:
            best = (found[0], [(part, t) for part, t in zip(parts, found[1]) if t >= 0])
    return best[1]


def signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def masks(plan: list[tuple[list[int], int]]) -> list[int]:
    """One mask for each bucket that a fingerprint goes to."""
    return [signed(sum(1 << b for b in part) & ~sum(1 << b for b in out)) for part, t in plan for out in combinations(part, t)]


def links(fps: DataFrame, d: int = 2, dense: int = DENSE) -> DataFrame:
    """``fps(fp)``, all different → edges ``(a, b)`` whose components are those of all pairs within d bits.

    In dense buckets, b may be a point one flip away from its fingerprints instead of a fingerprint.
    """
    if d % 2:
        raise ValueError("d must be even: dense buckets join their members half way")
    n = fps.count()
    keys = masks(allocation(n, bit_counts(fps), d))
    slots = F.array(*(F.struct(F.lit(i).alias("slot"), F.col("fp").bitwiseAND(F.lit(k)).alias("key")) for i, k in enumerate(keys)))
    probes = fps.select("fp", F.explode(slots).alias("k")).select("fp", "k.slot", "k.key")
    sizes = probes.groupBy("slot", "key").agg(F.count("*").alias("n")).where("n > 1")
    shared = stored(probes.join(sizes, ["slot", "key"]), "probes")
    thin = shared.where(F.col("n") <= dense).groupBy("slot", "key").agg(F.collect_list("fp").alias("group"))  # dense members at most
    pairs = (
        thin.select("group", F.explode("group").alias("a"))
        .select("a", F.explode(F.filter("group", lambda x: (x > F.col("a")) & (F.bit_count(x.bitwiseXOR(F.col("a"))) <= d))).alias("b"))
        .distinct()
    )
    flips = [signed(sum(1 << b for b in c)) for r in range(d // 2 + 1) for c in combinations(range(64), r)]
    thick = shared.where(F.col("n") > dense).select("fp").distinct()
    points = thick.select("fp", F.explode(F.array(*map(F.lit, flips))).alias("x")).select("fp", F.col("fp").bitwiseXOR(F.col("x")).alias("point"))
    met = points.groupBy("point").agg(F.count("*").alias("n")).where("n > 1").select("point")
    return pairs.union(points.join(met, "point").select("fp", "point"))


def near_duplicates(docs: DataFrame, d: int = 2, id_col: str = "doc_id", text_col: str = "text", width: int = 3, seed: int = 42) -> DataFrame:
    """``(doc_id, fingerprint, component_id)`` for every document."""
    own = stored(fingerprints(docs, id_col, text_col, width, seed), "fingerprints")
    firsts = stored(own.groupBy("fp").agg(F.min("doc_id").alias("first")), "firsts")
    labels = components(links(firsts.select("fp"), d)).withColumnRenamed("node", "fp")
    linked = firsts.join(labels, "fp")
    least = linked.groupBy("label").agg(F.min("first").alias("least"))
    classes = linked.join(least, "label").select("fp", "least")
    known = firsts.join(classes, "fp", "left").select("fp", F.coalesce("least", "first").alias("component_id"))
    # Written out, so that both sides of the last join are plain shuffles: a fingerprint of very many copies can then be split.
    return own.join(stored(known, "classes"), "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def query(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"))
