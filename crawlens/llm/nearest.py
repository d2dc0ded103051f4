"""Approximate nearest neighbours by shifted space-filling curves.

Vectors are projected onto CURVES seeded frames of DIMS orthonormal directions, scaled by the spread over all rows and
shifted at random; the Hilbert key of the grid cell orders each curve. Spark range-partitions the rows by (curve,
key), per-partition counts turn places into ranks, and a query meets the rows whose rank lies within its window on each
curve, block by block of ranks. A block's best rows are found by a matrix product and measured again exactly (double
precision, on the original vectors); the windows of all curves merge into the final ranking.

Equal vectors are one row that carries its smallest ids, so copies take no room in a window and none gets lost. The
window is a share of the table on either side (at least MIN_WINDOW rows): isotropic vectors, as in the tests, need wide
windows for a recall of 0.9; give ``window`` in rows where the vectors have structure.

Defined cases: vectors that are null, empty, all zero, or hold a null or non-finite component take no part, nor do those
of another length than the most frequent one (the smaller of tied lengths); null ids are neither queries nor
candidates; repeated rows count once; with fewer candidates than k all are returned; an empty table gives an empty
result; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from crawlens.llm.common import stored, table

CURVES, DIMS, BITS = 8, 3, 16
SHARE, MIN_WINDOW = 0.1, 256
BLOCK, QUERIES = 8192, 2048


def hilbert(x: np.ndarray, bits: int) -> np.ndarray:
    """Keys along the Hilbert curve of grid points ``x`` (n, d), unsigned; the transpose form of Skilling's algorithm."""
    x, one = x.astype(np.uint64), np.uint64(1)
    d = x.shape[1]
    for b in range(bits - 1, 0, -1):
        q = np.uint64(1 << b)
        p = q - one
        for i in range(d):
            high = (x[:, i] & q) != 0
            swap = (x[:, 0] ^ x[:, i]) & p
            first = np.where(high, x[:, 0] ^ p, x[:, 0] ^ swap)
            x[:, i] = np.where(high, x[:, i], x[:, i] ^ swap) if i else first
            x[:, 0] = first
    for i in range(1, d):
        x[:, i] ^= x[:, i - 1]
    t = np.zeros(len(x), np.uint64)
    for b in range(bits - 1, 0, -1):
        q = np.uint64(1 << b)
        t = np.where((x[:, d - 1] & q) != 0, t ^ (q - one), t)
    x ^= t[:, None]
    key = np.zeros(len(x), np.uint64)
    for b in range(bits - 1, -1, -1):
        for i in range(d):
            key = (key << one) | ((x[:, i] >> np.uint64(b)) & one)
    return key


def frames(dim: int, curves: int, dims: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """The projections (curves, dim, dims) and the shifts (curves, dims), in units of the spread."""
    rng = np.random.default_rng(seed)
    dims = min(dims, dim)
    return np.stack([np.linalg.qr(rng.normal(size=(dim, dims)))[0] for _ in range(curves)]), rng.uniform(-0.5, 0.5, (curves, dims))


def usable(vector: Column) -> Column:
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & F.coalesce(fine, F.lit(False)) & F.exists(vector, lambda x: x != 0)


def _matrix(column: pa.Array) -> np.ndarray:
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), np.float64).reshape(len(rows), -1) if rows else np.zeros((0, 1))


def distances(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    return np.sqrt(((x - q) ** 2).sum(axis=1))


def _distinct(rows: DataFrame, k: int) -> DataFrame:
    """``(vector, ids)``: every different vector as bytes, with its k + 1 smallest ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column("v").flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(b.num_rows, -1) + 0.0
            ids: dict[bytes, list[int]] = {}
            for i, row in sorted(zip(b.column("id").to_pylist(), x), key=lambda p: p[0]):
                own = ids.setdefault(row.tobytes(), [])
                if len(own) <= k and (not own or own[-1] != i):
                    own.append(i)
            yield pa.RecordBatch.from_arrays([pa.array(list(ids), pa.binary()), pa.array(list(ids.values()), pa.list_(pa.int64()))], names=["vector", "ids"])

    local = rows.mapInArrow(run, "vector binary, ids array<long>")
    return local.groupBy("vector").agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, k + 1).alias("ids"))  # k + 1 ids per batch at most


def searched(rows: DataFrame, k: int = 10, every: int = 100, curves: int = CURVES, dims: int = DIMS, share: float = SHARE, window: int | None = None, seed: int = 7, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``(query_id, rank, vec_id, score)`` for the rows whose id is divisible by ``every``."""
    own = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v")).where(F.col("id").isNotNull() & usable(F.col("v")))
    common = own.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").head()
    spark = rows.sparkSession
    if common is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim = common["d"]
    own = own.where(F.size("v") == dim)
    base = stored(_distinct(own, k), "vectors")
    n = base.count()
    w = window or max(MIN_WINDOW, int(np.ceil(share * n)))
    turn, shift = frames(dim, curves, dims, seed)
    dims = turn.shape[2]
    flat = turn.transpose(1, 0, 2).reshape(dim, curves * dims)

    def moments(batches):
        s = np.zeros((2, curves * dims))
        for b in batches:
            y = _matrix(b.column("vector")) @ flat if b.num_rows else np.zeros((0, curves * dims))
            s += np.stack([y.sum(axis=0), (y**2).sum(axis=0)])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(s.size)), pa.array(s.reshape(-1))], names=["cell", "v"])

    s = np.zeros(2 * curves * dims)
    for r in base.select("vector").mapInArrow(moments, "cell long, v double").groupBy("cell").agg(F.sum("v").alias("v")).collect():  # 2 * curves * dims rows
        s[r["cell"]] = r["v"]
    mean, square = s.reshape(2, -1) / n
    spread = np.sqrt(np.maximum(square - mean**2, 1e-30))

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            y = ((_matrix(b.column("vector")) @ flat - mean) / spread).reshape(b.num_rows, curves, dims) + shift
            cell = np.clip((y + 5) / 10 * (1 << BITS), 0, (1 << BITS) - 1).astype(np.uint64)
            for c in range(curves):
                key = (hilbert(cell[:, c], BITS) >> np.uint64(1)).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(b.num_rows, c, np.int32)), pa.array(key), b.column("vector"), b.column("ids")], names=["curve", "key", "vector", "ids"])

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at = TaskContext.get().partitionId(), 0
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(np.full(b.num_rows, part, np.int32)), pa.array(np.arange(at, at + b.num_rows)), b.column("curve"), b.column("vector"), b.column("ids")], names=["part", "place", "curve", "vector", "ids"])
            at += b.num_rows

    lines = base.mapInArrow(keyed, "curve int, key long, vector binary, ids array<long>")
    parts = max(8, n * curves // 100_000)
    lines = lines.repartitionByRange(parts, "curve", "key", "vector").sortWithinPartitions("curve", "key", "vector")
    lines = stored(lines.mapInArrow(placed, "part int, place long, curve int, vector binary, ids array<long>"), "curves")
    counts = lines.groupBy("curve", "part").agg(F.count("*").alias("n"), F.min("place").alias("first"))
    offset = F.coalesce(F.sum("n").over(W.partitionBy("curve").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select("curve", "part", (offset - F.col("first")).alias("offset"))
    ranked = lines.join(F.broadcast(counts) if parts * curves < 100_000 else counts, ["curve", "part"]).select("curve", (F.col("place") + F.col("offset")).alias("at"), "vector", "ids")

    size = int(min(BLOCK, max(256, w // 2)))
    asked = own.where(F.col("id") % every == 0)
    chunks = max(1, int(asked.count() * min(1.0, (2 * w + size) / n) // QUERIES))
    asks = asked.select("id", F.transform("v", lambda x: x.cast("double") + 0.0).alias("v")).distinct()

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column("v").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array([r.tobytes() for r in x], pa.binary())], names=["id", "vector"])

    asks = asks.mapInArrow(packed, "id long, vector binary").withColumn("chunk", F.pmod(F.xxhash64("id"), F.lit(chunks)).cast("int"))
    first, last = F.greatest(F.lit(0), F.col("at") - w), F.least(F.lit(n - 1), F.col("at") + w)
    asks = asks.join(ranked.select("curve", "at", "vector"), "vector").select("curve", "chunk", F.explode(F.sequence(F.floor(first / size), F.floor(last / size))).alias("block"), "id", "at", "vector")
    asks = stored(asks, "queries")
    blocks = ranked.select("curve", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk"), F.floor(F.col("at") / size).alias("block"), "at", "vector", "ids")

    def met(rows: pa.Table, queries: pa.Table) -> pa.Table:
        out: list[tuple[int, int, float]] = []
        if rows.num_rows and queries.num_rows:
            x, q = _matrix(rows.column("vector")), _matrix(queries.column("vector"))
            ids, at = rows.column("ids").to_pylist(), rows.column("at").to_numpy()
            near = (x**2).sum(axis=1)[None, :] + (q**2).sum(axis=1)[:, None] - 2 * q @ x.T
            near[np.abs(queries.column("at").to_numpy()[:, None] - at[None, :]) > w] = np.inf
            slack = 1e-9 * (float((x**2).sum(axis=1).max()) + float((q**2).sum(axis=1).max()))
            for i, own_id in enumerate(queries.column("id").to_pylist()):
                row = near[i]
                if len(row) > k + 1:
                    best = np.flatnonzero(row <= np.partition(row, k)[k] + slack)
                    best = best[np.isfinite(row[best])]
                else:
                    best = np.flatnonzero(np.isfinite(row))
                found = sorted((d, v) for j, d in zip(best.tolist(), distances(x[best], q[i]).tolist()) for v in ids[j] if v != own_id)
                out += [(own_id, v, d) for d, v in found[:k]]
        cols = list(zip(*out)) or [(), (), ()]
        return pa.table({"query_id": pa.array(cols[0], pa.int64()), "vec_id": pa.array(cols[1], pa.int64()), "score": pa.array(cols[2], pa.float64())})

    pairs = blocks.groupBy("curve", "chunk", "block").cogroup(asks.groupBy("curve", "chunk", "block")).applyInArrow(met, "query_id long, vec_id long, score double")
    best = pairs.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy("score", "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark, sf_dir):
    return searched(table(spark, sf_dir, "embeddings"))
