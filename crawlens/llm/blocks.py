"""Blocks of documents, and questions about keys that all blocks share.

A corpus is written once as rows of some MB of text each, bucketed by the scan task that made them (a task writes one
file, no text is shuffled). Exact answers about keys that occur in many blocks take an exchange: every block sends its
different keys, packed into one row of bytes per group of keys; one task per group answers each of these rows with as many
answers; and the answers go back to the block by a join on the bucket, which leaves the text where it is. Equal keys of
a block are one key, so a key in a third of all documents comes once from each block. The number of groups follows
the size of the corpus, so that a group takes a bounded share of memory at any size.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from crawlens.llm.common import fresh_path, small_batches, stored, texts

BLOCK_BYTES = 2 << 20
GROUP_BYTES = 16 << 20  # of text for each group of keys
BLOCKS = 2  # that a worker is handed at once
ROW_GROUP = 8 << 20  # bytes of a stored row group, which a writer and a reader hold whole
NO_ID = np.iinfo(np.int64).max  # a null id counts as the largest


@dataclass
class Block:
    """Documents in the order read, with what earlier exchanges answered (by name and group)."""

    part: int
    number: int
    ids: np.ndarray
    nulls: list[bool]
    texts: list[bytes]
    answers: dict[str, dict[int, bytes]] = field(default_factory=dict)


@dataclass
class Blocks:
    frame: DataFrame
    groups: int
    replies: dict[str, DataFrame] = field(default_factory=dict)


def blocks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> Blocks:
    """Write the blocks into shared storage; null texts count as empty."""
    spark = docs.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, ids, own, size = TaskContext.get().partitionId(), 0, [], [], 0

        def done():
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([number], pa.int32()), pa.array([ids], pa.list_(pa.int64())), pa.array([own], pa.list_(pa.binary())), pa.array([size], pa.int64())], names=["part", "number", "ids", "texts", "size"])

        for b in batches:
            for i, t in zip(b.column("_id").to_pylist(), texts(b, "_text")):
                if own and size + len(t or b"") > block_bytes:
                    yield done()
                    number, ids, own, size = number + 1, [], [], 0
                ids.append(i)
                own.append(t or b"")
                size += len(own[-1])
        if own:
            yield done()

    source = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("_text"))
    made = source.mapInArrow(run, "part int, number int, ids array<long>, texts array<binary>, size long")
    buckets = max(1, min(50_000, source.rdd.getNumPartitions()))
    name = f"crawlens_blocks_{uuid.uuid4().hex}"
    # A row is some MB: its group's size is looked at after each row (by default after 100 at least), so that memory does not follow the scan task's share of the input.
    groups = {"parquet.block.size": str(ROW_GROUP), "parquet.page.size.row.check.min": "1", "parquet.page.size.row.check.max": "1"}
    made.write.bucketBy(buckets, "part").option("path", fresh_path(spark, "blocks")).option("compression", "zstd").options(**groups).format("parquet").saveAsTable(name)
    frame = spark.table(name)
    total = frame.agg(F.sum("size").alias("n")).head()["n"] or 0
    return Blocks(frame, int(max(4, -(-total // GROUP_BYTES))))


def _joined(b: Blocks) -> DataFrame:
    """A block's row carries its own answers only: those of its whole part, in each of its rows, would grow with the square of the part."""
    frame = b.frame
    for name, reply in b.replies.items():
        frame = frame.join(reply.hint("shuffle_hash"), "part", "left").withColumn(f"re_{name}", F.col("answers")[F.col("number")]).drop("answers")
    return frame


def _read(batch: pa.RecordBatch, names: list[str]) -> Iterator[Block]:
    rows = batch.num_rows
    for i in range(rows):
        ids = batch.column("ids")[i].as_py()
        block = Block(
            batch.column("part")[i].as_py(), batch.column("number")[i].as_py(),
            np.array([NO_ID if x is None else x for x in ids], np.int64), [x is None for x in ids], batch.column("texts")[i].as_py(),
        )
        for n in names:
            got = batch.column(f"re_{n}")[i]
            block.answers[n] = {x["grp"].as_py(): x["data"].as_py() for x in got} if got.is_valid else {}
        yield block


def mapped(b: Blocks, fn: Callable[[Block], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``fn`` over all blocks, with the answers so far."""
    names = list(b.replies)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in _read(batch, names):
                yield from fn(block)

    return _joined(b).mapInArrow(run, schema)


def exchange(b: Blocks, name: str, ask: Callable[[Block], Iterator[tuple[int, bytes]]], answer: Callable[[list[bytes]], list[bytes | None]]) -> None:
    """Every block's ``ask`` gives (group, bytes) pairs; ``answer`` gets all bytes of a group and gives an answer for each (None: nothing to say)."""

    def asked(block: Block) -> Iterator[pa.RecordBatch]:
        pairs = list(ask(block))
        if pairs:
            grp, data = zip(*pairs)
            n = len(pairs)
            yield pa.RecordBatch.from_arrays([pa.array(grp, pa.int32()), pa.array([block.part] * n, pa.int32()), pa.array([block.number] * n, pa.int32()), pa.array(data, pa.binary())], names=["grp", "part", "number", "data"])

    def answered(rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        found = answer(rows.column("data").to_pylist())
        keep = pa.array([x is not None for x in found], pa.bool_())
        out = pa.table({"grp": rows.column("grp"), "part": rows.column("part"), "number": rows.column("number"), "data": pa.array(found, pa.binary())})
        return out.filter(keep)

    sent = mapped(b, asked, "grp int, part int, number int, data binary")
    replies = sent.groupBy("grp").applyInArrow(answered, "grp int, part int, number int, data binary")
    per_block = replies.repartition("part").groupBy("part", "number").agg(F.collect_list(F.struct("grp", "data")).alias("own"))  # a few bits for each key of the block
    per_part = per_block.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("number", "own"))).alias("answers"))
    with small_batches(b.frame.sparkSession, BLOCKS):
        b.replies[name] = stored(per_part, f"answers-{name}")


def by_group(keys: np.ndarray, groups: int) -> tuple[np.ndarray, np.ndarray]:
    """Group of each key (from its high half, so that low bits stay free), and the order that sorts by group, stable."""
    grp = ((keys >> np.uint64(32)) % np.uint64(groups)).astype(np.int64)
    return grp, np.argsort(grp, kind="stable")


def split(keys: np.ndarray, groups: int) -> Iterator[tuple[int, np.ndarray]]:
    """(group, places of its keys), groups in order."""
    grp, order = by_group(keys, groups)
    if len(order):
        cuts = np.flatnonzero(np.diff(grp[order])) + 1
        for places in np.split(order, cuts):
            yield int(grp[places[0]]), places


def gathered(keys: np.ndarray, groups: int, answers: dict[int, bytes], kind=np.uint8) -> np.ndarray:
    """The answers of one exchange, one for each key that was asked; 0 where a group said nothing."""
    out = np.zeros(len(keys), kind)
    for g, places in split(keys, groups):
        if g in answers:
            out[places] = np.frombuffer(answers[g], kind)
    return out


def mixed(x: np.ndarray) -> np.ndarray:
    """Bits of 64-bit numbers spread over the whole number."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def earliest(sent: list[bytes]) -> list[bytes | None]:
    """For rows of (key, order…) records: 1 where a smaller order of the same key was sent. Records are uint64 keys, then int64 columns."""
    tables = [unpacked(x) for x in sent]
    keys = np.concatenate([t[0] for t in tables])
    orders = [np.concatenate(c) for c in zip(*(t[1:] for t in tables))]
    order = np.lexsort((*orders[::-1], keys))
    k = keys[order]
    first = np.ones(len(k), bool)
    first[1:] = k[1:] != k[:-1]
    lead = np.maximum.accumulate(np.where(first, np.arange(len(k)), 0))
    later = np.zeros(len(k), bool)
    for c in orders:
        later |= c[order] != c[order][lead]
    out = np.zeros(len(k), np.uint8)
    out[order] = later
    cuts = np.cumsum([len(t[0]) for t in tables])[:-1]
    return [x.tobytes() if x.any() else None for x in np.split(out, cuts)]


def packed(keys: np.ndarray, *columns: np.ndarray) -> bytes:
    return np.array([len(columns)], np.int64).tobytes() + keys.tobytes() + b"".join(c.astype(np.int64).tobytes() for c in columns)


def unpacked(data: bytes) -> list[np.ndarray]:
    m = int(np.frombuffer(data, np.int64, 1)[0])
    rows = np.frombuffer(data, np.int64, offset=8).reshape(m + 1, -1)
    return [rows[0].view(np.uint64), *rows[1:]]
