"""Near-duplicates by SimHash, confirmed and completed by the Jaccard similarity of word shingles: every pair at or above the bound is linked, none by chance.

SimHash comes first: fingerprints of the texts' shingles are linked within BITS bits by the generalised pigeonhole (``simhash.links``), and each set is
verified against the first of its class. Bits are no proof, and most pairs at the bound differ in more of them, so an exact search follows for what they leave apart.

Two sets of similarity t or more share an element among the first ``n - ceil(t * n) + 1`` of each, whatever the order of
elements (prefix filter). The order is by how many shingles fall into a shingle's bin, of 2^BINS bins of their hashes: one that even some tens of sets share
stands out of its bin and comes late. The counts decide how much work there is, not what is found. Sets that meet in a bucket (a shingle of their prefixes) and whose sizes and
positions leave it possible are verified on the whole sets, in integers, unless their sketches rule them out.

A bucket of more than DENSE sets is first compared with some LEADERS among its members, by a hash of the member, so that they are much the same
ones in all buckets of a group; each turn has more of them, for the sets that are not linked yet. Only sets that are not in one component yet are then paired, each set outside of the bucket's largest component with all others. So no pair is lost,
and the copies of one text cost no square of their number.

Defined cases: texts are lower-cased; a text of fewer words than a shingle is one shingle; null, empty and blank texts are
equal; bytes that are not UTF-8 become replacement characters; equal sets are one node, by a 64-bit key of the whole set that is not confirmed (among 10^9 different
sets one pair in 30 corpora has equal keys); rows without an id stay and take no part; columns of any name are kept; an empty table gives an empty result.

Sets are verified in 32 bits a shingle: two sets of 1,000 shingles have a false common one once in 4,000 pairs, which matters only
where it lifts a similarity over the bound by one shingle.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from crawlens.llm import simhash
from crawlens.llm.common import freed, fresh_path, small_batches, stored, texts
from crawlens.llm.components import components

WIDTH, SEED = 5, 42
#: Differing bits of two fingerprints that link them.
BITS = 2
#: The bound on the similarity, as a fraction.
UP, DOWN = 4, 5
BINS, BLOCK = 20, 12  # bits: of bins, and of the bins of a packed block of counts
#: Longs of a sketch; of the wider one of sets of more than LONG shingles, which the first cannot tell apart.
WORDS, WIDE, LONG = 8, 128, 1000
SLICE = 256  # rows whose sets a worker holds at once
DENSE, LEADERS = 8, (8, 64)


def shingles(text: bytes | None, width: int = WIDTH, seed: int = SEED) -> np.ndarray:
    """The different hashes of a text's shingles, sorted."""
    words = (text or b"").decode(errors="replace").lower().encode().split()
    h = xxhash.xxh64_intdigest
    own = np.fromiter((h(w, seed) for w in words), np.uint64, len(words))
    n = max(1, len(words) - width + 1)
    out = np.full(n, min(width, len(words)), np.uint64)
    for j in range(min(width, len(words))):
        out = (out ^ own[j : j + n]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return np.unique(out)


def key_of(hashes: np.ndarray) -> int:
    """The signed key of a set."""
    x = xxhash.xxh64_intdigest(hashes.tobytes(), SEED)
    return x - (1 << 64) if x >= 1 << 63 else x


def prefix_size(n: int) -> int:
    return n + (-UP * n // DOWN) + 1


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of SLICE rows, so that a worker's memory follows its largest text and not the batch."""
    for b in batches:
        for at in range(0, b.num_rows, SLICE):
            yield b.slice(at, SLICE)


def sketch(hashes: np.ndarray, words: int = WORDS) -> np.ndarray:
    """By bin, the parity of its shingles. Sketches differ in no more bits than the sets differ in shingles, so they rule pairs out without loss."""
    odd = np.bincount((hashes & np.uint64(64 * words - 1)).astype(np.int64), minlength=64 * words) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(doc_id, node, counts)``: a document's set without counts; and rows without an id, a task's counts of the bins of block ``node``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, counts, kind = ["doc_id", "node", "counts"], np.zeros(1 << BINS, np.int32), None
        for b in _slices(batches):
            kind, keys = b.column("_id").type, []
            for t in texts(b, "_text"):
                own = shingles(t)
                keys.append(key_of(own))
                np.add.at(counts, (own >> np.uint64(64 - BINS)).astype(np.int64), 1)
            yield pa.RecordBatch.from_arrays([b.column("_id"), pa.array(keys, pa.int64()), pa.nulls(len(keys), pa.binary())], names=names)
        if kind is not None:
            parts = counts.reshape(-1, 1 << BLOCK)
            yield pa.RecordBatch.from_arrays([pa.nulls(len(parts), kind), pa.array(np.arange(len(parts))), pa.array([x.tobytes() for x in parts], pa.binary())], names=names)

    kind = docs.schema[id_col].dataType.simpleString()
    own = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    return own.mapInArrow(run, f"doc_id {kind}, node long, counts binary")


def _order(counts: DataFrame) -> np.ndarray:
    """By bin, how many shingles it holds, as far as 32 bits tell."""

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, node = np.zeros(1 << BLOCK, np.int64), None
        for b in batches:  # a task's block at a time, whatever the number of tasks
            node = b.column("node").slice(0, 1)
            for x in b.column("counts"):
                total += np.frombuffer(x.as_buffer(), np.int32)
        yield pa.RecordBatch.from_arrays([node, pa.array([np.minimum(total, np.iinfo(np.int32).max).astype(np.int32).tobytes()], pa.binary())], names=["node", "counts"])

    out = np.zeros((1 << (BINS - BLOCK), 1 << BLOCK), np.int32)
    for r in counts.groupBy("node").applyInArrow(summed, "node long, counts binary").collect():  # 4 * 2^BINS bytes at any size
        out[r["node"]] = np.frombuffer(r["counts"], np.int32)
    return out.reshape(-1)


def _prefixes(docs: DataFrame, order: np.ndarray, text_col: str) -> DataFrame:
    """``(node, fp, n, prefix, sketch, wide, h)``: each set's key, SimHash fingerprint, size, first shingles, sketches, and all shingles in 32 bits. A task gives each set once."""
    shared = docs.sparkSession.sparkContext.broadcast(order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, seen = shared.value, set()
        for b in _slices(batches):
            rows = []
            for t in texts(b, "_text"):
                own = shingles(t)
                if (key := key_of(own)) in seen:
                    continue
                seen.add(key)
                at = np.argsort(common[(own >> np.uint64(64 - BINS)).astype(np.int64)], kind="stable")
                rows.append((key, simhash.fingerprint(t, WIDTH, SEED), len(own), own[at[: prefix_size(len(own))]].view(np.int64), sketch(own), sketch(own, WIDE) if len(own) > LONG else (), folded(own)))
            keys, fps, sizes, parts, bits, wide, sets = zip(*rows) if rows else ((),) * 7
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(fps, pa.int64()), pa.array(sizes, pa.int32()), pa.array(parts, pa.list_(pa.int64())), pa.array(bits, pa.list_(pa.int64())), pa.array(wide, pa.list_(pa.int64())), pa.array(sets, pa.list_(pa.int32()))], names=["node", "fp", "n", "prefix", "sketch", "wide", "h"])

    return docs.select(F.col(text_col).alias("_text")).mapInArrow(run, "node long, fp long, n int, prefix array<long>, sketch array<long>, wide array<long>, h array<int>")


def folded(hashes: np.ndarray) -> np.ndarray:
    """A set in 32 bits. Equal ones are told apart by their number, so that the size stays and each counts once."""
    out = np.sort((hashes ^ (hashes >> np.uint64(32))).astype(np.uint32))
    while (same := np.flatnonzero(out[1:] == out[:-1])).size:
        out[same + 1] += np.uint32(1)
        out.sort()
    return out.view(np.int32)


def _possible(a: Column, b: Column) -> Column:
    """Whether sizes and the places of a common shingle leave the bound possible."""
    return (DOWN * F.least(a["n"], b["n"]) >= UP * F.greatest(a["n"], b["n"])) & ((UP + DOWN) * F.least(a["n"] - a["i"], b["n"] - b["i"]) >= UP * (a["n"] + b["n"]))


def _placed(prefixes: DataFrame) -> DataFrame:
    """Each set once, whatever the number of tasks that met it, in buckets of its node: joins then move the pairs to the sets."""
    sets = prefixes.groupBy("node").agg(*(F.first(c).alias(c) for c in ("fp", "n", "prefix", "sketch", "wide", "h")))
    spark, name = sets.sparkSession, f"crawlens_sets_{uuid.uuid4().hex}"
    buckets = min(50_000, max(8, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    with freed(spark):
        sets.write.bucketBy(buckets, "node").option("path", fresh_path(spark, "sets")).format("parquet").saveAsTable(name)
    return spark.table(name)


def _likely(pairs: DataFrame, sets: DataFrame, column: str) -> DataFrame:
    """The pairs ``(a, b)`` whose sketches leave the bound possible: few others are left for the sets to travel to."""
    left, right = sets.select("node", F.col("n").alias("n_a"), F.col(column).alias("x")), sets.select("node", F.col("n").alias("n_b"), F.col(column).alias("y"))
    one = pairs.join(left.hint("merge"), F.col("a") == left["node"]).select("a", "b", "n_a", "x")
    both = one.join(right.hint("merge"), F.col("b") == right["node"])
    differ = F.aggregate(F.zip_with("x", "y", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, m: n + m)
    possible = (UP + DOWN) * differ <= (DOWN - UP) * (F.col("n_a") + F.col("n_b"))
    return both.where((F.size("x") != F.size("y")) | possible).select("a", "b")  # one set may be too short for the wide sketch


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs ``(a, b)`` whose sets reach the bound."""
    left, right = sets.select("node", F.col("h").alias("x")), sets.select("node", F.col("h").alias("y"))
    likely = stored(_likely(_likely(pairs.distinct(), sets, "sketch"), sets, "wide"), "likely")
    one = likely.join(left, F.col("a") == left["node"]).select("a", "b", "x")
    both = one.join(right, F.col("b") == right["node"]).select("a", "b", "x", "y")
    return both.where((UP + DOWN) * F.size(F.array_intersect("x", "y")) >= UP * (F.size("x") + F.size("y"))).select("a", "b")


def _labelled(rows: DataFrame, edges: DataFrame) -> DataFrame:
    return rows.join(components(edges), "node", "left").select("token", "size", "m", F.coalesce("label", "node").alias("label"))


def by_fingerprints(sets: DataFrame, bits: int = BITS) -> DataFrame:
    """Edges ``(a, b)`` between the sets of each SimHash class (fingerprints linked within so many bits) and its first set, where they reach the bound."""
    own = sets.select("node", "fp")
    labels = stored(components(simhash.links(own.select("fp").distinct(), bits)), "fingerprints").withColumnRenamed("node", "fp")
    classed = stored(own.join(labels, "fp", "left").select("node", F.coalesce("label", "fp").alias("label")), "fingerprints")
    first = classed.groupBy("label").agg(F.min("node").alias("a"))
    return stored(_verified(classed.join(first, "label").where("node <> a").select("a", F.col("node").alias("b")), sets), "similar")


def _links(shared: DataFrame, sets: DataFrame, near: DataFrame) -> DataFrame:
    """``shared(token, node, n, i, size)`` → edges ``(a, b)`` whose components, with those of ``near``, are those of all pairs at the bound."""
    member = F.struct("node", "n", "i")
    groups = shared.where(F.col("size") <= DENSE).groupBy("token").agg(F.collect_list(member).alias("group"))  # DENSE members at most
    thin = groups.select("group", F.explode("group").alias("one")).select(
        F.col("one.node").alias("a"), F.explode(F.filter("group", lambda x: (x["node"] > F.col("one.node")) & _possible(x, F.col("one")))["node"]).alias("b")
    )
    edges = stored(near.union(_verified(thin.join(near, ["a", "b"], "left_anti"), sets)), "similar")
    dense = stored(shared.where(F.col("size") > DENSE).select("token", "node", "size", member.alias("m")), "dense")
    if not dense.limit(1).count():
        return edges
    for turn, count in enumerate(LEADERS):
        rows = stored(_labelled(dense, edges), "dense")
        share = F.pmod(F.xxhash64("m.node", F.lit(turn)), F.lit(1 << 32)) * F.col("size") < count * (1 << 32)
        some = rows.where(share).select("token", F.struct("m", "label").alias("one"))
        near = rows.join(some, "token").where((F.col("label") != F.col("one.label")) & _possible(F.col("m"), F.col("one.m")))
        found = _verified(near.select(F.col("m.node").alias("a"), F.col("one.m.node").alias("b")), sets)
        edges = stored(edges.union(found), "similar")
    rows = stored(_labelled(dense, edges), "dense")
    most = rows.groupBy("token", "label").agg(F.count("*").alias("n")).groupBy("token").agg(F.max_by("label", "n").alias("most"))
    other = rows.join(most, "token").where("label <> most").select("token", F.col("m").alias("o"), F.col("label").alias("other"))
    left = other.join(rows, "token").where((F.col("label") != F.col("other")) & _possible(F.col("m"), F.col("o")))
    pairs = left.select(F.least("m.node", "o.node").alias("a"), F.greatest("m.node", "o.node").alias("b"))
    return stored(edges.union(_verified(pairs, sets)), "similar")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component, with its smallest id; rows without an id stay."""
    with small_batches(docs.sparkSession):
        keyed = stored(_keyed(docs, id_col, text_col), "keyed")
    own = keyed.where("counts IS NULL").select("doc_id", "node")
    firsts = stored(own.groupBy("node").agg(F.min("doc_id").alias("first")), "firsts")
    given = docs.where(F.col(id_col).isNotNull())
    with small_batches(docs.sparkSession):
        sets = _placed(_prefixes(given, _order(keyed.where("counts IS NOT NULL").select("node", "counts")), text_col))
    probes = sets.select("node", "n", F.posexplode("prefix").alias("i", "token"))
    met = probes.withColumn("size", F.count("*").over(W.partitionBy("token")))  # one shuffle; a token's rows are buffered on disk where they are many
    shared = stored(met.where("size > 1").select("token", "node", "n", "i", "size"), "probes")
    labels = stored(components(_links(shared, sets, by_fingerprints(sets))), "labels")
    classes = firsts.join(labels, "node", "left").select("node", "first", F.coalesce("label", "node").alias("label"))
    least = classes.groupBy("label").agg(F.min(F.struct("first", "node")).alias("least"))
    known = stored(classes.join(least, "label").select("node", F.col("least.first").alias("first"), F.col("least.node").alias("stays")), "classes")
    if own.groupBy("doc_id").count().where("count > 1").limit(1).count():
        return _one_of_repeated(docs, known, id_col, text_col)
    gone = own.join(known, "node").where("doc_id <> first").select("doc_id")
    whole = docs.select(F.struct(*docs.columns).alias("row"))  # no name of the documents can meet one of ours
    return whole.join(gone, F.col(f"row.`{id_col}`") == F.col("doc_id"), "left_anti").select("row.*")


def _one_of_repeated(docs: DataFrame, known: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """As ``one_of_each`` where an id has several rows: each class keeps one row, whatever else has its id."""

    whole = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.struct(*docs.columns).alias("row"))
    kind = whole.schema["row"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches):
            keys = pa.array([key_of(shingles(t)) for t in texts(b)], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("id"), keys, b.column("row")], names=["id", "node", "row"])

    given = whole.where("id IS NOT NULL").mapInArrow(run, f"id {docs.schema[id_col].dataType.simpleString()}, node long, row {kind}")
    stays = known.where("node = stays").select(F.col("first").alias("id"), "node")
    left = given.join(stays, ["id", "node"], "left_semi").dropDuplicates(["id", "node"])
    return left.select("row.*").unionByName(docs.where(F.col(id_col).isNull()))
