"""Conversation prefix trie: which openings conversations share, and how many words sharing them saves.

Every turn becomes a SHA-256 digest of role and text where it is read, so that no text is shuffled. The turns of a
conversation, in order, are chained: the digest of a prefix is that of the shorter prefix and the next turn's digest. One
streaming pass over sorted rows does it and gives a row per prefix, in constant memory for a conversation of any length. Prefixes grouped by (depth,
digest) are the nodes.

Subtree sums send every node to all its ancestors. Nodes with the same smallest member are a run down that member's path,
so each run is summed first and only its sum is sent on, to the ancestors above the run: no more rows than the
member has turns, however deep the trie is. Within a run the sums are those from the end of the path up. What all conversations share (the root, a common first
turn) is combined before each shuffle.

The ids that end at a node are hashed in ascending order: ids of a range of RANGE numbers are joined first, and one pass hashes
the pieces as a stream, so that a text that a third of all conversations repeat holds no list of them.

Defined cases: rows without a conversation id take no part; null roles and texts are empty; null turns come first; turns of equal
number are ordered by their digest, and repeated rows are turns like any other; a conversation without turns is a member of the
root alone; an empty table has no node; very long texts are digested whole; other columns, whatever their names, are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from crawlens.llm.common import WORD, stored, table

ROOT = hashlib.sha256(b"").digest()
RANGE = 1024
FAMILY, SHARED = 20, 4  # conversations that share an opening, and the numbers of turns that they may share


def placed(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``(conv_id, place, said, words)``: each turn's place from 1, its digest and the words of its text."""
    who, what = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role, text))
    said = F.unhex(F.sha2(F.concat(F.octet_length(who).cast("string"), F.lit(":"), who, what).cast("binary"), 256))
    rows = conversations.where(F.col(conv).isNotNull()).select(
        F.col(conv).cast("long").alias("conv_id"), F.col(turn).alias("turn"), said.alias("said"), F.regexp_count(what, F.lit(WORD)).cast("long").alias("words")
    )
    place = F.row_number().over(W.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "said"))
    return rows.select("conv_id", place.alias("place"), "said", "words")


def rebuilt(turns: DataFrame, family: int = FAMILY, shared: int = SHARED) -> DataFrame:
    """Every conversation c with the first h turns of the first conversation of its family instead of its own first h; h = crc32(c) mod ``shared``."""
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % shared
    convs = turns.select("conv_id").distinct().select("conv_id", (F.col("conv_id") - F.col("conv_id") % family).alias("base"), h.alias("h"))
    heads = turns.where((F.col("conv_id") % family == 0) & (F.col("place") < shared)).withColumnRenamed("conv_id", "base")
    taken = convs.join(heads, "base").where("place <= h").select("conv_id", "place", "said", "words")
    return taken.unionByName(turns.where(F.col("place") > h))


def prefixes(convs: DataFrame, turns: DataFrame) -> DataFrame:
    """``(conv_id, depth, node, parent, words, last)``: a row for every prefix of every conversation, the empty one included."""
    start = convs.select("conv_id", F.lit(0).alias("place"), F.lit(b"").alias("said"), F.lit(0).cast("long").alias("words"))
    ordered = start.unionByName(turns).repartition("conv_id").sortWithinPartitions("conv_id", "place")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", "depth", "node", "parent", "words", "last"]
        kinds = (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.bool_())
        rows: list[list] = []  # its last row waits until it is known whether a longer prefix follows

        def out(some: list[list]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*some), kinds)], names=names)

        for b in batches:
            for conv, place, said, words in zip(*(b.column(c).to_pylist() for c in ("conv_id", "place", "said", "words"))):
                if place == 0:
                    rows.append([conv, 0, ROOT, None, 0, True])
                    continue
                before = rows[-1]
                before[5] = False
                rows.append([conv, before[1] + 1, hashlib.sha256(before[2] + said).digest(), before[2], words, True])
            if len(rows) > 1:
                yield out(rows[:-1])
                rows = rows[-1:]
        if rows:
            yield out(rows)

    return ordered.select("conv_id", "place", "said", "words").mapInArrow(run, "conv_id long, depth int, node binary, parent binary, words long, last boolean")


def _ends(paths: DataFrame) -> DataFrame:
    """``(node, ends_sha256)`` of the nodes where conversations end."""
    ids = F.array_join(F.array_sort(F.collect_list("conv_id")).cast("array<string>"), ",")  # RANGE different ids at most
    pieces = paths.where("last").groupBy("node", F.floor(F.col("conv_id") / RANGE).alias("range")).agg(F.min("conv_id").alias("least"), ids.alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state = None, None
        for b in batches:
            done: list[tuple[bytes, str]] = []
            for node, own in zip(b.column("node").to_pylist(), b.column("ids").to_pylist()):
                if node == at:
                    state.update(b"," + own.encode())
                    continue
                if state:
                    done.append((at, state.hexdigest()))
                at, state = node, hashlib.sha256(own.encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done), (pa.binary(), pa.string()))], names=["node", "ends_sha256"])
        if state:
            yield pa.RecordBatch.from_arrays([pa.array([at], pa.binary()), pa.array([state.hexdigest()], pa.string())], names=["node", "ends_sha256"])

    return pieces.repartition("node").sortWithinPartitions("node", "least").select("node", "ids").mapInArrow(run, "node binary, ends_sha256 string")


def trie(convs: DataFrame, turns: DataFrame) -> DataFrame:
    """The nodes over ``convs(conv_id)``, distinct, and ``turns(conv_id, place, said, words)``.

    ``(node, depth, conv_id, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256)``.
    """
    paths = stored(prefixes(convs, turns), "prefixes")
    nodes = paths.groupBy("depth", "node").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.first("parent").alias("parent"), F.first("words").alias("words"))
    nodes = stored(nodes, "nodes")
    children = nodes.where("depth > 0").groupBy("parent").agg(F.count("*").alias("n_children")).withColumnRenamed("parent", "node")
    known = stored(
        nodes.join(children, "node", "left").select(
            "node", "depth", "conv_id", "parent", "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"), F.col("n_children").isNull().cast("long").alias("leaf"), ((F.col("n_convs") - 1) * F.col("words")).alias("saved")
        ),
        "nodes",
    )
    runs = known.groupBy("conv_id").agg(F.min("depth").alias("top"), F.sum("leaf").alias("leaf"), F.sum("saved").alias("saved"))
    above = paths.select("conv_id", "depth", "node").join(runs, "conv_id").where("depth < top")
    arrived = above.groupBy("node").agg(F.sum("leaf").alias("more_leaves"), F.sum("saved").alias("more_saved"))
    below = W.partitionBy("conv_id").orderBy(F.col("depth").desc()).rowsBetween(W.unboundedPreceding, 0)
    own = known.withColumn("leaf", F.sum("leaf").over(below)).withColumn("saved", F.sum("saved").over(below))
    parents = nodes.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    zero = F.lit(0).cast("long")
    return own.join(arrived, "node", "left").join(_ends(paths), "node", "left").join(parents, "parent", "left").select(
        "node", "depth", "conv_id", "parent_conv_id", "n_convs", "n_children", (F.col("leaf") + F.coalesce("more_leaves", zero)).alias("n_leaves"),
        (F.col("saved") + F.coalesce("more_saved", zero)).alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(ROOT.hex())).alias("ends_sha256"),
    )


def query(spark, sf_dir):
    turns = stored(placed(table(spark, sf_dir, "conversations")), "turns")
    nodes = trie(turns.select("conv_id").distinct(), rebuilt(turns))
    return nodes.select("conv_id", F.col("depth").cast("long").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


#: crc32 bit by bit over the digits; a prefix is the list of its turns itself.
ORACLE = r"""
WITH turns AS (
  SELECT conv_id, struct_pack(r := coalesce(role, ''), t := coalesce(text, '')) AS s, turn,
         sha256(CAST(octet_length(encode(coalesce(role, ''))) AS VARCHAR) || ':' || coalesce(role, '') || coalesce(text, '')) AS said
  FROM conversations WHERE conv_id IS NOT NULL
), given AS (SELECT conv_id, list(s ORDER BY turn NULLS FIRST, said) AS own FROM turns GROUP BY conv_id),
h AS (
  SELECT conv_id, own, xor(list_reduce(list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT)),
    lambda a, b: list_reduce(list_prepend(xor(a, b), CAST(range(8) AS BIGINT[])), lambda x, i: xor(x >> 1, (x & 1) * 3988292384)), 4294967295), 4294967295) % 4 AS h FROM given
), convs AS (
  SELECT h.conv_id, list_concat(coalesce(base.own[1:CAST(h AS INT)], []), h.own[CAST(h AS INT) + 1:]) AS path
  FROM h LEFT JOIN given base ON base.conv_id = h.conv_id - h.conv_id % 20
), prefixes AS (SELECT conv_id, d, path[1:d] AS node, len(path) = d AS last FROM (SELECT conv_id, path, unnest(range(len(path) + 1)) AS d FROM convs)),
nodes AS (
  SELECT d, node, min(conv_id) AS conv_id, count(*) AS n_convs, coalesce(string_agg(CASE WHEN last THEN CAST(conv_id AS VARCHAR) END, ',' ORDER BY conv_id), '') AS ends,
         (count(*) - 1) * CASE WHEN d = 0 THEN 0 ELSE len(regexp_extract_all(node[d].t, '[^\x20\x09-\x0D]+')) END AS saved
  FROM prefixes GROUP BY d, node
), kids AS (SELECT node[1:d - 1] AS node, d - 1 AS d, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY ALL),
known AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM nodes n LEFT JOIN kids k ON k.d = n.d AND k.node = n.node),
below AS (
  SELECT node[1:a] AS node, a AS d, sum(saved) AS saved_tokens, count(*) FILTER (n_children = 0) AS n_leaves
  FROM (SELECT *, unnest(range(d + 1)) AS a FROM known) GROUP BY 1, 2
)
SELECT k.conv_id, CAST(k.d AS BIGINT) AS depth, p.conv_id AS parent_conv_id, k.n_convs, CAST(k.n_children AS BIGINT) AS n_children, CAST(b.n_leaves AS BIGINT) AS n_leaves,
       CAST(b.saved_tokens AS BIGINT) AS saved_tokens, sha256(k.ends) AS ends_sha256
FROM known k JOIN below b ON b.d = k.d AND b.node = k.node LEFT JOIN nodes p ON p.d = k.d - 1 AND p.node = k.node[1:k.d - 1]
"""
