"""Whether two runs over the same input gave the same, at any depth: documents as hash trees.

A document's tree has a digest for each value, by its path: a leaf's is that of its type and text, an object's that of its members' names and digests in order of
names, a list's that of its entries' digests in their order. So two documents are equal, whatever the order of keys, if their roots are;
where they are not, only paths whose digests differ are compared, down to the leaves that changed.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

ROOT = "$"


def tree(document: str) -> list[tuple[str, bytes, str | None]]:
    """``(path, digest, text)`` of every value of a JSON document; only leaves and empty values have a text. What is no JSON is one leaf."""
    try:
        data = json.loads(document)
    except (ValueError, RecursionError):
        return [(ROOT, hashlib.sha256(b"raw:" + document.encode("utf-8", "replace")).digest(), document)]
    out: list[tuple[str, bytes, str | None]] = []
    digests: dict[int, bytes] = {}  # of the values below, by their place on the way down
    todo = [(ROOT, data, False, 0, [])]
    number = 0
    while todo:  # no recursion: depth is whatever the document has
        path, value, back, own, below = todo.pop()
        if not back and isinstance(value, (dict, list)) and value:
            parts = sorted(value.items()) if isinstance(value, dict) else list(enumerate(value))
            steps = [(f"{path}.{k}" if isinstance(value, dict) else f"{path}[{k}]", k, v) for k, v in parts]
            numbers = list(range(number + 1, number + 1 + len(steps)))
            number += len(steps)
            todo.append((path, value, True, own, list(zip(numbers, (k for _, k, _ in steps)))))
            todo += [(p, v, False, n, []) for n, (p, _, v) in zip(numbers, steps)]
            continue
        if back:
            kind = b"{" if isinstance(value, dict) else b"["
            h = hashlib.sha256(kind)
            for n, k in below:
                h.update(hashlib.sha256(json.dumps(k).encode()).digest() + digests.pop(n))
            digests[own], text = h.digest(), None
        else:
            text = json.dumps(value, ensure_ascii=False)
            digests[own] = hashlib.sha256(text.encode("utf-8", "replace")).digest()
        out.append((path, digests[own], text))
    return out


def digests(documents: DataFrame, key: str, column: str) -> DataFrame:
    """``(key, path, digest, text)``: the tree of every document; a null one has none."""
    kind = documents.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, d in enumerate(b.column("d").to_pylist()):
                paths, sums, texts = zip(*tree(d))
                own = pa.concat_arrays([b.column("k").slice(i, 1)] * len(paths))
                yield pa.RecordBatch.from_arrays([own, pa.array(paths, pa.string()), pa.array(sums, pa.binary()), pa.array(texts, pa.string())], names=[key, "path", "digest", "text"])

    return documents.where(F.col(column).isNotNull()).select(F.col(key).alias("k"), F.col(column).alias("d")).mapInArrow(run, f"`{key}` {kind}, path string, digest binary, text string")


def roots(documents: DataFrame, key: str, column: str) -> DataFrame:
    """``(key, digest)`` of whole documents, without the rows of their parts."""
    return digests(documents, key, column).where(F.col("path") == ROOT).select(key, "digest")


def equal(one: DataFrame, two: DataFrame, key: str, column: str) -> DataFrame:
    """``(key, equal)`` for each key of either; one that is missing on a side, or null there, is not equal."""
    a, b = roots(one, key, column).withColumnRenamed("digest", "x"), roots(two, key, column).withColumnRenamed("digest", "y")
    both = one.select(key).union(two.select(key)).distinct()
    return both.join(a, key, "left").join(b, key, "left").select(key, F.coalesce(F.col("x") == F.col("y"), F.lit(False)).alias("equal"))


def differences(one: DataFrame, two: DataFrame, key: str, column: str) -> DataFrame:
    """``(key, path, one, two)``: the leaves that differ, a side null where it has no leaf at the path. Only documents whose roots differ are taken apart."""
    odd = equal(one, two, key, column).where("NOT equal").select(key)
    part = lambda df, text, digest: digests(df.join(odd, key, "left_semi"), key, column).withColumnRenamed("text", text).withColumnRenamed("digest", digest)
    met = part(one, "one", "x").join(part(two, "two", "y"), [key, "path"], "full").where(~F.col("x").eqNullSafe(F.col("y")))
    return met.where("one IS NOT NULL OR two IS NOT NULL").select(key, "path", "one", "two")
