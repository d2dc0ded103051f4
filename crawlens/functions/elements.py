"""Pages as a table of their elements and texts, in document order, each with the interval of places that it takes up.

``at`` is a node's place and ``until`` the first place after all that it holds: x stands inside of y where ``y.at < x.at AND x.at < y.until``. So
ancestors, descendants and the text of an element are joins within a page. Texts are rows of the tag TEXT.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from crawlens.functions.tree import INERT, Tree

TEXT = "#text"
NODE = "at: int, until: int, parent: int, depth: int, tag: string, attrs: map<string,string>, text: string"
ROWS = 4096  # nodes of a batch


def _nodes(html: str) -> Iterator[tuple]:
    root = Tree(html)
    places = root.places()
    for i in range(1, len(root)):
        yield *places[i], places[root.parent[i]][0], root.depth[i], root.tags[i], root.attrs[i], None
    for k, (owner, before) in enumerate(zip(root.owner, root.started)):
        yield k + before, k + before + 1, places[owner][0], root.depth[owner] + 1, TEXT, None, root.runs[k]


def elements(pages: DataFrame, keys: tuple[str, ...] = ("site_id", "page_seq"), html: str = "html") -> DataFrame:
    """``(keys…, at, until, parent, depth, tag, attrs, text)``: a row for each element and each text; a page without HTML, or that cannot be read, has none."""
    row = pages.where(F.col(html).isNotNull()).select(F.struct(*keys).alias("key"), F.col(html).alias("html"))
    kind = row.schema["key"].dataType.simpleString()
    arrow = to_arrow_type(StructType.fromDDL(NODE))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.name for f in arrow]
        for b in batches:
            for i, page in enumerate(b.column("html").to_pylist()):
                try:
                    found = list(_nodes(page))
                except Exception:  # parsed() says why; here such a page has no elements
                    continue
                for a in range(0, len(found), ROWS):
                    part = [dict(zip(names, (*x[:5], None if x[5] is None else list(x[5].items()), x[6]))) for x in found[a : a + ROWS]]
                    key = pa.concat_arrays([b.column("key").slice(i, 1)] * len(part))
                    yield pa.RecordBatch.from_arrays([key, pa.array(part, arrow)], names=["key", "node"])

    return row.mapInArrow(run, f"key {kind}, node struct<{NODE}>").select("key.*", "node.*")


def inside(x: str, y: str) -> Column:
    """The condition that the node x stands inside of y, both of one page."""
    return (F.col(f"{y}.at") < F.col(f"{x}.at")) & (F.col(f"{x}.at") < F.col(f"{y}.until"))


def same_page(x: str, y: str, keys: tuple[str, ...] = ("site_id", "page_seq")) -> Column:
    out = F.lit(True)
    for k in keys:
        out = out & (F.col(f"{x}.{k}") == F.col(f"{y}.{k}"))
    return out


def attr(name: str) -> Column:
    """An attribute, empty where it is missing."""
    return F.coalesce(F.col("attrs")[name], F.lit(""))


def without(nodes: DataFrame, some: DataFrame, keys: tuple[str, ...] = ("site_id", "page_seq")) -> DataFrame:
    """The nodes that stand inside of none of ``some``."""
    return nodes.alias("x").join(some.select(*keys, "at", "until").alias("y"), same_page("x", "y", keys) & inside("x", "y"), "left_anti")


def texts(table: DataFrame, of: DataFrame, keys: tuple[str, ...] = ("site_id", "page_seq")) -> DataFrame:
    """``(keys…, at, shown)``: what each of the nodes ``of`` shows, without what inert elements inside of it hold; nodes without text are missing.

    A text is hidden from y if an inert element around the text starts inside of y: the last one that starts around it decides.
    """
    shown = table.where((F.col("tag") == TEXT) & (F.trim(F.regexp_replace("text", r"(?U)\s+", " ")) != ""))
    inert = table.where(F.col("tag").isin(*INERT)).select(*keys, "at", "until")
    hidden = shown.alias("x").join(inert.alias("y"), same_page("x", "y", keys) & inside("x", "y"), "left").groupBy(*(F.col(f"x.{k}") for k in keys), "x.at", "x.text").agg(F.max("y.at").alias("by"))
    both = hidden.alias("x").join(of.select(*keys, "at", "until").alias("y"), same_page("x", "y", keys) & inside("x", "y"))
    parts = both.where(F.col("x.by").isNull() | (F.col("x.by") <= F.col("y.at")))
    own = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x.at", "x.text"))), lambda t: F.trim(F.regexp_replace(t["text"], r"(?U)\s+", " "))), " ")
    return parts.groupBy(*(F.col(f"y.{k}") for k in keys), "y.at").agg(own.alias("shown"))
