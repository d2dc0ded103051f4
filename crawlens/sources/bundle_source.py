"""Site bundles as a data source of their own: ``spark.read.format("site_bundles")`` and ``df.write.format("site_bundles")``.

A bundle is one JSON file per site, ``<site>.bundle.json``, with keys in order. As rows it is its head and its pages: ``(site_id, page_seq, body)``, where
``body`` is JSON text and the head has the number HEAD. One site's pages are in memory at a time, on either side.

Reading splits by file. Conditions on ``site_id`` are taken over: a file whose name rules a site out is not opened.

Writing commits in two phases: a task writes whole bundles into a folder of its own attempt and tells the driver which; only once all tasks have done so
are they moved to their place. A task that is killed or fails leaves nothing but that folder, which the end of the job removes,
so that there is no half bundle anywhere. Rows of a site must lie together in one task, in order: ``laid_out`` sees to that.

Paths are those of Arrow's file systems (local, HDFS, object stores), not of all that Spark can mount.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, In, InputPartition, WriterCommitMessage

NAME, SUFFIX, HEAD = "site_bundles", ".bundle.json", -1
SCHEMA = "site_id string, page_seq int, body string"


def _store(path: str):
    """The file system of a path, and the path in it."""
    from pyarrow import fs

    path = path.rstrip("/")
    return fs.FileSystem.from_uri(path if "://" in path else f"file://{path}" if not path.startswith("file:") else "file://" + path.removeprefix("file:"))


def _file(site: str) -> str:
    """A site's file; a character that no file name can hold is written as its number."""
    return "".join(c if c.isalnum() or c in ".-_" else f"%{ord(c):x}." for c in site) + SUFFIX


@dataclass
class File(InputPartition):
    path: str

    def __init__(self, path: str):
        super().__init__(path)
        self.path = path


@dataclass
class Written(WriterCommitMessage):
    folder: str
    files: list[str]


class Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path, self.sites = path, None  # sites: those asked for, None for all

    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            asked = {f.value} if isinstance(f, EqualTo) and f.attribute == ("site_id",) else set(f.value) if isinstance(f, In) and f.attribute == ("site_id",) else None
            if asked is None:
                yield f
            else:
                self.sites = asked if self.sites is None else self.sites & asked

    def partitions(self) -> list[File]:
        from pyarrow import fs

        store, path = _store(self.path)
        wanted = None if self.sites is None else {_file(s) for s in self.sites if s is not None}
        found = store.get_file_info(fs.FileSelector(path, allow_not_found=True))
        return [File(x.path) for x in sorted(found, key=lambda x: x.path) if x.is_file and x.base_name.endswith(SUFFIX) and (wanted is None or x.base_name in wanted)]

    def read(self, partition: File | None) -> Iterator[tuple]:
        if partition is None:  # no file
            return
        store, _ = _store(self.path)
        with store.open_input_stream(partition.path) as f:
            bundle = json.loads(f.read())
        pages, site = bundle.pop("pages", None) or [], bundle.get("site")
        if self.sites is not None and site not in self.sites:
            return
        text = lambda x: json.dumps(x, sort_keys=True, ensure_ascii=False)
        yield site, HEAD, text(bundle)
        for i, p in enumerate(pages):
            yield site, i, text(p)


class Writer(DataSourceWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.job = path, overwrite, uuid.uuid4().hex

    def _staging(self, path: str) -> str:
        return f"{path}/_staging-{self.job}"

    def write(self, rows: Iterator[Row]) -> Written:
        from pyspark import TaskContext

        store, path = _store(self.path)
        task = TaskContext.get()
        folder = f"{self._staging(path)}/{task.partitionId()}-{task.taskAttemptId()}"
        done: list[str] = []
        site, head, pages = None, None, []

        def finish() -> None:
            if site is None:
                return
            if head is None:
                raise ValueError(f"the pages of {site} have no head")
            store.create_dir(folder)
            bundle = json.loads(head) | {"site": site, "pages": pages}
            with store.open_output_stream(f"{folder}/{_file(site)}") as f:
                f.write(json.dumps(bundle, indent=1, sort_keys=True, ensure_ascii=False).encode())
            done.append(_file(site))

        seen = set()
        for row in rows:
            if row["site_id"] != site:
                finish()
                if row["site_id"] in seen or row["site_id"] is None:
                    raise ValueError(f"the rows of {row['site_id']} do not lie together")
                seen.add(row["site_id"])
                site, head, pages = row["site_id"], None, []
            if row["page_seq"] == HEAD:
                head = row["body"]
            else:
                pages.append(json.loads(row["body"]))
        finish()
        return Written(folder, done)

    def commit(self, messages: list[Written | None]) -> None:
        from pyarrow import fs

        store, path = _store(self.path)
        store.create_dir(path)
        names = [n for m in messages if m for n in m.files]
        if len(names) != len(set(names)):
            self.abort(messages)
            raise ValueError("several tasks wrote the bundle of one site")
        old = {x.path for x in store.get_file_info(fs.FileSelector(path)) if x.is_file and x.base_name.endswith(SUFFIX)} if self.overwrite else set()
        for m in filter(None, messages):
            for n in m.files:
                store.move(f"{m.folder}/{n}", f"{path}/{n}")
                old.discard(f"{path}/{n}")
        for x in old:
            store.delete_file(x)
        self._clear(store, path)

    def abort(self, messages: list[Written | None]) -> None:
        self._clear(*_store(self.path))

    def _clear(self, store, path: str) -> None:
        from pyarrow import fs

        if store.get_file_info(self._staging(path)).type == fs.FileType.Directory:
            store.delete_dir(self._staging(path))


class SiteBundles(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        return Reader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> Writer:
        return Writer(self.options["path"], overwrite)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(SiteBundles)


def laid_out(sites: DataFrame, pages: DataFrame) -> DataFrame:
    """``sites(site_id, …)`` and ``pages(site_id, page_seq, …)`` as rows of bundles, a site's rows together and in order."""
    body = lambda df, *without: F.to_json(F.struct(*[c for c in df.columns if c not in without]))
    head = sites.select("site_id", F.lit(HEAD).alias("page_seq"), body(sites, "site_id").alias("body"))
    own = pages.select("site_id", F.col("page_seq").cast("int").alias("page_seq"), body(pages, "site_id", "page_seq").alias("body"))
    return head.unionByName(own).repartition("site_id").sortWithinPartitions("site_id", "page_seq")


def write(sites: DataFrame, pages: DataFrame, path: str, mode: str = "append") -> None:
    register(sites.sparkSession)
    laid_out(sites, pages).write.format(NAME).mode(mode).save(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """``(site_id, page_seq, body)`` of all bundles of a folder."""
    register(spark)
    return spark.read.format(NAME).load(path)


def pages(rows: DataFrame) -> DataFrame:
    """The pages of ``read`` with typed columns, in the form of ``bundles.pages``; heads lend their ``start_url`` and ``audited_at``."""
    from crawlens.sources import bundles

    head = rows.where(F.col("page_seq") == HEAD).select("site_id", F.get_json_object("body", "$.start_url").alias("start_url"), F.to_timestamp(F.get_json_object("body", "$.audited_at")).alias("audited_at"))
    p = rows.where(F.col("page_seq") != HEAD).select("site_id", "page_seq", F.from_json("body", bundles.PAGE).alias("p")).select("site_id", "page_seq", "p.*")
    return bundles.tidy(p.join(head, "site_id"))
