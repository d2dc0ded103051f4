"""The state of each site over a stream of fetches: pages seen once, longest run of refusals, run status. Any split into batches gives what the whole table gives.

Fetches of a site wait until the watermark has passed them, so that rows that arrive late, within the delay, still take their place in crawl order; then
they are settled in that order and forgotten, so that a site's state is bounded by what the delay lets wait. A fetch that comes again is
counted once: while it waits by its number, afterwards because it is not after the last one settled. Each batch tells, for the sites it
touched, what holds with all that has come so far.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

OUT = "site_id long, longest long, pages long, ok long, run_status string"
REFUSED = 503


class Sites(StatefulProcessor):
    """``rows(site_id, page_seq, status, at)``."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.settled = handle.getValueState("settled", "last long, longest long, run long, pages long, ok long")
        self.waiting = handle.getListState("waiting", "page_seq long, status int, at long")

    def _settled(self) -> list:
        return list(self.settled.get()) if self.settled.exists() else [None, 0, 0, 0, 0]

    @staticmethod
    def _after(state: list, number: int, status: int) -> list:
        _, longest, run, pages, ok = state
        run = run + 1 if status == REFUSED else 0
        return [number, max(longest, run), run, pages + 1, ok + (200 <= status <= 299)]

    def _waiting(self) -> dict:
        return {number: (status, at) for number, status, at in map(tuple, self.waiting.get())} if self.waiting.exists() else {}

    def _settle(self, state: list, waiting: dict, upto: int) -> list:
        """Settle what the watermark has passed, as far as nothing before it may still come; the state with all that waits besides. A site's state is read and written as a whole, not fetch by fetch."""
        now, open_, left = state, True, []
        for number, (status, at) in sorted(waiting.items()):
            now = self._after(now, number, status)
            open_ = open_ and at <= upto
            if open_:
                state = now
            else:
                left.append((number, status, at))
        self.settled.update(tuple(state))
        if left:
            self.waiting.put(left)
        else:
            self.waiting.clear()
        return now

    def _told(self, key, now: list) -> Row:
        _, longest, _, pages, ok = now
        status = "failed" if not ok else "partial" if ok < pages else "complete"
        return Row(site_id=key[0], longest=longest, pages=pages, ok=ok, run_status=status)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        state, waiting = self._settled(), self._waiting()
        last, latest = state[0], 0
        for r in rows:
            number = r["page_seq"]
            if (last is None or number > last) and number not in waiting:
                waiting[number] = (r["status"], at := int(r["at"].timestamp() * 1000))
                latest = max(latest, at)
        now = self._settle(state, waiting, timerValues.getCurrentWatermarkInMs())
        if latest:
            self.handle.registerTimer(latest + 1)  # what waits is settled even if the site sends no more
        yield self._told(key, now)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self._settle(self._settled(), self._waiting(), timerValues.getCurrentWatermarkInMs())
        yield from ()

    def close(self) -> None:
        pass


def states(fetches: DataFrame, delay: str) -> DataFrame:
    """``fetches(site_id, page_seq, status, at)``, a stream → the states of the sites that each batch touched. Fetches come at most ``delay`` late."""
    kept = fetches.withWatermark("at", delay)
    return kept.groupBy("site_id").transformWithState(statefulProcessor=Sites(), outputStructType=OUT, outputMode="Update", timeMode="EventTime")


def use_rocksdb(spark: SparkSession) -> None:
    """State with lists and maps needs the RocksDB store."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def latest(stream: DataFrame, path: str, checkpoint: str):
    """Run over what is there, appending each batch's states with its number; ``newest`` reads them."""

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{path}/batch={number}")  # a batch that is run again replaces itself

    return stream.writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()


def newest(spark: SparkSession, path: str) -> DataFrame:
    """The last state told of each site."""
    rows = spark.read.option("basePath", path).schema(f"{OUT}, batch long").parquet(f"{path}/batch=*")
    last = F.max_by(F.struct("longest", "pages", "ok", "run_status"), "batch").alias("s")
    return rows.groupBy("site_id").agg(last).select("site_id", "s.*")
