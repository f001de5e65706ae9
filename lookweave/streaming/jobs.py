"""Structured Streaming twins of the event jobs."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .. import dims
from ..operators.feedback import admit
from ..sources.tables import upsert_latest


_STORE = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def timed_state(spark: SparkSession) -> Iterator[None]:
    """Streams that are started within the block keep their state in the store that supports lists and timers."""
    before = spark.conf.get(_STORE)
    spark.conf.set(_STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(_STORE, before)


class Budget(StatefulProcessor):
    """The admitted times of a client within the last window, and a timer that forgets the client after it."""

    def __init__(self, time_us: str, order: str, key: str, window_us: int, limit: int) -> None:
        self.names, self.window_us, self.limit = (time_us, order, key), window_us, limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.times = handle, handle.getListState("times", "t long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        time_us, order, name = self.names
        times, last = deque(r[0] for r in self.times.get()), 0
        for frame in rows:
            frame = frame.sort_values([time_us, order])
            out = [(o, key[0], *admit(times, int(now), self.window_us, self.limit)) for o, now in zip(frame[order], frame[time_us])]
            last = max(last, int(frame[time_us].max()))
            yield pd.DataFrame(out, columns=[order, name, "admitted", "retry_after"])
        self.times.put([(t,) for t in times])
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        self.handle.registerTimer((last + self.window_us) // 1000 + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.times.clear()
        _, order, name = self.names
        yield pd.DataFrame({order: [], name: [], "admitted": [], "retry_after": []})

    def close(self) -> None:
        pass


def admission_stream(events: DataFrame, key: str, time_us: str, order: str, window: int = dims.ADMISSION_WINDOW_SECONDS,
                     limit: int = dims.ADMISSION_LIMIT) -> DataFrame:
    """Request budget per client; start the stream within ``timed_state``.

    A client's rows of a micro-batch are admitted frame by frame as they come, each frame in order of time; what is kept is at
    most ``limit`` times.  A client whose last request lies a window behind the watermark is forgotten.  Requests of more than
    a window before the latest one are late: the watermark drops them, they are neither admitted nor answered.
    """
    timed = events.withColumn("_at", F.timestamp_micros(time_us)).withWatermark("_at", f"{window} seconds")
    return timed.groupBy(key).transformWithStateInPandas(
        Budget(time_us, order, key, window * 1_000_000, limit), f"{order} long, {key} long, admitted boolean, retry_after long", "append", "EventTime")


class Queue(StatefulProcessor):
    """Whether a key is queued; a key that is not has no state."""

    def __init__(self, key: str, time_us: str, order: str, add: str) -> None:
        self.key, self.time_us, self.order, self.add = key, time_us, order, add

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.queued = handle.getValueState("queued", "on boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        queued = self.queued.exists()
        for frame in rows:
            frame, out = frame.sort_values([self.time_us, self.order]), []
            for order, add in zip(frame[self.order], frame[self.add]):
                if add and not queued:
                    out.append((order, key[0]))
                queued = bool(add)
            yield pd.DataFrame(out, columns=[self.order, self.key]).astype({self.order: "int64", self.key: "int64"})
        if queued:
            self.queued.update((True,))
        else:
            self.queued.clear()

    def close(self) -> None:
        pass


def enqueue_stream(events: DataFrame, key: str, time_us: str, order: str, add: str, patience: str) -> DataFrame:
    """(order, key) of the enqueue requests (``add``) whose key was not queued; other rows finish a key's work.

    Start the stream within ``timed_state``.  Only queued keys are remembered, until they are finished.  Rows of more than
    ``patience`` before the latest one are late: the watermark drops them, they neither queue nor finish anything.
    """
    timed = events.withColumn("_at", F.timestamp_micros(time_us)).withWatermark("_at", patience)
    return timed.groupBy(key).transformWithStateInPandas(Queue(key, time_us, order, add), f"{order} long, {key} long", "append", "EventTime")


BUCKETS = 64


def upsert_stream(changes: DataFrame, root: str, key: str, order: list[str], values: list[str], deleted: str | None = None):
    """Keep the latest row per key: a micro-batch rewrites the hash buckets of the keys it holds.

    A manifest per batch lists the folder of every bucket.  A batch starts from the newest manifest before its own number,
    so a batch that is run again after a failure writes the same folders from the same input.
    """
    def merge(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        kept = [key, *order, *values, *([deleted] if deleted else [])]
        rows = batch.select(*kept, F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int").alias("bucket"))
        touched = {r["bucket"] for r in rows.select("bucket").distinct().collect()}  # BUCKETS rows at most
        folders = _folders(spark, root, batch_id - 1)
        old = [folders[b] for b in sorted(touched & set(folders))]
        if old:
            rows = rows.unionByName(spark.read.schema(rows.drop("bucket").schema).parquet(*old).withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")))
        latest = upsert_latest(rows, key, order, [c for c in [*kept, "bucket"] if c != key])  # tombstones stay, so late rows cannot revive a key
        latest.write.mode("overwrite").partitionBy("bucket").parquet(f"{root}/v{batch_id}")
        folders |= {b: f"{root}/v{batch_id}/bucket={b}" for b in touched}
        spark.createDataFrame([(b, f) for b, f in folders.items()], _MANIFEST).coalesce(1).write.mode("overwrite").json(f"{root}/manifests/batch={batch_id}")

    return changes.writeStream.foreachBatch(merge).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True)


_MANIFEST = "bucket int, folder string"


def _folders(spark: SparkSession, root: str, last: int) -> dict[int, str]:
    """Folder of every bucket after the newest batch up to ``last``; at most ``BUCKETS`` rows."""
    if last < 0:
        return {}
    rows = spark.read.schema(_MANIFEST + ", batch long").json(f"{root}/manifests").where(F.col("batch") <= last)
    newest = rows.agg(F.max("batch")).first()[0]
    return {r["bucket"]: r["folder"] for r in rows.where(F.col("batch") == newest).collect()} if newest is not None else {}


def upserted(spark: SparkSession, root: str, batch_id: int, deleted: str | None = None) -> DataFrame:
    rows = spark.read.parquet(*_folders(spark, root, batch_id).values())
    return rows.where(~F.col(deleted)).drop(deleted) if deleted else rows


def without_tombstones(events: DataFrame, tombstones: DataFrame, key: str) -> DataFrame:
    """Stream or table rows whose key was not deleted; ``tombstones`` is a table."""
    return events.join(tombstones.select(key).distinct().withColumn("_gone", F.lit(True)), key, "left").where("_gone IS NULL").drop("_gone")
