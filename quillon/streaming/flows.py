"""Structured Streaming counterparts: traces, state, ingest, exports.

Each flow has the result of its batch form on the same rows. Progress is kept in a checkpoint
folder, so a restarted flow skips what it has done."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from quillon.config import DEFAULT
from quillon.operators import ingest
from quillon.sources.files import write_artifact

TRACE = "ts timestamp, type string, invocation_id string, agent string, tool string, session_id string, payload string"


def trace_events(spark: SparkSession, folder: str) -> DataFrame:
    """Stream of trace records (JSON lines)."""
    return spark.readStream.schema(TRACE).json(folder)


class PairSpans(StatefulProcessor):
    """Pairs the starts and ends of a key; an end or an error gives up the start it takes. With ``expire``, a
    start that has no end so many seconds after it is forgotten, as soon as the watermark says so."""

    def __init__(self, expire: float | None = None):
        self.expire = expire

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.started = handle, handle.getValueState("started", "at double")

    def _timer(self, at: float | None) -> None:
        if self.expire is not None:
            for old in self.handle.listTimers():
                self.handle.deleteTimer(old)
            if at is not None:
                self.handle.registerTimer(int((at + self.expire) * 1000) + 1)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        table = pd.concat(list(rows)).sort_values(["at", "event_id"], kind="stable")
        begun = self.started.get()[0] if self.started.exists() else None
        out = []
        for at, event, kind in zip(table["at"].tolist(), table["event_id"], table["kind"], strict=True):
            if kind == "start":
                begun = at
                continue
            ms = round((at - begun) * 1000) if begun is not None and kind == "end" else None
            begun = None
            out.append((str(key[0]), int(event), kind, ms))
        if begun is None:
            self.started.clear()
        else:
            self.started.update((begun,))
        self._timer(begun)
        yield pd.DataFrame(out, columns=["key", "event_id", "kind", "latency_ms"]).astype({"latency_ms": "Int64"})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.started.clear()
        return iter([])

    def close(self) -> None:
        pass


def span_latency(events: DataFrame, key: str, expire: float | None = None, late: str = "1 minute") -> DataFrame:
    """Latency of spans in a stream (key, ts, event_id, kind); needs the RocksDB state store. With ``expire``
    (seconds) state of starts that are not ended goes, and rows that are ``late`` beyond all before them are refused."""
    rows = events.select(F.col(key).alias("key"), "ts", F.col("ts").cast("double").alias("at"), "event_id", "kind")
    rows = rows if expire is None else rows.withWatermark("ts", late)
    return rows.groupBy("key").transformWithStateInPandas(PairSpans(expire), "key string, event_id long, kind string, latency_ms long", "Append", "None" if expire is None else "EventTime")


class SpaceRequests(StatefulProcessor):
    """The next time at which a domain may be asked, kept until the watermark has passed it: a later
    request then goes at its own time, with or without the state."""

    def __init__(self, gap: float):
        self.gap = gap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.following = handle, handle.getValueState("following", "at double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        table = pd.concat(list(rows)).sort_values(["at", "request_id"], kind="stable")
        following = self.following.get()[0] if self.following.exists() else None
        out = []
        for at, request in zip(table["at"].tolist(), table["request_id"], strict=True):
            allowed = at if following is None else max(at, following)
            following = allowed + self.gap
            out.append((str(key[0]), int(request), allowed, allowed - at))
        self.following.update((following,))
        for old in self.handle.listTimers():
            self.handle.deleteTimer(old)
        self.handle.registerTimer(int(following * 1000) + 1)
        yield pd.DataFrame(out, columns=["domain", "request_id", "allowed", "wait"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.following.clear()
        return iter([])

    def close(self) -> None:
        pass


def rate_limited(requests: DataFrame, gap: float = DEFAULT.spacing, late: str = "1 minute") -> DataFrame:
    """When each request of a stream (domain, request_id, ts) may go: at its time, or ``gap`` seconds after
    the one before it of its domain. Requests of a batch go by time; one that is ``late`` beyond all that came before is
    refused (it is not in the result). Needs the RocksDB state store."""
    return requests.select("domain", "request_id", "ts", F.col("ts").cast("double").alias("at")).withWatermark("ts", late).groupBy("domain").transformWithStateInPandas(
        SpaceRequests(gap), "domain string, request_id long, allowed double, wait double", "Append", "EventTime"
    )


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """The state store that stateful processors need, for streams that are started inside."""
    name, before = "spark.sql.streaming.stateStore.providerClass", spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def last_write(changes: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The last value of each key so far (update mode)."""
    return changes.groupBy(*keys).agg(F.max_by(value, F.struct("ts", "event_id")).alias(value))


def ingest_pages(crawled: DataFrame, out: str, checkpoint: str, strategy: str = "crawl_many"):
    """Pages, links and chunks of a stream of crawled rows, written batch by batch; a batch that is
    repeated writes to its own folder again, so it counts once."""

    def write(batch: DataFrame, number: int) -> None:
        pages = ingest.page_rows(batch, strategy)
        for name, table in (("pages", pages), ("links", ingest.link_rows(batch)), ("chunks", ingest.chunk_rows(pages))):
            table.write.mode("overwrite").parquet(f"{out}/{name}/batch={number}")

    return crawled.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def export_state(changes: DataFrame, folder: str, checkpoint: str, names: dict[str, str]):
    """Files of state keys, one a session and key, each with its last value: ``names`` gives the
    file of a key; other keys are passed over. Tasks write the files, so ``folder`` is one that
    all executors share; a batch that is repeated writes the same files again."""

    def put(rows: Iterator[Row]) -> None:
        for r in rows:
            write_artifact(r["value"], f"{folder}/{r['session_id']}", names[r["key"]])

    def write(batch: DataFrame, _: int) -> None:
        wanted = batch.where(F.col("key").isin(*names))
        wanted.groupBy("session_id", "key").agg(F.max_by("value", F.struct("ts", "event_id")).alias("value")).foreachPartition(put)

    return changes.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def append_trace(events: DataFrame, out: str, checkpoint: str):
    """Append trace records as JSON lines, in a folder for each session."""
    return events.writeStream.format("json").partitionBy("session_id").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out)


def each_batch(stream: DataFrame, f: Callable[[DataFrame], DataFrame], out: str, checkpoint: str):
    """Any batch operator over a stream, by batches."""
    return stream.writeStream.foreachBatch(lambda b, n: f(b).write.mode("overwrite").parquet(f"{out}/batch={n}")).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Extra: event-time windows with a watermark, which Spark gives for nothing."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
