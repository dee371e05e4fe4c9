"""Event feeds with Structured Streaming: ordered feeds, session interests and tables kept current.

Times are cast to timestamps with a zone before a watermark; state is bounded by time and count. Every foreachBatch step
keys what it writes by batch, so a batch that is replayed changes nothing.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..functions.text import SESSION_SEPARATORS
from ..operators.aggregates import message_counts
from ..operators.mutations import upsert_notices, upsert_people
from ..operators.windows import event_history, retain_newest
from ..sources.snapshots import Snapshots


def timed(stream: DataFrame, column: str = "ts", delay: str = "1 hour") -> DataFrame:
    """A stream with a watermark on its time, cast from a time without zone."""
    return stream.withColumn(column, F.col(column).cast("timestamp")).withWatermark(column, delay)


def _replace(df: DataFrame, path: str) -> None:
    """Writes a batch's part of a table; the same batch again overwrites the same part."""
    df.write.mode("overwrite").parquet(path)


def event_feed(path: str, order: tuple[str, ...] = ("ts", "event_id")) -> Callable[[DataFrame, int], None]:
    """A foreachBatch step that stores events with their batch, sorted in many tasks; (batch, *order) is their order of arrival."""

    def step(batch: DataFrame, batch_id: int) -> None:
        _replace(batch.orderBy(*order), f"{path}/batch={batch_id}")

    return step


def replay(spark: SparkSession, path: str, n: int = 100, order: tuple[str, ...] = ("ts", "event_id")) -> DataFrame:
    """The last n events of a stored feed, numbered."""
    return event_history(spark.read.parquet(path), n, ("batch", *order))



def _with_rocksdb(stream: DataFrame) -> None:
    """Typed state with timers lives in RocksDB, on the executors' disks; a session that names no provider of its own gets that one."""
    conf, key = stream.sparkSession.conf, "spark.sql.streaming.stateStore.providerClass"
    if "RocksDB" not in (conf.get(key, "") or ""):
        conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class _Forgetting(StatefulProcessor):
    """A processor whose keys go when the watermark is ``keep_ms`` past their newest event, by one timer each."""

    def __init__(self, keep_ms: int):
        self.keep_ms = keep_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.goes = handle.getValueState("goes", "at long")

    def wait(self, newest: pd.Timestamp, timerValues) -> None:
        """Puts the timer off to after the newest event."""
        at = max(int(newest.timestamp() * 1000), timerValues.getCurrentWatermarkInMs()) + self.keep_ms
        if self.goes.exists():
            before = self.goes.get()[0]
            if before >= at:
                return
            self.handle.deleteTimer(before)
        self.handle.registerTimer(at)
        self.goes.update((at,))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.goes.clear()
        self.forget()
        return iter(())

    def close(self) -> None:
        pass


class _Interest(_Forgetting):
    def __init__(self, n: int, decay: float, keep_ms: int):
        super().__init__(keep_ms)
        self.n, self.decay = n, decay

    def init(self, handle) -> None:
        super().init(handle)
        self.events = handle.getListState("events", "ts timestamp, event_id long, areas string")

    def forget(self) -> None:
        self.events.clear()

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        events = [tuple(e) for e in self.events.get()] if self.events.exists() else []
        for f in rows:
            events += [(t.to_pydatetime(), int(e), a or "") for t, e, a in zip(f["ts"], f["event_id"], f["areas"], strict=True)]
        events = sorted(events, key=lambda e: (pd.Timestamp(e[0]), e[1]), reverse=True)[: self.n]
        self.events.put(events)
        self.wait(pd.Timestamp(events[0][0]), timerValues)
        weights: dict[str, float] = {}
        for age, (_, _, areas) in enumerate(events):
            for term in re.split(SESSION_SEPARATORS, areas.lower()):
                if len(term) >= 2:
                    weights[term] = weights.get(term, 0.0) + self.decay**age
        yield pd.DataFrame({"session_id": [key[0]], "terms": [json.dumps(weights, sort_keys=True, ensure_ascii=False)], "n_events": [len(events)]})


def session_interest(stream: DataFrame, n: int = 20, decay: float = 0.8, delay: str = "1 hour", keep_ms: int = 86_400_000) -> DataFrame:
    """(session_id, terms, n_events) after each batch: decayed weights of the terms of a session's last n events, as JSON.

    ``stream`` is (session_id, ts, event_id, areas). List state holds the n newest events of a session and goes by a timer after a
    day without any; events that come later than ``delay`` are dropped. Update mode.
    """
    _with_rocksdb(stream)
    grouped = timed(stream.select("session_id", "ts", "event_id", "areas"), "ts", delay).groupBy("session_id")
    return grouped.transformWithStateInPandas(_Interest(n, decay, keep_ms), "session_id long, terms string, n_events long", "Update", "eventTime")


def crawl_progress(events: DataFrame) -> DataFrame:
    """Per university: largest count so far, last event, whether the crawl is active or done, its seconds so far or, once it has ended, in all,
    and why it failed if the last event is an error. ``events`` is (university, ts, event_id, type, value, message). Batch, or streaming in update mode."""
    order = F.struct("ts", "event_id")
    last = F.max_by("type", order)
    started = F.min(F.when(F.col("type") == "scrape-start", F.col("ts")))
    per = events.where("type <> 'heartbeat'").groupBy("university").agg(F.max("value").alias("most"), last.alias("last_type"), started.alias("started"), F.max("ts").alias("latest"), F.max_by("message", order).alias("message"))
    elapsed, active = F.unix_timestamp("latest") - F.unix_timestamp("started"), F.col("last_type").isin("scrape-start", "scrape-progress")
    return per.select(
        "university", "most", "last_type", active.alias("active"), (F.col("last_type") == "scrape-done").alias("done"), elapsed.alias("elapsed"),
        F.when(~active, elapsed.cast("double")).alias("duration"), F.when(F.col("last_type") == "scrape-error", F.col("message")).alias("reason"),
    )


class _Jobs(_Forgetting):
    def init(self, handle) -> None:
        super().init(handle)
        self.active = handle.getValueState("active", "active boolean")

    def forget(self) -> None:
        self.active.clear()

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        active = self.active.get()[0] if self.active.exists() else False
        events = pd.concat(list(rows)).sort_values(["ts", "event_id"])
        started = []
        for event, kind in zip(events["event_id"], events["type"], strict=True):
            if kind in ("scrape-done", "scrape-error"):
                active = False
            elif kind == "scrape-start" and not active:
                active = True
                started.append(event)
        self.active.update((active,))
        self.wait(events["ts"].max(), timerValues)
        if started:
            yield pd.DataFrame({"job": [key[0]] * len(started), "event_id": started}).astype({"event_id": "int64"})


def dedupe_jobs(stream: DataFrame, delay: str = "1 hour", keep_ms: int = 3_600_000) -> DataFrame:
    """Triggers (job, ts, event_id, type) that start a job while it isn't active; done or error frees it, as does an hour without events.

    Value state holds whether a job is active; a timer frees it. Append mode.
    """
    _with_rocksdb(stream)
    grouped = timed(stream.select("job", "ts", "event_id", "type"), "ts", delay).groupBy("job")
    return grouped.transformWithStateInPandas(_Jobs(keep_ms), "job string, event_id long", "Append", "eventTime")


def upsert_stream(path: str, kind: str = "people") -> Callable[[DataFrame, int], None]:
    """A foreachBatch step that adds arrivals to a table with snapshots, once each; :func:`current_table` merges them."""

    def step(batch: DataFrame, batch_id: int) -> None:
        Snapshots(batch.sparkSession, path).append(batch.withColumn("kind", F.lit(kind)), batch_id)

    return step


def _merged(rows: DataFrame, kind: str) -> DataFrame:
    rows = rows.withColumn("seq", F.struct("batch", "seq")).drop("batch", "kind")
    return {"people": upsert_people, "notices": upsert_notices}[kind](rows.limit(0), rows)


def current_table(spark: SparkSession, path: str, kind: str = "people") -> DataFrame:
    """All arrivals merged by the rules of people or notices, in order of batch and seq."""
    return _merged(Snapshots(spark, path).read(), kind)


def compact(spark: SparkSession, path: str, kind: str = "people") -> bool:
    """Puts the merged table in the place of all batches stored so far, so reads don't grow with the log; False if nothing changed.

    The stream may go on meanwhile, and a batch that is replayed afterwards is known by its mark and adds nothing.
    """

    def change(rows: DataFrame) -> DataFrame:
        merged = _merged(rows, kind)
        return merged.withColumn("seq", F.col("seq.seq") if "seq" in merged.columns else F.lit(0).cast("long")).withColumn("kind", F.lit(kind))

    return Snapshots(spark, path).rewrite(change)


def retain(spark: SparkSession, path: str, keep: int = 50) -> bool:
    """Leaves the turns of the ``keep`` conversations updated last; maintenance like :func:`compact`."""

    def change(rows: DataFrame) -> DataFrame:
        turns = rows.drop("batch")
        return retain_newest(message_counts(turns), turns, keep)[1]

    return Snapshots(spark, path).rewrite(change)


def conversation_log(path: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch step that appends turns by batch."""
    return upsert_stream(path, "turn")


def conversation_state(spark: SparkSession, path: str, keep: int = 50) -> tuple[DataFrame, DataFrame]:
    """Counts of the conversations kept, and their turns."""
    turns = Snapshots(spark, path).read().drop("batch", "kind")
    return retain_newest(message_counts(turns), turns, keep)
