"""The event ledger as a stream: each event is held in state until it is acknowledged, and each change is appended once.

Events and acknowledgements come as one stream, in any order and as often as they like. The state of an event_id is its
latest entry, whether an acknowledgement was seen, and how many changes were told; it lies in a RocksDB store by key, so
a batch reads neither the ledger nor other events. There is no watermark, so no event is too late. Timers tell of events
that stay open; they run by the clock, as an event's own time says nothing of when it came.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ledgerloom.operators.references import new_entries
from ledgerloom.sources.readers import EVENTS


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """New JSONL files of a folder as a stream of events; malformed lines are skipped."""
    return spark.readStream.schema(EVENTS).option("mode", "DROPMALFORMED").json(path).where("event_id is not null")


#: What a change tells: version counts the changes of an event.
CHANGES = "event_id string, version long, change string, ts timestamp, level string, acknowledged boolean"
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Held(StatefulProcessor):
    """One event_id: opened by its first entry, updated by later ones, acknowledged by an entry or an acknowledgement, overdue if it stays open."""

    def __init__(self, hold_ms: int):
        self.hold_ms = hold_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("held", "ts timestamp, level string, own boolean, seen boolean, version long, timer long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        ts, level, own, seen, version, timer = self.state.get() if self.state.exists() else (None, None, False, False, 0, None)
        had, was = ts is not None, own or seen
        newest = (pd.Timestamp(ts), level or "", own) if had else None
        for batch in rows:
            seen = bool(seen or (batch["record_type"] == "acknowledgement").any())
            for r in batch[batch["record_type"] != "acknowledgement"].itertuples():
                entry = (r.ts, "" if pd.isna(r.level) else r.level, bool(r.acknowledged) if not pd.isna(r.acknowledged) else False)
                newest = entry if newest is None or entry > newest else newest
        changed = newest is not None and (not had or newest != (pd.Timestamp(ts), level or "", own))
        if newest is not None:
            ts, level, own = newest
        done = bool(own or seen)
        told = None if ts is None else "opened" if not had else "acknowledged" if done and not was else "updated" if changed or done != was else None
        if ts is not None and not done and timer is None:
            timer = timerValues.getCurrentProcessingTimeInMs() + self.hold_ms
            self.handle.registerTimer(timer)
        if done and timer is not None:
            self.handle.deleteTimer(timer)
            timer = None
        version += told is not None
        self.state.update((None if ts is None else pd.Timestamp(ts).to_pydatetime(), level, own, seen, version, timer))
        if told:
            yield self._row(key, version, told, ts, level, done)

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:
        ts, level, own, seen, version, _ = self.state.get()
        if not (own or seen):
            self.state.update((ts, level, own, seen, version + 1, expiredTimerInfo.getExpiryTimeInMs()))
            yield self._row(key, version + 1, "overdue", ts, level, False)

    @staticmethod
    def _row(key: tuple, version: int, change: str, ts: object, level: str | None, done: bool) -> pd.DataFrame:
        return pd.DataFrame({"event_id": [key[0]], "version": [version], "change": [change], "ts": [pd.Timestamp(ts)], "level": [level or None], "acknowledged": [done]})

    def close(self) -> None:
        pass


def changes(records: DataFrame, hold: int = 7 * 24 * 3600) -> DataFrame:
    """The changes of a stream of records (event_id, ts, level, acknowledged, record_type): CHANGES. hold: seconds after which an event that is still open is told as overdue, once. The session's state store must be RocksDB (STORE)."""
    slim = records.select("event_id", "ts", "level", "acknowledged", F.coalesce("record_type", F.lit("")).alias("record_type"))
    return slim.groupBy("event_id").transformWithStateInPandas(_Held(hold * 1000), CHANGES, "Append", "ProcessingTime")


def follow(records: DataFrame, path: str, checkpoint: str, hold: int = 7 * 24 * 3600, every: str | None = None) -> StreamingQuery:
    """Appends changes to a table of files, each once; started again, it goes on from its checkpoint. every: how often it looks for records and timers; without it, it takes what is there in one batch and ends."""
    trigger = {"processingTime": every} if every else {"once": True}
    return changes(records, hold).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(**trigger).start()


def current(spark: SparkSession, path: str) -> DataFrame:
    """event_id, ts, level, acknowledged, overdue: what the changes come to."""
    told = spark.read.schema(CHANGES).parquet(path)
    last = told.groupBy("event_id").agg(F.max_by(F.struct("ts", "level", "acknowledged"), "version").alias("last"), F.max(F.col("change") == "overdue").alias("overdue"))
    return last.select("event_id", "last.*", (F.col("overdue") & ~F.col("last.acknowledged")).alias("overdue"))


def append_once(events: DataFrame, path: str, checkpoint: str, lateness: str = "1 day") -> StreamingQuery:
    """Appends each event once: those of a batch are held against the ledger by an anti-join, so a restart repeats none."""

    def write(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        try:
            existing = spark.read.parquet(path).select("event_id")
        except Exception as e:  # no ledger yet
            if "PATH_NOT_FOUND" not in str(e):
                raise
            existing = batch.select("event_id").limit(0)
        new_entries(batch, existing).write.mode("append").parquet(path)

    slim = events.withWatermark("ts", lateness).dropDuplicatesWithinWatermark(["event_id"])
    return slim.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def counts_by_window(events: DataFrame, width: str = "1 hour", lateness: str = "1 day") -> DataFrame:
    """Events by level and window of time, with late ones up to the watermark."""
    return events.withWatermark("ts", lateness).groupBy(F.window("ts", width), "level").count().select(F.col("window.start").alias("start"), "level", "count")


#: What the id of a run looks like.
RUN_ID = "^[0-9a-f]{12}$"


def acknowledge(spark: SparkSession, event_ids: list[str], path: str) -> None:
    """Appends an acknowledgement of each event to a JSONL ledger; entries that are there stay as they are."""
    rows = spark.createDataFrame([(x,) for x in event_ids], "event_id string").select(F.lit("acknowledgement").alias("record_type"), "event_id", F.current_timestamp().alias("ts"))
    rows.write.mode("append").json(path)


def append_provenance(runs: DataFrame, path: str) -> DataFrame:
    """Appends runs (run_id, produced_by, merged_file, delivery_paths, pipeline_steps) to a JSONL ledger; returns those whose run_id is none, which are left out."""
    good = F.coalesce(F.col("run_id").rlike(RUN_ID), F.lit(False))
    runs.where(good).write.mode("append").json(path)
    return runs.where(~good)
