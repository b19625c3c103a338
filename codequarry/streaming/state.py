"""Keyed streaming state: change detection per path, watcher status, leases."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Window as W, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


class PathState(StatefulProcessor):
    """Last hash of each path; emits created, modified and deleted.

    A null hash is a deletion.  Entries not seen for ``ttl_ms`` are dropped by
    the state store.
    """

    def __init__(self, ttl_ms: int | None = None):
        self.ttl = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "content_hash string", self.ttl)

    def handleInputRows(self, key, rows, timers) -> Iterator:
        import pandas as pd

        before = self.last.get()[0] if self.last.exists() else None
        first, out = before, []
        for part in rows:
            for value in part.sort_values("poll")["content_hash"]:
                first_change = None if value == before else "created" if before is None else "deleted" if value is None else "modified"
                if first_change:
                    out.append((key[0], first_change, before, value))
                before = value
        if before is None:
            self.last.clear()
        elif before != first:
            self.last.update((before,))
        if out:
            yield pd.DataFrame(out, columns=["path", "change", "old_hash", "new_hash"])

    def close(self) -> None:
        pass


def changes(stream: DataFrame, ttl_ms: int | None = None) -> DataFrame:
    """(path, change, old_hash, new_hash) of a stream of (poll, path, content_hash).

    Needs the RocksDB state store provider.
    """
    return stream.groupBy("path").transformWithStateInPandas(PathState(ttl_ms), "path string, change string, old_hash string, new_hash string", "Append", "ProcessingTime" if ttl_ms else "None")


# What an event makes of a watcher's state.
STATES = {
    "started": "watching", "idle": "watching", "changes_pending": "pending", "changes_detected": "indexing", "batch_completed": "watching",
    "batch_failed": "error", "quality_started": "quality", "quality_completed": "watching", "quality_failed": "error", "stopped": "stopped",
}


def watcher_status(events: DataFrame) -> DataFrame:
    """The watcher row that a history of (repository_id, at, seq, event,
    files_seen, queued, path, error) leads to."""
    order = F.struct("at", "seq")
    state = F.lit("watching")
    for name, value in STATES.items():
        state = F.when(F.col("event") == name, value).otherwise(state)
    rows = events.withColumn("state", state)
    failed = F.col("event").isin("batch_failed", "quality_failed")
    cleared = failed | (F.col("event") == "batch_completed")
    return rows.groupBy("repository_id").agg(
        F.max_by("state", order).alias("state"), F.max("at").alias("updated_at"), F.max_by("files_seen", F.when(F.col("files_seen").isNotNull(), order)).alias("files_seen"),
        F.max_by(F.when(F.col("event").isin("changes_pending", "changes_detected"), F.col("queued")).otherwise(F.lit(0)), order).alias("queued_events"),
        F.max_by("path", F.when(F.col("path").isNotNull(), order)).alias("last_indexed_path"),
        F.max_by(F.when(failed, F.col("error")), F.when(cleared, order)).alias("last_error"),
    )


def lease_gaps(beats: DataFrame, key: str, at: str, seconds: float = 10.0) -> DataFrame:
    """Leases per key: a gap of more than ``seconds`` between heartbeats ends one.

    (key, leases, longest_gap, last_beat): window over one key's beats.
    """
    over = W.partitionBy(key).orderBy(at)
    seconds_at = F.unix_micros(F.col(at).cast("timestamp")) / 1e6
    gap = seconds_at - F.lag(seconds_at).over(over)
    rows = beats.withColumn("gap", gap)
    return rows.groupBy(key).agg((F.count_if(F.col("gap") > seconds) + 1).alias("leases"), F.max("gap").alias("longest_gap"), F.max(at).alias("last_beat"))


def live_clients(beats: DataFrame, watermark: str = "10 seconds", lease: str = "10 seconds") -> DataFrame:
    """Streaming form: one session window for each unbroken lease."""
    return beats.withWatermark("at", watermark).groupBy("repository_id", "client_id", F.session_window("at", lease)).agg(F.count("*").alias("beats"))


def may_stop(clients: int, idle_since: float | None, now: float, grace: float = 10.0) -> tuple[bool, float | None]:
    """Whether a watcher without clients may stop, and since when it has none."""
    if clients:
        return False, None
    since = now if idle_since is None else idle_since
    return now - since >= grace, since
