"""Continuous indexing: snapshots of a tree as a stream, diffs as batches.

A Python data source polls the tree; every micro-batch is one snapshot.  In
``foreachBatch`` it is compared with the stored one by a full outer join, and
the stored one is replaced only after the batch was handled: a busy writer or a
failure leaves it, and the next poll folds both changes into one.
"""

from __future__ import annotations

import hashlib
import os
import time
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

from codequarry.operators import freshness
from codequarry.sources.discovery import walk


class Busy(Exception):
    """The writer is taken; the batch is left for the next poll."""


class TreeReader(SimpleDataSourceStreamReader):
    """Each read is one poll: all paths with their hashes, and a counter."""

    def __init__(self, options: dict):
        self.root, self.json = options["path"], options.get("jsonroots")

    def initialOffset(self) -> dict:
        return {"poll": 0}

    def _rows(self, poll: int) -> list[tuple]:
        out = []
        for path in walk(self.root, self.json):
            with open(os.path.join(self.root, path), "rb") as f:
                out.append((poll, path, hashlib.md5(f.read()).hexdigest()))
        return out or [(poll, None, None)]

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        return iter(self._rows(start["poll"])), {"poll": start["poll"] + 1}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return iter(self._rows(start["poll"]))


class TreeSource(DataSource):
    """``spark.readStream.format("tree").load(root)``."""

    @classmethod
    def name(cls) -> str:
        return "tree"

    def schema(self) -> str:
        return "poll bigint, path string, content_hash string"

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        return TreeReader({k.lower(): v for k, v in self.options.items()})


SNAPSHOT = "path string, content_hash string"


class Tracker:
    """Keeps the last snapshot handled and hands over what changed since.

    Snapshots are folders of the state, each marked once its changes were
    handled.  A tracker that starts anew goes on from the last mark; snapshots
    before the last two are removed.
    """

    def __init__(self, spark: SparkSession, root: str, on_change: Callable[[DataFrame, int], None], debounce: float = 0.0):
        self.spark, self.root, self.on_change, self.debounce = spark, root.rstrip("/"), on_change, debounce
        self.done = max(self._numbers("done-"), default=-1)

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _numbers(self, prefix: str) -> list[int]:
        p, fs = self._fs(self.root)
        names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
        return [int(n.removeprefix(prefix)) for n in names if n.startswith(prefix)]

    def _where(self, batch: int) -> str:
        return f"{self.root}/snapshot-{batch}"

    def snapshot(self) -> DataFrame:
        if self.done < 0:
            return self.spark.createDataFrame([], SNAPSHOT)
        return self.spark.read.schema(SNAPSHOT).parquet(self._where(self.done))

    def _finish(self, batch: int) -> None:
        mark, fs = self._fs(f"{self.root}/done-{batch}")
        fs.create(mark, True).close()
        for prefix in ("done-", "snapshot-"):
            for n in self._numbers(prefix):
                if n < self.done:
                    fs.delete(self._fs(f"{self.root}/{prefix}{n}")[0], True)
        self.done = batch

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        """One poll.  A batch id seen before does nothing."""
        if batch_id <= self.done:
            return
        last = batch.agg(F.max("poll")).first()[0]
        now = batch.where((F.col("poll") == last) & F.col("path").isNotNull()).select("path", "content_hash")
        now.write.mode("overwrite").parquet(self._where(batch_id))
        now = self.spark.read.schema(SNAPSHOT).parquet(self._where(batch_id))
        changes = freshness.diff(self.snapshot(), now)
        if not changes.isEmpty():
            if self.debounce:
                time.sleep(self.debounce)
            try:
                self.on_change(changes, batch_id)
            except Busy:
                return
        self._finish(batch_id)


def watch(spark: SparkSession, root: str, state: str, checkpoint: str, on_change: Callable[[DataFrame, int], None], poll: str | None = "1 second", debounce: float = 0.25):
    """Start the query; ``poll=None`` takes one snapshot and stops."""
    spark.dataSource.register(TreeSource)
    tracker = Tracker(spark, state, on_change, debounce)
    writer = spark.readStream.format("tree").load(root).writeStream.foreachBatch(tracker).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=poll) if poll else writer.trigger(availableNow=True)).start()
