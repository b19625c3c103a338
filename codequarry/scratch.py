"""Intermediate tables in the folder that all executors share.

A lineage is cut by writing a Parquet table under ``spark.checkpoint.dir``.
Losing an executor then costs only the tasks it ran: the table is read again
from shared storage.  The setting is taken from the session; a folder of our
own is made only where it is unset and driver and executors are one process
(tests on one machine).  Elsewhere an unset folder is an error.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names, or one of our own in
    local mode."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError(f"spark.checkpoint.dir is unset: tables between steps need a folder that all executors of {master} share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = "file://" + tempfile.mkdtemp(prefix="codequarry-")
    return _OWN[app]


class Scratch:
    """A folder of written tables, removed when the application ends."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/codequarry/{label}-{uuid.uuid4().hex}"
        self._path(self.root)[1].deleteOnExit(self._path(self.root)[0])

    def _path(self, text: str):
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(text)
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` once and return it as a table read from storage."""
        target = f"{self.root}/{name}"
        df.write.mode("overwrite").parquet(target)
        return self.spark.read.schema(df.schema).parquet(target)

    def drop(self, name: str) -> None:
        """Remove a table that nothing reads any more."""
        path, fs = self._path(f"{self.root}/{name}")
        fs.delete(path, True)
