"""Runtime failure logs -> frames, failing tests and malformed lines.

Lines are classified by expressions; the rules that look across lines are
windows over one log: a symbol line takes the location line that follows
before any other symbol or full frame, and the ``failures:`` section lasts to
the next blank-free header.
"""

from __future__ import annotations

import os
import sys

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from codequarry.functions import frames


def runtime_input(value: str) -> str:
    """``-`` reads standard input, an existing path its file, else the text itself."""
    if value == "-":
        return sys.stdin.read()
    if len(value) < 4096 and os.path.isfile(value):
        with open(value, encoding="utf-8", errors="replace") as f:
            return f.read()
    return value


def read(spark: SparkSession, path: str) -> DataFrame:
    """(log_id, text) of whole log files."""
    return spark.read.text(path, wholetext=True).select(F.md5(F.input_file_name()).alias("log_id"), F.col("value").alias("text"))


def lines(logs: DataFrame) -> DataFrame:
    """(log_id, line_no, text, kind, frame, in_failures) of (log_id, text)."""
    each = logs.select("log_id", F.posexplode(F.split("text", r"\r?\n")).alias("line_no", "raw")).withColumn("raw", F.trim("raw"))
    each = each.withColumn("c", frames.classify(F.col("raw"))).select("log_id", "line_no", F.col("raw").alias("text"), "c.kind", "c.frame").where("kind <> 'blank'")
    over = W.partitionBy("log_id").orderBy("line_no").rowsBetween(W.unboundedPreceding, 0)
    return each.withColumn("in_failures", F.max((F.col("kind") == "failures")).over(over))


def frame_rows(classified: DataFrame) -> DataFrame:
    """(log_id, ordinal, raw, symbol, path, line, column)."""
    own = classified.where("kind in ('symbol', 'location', 'full')")
    over = W.partitionBy("log_id").orderBy("line_no")
    own = own.withColumn("before", F.lag(F.struct("kind", "text", "frame")).over(over)).withColumn("after", F.lead("kind").over(over))
    merged = (F.col("kind") == "location") & (F.col("before.kind") == "symbol")
    waits = (F.col("kind") == "symbol") & F.coalesce(F.col("after") == "location", F.lit(False))
    rows = own.where(~waits).select(
        "log_id", "line_no",
        F.when(merged, F.concat_ws("\n", "before.text", "text")).otherwise(F.col("text")).alias("raw"),
        F.when(merged, F.col("before.frame.symbol")).otherwise(F.col("frame.symbol")).alias("symbol"),
        F.col("frame.path").alias("path"), F.col("frame.line").alias("line"), F.col("frame.column").alias("column"),
    )
    return rows.withColumn("ordinal", (F.row_number().over(over) - 1).cast("bigint")).select("log_id", "ordinal", "raw", "symbol", "path", "line", "column")


def failing_tests(classified: DataFrame) -> DataFrame:
    """Distinct (log_id, test)."""
    return classified.select("log_id", frames.failing_test(F.col("text"), F.col("in_failures")).alias("test")).where("test is not null").distinct()


def malformed(classified: DataFrame) -> DataFrame:
    return classified.where("kind = 'noise'").select("log_id", "line_no", "text")
