"""Doctor checks: rows of label, state and message."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from codequarry.operators.store import Store
from codequarry.schema import TABLES


def check(df: DataFrame, label: str, state, message) -> DataFrame:
    return df.select(F.lit(label).alias("label"), state.alias("state"), message.cast("string").alias("message"))


def diagnose(spark: SparkSession, store: Store, freshness: DataFrame | None = None) -> DataFrame:
    """Engine, tables, freshness and provenance consistency."""
    one = spark.range(1)
    parts = [check(one, "engine", F.lit("Ok"), F.version())]
    parts += [check(one, f"table:{n}", F.lit("Ok" if store.exists(n) else "Warning"), F.lit("present" if store.exists(n) else "not created")) for n in TABLES]
    files, runs = store.read("files"), store.read("index_runs")
    lost = files.join(runs.select(F.col("id").alias("index_run_id")), "index_run_id", "left_anti").agg(F.count("*").alias("n"))
    parts.append(check(lost, "provenance", F.when(F.col("n") > 0, "Warning").otherwise("Ok"), F.col("n")))
    failed = runs.agg(F.max_by("status", "started_at").alias("s"))
    parts.append(check(failed, "last_run", F.when(F.col("s") == "failed", "Error").when(F.col("s").isNull(), "Warning").otherwise("Ok"), F.coalesce("s", F.lit("no run"))))
    if freshness is not None:
        stale = freshness.agg(F.count_if(F.col("freshness") != "fresh").alias("n"))
        parts.append(check(stale, "freshness", F.when(F.col("n") > 0, "Warning").otherwise("Ok"), F.col("n")))
    return reduce(DataFrame.union, parts)
