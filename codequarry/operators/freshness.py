"""Indexed side against the live side: freshness, snapshot diffs, counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from codequarry.functions import reasons, trust
from codequarry.schema import VOCABULARY


def report(indexed: DataFrame, current: DataFrame, scope: DataFrame | None = None) -> DataFrame:
    """(path, indexed_hash, current_hash, freshness, reasons) by full outer join.

    ``indexed`` and ``current`` have path and content_hash.  With ``scope``
    (paths) only those count, and a path that neither side knows is unknown.
    """
    old = indexed.select("path", F.col("content_hash").alias("indexed_hash"))
    new = current.select("path", F.col("content_hash").alias("current_hash"))
    both = old.join(new, "path", "full_outer")
    if scope is not None:
        both = scope.select("path").distinct().join(both, "path", "left")
    out = both.withColumn("freshness", trust.freshness(F.col("indexed_hash"), F.col("current_hash")))
    return out.withColumn("reasons", reasons.freshness(F.col("freshness")))


def counts(rows: DataFrame) -> DataFrame:
    """Rows per label, labels without rows included."""
    labels = rows.sparkSession.createDataFrame([(x,) for x in VOCABULARY["freshness"]], "freshness string")
    return labels.join(rows.groupBy("freshness").agg(F.count("*").alias("n")), "freshness", "left").na.fill(0, ["n"])


def diff(previous: DataFrame, current: DataFrame) -> DataFrame:
    """(path, change) between two snapshots: created, modified or deleted."""
    old = previous.select("path", F.col("content_hash").alias("old_hash"))
    new = current.select("path", F.col("content_hash").alias("new_hash"))
    both = old.join(new, "path", "full_outer")
    change = F.when(F.col("old_hash").isNull(), "created").when(F.col("new_hash").isNull(), "deleted").when(F.col("old_hash") != F.col("new_hash"), "modified")
    return both.withColumn("change", change).where("change is not null")


def apply(previous: DataFrame, changes: DataFrame) -> DataFrame:
    """The snapshot after the changes (the inverse of ``diff``)."""
    kept = previous.select("path", "content_hash").join(changes.select("path"), "path", "left_anti")
    return kept.union(changes.where("change <> 'deleted'").select("path", F.col("new_hash").alias("content_hash")))


def change_counts(changes: DataFrame) -> DataFrame:
    """One row: number of changes, sorted paths of each kind, the latest path
    (modified before created before deleted)."""
    paths = lambda kind: F.sort_array(F.collect_list(F.when(F.col("change") == kind, F.col("path"))))
    row = changes.agg(F.count("*").alias("event_count"), *[paths(k).alias(k) for k in ("created", "modified", "deleted")])
    first = lambda c: F.try_element_at(F.col(c), F.lit(1))
    return row.withColumn("latest", F.coalesce(first("modified"), first("created"), first("deleted")))


def file_events(changes: DataFrame, run_id: str, diagnostics: DataFrame | None = None) -> DataFrame:
    """(path, action, reason, status) rows of the append-only event table."""
    action = F.when(F.col("change") == "created", "created").when(F.col("change") == "modified", "updated").otherwise("deleted")
    reason = F.when(F.col("change") == "created", "new_file").when(F.col("change") == "modified", "content_changed").otherwise("missing_from_discovery")
    rows = changes.select(F.lit(run_id).alias("index_run_id"), "path", F.col("old_hash").alias("old_content_hash"), F.col("new_hash").alias("new_content_hash"), action.alias("action"), reason.alias("reason"))
    if diagnostics is not None:
        rows = rows.join(diagnostics.select("path").distinct().withColumn("diag", F.lit(True)), "path", "left")
        rows = rows.withColumn("reason", F.when(F.col("diag") & (F.col("action") != "deleted"), "parsed_with_diagnostics").otherwise(F.col("reason"))).drop("diag")
    return rows.withColumn("status", F.lit("success"))
