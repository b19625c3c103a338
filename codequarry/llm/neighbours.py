"""Next and previous document by descending id, without a global sort task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from codequarry.scratch import Scratch


def ring(ids: DataFrame, scratch: Scratch, carry: str) -> DataFrame:
    """(doc_id, carry, next_id, prev_id, prev_carry) in a ring of descending doc_id.

    ``ids`` has distinct non-null ``doc_id`` and the column ``carry``.  The ids
    are cut into ranges; neighbours inside a range come from a window over it,
    and the ends of the ranges (one row each) are joined up separately.
    """
    cut = ids.select("doc_id", F.col(carry).alias("carry")).repartitionByRange(F.desc("doc_id")).withColumn("part", F.spark_partition_id())
    cut = scratch.save(cut, "ranges")
    ends = cut.groupBy("part").agg(F.max(F.struct("doc_id", "carry")).alias("head"), F.min(F.struct("doc_id", "carry")).alias("tail"))
    over = W.orderBy("part")
    whole = over.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    ends = ends.select(
        "part",
        F.coalesce(F.lead("head.doc_id").over(over), F.first("head.doc_id").over(whole)).alias("after"),
        F.coalesce(F.lag("tail").over(over), F.last("tail").over(whole)).alias("before"),
    )
    inside = W.partitionBy("part").orderBy(F.desc("doc_id"))
    rows = cut.withColumn("next_id", F.lead("doc_id").over(inside)).withColumn("prev", F.lag(F.struct("doc_id", "carry")).over(inside))
    return rows.join(ends, "part").select(
        "doc_id",
        "carry",
        F.coalesce("next_id", "after").alias("next_id"),
        F.coalesce("prev.doc_id", "before.doc_id").alias("prev_id"),
        F.coalesce("prev.carry", "before.carry").alias("prev_carry"),
    )
