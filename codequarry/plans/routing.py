"""Which semantic layer answers a search, and why."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def route(rows: DataFrame) -> DataFrame:
    """Add ``layer`` and ``reason`` to rows of mode, active_layer,
    quality_status, quality_model, is_complete and is_latest.

    ``auto`` takes the quality layer only if it is active, ready, complete and
    of the latest generation, else the fast one with a reason.  A forced
    quality layer that is not fit gives no layer.
    """
    why = (
        F.when(F.col("quality_model").isNull(), "quality_not_configured").when(F.col("active_layer") != "quality", "quality_layer_inactive")
        .when(F.col("quality_status") != "quality_ready", F.col("quality_status")).when(~F.coalesce("is_complete", F.lit(False)), "quality_manifest_incomplete")
        .when(~F.coalesce("is_latest", F.lit(True)), "quality_generation_outdated")
    )
    out = rows.withColumn("__why", why)
    layer = F.when(F.col("mode") == "fast", "fast").when(F.col("__why").isNull(), "quality").when(F.col("mode") == "auto", "fast")
    return out.withColumn("layer", layer).withColumn("reason", F.when(F.col("mode") != "fast", F.col("__why"))).drop("__why")


def choose(rows: DataFrame) -> tuple[str, str | None]:
    """The decision for one row; ValueError if the forced layer is not fit."""
    row = route(rows).select("layer", "reason").first()
    if row is None:
        return "fast", "quality_not_configured"
    if row["layer"] is None:
        raise ValueError(f"the quality layer cannot answer: {row['reason']}")
    return row["layer"], row["reason"]
