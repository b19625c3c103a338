"""Freshness, provenance completeness, trust scores and their explanation."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

FRESHNESS_WEIGHT = {"fresh": 1.0, "stale": 0.55, "deleted": 0.25, "missing": 0.2, "unknown": 0.45}
LEVELS = ((0.85, "high"), (0.65, "medium"), (0.35, "low"))


def freshness(indexed: Column, current: Column) -> Column:
    """Label of an (indexed hash, current hash) pair; null means absent."""
    return (
        F.when(indexed.isNull() & current.isNull(), "unknown")
        .when(indexed.isNull(), "missing")
        .when(current.isNull(), "deleted")
        .when(indexed == current, "fresh")
        .otherwise("stale")
    )


def completeness(content_hash: Column, run_id: Column, parser_version: Column, indexed_at: Column) -> Column:
    """Share of the four provenance fields that are present."""
    present = [F.when(c.isNotNull(), 1.0).otherwise(0.0) for c in (content_hash, run_id, parser_version, indexed_at)]
    return sum(present[1:], present[0]) / F.lit(4.0)


def index_completeness(run_id: Column, parser_version: Column) -> Column:
    both, none = run_id.isNotNull() & parser_version.isNotNull(), run_id.isNull() & parser_version.isNull()
    return F.when(both, 1.0).when(none, 0.0).otherwise(0.6)


def level(score: Column) -> Column:
    out = None
    for least, name in LEVELS:
        out = F.when(score >= least, name) if out is None else out.when(score >= least, name)
    return out.otherwise("minimal")


def clamp01(value: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), value))


def score(fresh: Column, provenance: Column, index: Column, confidence: Column) -> Column:
    """0.35 freshness + 0.25 provenance + 0.25 confidence + 0.15 index, to two
    places.  A null confidence counts as 1."""
    weight = F.lit(FRESHNESS_WEIGHT["unknown"])
    for name, value in FRESHNESS_WEIGHT.items():
        weight = F.when(fresh == name, value).otherwise(weight)
    sure = clamp01(F.coalesce(confidence.cast("double"), F.lit(1.0)))
    total = weight * 0.35 + provenance * 0.25 + sure * 0.25 + index * 0.15
    return F.floor(total * 100 + 0.5) / 100


def completeness_label(value: Column) -> Column:
    return F.when(value >= 1.0, "complete").when(value >= 0.5, "partial").otherwise("missing")


def factors(fresh: Column, confidence: Column, provenance: Column, index: Column) -> Column:
    sure = F.when(confidence.isNull(), "not_applicable").otherwise(F.format_string("%.2f", clamp01(confidence.cast("double"))))
    return F.array(
        F.concat(F.lit("freshness:"), fresh),
        F.concat(F.lit("confidence:"), sure),
        F.concat(F.lit("provenance:"), completeness_label(provenance)),
        F.concat(F.lit("index_metadata:"), completeness_label(index)),
    )


def with_trust(df, fresh: str = "freshness", confidence: Column | None = None, prefix: str = ""):
    """Add trust_score, trust_level and trust_factors from provenance columns
    content_hash, index_run_id, parser_version and indexed_at."""
    cols = [F.col(f"{prefix}{c}") for c in ("content_hash", "index_run_id", "parser_version", "indexed_at")]
    whole, index = completeness(*cols), index_completeness(cols[1], cols[2])
    sure = F.lit(None).cast("double") if confidence is None else confidence
    value = score(F.col(fresh), whole, index, sure)
    return df.withColumn("trust_score", value).withColumn("trust_level", level(F.col("trust_score"))).withColumn("trust_factors", factors(F.col(fresh), sure, whole, index))


def aggregate_score(scores: Column, *order: Column) -> Column:
    """Mean of the edges' scores to two places; no edges: that of nothing known.

    A sum of doubles depends on its order, and a mean at half a hundredth falls
    either way.  With ``order`` the scores are summed one by one in that order,
    so the result is the same however the rows are dealt out."""
    if not order:
        mean = F.avg(scores)
    else:
        row = F.struct(*[c.alias(f"o{k}") for k, c in enumerate(order)], scores.cast("double").alias("score"))
        held = F.array_sort(F.collect_list(F.when(scores.isNotNull(), row)))
        mean = F.when(F.size(held) > 0, F.aggregate(held, F.lit(0.0), lambda s, x: s + x["score"]) / F.greatest(F.size(held), F.lit(1)))
    return F.coalesce(F.floor(mean * 100 + 0.5) / 100, F.lit(0.41))
