"""Reason tags: short ``name:value`` strings that say why a row is in a result."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def tag(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}:"), value.cast("string"))


def two_places(value: Column) -> Column:
    return F.format_string("%.2f", value.cast("double"))


def present(*tags: Column) -> Column:
    """The tags that are not null, in order."""
    return F.array_compact(F.array(*tags))


def call(relationship: str) -> Column:
    """Tags of a call row (columns callee_text, resolution_status, confidence,
    qualified_name, name, path)."""
    symbol = F.coalesce("qualified_name", "name", F.lit("unresolved"))
    return present(
        F.lit(f"relationship:{relationship}"), F.lit("persisted_call_edge"), tag("callee_text", F.col("callee_text")),
        tag("resolution_status", F.col("resolution_status")), tag("confidence", two_places(F.col("confidence"))),
        tag("symbol_match", symbol), F.when(F.col("path").isNotNull(), tag("path", F.col("path"))),
    )


def path(relationship: str) -> Column:
    return F.array(
        F.lit(f"relationship:{relationship}"), F.lit("bounded_transitive_call_path"), tag("hops", F.col("hops")),
        tag("min_confidence", two_places(F.col("min_confidence"))), tag("terminal_resolution_status", F.col("terminal_resolution_status")),
    )


def edge(relationship: str) -> Column:
    return F.array(
        F.lit(f"relationship:{relationship}"), F.lit("persisted_path_edge"), tag("caller", F.col("caller_name")),
        tag("callee", F.coalesce("callee_name", "callee_text")), tag("resolution_status", F.col("resolution_status")),
        tag("confidence", two_places(F.col("confidence"))),
    )


def related_file(count: Column, has_provenance: Column) -> Column:
    return F.array(F.lit("related_file_from_call_evidence"), tag("relationship_count", count), F.when(has_provenance, "provenance:first_related_edge").otherwise("provenance:missing"))


def semantic(score: Column, path_: Column, symbol: Column, kind: Column) -> Column:
    return present(F.concat(F.lit("semantic_score:"), F.format_string("%.4f", score.cast("double"))), tag("path", path_), F.when(symbol.isNotNull(), tag("symbol", symbol)), tag("chunk_kind", kind))


def symbol_match(query: Column) -> Column:
    """How a symbol (id, name, qualified_name) meets the query, best first."""
    return present(
        F.when(F.col("id") == query, "symbol_id_exact"), F.when(F.col("qualified_name") == query, "qualified_name_exact"),
        F.when(F.col("name") == query, "name_exact"), F.when(F.col("qualified_name").endswith(F.concat(F.lit("::"), query)), "qualified_name_suffix"), F.lit("sqlite_like"),
    )


def debug_frame(ordinal: Column, normalized: Column, raw_path: Column, provenance: Column, match: Column, calls: Column, matched: Column) -> Column:
    where = F.when(normalized.isNotNull(), tag("runtime_path_normalized", normalized)).when(raw_path.isNotNull(), "runtime_path_outside_or_unindexed").otherwise("runtime_path:missing")
    return present(
        tag("runtime_frame", ordinal), where, F.when(provenance, "file_provenance_match"), match,
        F.when(calls > 0, tag("calls_at_runtime_line", calls)), F.when(~matched, "unmatched_runtime_frame"),
    )


def debug_match_kind(reasons: Column) -> Column:
    """The strongest kind of match that the tags of a frame name."""
    has = lambda name: F.array_contains(reasons, name)
    return (
        F.when(has("unmatched_runtime_frame"), "unmatched").when(has("symbol_at_runtime_location"), "location_symbol").when(has("runtime_symbol_name_match"), "symbol_name")
        .when(F.exists(reasons, lambda r: r.startswith("calls_at_runtime_line:")), "call_line").when(has("file_provenance_match"), "file").otherwise("matched")
    )


def freshness(label: Column) -> Column:
    return F.array(tag("freshness", label), F.when(label == "unknown", "no_indexed_or_current_hash").otherwise("content_hash_compared"))


def error_category(error: Column) -> Column:
    """Which known failure of semantic search an error text tells of."""
    e = F.lower(error)
    return (
        F.when(e.rlike("missing vector|vector table|collection|no such table"), "missing_vector_collection")
        .when(e.rlike("connection refused|connect|timed out|unreachable"), "local_service_unavailable")
        .when(e.rlike("embed|ollama|model"), "embedding_unavailable").otherwise("query_error")
    )
