"""Call graph: enriched edges, direct neighbours and bounded simple paths."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from codequarry.functions import reasons, status, trust
from codequarry.scratch import Scratch

RESOLVED = ("resolved_exact", "resolved_local_candidate")
MOST_HOPS = 8


def enriched_edges(calls: DataFrame, symbols: DataFrame, files: DataFrame) -> DataFrame:
    """Calls with their caller (always there) and callee (null if unresolved)."""
    file = files.select(F.col("id").alias("file_id"), "path", "content_hash", "index_run_id", "parser_version", "indexed_at")
    placed = symbols.drop("index_run_id", "parser_version").join(file, "file_id")
    caller = placed.select(
        F.col("id").alias("caller_symbol_id"), F.col("name").alias("caller_short"), F.col("qualified_name").alias("caller_name"), F.col("path").alias("caller_path"),
        "content_hash", "index_run_id", "parser_version", "indexed_at",
    )
    callee = placed.select(F.col("id").alias("callee_symbol_id"), F.col("name").alias("callee_short"), F.col("qualified_name").alias("callee_name"), F.col("path").alias("callee_path"), F.col("start_line").alias("callee_start_line"))
    own = calls.select(F.col("id").alias("call_id"), "caller_symbol_id", "callee_symbol_id", "callee_text", "call_line", "confidence", "resolution_status")
    return own.join(caller, "caller_symbol_id").join(callee, "callee_symbol_id", "left")


def _is(prefix: str, query: str):
    return (F.col(f"{prefix}_symbol_id") == query) | (F.col(f"{prefix}_short") == query) | (F.col(f"{prefix}_name") == query)


def callers(edges: DataFrame, query: str) -> DataFrame:
    """Edges into the symbol; unresolved ones count by their text."""
    text = F.col("callee_symbol_id").isNull() & (F.col("callee_text") == query)
    rows = edges.where(F.coalesce(_is("callee", query), F.lit(False)) | text)
    return rows.orderBy("caller_name", "caller_path", "call_line", "callee_text", "call_id")


def callees(edges: DataFrame, query: str) -> DataFrame:
    """Edges out of the symbol, unresolved ones included."""
    return edges.where(_is("caller", query)).orderBy("call_line", "callee_text", "call_id")


def evidence(rows: DataFrame, current: DataFrame, relationship: str) -> DataFrame:
    """Direct call rows with freshness, trust and reasons; the row's symbol is
    the caller for ``caller`` and the callee for ``callee``."""
    side = "caller" if relationship == "caller" else "callee"
    own = rows.withColumn("path", F.col(f"{side}_path")).withColumn("qualified_name", F.col(f"{side}_name")).withColumn("name", F.col(f"{side}_short"))
    live = current.select(F.col("path"), F.col("content_hash").alias("live_hash"))
    out = own.join(live, "path", "left").withColumn("freshness", trust.freshness(F.col("content_hash"), F.col("live_hash")))
    return trust.with_trust(out, confidence=F.col("confidence")).withColumn("reasons", reasons.call(relationship))


def _step(edges: DataFrame) -> DataFrame:
    return edges.select(
        F.col("caller_symbol_id").alias("src"), F.col("callee_symbol_id").alias("dst"), "call_id", "confidence", "resolution_status", "callee_text",
    )


def paths_from(edges: DataFrame, starts: DataFrame, depth: int | None = None) -> DataFrame:
    """All simple paths of 1 .. depth hops out of ``starts`` (column id).

    Columns start, node (last symbol, null if unresolved), hops, calls (ids),
    visited, min_confidence, terminal_resolution_status, terminal_text.
    Resolved edges are followed; an unresolved or ambiguous one ends its path.
    A symbol appears once in a path.  The depth is at most 8; each level but the
    last is written before the next one joins it, so no level is computed twice,
    and an empty one ends the walk.
    """
    depth = status.clamp(depth, 4, 1, MOST_HOPS)
    step = _step(edges)
    first = starts.select(F.col("id").alias("start")).distinct().join(step, F.col("start") == F.col("src"))
    level = first.select(
        "start", F.col("dst").alias("node"), F.lit(1).alias("hops"), F.array("call_id").alias("calls"), F.array_compact(F.array("start", "dst")).alias("visited"),
        F.col("confidence").alias("min_confidence"), F.col("resolution_status").alias("terminal_resolution_status"), F.col("callee_text").alias("terminal_text"),
    ).where("node is null or node <> start")
    scratch = Scratch(edges.sparkSession, "paths")
    levels = []
    for hop in range(1, depth):
        level = scratch.save(level, f"level{hop}")
        if level.isEmpty():
            return reduce(DataFrame.union, levels, level)
        levels.append(level)
        open_ = level.where(F.col("node").isNotNull() & F.col("terminal_resolution_status").isin(*RESOLVED))
        level = open_.join(step, F.col("node") == F.col("src")).where("dst is null or not array_contains(visited, dst)").select(
            "start", F.col("dst").alias("node"), (F.col("hops") + 1).alias("hops"), F.concat("calls", F.array("call_id")).alias("calls"),
            F.concat("visited", F.array_compact(F.array("dst"))).alias("visited"), F.least("min_confidence", "confidence").alias("min_confidence"),
            F.col("resolution_status").alias("terminal_resolution_status"), F.col("callee_text").alias("terminal_text"),
        )
    return reduce(DataFrame.union, levels, level)


def paths_between(edges: DataFrame, starts: DataFrame, targets: DataFrame, target_text: str | None = None, depth: int | None = None) -> DataFrame:
    """Paths that end in one of ``targets`` (column id), or in an unresolved
    call of text ``target_text``."""
    ends = targets.select(F.col("id").alias("end")).distinct()
    every = paths_from(edges, starts, depth).join(ends, F.col("node") == F.col("end"), "left")
    text = F.col("node").isNull() & (F.col("terminal_text") == F.lit(target_text))
    return every.where(F.col("end").isNotNull() | F.coalesce(text, F.lit(False))).drop("end")


def paths_to(edges: DataFrame, targets: DataFrame, depth: int | None = None) -> DataFrame:
    """Simple paths into ``targets``, by walking the resolved edges backward.

    ``node`` is the first caller; ``calls`` are in the order of the calls."""
    resolved = edges.where(F.col("resolution_status").isin(*RESOLVED) & F.col("callee_symbol_id").isNotNull())
    back = resolved.withColumn("__c", F.col("caller_symbol_id")).withColumn("caller_symbol_id", F.col("callee_symbol_id")).withColumn("callee_symbol_id", F.col("__c")).drop("__c")
    return paths_from(back, targets, depth).withColumn("calls", F.reverse("calls")).withColumn("visited", F.reverse("visited"))


def path_key(calls: str) -> Column:
    """The call ids joined by ``>``: names a path."""
    return F.array_join(calls, ">")


def path_edges(paths: DataFrame, edges: DataFrame, relationship: str) -> DataFrame:
    """One row for each edge of each path, in order, with reasons."""
    each = paths.withColumn("path_key", path_key("calls")).select("path_key", "hops", F.posexplode("calls").alias("place", "call_id"))
    return each.join(edges, "call_id").withColumn("reasons", reasons.edge(relationship))
