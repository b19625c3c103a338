"""Impact of a symbol or a change, for all asked symbols in one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from codequarry.functions import reasons, trust
from codequarry.operators import graph, resolve, search, summaries

NOTES = ("static_evidence_only", "dynamic_calls_not_seen")


def dependency_usages(usages: DataFrame, dependencies: DataFrame, files: DataFrame, symbols: DataFrame) -> DataFrame:
    """Usages of dependencies from the symbols (column id) or their files."""
    own = usages.join(symbols.select(F.col("id").alias("source_symbol_id")), "source_symbol_id", "left_semi")
    d = dependencies.select(F.col("id").alias("dependency_id"), "package_name", "version_req", "dependency_kind")
    f = files.select(F.col("id").alias("file_id"), "path", "content_hash", "indexed_at")
    return own.join(d, "dependency_id").join(f, "file_id")


def impact(matched: DataFrame, edges: DataFrame, current: DataFrame, tables: dict[str, DataFrame] | None = None, depth: int | None = None) -> dict[str, DataFrame]:
    """Sections of the impact of ``matched`` symbols (with id and file_id):
    callers, callees, callers_transitive, callees_transitive, files and, if the
    tables are given, dependencies and tests.

    All symbols are handled at once; nothing is looked up one by one.
    """
    ids_ = matched.select("id").distinct()
    callers = edges.join(ids_.select(F.col("id").alias("callee_symbol_id")), "callee_symbol_id", "left_semi")
    callees = edges.join(ids_.select(F.col("id").alias("caller_symbol_id")), "caller_symbol_id", "left_semi")
    up, down = graph.paths_to(edges, ids_, depth), graph.paths_from(edges, ids_, depth)
    named = lambda df, kind: with_path_trust(df, edges, current, kind)
    out = {
        "callers": graph.evidence(callers, current, "caller"), "callees": graph.evidence(callees, current, "callee"),
        "callers_transitive": named(up, "transitive_caller"), "callees_transitive": named(down, "transitive_callee"),
    }
    used = graph.path_edges(up, edges, "transitive_caller").unionByName(graph.path_edges(down, edges, "transitive_callee"))
    direct = out["callers"].select("path").union(out["callees"].select("path"))
    files = summaries.related_files(direct, used)
    hashes = edges.select(F.col("caller_path").alias("path"), "content_hash", "index_run_id", "parser_version", "indexed_at").dropDuplicates(["path"])
    files = files.join(hashes, "path", "left").join(current.select("path", F.col("content_hash").alias("live_hash")), "path", "left")
    files = trust.with_trust(files.withColumn("freshness", trust.freshness(F.col("content_hash"), F.col("live_hash"))))
    out["files"] = files.withColumn("reasons", reasons.related_file(F.col("relationship_count"), F.col("content_hash").isNotNull()))
    if tables:
        out["dependencies"] = dependency_usages(tables["dependency_usages"], tables["dependencies"], tables["files"], ids_)
        out["tests"] = resolve.likely_tests(tables["test_targets"], tables["tests"], ids_, matched.select(F.col("file_id").alias("id")).distinct())
    return out


def with_path_trust(paths: DataFrame, edges: DataFrame, current: DataFrame, relationship: str) -> DataFrame:
    """Paths with the mean trust of their edges and reasons."""
    own = edges.select("call_id", F.col("caller_path").alias("path"), "content_hash", "index_run_id", "parser_version", "indexed_at", "confidence")
    live = current.select("path", F.col("content_hash").alias("live_hash"))
    scored = own.join(live, "path", "left").withColumn("freshness", trust.freshness(F.col("content_hash"), F.col("live_hash")))
    scored = trust.with_trust(scored, confidence=F.col("confidence")).select("call_id", F.col("trust_score").alias("edge_trust"))
    keyed = paths.withColumn("path_key", graph.path_key("calls"))
    mean = keyed.select("start", "path_key", F.explode("calls").alias("call_id")).join(scored, "call_id").groupBy("start", "path_key").agg(trust.aggregate_score(F.col("edge_trust")).alias("trust_score"))
    return keyed.join(mean, ["start", "path_key"], "left").withColumn("trust_level", trust.level(F.col("trust_score"))).withColumn("reasons", reasons.path(relationship))


def explain_change(targets: DataFrame, symbols: DataFrame, edges: DataFrame, current: DataFrame, tables: dict[str, DataFrame] | None = None, depth: int | None = None) -> dict[str, DataFrame]:
    """Impact of all symbols that the targets' line ranges touch."""
    touched = search.intersecting(symbols, targets)
    out = impact(touched, edges, current, tables, depth)
    return out | {"symbols": touched}


def distinct_calls(rows: DataFrame) -> DataFrame:
    """Call evidence once: the first of rows with the same place and callee."""
    key = F.concat_ws(":", F.coalesce("path", F.lit("<unknown>")), F.coalesce("caller_symbol_id", F.lit("<unresolved>")), "callee_text", F.col("call_line").cast("string"))
    nth = F.row_number().over(W.partitionBy("evidence_key").orderBy("call_id"))
    return rows.withColumn("evidence_key", key).withColumn("nth", nth).where("nth = 1").drop("nth")
