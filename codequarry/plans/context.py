"""Context packs and debug context: evidence of several kinds in one order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from codequarry.functions import paths, reasons, status, trust
from codequarry.operators import search
from codequarry.schema import KIND_RANK, SOURCE_RANK
from codequarry.sources import runtime_log

MAX_INT = 2147483647
#: Columns of an evidence item.
ITEM = ("item_id", "item_kind", "source", "symbol_id", "chunk_id", "path", "start_line", "end_line", "score", "confidence", "relationship")


def _rank(column: str, ranks: dict[str, int]):
    out = F.lit(len(ranks))
    for name, value in ranks.items():
        out = F.when(F.col(column) == name, value).otherwise(out)
    return out


def symbol_items(symbols: DataFrame, relationship: str = "focus") -> DataFrame:
    return symbols.select(
        F.concat(F.lit("symbol:"), "id").alias("item_id"), F.lit("symbol").alias("item_kind"), F.lit("structural").alias("source"), F.col("id").alias("symbol_id"), F.lit(None).cast("string").alias("chunk_id"),
        "path", "start_line", "end_line", F.lit(None).cast("double").alias("score"), F.lit(None).cast("double").alias("confidence"), F.lit(relationship).alias("relationship"),
    )


def call_items(calls: DataFrame, relationship: str) -> DataFrame:
    return calls.select(
        F.concat(F.lit(f"call:{relationship}:"), "call_id").alias("item_id"), F.lit("call").alias("item_kind"), F.lit("structural").alias("source"), F.col("caller_symbol_id").alias("symbol_id"), F.lit(None).cast("string").alias("chunk_id"),
        F.col("caller_path").alias("path"), F.col("call_line").alias("start_line"), F.col("call_line").alias("end_line"), F.lit(None).cast("double").alias("score"), "confidence", F.lit(relationship).alias("relationship"),
    )


def chunk_items(hits: DataFrame) -> DataFrame:
    """Semantic hits; one with a symbol is known by the symbol."""
    return hits.select(
        F.when(F.col("symbol_id").isNotNull(), F.concat(F.lit("symbol:"), "symbol_id")).otherwise(F.concat(F.lit("chunk:"), "chunk_id")).alias("item_id"),
        F.lit("chunk").alias("item_kind"), F.lit("semantic").alias("source"), "symbol_id", "chunk_id", "path", "start_line", "end_line", F.col("score").cast("double").alias("score"),
        F.lit(None).cast("double").alias("confidence"), F.lit("semantic").alias("relationship"),
    )


def merge(structural: DataFrame, semantic: DataFrame) -> DataFrame:
    """Items of both sides by id: fields from the structural side first, the
    greatest score, and ``both`` as source where both have it."""
    s = structural.select(*ITEM).withColumn("order", F.lit(0))
    m = semantic.select(*ITEM).withColumn("order", F.lit(1))
    rest = [c for c in ITEM if c not in ("item_id", "source", "score")]
    first = lambda c: F.min_by(F.col(c), F.when(F.col(c).isNotNull(), F.col("order"))).alias(c)
    rows = s.unionByName(m).groupBy("item_id").agg(
        F.when(F.min("order") != F.max("order"), "both").when(F.min("order") == 0, "structural").otherwise("semantic").alias("source"), F.max("score").alias("score"), *[first(c) for c in rest],
    )
    return rows.select(*ITEM)


def ordered(items: DataFrame, limit: int | None = None) -> DataFrame:
    """Items in presentation order, ``place`` from 1, at most ``limit``."""
    keys = [
        _rank("source", SOURCE_RANK), _rank("item_kind", KIND_RANK), F.desc_nulls_last("score"), F.desc_nulls_last("confidence"), F.col("relationship").asc_nulls_first(), F.col("path").asc_nulls_first(),
        F.coalesce("start_line", F.lit(MAX_INT)), F.coalesce("end_line", F.lit(MAX_INT)), F.col("item_id"),
    ]
    top = items.orderBy(*keys).limit(status.clamp(limit, 8))
    return top.withColumn("place", F.row_number().over(W.orderBy(*keys)))


def pack(focus: DataFrame, callers: DataFrame, callees: DataFrame, limit: int | None = None) -> dict[str, DataFrame]:
    """Structural context: focus symbols, direct calls and files involved."""
    n = status.clamp(limit, 8)
    out = {"symbols": focus.limit(n), "callers": callers.limit(n), "callees": callees.limit(n)}
    seen = out["symbols"].select("path").union(out["callers"].select("caller_path")).union(out["callees"].select("callee_path"))
    return out | {"files": seen.where("path is not null").distinct().orderBy("path")}


def unified(structural: dict[str, DataFrame], hits: DataFrame | None, limit: int | None = None) -> DataFrame:
    """The pack and semantic hits in one ordered list."""
    items = symbol_items(structural["symbols"]).unionByName(call_items(structural["callers"], "caller")).unionByName(call_items(structural["callees"], "callee"))
    return ordered(merge(items, chunk_items(hits if hits is not None else structural["symbols"].sparkSession.createDataFrame([], "symbol_id string, chunk_id string, path string, start_line bigint, end_line bigint, score double"))), limit)


def debug(logs: DataFrame, root: str, files: DataFrame, symbols: DataFrame, edges: DataFrame, current: DataFrame, limit: int | None = None) -> dict[str, DataFrame]:
    """Frames of runtime logs matched to indexed code.

    A frame's file is looked up by its normalised path; its symbol is the
    smallest one around the line, else one of the runtime symbol's name.
    Result: frames (with freshness, trust and reasons), adjacent (pairs of
    matched frames), failing_tests, malformed.
    """
    lines = runtime_log.lines(logs)
    most = status.clamp(limit, 8)
    frames = runtime_log.frame_rows(lines).withColumn("normalized_path", paths.normalize_runtime(F.col("path"), root)).withColumnRenamed("path", "runtime_path").withColumnRenamed("line", "frame_line")
    known = search.provenance(files).select(F.col("path").alias("normalized_path"), "content_hash", "index_run_id", "parser_version", "indexed_at", F.lit(True).alias("has_file"))
    live = current.select(F.col("path").alias("normalized_path"), F.col("content_hash").alias("live_hash"))
    placed = frames.join(known, "normalized_path", "left").join(live, "normalized_path", "left")
    span = symbols.select(F.col("path").alias("normalized_path"), F.col("id").alias("sid"), F.col("qualified_name").alias("sname"), "start_line", "end_line")
    around = placed.select("log_id", "ordinal", "normalized_path", "frame_line").join(span, "normalized_path").where("start_line <= frame_line and frame_line <= end_line")
    around = around.groupBy("log_id", "ordinal").agg(F.min_by(F.struct("sid", "sname"), F.struct(F.col("end_line") - F.col("start_line"), F.col("sid"))).alias("here"))
    by_name = symbols.select(F.explode(F.array_distinct(F.array("qualified_name", "name"))).alias("symbol"), F.struct(F.col("id").alias("sid"), F.col("qualified_name").alias("sname")).alias("s")).groupBy("symbol").agg(F.min("s").alias("named"))
    calls = edges.groupBy(F.col("caller_path").alias("normalized_path"), F.col("call_line").alias("frame_line")).agg(F.count("*").alias("calls_at_line"))
    rows = placed.join(around, ["log_id", "ordinal"], "left").join(by_name, "symbol", "left").join(calls, ["normalized_path", "frame_line"], "left").na.fill(0, ["calls_at_line"])
    hit = F.coalesce("here", "named")
    why = F.when(F.col("here").isNotNull(), "symbol_at_runtime_location").when(F.col("named").isNotNull(), "runtime_symbol_name_match")
    has = F.coalesce("has_file", F.lit(False))
    rows = rows.withColumn("symbol_id", hit["sid"]).withColumn("symbol_name", hit["sname"]).withColumn("matched", hit.isNotNull() | (F.col("calls_at_line") > 0) | has)
    rows = rows.withColumn("freshness", trust.freshness(F.col("content_hash"), F.col("live_hash")))
    rows = rows.withColumn("freshness", F.when(has | F.col("live_hash").isNotNull(), F.col("freshness")).otherwise("unknown"))
    rows = trust.with_trust(rows).withColumn("reasons", reasons.debug_frame(F.col("ordinal"), F.col("normalized_path"), F.col("runtime_path"), has, why, F.col("calls_at_line"), F.col("matched")))
    rows = rows.withColumn("match_kind", reasons.debug_match_kind(F.col("reasons")))
    out = rows.select("log_id", "ordinal", "raw", "symbol", "runtime_path", "normalized_path", F.col("frame_line").alias("line"), "column", "symbol_id", "symbol_name", "calls_at_line", "matched", "freshness", "trust_score", "trust_level", "reasons", "match_kind").where(F.col("ordinal") < most * 4)
    over = W.partitionBy("log_id").orderBy("ordinal")
    pairs = out.where("symbol_id is not null").withColumn("next_symbol_id", F.lead("symbol_id").over(over)).where("next_symbol_id is not null and next_symbol_id <> symbol_id").select("log_id", "ordinal", "symbol_id", "next_symbol_id")
    return {"frames": out, "adjacent": pairs, "failing_tests": runtime_log.failing_tests(lines), "malformed": runtime_log.malformed(lines)}


def observations(frames: DataFrame, failing: DataFrame, repository_id: str, now, hours: int = 24) -> DataFrame:
    """Rows of the table runtime_observations, one per frame and failing test."""
    f = frames.select(
        "log_id", F.lit("frame").alias("observation_kind"), "ordinal", F.col("symbol").alias("runtime_symbol"), "runtime_path", "normalized_path", "line", "column",
        F.lit(None).cast("string").alias("failing_test_name"), "matched", "match_kind", F.to_json(F.struct("symbol_id", "freshness", "trust_score", "reasons")).alias("match_summary"),
    )
    t = failing.select(
        "log_id", F.lit("failing_test").alias("observation_kind"), *[F.lit(None).cast(k).alias(c) for c, k in (("ordinal", "bigint"), ("runtime_symbol", "string"), ("runtime_path", "string"), ("normalized_path", "string"), ("line", "bigint"), ("column", "bigint"))],
        F.col("test").alias("failing_test_name"), F.lit(False).alias("matched"), F.lit("failing_test").alias("match_kind"), F.to_json(F.struct("test")).alias("match_summary"),
    )
    rows = f.unionByName(t).withColumn("repository_id", F.lit(repository_id)).withColumn("observed_at", now).withColumn("expires_at", now + F.expr(f"interval {hours} hours"))
    return rows.withColumn("id", F.md5(F.concat_ws("|", "log_id", "observation_kind", F.coalesce(F.col("ordinal").cast("string"), "failing_test_name"))))
