"""Coverage, resolution, embedding, health, timeline and progress summaries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

CONFIDENCE = ((0.85, "High"), (0.5, "Medium"))


def bucket(confidence):
    out = None
    for least, name in CONFIDENCE:
        out = F.when(confidence >= least, name) if out is None else out.when(confidence >= least, name)
    return out.otherwise("Low")


def storage(tables: dict[str, DataFrame]) -> DataFrame:
    """(table, rows) for each table."""
    return reduce(DataFrame.union, [df.agg(F.lit(name).alias("table"), F.count("*").alias("rows")) for name, df in tables.items()])


def chunk_counts(chunks: DataFrame, embeddings: DataFrame) -> DataFrame:
    """One row: chunks, embeddable, excluded, vector_backed, missing."""
    backed = embeddings.where("status = 'current'").select(F.col("chunk_id").alias("id")).distinct().withColumn("backed", F.lit(1))
    rows = chunks.join(backed, "id", "left")
    return rows.agg(
        F.count("*").alias("chunks"), F.count_if(F.col("excluded_reason").isNull()).alias("embeddable"), F.count_if(F.col("excluded_reason").isNotNull()).alias("excluded"),
        F.count_if(F.col("backed").isNotNull()).alias("vector_backed"), F.count_if(F.col("excluded_reason").isNull() & F.col("backed").isNull()).alias("missing"),
    )


def coverage(files: DataFrame, chunks: DataFrame, symbols: DataFrame, calls: DataFrame, embeddings: DataFrame) -> DataFrame:
    """Per file: counts and status.  Every fact is counted by file before it is
    joined, so nothing fans out."""
    backed = embeddings.where("status = 'current'").select("chunk_id").distinct()
    c = chunks.join(backed, chunks["id"] == backed["chunk_id"], "left").groupBy("file_id").agg(
        F.count("*").alias("chunk_count"), F.count_if(F.col("excluded_reason").isNull()).alias("embeddable_count"),
        F.count_if(F.col("excluded_reason").isNotNull()).alias("excluded_count"), F.count_if(F.col("chunk_id").isNotNull()).alias("vector_count"),
    )
    s = symbols.groupBy("file_id").agg(F.count("*").alias("symbol_count"))
    k = calls.join(symbols.select(F.col("id").alias("caller_symbol_id"), "file_id"), "caller_symbol_id").groupBy("file_id").agg(F.count("*").alias("call_count"))
    own = files.select(F.col("id").alias("file_id"), "path", "language")
    rows = own.join(c, "file_id", "left").join(s, "file_id", "left").join(k, "file_id", "left").na.fill(0)
    label = (
        F.when((F.col("chunk_count") > 0) & (F.col("excluded_count") == F.col("chunk_count")), "excluded").when(F.col("vector_count") == 0, "metadata-only")
        .when(F.col("embeddable_count") > F.col("vector_count"), "missing-vector").otherwise("covered")
    )
    return rows.withColumn("status", label).orderBy("path")


def exclusion_histogram(chunks: DataFrame) -> DataFrame:
    return chunks.where("excluded_reason is not null").groupBy("excluded_reason").agg(F.count("*").alias("n"))


def resolution(calls: DataFrame) -> DataFrame:
    """Calls by status and confidence bucket: count and mean confidence."""
    return calls.groupBy("resolution_status", bucket(F.col("confidence")).alias("confidence_bucket")).agg(F.count("*").alias("calls"), F.round(F.avg("confidence"), 6).alias("avg_confidence"))


def latest_by(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The latest row of each key, by combined maxima instead of a sort."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r")).select(*keys, *[F.col(f"r.{c}").alias(c) for c in rest])


def timeline(runs: DataFrame, limit: int = 50) -> DataFrame:
    return runs.orderBy(F.desc("started_at"), "id").limit(limit)


def embedding_coverage(chunks: DataFrame, embeddings: DataFrame, runs: DataFrame) -> DataFrame:
    last = runs.where("status = 'success'").agg(F.max_by(F.struct("embedding_model", "embedding_dimension"), F.struct("started_at", "id")).alias("r"))
    return chunk_counts(chunks, embeddings).join(F.broadcast(last.select("r.*")), F.lit(True), "left")


def health(chunks: DataFrame, embeddings: DataFrame, table_exists: bool) -> DataFrame:
    """(check, status, detail) rows over the stores."""
    facts = chunk_counts(chunks, embeddings)
    drift = embeddings.agg(F.count_distinct("embedding_model").alias("models"), F.count_distinct("embedding_dimension").alias("dimensions"))
    row = lambda df, check, bad, worst, detail: df.select(F.lit(check).alias("check"), F.when(bad, worst).otherwise("Ok").alias("status"), detail.cast("string").alias("detail"))
    parts = [
        row(facts, "vector_table", F.lit(not table_exists), "Error", F.lit(table_exists)),
        row(facts, "missing_vectors", F.col("missing") > 0, "Error", F.col("missing")),
        row(facts, "excluded_chunks", F.col("excluded") > 0, "Warning", F.col("excluded")),
        row(drift, "model_drift", F.col("models") > 1, "Warning", F.col("models")),
        row(drift, "dimension_drift", F.col("dimensions") > 1, "Error", F.col("dimensions")),
    ]
    return reduce(DataFrame.union, parts)


def layers(embeddings: DataFrame, wanted: DataFrame) -> DataFrame:
    """Per layer: rows by status, expected (layer, expected) and completeness."""
    by = embeddings.groupBy("semantic_layer").agg(
        *[F.count_if(F.col("status") == s).alias(s) for s in ("current", "stale", "blocked", "failed")],
        F.count_if(~F.col("status").isin("current", "stale", "blocked", "failed")).alias("other"), F.count("*").alias("total"),
    )
    both = wanted.join(by, "semantic_layer", "left").na.fill(0)
    return both.withColumn("is_complete", (F.col("expected") > 0) & (F.col("current") >= F.col("expected")))


def progress(jobs: DataFrame) -> DataFrame:
    """Jobs of each generation by status."""
    return jobs.groupBy("generation_id").agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("pending", "running", "succeeded", "failed", "skipped_stale", "skipped_excluded")], F.count("*").alias("total"))


def latest_error(jobs: DataFrame) -> DataFrame:
    return jobs.where("status = 'failed'").groupBy("generation_id").agg(F.max_by("error_summary", F.struct("updated_at", "id")).alias("error_summary"))


def activation(done: DataFrame) -> DataFrame:
    """Status of the quality layer from one row of progress with eligible,
    embedded, model, dimension and is_latest."""
    busy = (F.col("pending") + F.col("running")) > 0
    label = (
        F.when(~F.col("is_latest"), "quality_stale").when(F.col("failed") > 0, "quality_failed").when(busy, "quality_pending")
        .when(F.col("skipped_stale") > 0, "quality_stale").when(F.col("model").isNull() | F.col("dimension").isNull(), "quality_blocked")
        .when((F.col("eligible") > 0) & (F.col("embedded") >= F.col("eligible")), "quality_ready").otherwise("quality_pending")
    )
    return done.withColumn("quality_status", label).withColumn("active_layer", F.when(F.col("quality_status") == "quality_ready", "quality").otherwise("fast"))


def related_files(direct: DataFrame, path_edges: DataFrame) -> DataFrame:
    """(path, relationship_count): direct rows count for their path, path edges
    for both ends."""
    ends = path_edges.select(F.explode(F.array("caller_path", "callee_path")).alias("path"))
    return direct.select("path").union(ends).where("path is not null").groupBy("path").agg(F.count("*").alias("relationship_count"))


def merge_related(files: DataFrame) -> DataFrame:
    """Rows of several impacts: counts added, reasons joined in order, the
    evidence of highest trust kept."""
    return files.groupBy("path").agg(
        F.sum("relationship_count").alias("relationship_count"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("reasons")))).alias("reasons"),
        F.max_by(F.struct("freshness", "trust_score", "trust_level"), "trust_score").alias("e"),
    ).select("path", "relationship_count", "reasons", "e.*")


def run_counters(files: DataFrame, chunks: DataFrame) -> DataFrame:
    return files.agg(F.count("*").alias("files_seen"), F.count_if(F.col("indexed")).alias("files_indexed")).join(F.broadcast(chunks.agg(F.count("*").alias("chunks"))), F.lit(True))


def parser_versions(files: DataFrame) -> DataFrame:
    return files.agg(F.array_join(F.array_sort(F.collect_set("parser_version")), ",").alias("parser_versions"))


def clients(rows: DataFrame, now, stale_after: int = 10) -> DataFrame:
    """Live clients per repository; a heartbeat that is no time counts as live."""
    live = F.coalesce(F.col("heartbeat_at") >= now - F.expr(f"interval {stale_after} seconds"), F.lit(True))
    return rows.where(live).groupBy("repository_id").agg(F.count("*").alias("clients"), F.array_sort(F.collect_set("client_kind")).alias("kinds"))


def enrichment_plan(files: DataFrame, symbols: DataFrame, calls: DataFrame, language: str = "rust") -> DataFrame:
    """Files, symbols and unsure calls that deeper analysis could improve."""
    own = files.where(F.col("language") == language).select(F.col("id").alias("file_id"))
    s = symbols.join(own, "file_id", "left_semi")
    unsure = calls.where("resolution_status in ('unresolved', 'ambiguous', 'resolved_local_candidate')").join(s.select(F.col("id").alias("caller_symbol_id")), "caller_symbol_id", "left_semi")
    return own.agg(F.count("*").alias("eligible_files")).join(F.broadcast(s.agg(F.count("*").alias("eligible_symbols"))), F.lit(True)).join(F.broadcast(unsure.agg(F.count("*").alias("eligible_calls"))), F.lit(True))


def prompt_tokens(rows: DataFrame) -> DataFrame:
    """Sum of the known counts; null if none is known."""
    return rows.agg(F.sum("prompt_eval_count").alias("prompt_tokens"))


def copies(rows: DataFrame, keys: list[str], id_column: str) -> DataFrame:
    """One row for each key: the least id that has it, and how many do."""
    return rows.groupBy(*keys).agg(F.min(id_column).alias(id_column), F.count("*").alias("copies"))
