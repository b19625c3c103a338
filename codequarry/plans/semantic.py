"""The semantic side of indexing: segments, embeddings, generations, status."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from codequarry.functions import ids, tokens, vectors as vec
from codequarry.operators import vectors
from codequarry.operators.store import Store
from codequarry.sources import embedder


def embeddable(chunks: DataFrame, text: str = "text") -> DataFrame:
    """Chunks that may be embedded: not excluded, with text."""
    return chunks.where(F.col("excluded_reason").isNull() & (F.trim(F.coalesce(text, F.lit(""))) != ""))


def chunk_vectors(chunks: DataFrame, budget: int, embed: Callable = embedder.hashed) -> DataFrame:
    """(chunk_id, mean, dimension): a vector for each chunk (chunk_id, text).

    Long texts are cut into overlapping segments of ``budget`` tokens; their
    vectors are averaged by tokens and scaled to length 1.
    """
    parts = tokens.segment_table(chunks.select("chunk_id", "text"), "text", budget).select("chunk_id", "segment", "segment_tokens")
    means = vec.weighted_mean(embedder.with_embedding(parts, "segment", embed), "chunk_id", "embedding", "segment_tokens")
    return means.withColumn("dimension", F.size("mean").cast("bigint"))


def points(chunks: DataFrame, means: DataFrame, layer: str, model: str, generation: DataFrame | None = None) -> DataFrame:
    """Rows of the table vector_points for chunks with file columns."""
    rows = chunks.join(means, "chunk_id").select(
        F.lit(layer).alias("vector_store"), ids.vector_table_name(F.col("repository_id"), F.lit(model)).alias("vector_table"), "repository_id", "file_id", "chunk_id", "symbol_id", "path", "language", F.col("kind").alias("chunk_kind"),
        "content_hash", "text_hash", "start_line", "end_line", F.lit(model).alias("embedding_model"), F.col("dimension").alias("embedding_dimension"), F.lit(layer).alias("semantic_layer"), F.current_timestamp().alias("embedded_at"),
        F.transform("mean", lambda x: x.cast("float")).alias("embedding"),
    )
    rows = vectors.with_point_id(rows)
    return rows if generation is None else rows.join(generation, "repository_id")


def embed_chunks(store: Store, texts: DataFrame, repository_id: str, model: str = "hashed-64", layer: str = "fast", budget: int = 2048, embed: Callable = embedder.hashed, keep: DataFrame | None = None) -> None:
    """Embed current chunks (``texts``: chunk_id, text) and record a generation.

    Vectors come first, then the manifest and the generation, then stale
    vectors go: a failure leaves the generation before readable.  Only chunks
    without a current vector of the model are embedded.
    """
    files = store.read("files").where(F.col("repository_id") == repository_id).select(F.col("id").alias("file_id"), "repository_id", "path", "language", "content_hash")
    chunks = store.read("chunks").withColumnRenamed("id", "chunk_id").drop("embedding_model", "embedding_dimension", "embedded_at").join(files, "file_id")
    fit = embeddable(chunks.join(texts, "chunk_id"))
    old = store.read("vector_points").where((F.col("repository_id") == repository_id) & (F.col("semantic_layer") == layer) & (F.col("embedding_model") == model))
    todo = fit.join(old.select("chunk_id", "text_hash"), ["chunk_id", "text_hash"], "left_anti")
    manifest = fit.select("repository_id", "chunk_id", "content_hash", "text_hash", F.lit(model).alias("embedding_model"), F.lit(0).alias("embedding_dimension"))
    generation = vectors.generation_id(manifest)
    new = points(todo.drop("text"), chunk_vectors(todo, budget, embed), layer, model, generation)
    store.upsert_points(new)
    current = store.read("vector_points").where((F.col("semantic_layer") == layer) & (F.col("embedding_model") == model)).drop("generation_id").join(generation, "repository_id").join(fit.select("chunk_id", "text_hash"), ["chunk_id", "text_hash"], "left_semi")
    rows = current.select(
        ids.stable_id(F.col("chunk_id"), F.col("semantic_layer"), F.col("embedding_model")).alias("id"), "repository_id", "file_id", "chunk_id", "semantic_layer", "embedding_model", "embedding_dimension", "content_hash", "text_hash", "vector_table", "vector_point_id",
        "generation_id", "embedded_at", F.lit("current").alias("status"),
    )
    before = store.read("chunk_embeddings").where((F.col("repository_id") == repository_id) & (F.col("semantic_layer") == layer))
    store.change("chunk_embeddings", new=rows, gone=before.join(rows.select("chunk_id"), "chunk_id", "left_anti").select("chunk_id", "semantic_layer"))
    record_generation(store, repository_id, generation, model, layer)
    wanted = store.read("chunk_embeddings").select("vector_point_id")
    protected = wanted if keep is None else wanted.union(keep.select("vector_point_id"))
    gone = store.read("vector_points").where((F.col("repository_id") == repository_id) & (F.col("semantic_layer") == layer)).select("vector_point_id").join(protected, "vector_point_id", "left_anti")
    if not gone.isEmpty():
        store.delete("vector_points", gone)


def record_generation(store: Store, repository_id: str, generation: DataFrame, model: str, layer: str) -> None:
    """Upsert the generation with its counts; its id follows from the manifest."""
    mine = store.read("chunk_embeddings").where((F.col("repository_id") == repository_id) & (F.col("semantic_layer") == layer))
    facts = mine.agg(F.count("*").alias("embedded"), F.max("embedding_dimension").alias("dimension"), F.countDistinct("file_id").alias("files"))
    now = F.current_timestamp()
    fast = layer == "fast"
    rows = generation.join(F.broadcast(facts), F.lit(True)).select(
        F.col("generation_id").alias("id"), "repository_id", F.lit(model).alias("fast_model"), F.coalesce("dimension", F.lit(0)).alias("fast_dimension"), now.alias("fast_completed_at"), F.lit("fast_ready" if fast else "quality_ready").alias("quality_status"),
        F.lit(layer).alias("active_layer"), F.col("files").alias("files_seen"), F.col("embedded").alias("embeddable_chunks"), F.col("embedded").alias("fast_embedded_chunks"), F.lit(0 if fast else 1).cast("bigint").alias("quality_embedded_chunks"), now.alias("created_at"), now.alias("updated_at"),
    )
    store.upsert("semantic_generations", rows)


def link_generation(store: Store, repository_id: str, ref_id: str, generation_id: str) -> None:
    rows = store.spark.createDataFrame([(ref_id, repository_id, generation_id)], "repository_ref_id string, repository_id string, generation_id string")
    store.upsert("semantic_generation_refs", rows.withColumn("linked_at", F.current_timestamp()))


def semantic_status(generations: DataFrame, jobs: DataFrame) -> DataFrame:
    """Per repository: the latest generation with its open and ended jobs."""
    from codequarry.operators import summaries

    last = summaries.latest_by(generations, ["repository_id"], ["created_at", "id"])
    done = summaries.progress(jobs)
    rows = last.join(done.withColumnRenamed("generation_id", "id"), "id", "left").na.fill(0, ["pending", "running", "succeeded", "failed", "skipped_stale", "skipped_excluded", "total"])
    return rows.withColumn("quality_status", F.coalesce("quality_status", F.lit("missing"))).withColumn("active_layer", F.coalesce("active_layer", F.lit("fast")))


def repository_status(files: DataFrame, chunks: DataFrame, symbols: DataFrame, runs: DataFrame, refs: DataFrame) -> DataFrame:
    """One row: counts, the latest successful run and the current ref."""
    one = lambda df, name: F.broadcast(df.agg(F.count("*").alias(name)))
    last = runs.where("status = 'success'").agg(F.max_by(F.struct("id", "embedding_model", "embedding_dimension", "finished_at"), F.struct("started_at", "id")).alias("last_run"))
    ref = refs.where("is_current and deleted_at is null").agg(F.max_by("ref_name", "updated_at").alias("current_ref"))
    out = files.agg(F.count("*").alias("files"))
    for side in (one(chunks, "chunks"), one(symbols, "symbols"), F.broadcast(last), F.broadcast(ref)):
        out = out.join(side, F.lit(True))
    return out
