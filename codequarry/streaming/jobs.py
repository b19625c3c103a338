"""Queue of quality embedding jobs, worked off in bounded batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from codequarry.functions import ids
from codequarry.operators import store as st, vectors
from codequarry.operators.store import Store
from codequarry.sources import embedder


def run_batch(store: Store, generation_id: str, texts: DataFrame, limit: int = 16, model: str = "hashed-64", embed: Callable = embedder.hashed) -> dict[str, int]:
    """Claim, check again, embed, store, complete; counts by outcome.

    ``texts`` has chunk_id and text of current chunks (never stored).  A job is
    stale when its file or chunk changed since; it gives no vector.
    """
    store.upsert("quality_embedding_jobs", st.claimed(st.oldest_pending(store.read("quality_embedding_jobs"), generation_id, limit)))
    jobs = store.read("quality_embedding_jobs")
    mine = jobs.where((F.col("generation_id") == generation_id) & (F.col("status") == "running"))
    sources = vectors.job_sources(mine, store.read("files"), store.read("chunks")).join(texts, "chunk_id", "left")
    fit = sources.where(~F.col("is_stale") & F.col("text").isNotNull())
    points = embedder.with_embedding(fit, "text", embed).drop("text")
    size = F.size("embedding").cast("bigint")
    rows = points.select(
        F.lit("quality").alias("vector_store"), F.lit(f"quality_{model}").alias("vector_table"), "chunk_id", "file_id", "repository_id", "path", "content_hash", "text_hash", "embedding", "generation_id",
        F.lit(model).alias("embedding_model"), size.alias("embedding_dimension"), F.lit("quality").alias("semantic_layer"), F.current_timestamp().alias("embedded_at"),
        F.lit("").alias("language"), F.lit("").alias("chunk_kind"), F.lit(0).alias("start_line"), F.lit(0).alias("end_line"),
    )
    point = ids.vector_point_id(ids.stable_id(F.col("chunk_id"), F.lit("quality"), F.lit(model)))
    store.upsert_points(rows.withColumn("vector_point_id", point).withColumn("vector_rowid", ids.vector_rowid(F.col("vector_point_id"))))
    ended = sources.select("id", F.when(F.col("is_stale"), "skipped_stale").when(F.col("text").isNull(), "skipped_excluded").otherwise("succeeded").alias("outcome"))
    # the jobs of this batch alone are written, into their buckets
    store.upsert("quality_embedding_jobs", mine.join(ended, "id").withColumn("status", F.col("outcome")).select(*jobs.columns))
    return {r["status"]: r["count"] for r in store.read("quality_embedding_jobs").where(F.col("generation_id") == generation_id).groupBy("status").count().collect()}


def run_all(store: Store, generation_id: str, texts: DataFrame, limit: int = 16, **more) -> dict[str, int]:
    """Batches until nothing is pending."""
    counts = run_batch(store, generation_id, texts, limit, **more)
    while counts.get("pending"):
        counts = run_batch(store, generation_id, texts, limit, **more)
    return counts
