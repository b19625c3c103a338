"""Vector table: exact nearest neighbours, pre-filters, manifests, verification."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window as W, functions as F

from codequarry.functions import ids, vectors

#: Queries and values of points (rows x dimension) that meet in one cell, about.
MOST_QUERIES = 4096
MOST_VALUES = 1 << 22
#: More than products of unit vectors in doubles can be off.
SLACK = 1e-9
#: Payload fields that a manifest row and a stored point must share.
CHECKED = ("content_hash", "text_hash", "path", "start_line", "end_line", "embedding_model", "embedding_dimension")


def check_query(vector: list[float], limit: int, dimension: int | None = None) -> None:
    if not vector:
        raise ValueError("the query vector is empty")
    if limit < 1:
        raise ValueError("the number of neighbours must be at least 1")
    if dimension is not None and dimension != len(vector):
        raise ValueError(f"the query has {len(vector)} dimensions, the table {dimension}")


def nearest(points: DataFrame, vector: list[float], limit: int, id_column: str = "vector_point_id") -> DataFrame:
    """The ``limit`` points of greatest cosine similarity, ties by id.

    One scan; each task keeps its own best (TakeOrderedAndProject), so no
    shuffle grows with the table.
    """
    check_query(vector, limit)
    q = F.array(*[F.lit(float(x)) for x in vector])
    scored = points.withColumn("score", vectors.cosine(F.col("embedding"), q)).drop("embedding")
    return scored.orderBy(F.desc("score"), id_column).limit(limit)


def _vectors(column: pa.ChunkedArray, dimension: int) -> np.ndarray:
    """Rows of doubles; one with a null in it counts as of length 0."""
    flat = pa.chunked_array(column.chunks, column.type).combine_chunks().flatten()
    out = np.array(flat.to_numpy(zero_copy_only=False), dtype=np.float64).reshape(len(column), dimension)
    if flat.null_count:
        out[np.asarray(flat.is_null()).reshape(out.shape).any(axis=1)] = 0
    return out


def _dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, summed from the first place to the last: equal rows give
    equal sums wherever they stand."""
    out = np.zeros(len(a))
    for j in range(a.shape[1]):
        out += a[:, j] * b[:, j]
    return out


def _best(points: np.ndarray, queries: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, point, score) of the ``limit`` best points of each query; equal
    scores in the order of the points.  A matrix product finds the points that
    can be among the best; their scores are then summed in order."""
    # of equal points only the first count, so large groups of copies stay small
    _, same = np.unique(np.ascontiguousarray(points).view(np.dtype((np.void, max(points.itemsize * points.shape[1], 1)))).ravel() if points.shape[1] else np.zeros(len(points)), return_inverse=True)
    by = np.argsort(same, kind="stable")
    first = np.flatnonzero(np.r_[True, np.diff(same[by]) > 0])
    nth = np.arange(len(by)) - np.repeat(first, np.diff(np.r_[first, len(by)]))
    rows = np.sort(by[nth < limit])
    points = points[rows]
    lengths, own = np.sqrt(_dots(points, points)), np.sqrt(_dots(queries, queries))
    with np.errstate(all="ignore"):
        unit = np.where(lengths[:, None] > 0, points / lengths[:, None], np.where(np.isnan(lengths)[:, None], np.nan, 0.0))
        found = []
        step = max(1, MOST_VALUES // max(len(points), 1))
        for at in range(0, len(queries), step):
            q, size = queries[at : at + step], own[at : at + step]
            near = np.where(size[:, None] > 0, q / size[:, None], np.where(np.isnan(size)[:, None], np.nan, 0.0)) @ unit.T
            rough = np.where(np.isfinite(near), near, np.inf)
            least = np.partition(rough, rough.shape[1] - limit, axis=1)[:, rough.shape[1] - limit] if limit < rough.shape[1] else np.full(len(q), -np.inf)
            who, what = np.nonzero(rough >= np.minimum(least, 2.0)[:, None] - SLACK)
            for k in range(0, len(who), MOST_VALUES // 64):
                w, p = who[k : k + MOST_VALUES // 64], what[k : k + MOST_VALUES // 64]
                scale = lengths[p] * size[w]
                found.append((w + at, p, np.where((scale > 0) | np.isnan(scale), _dots(points[p], q[w]) / scale, 0.0)))
    who, what, score = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.lexsort((what, -np.where(np.isnan(score), np.inf, score), who))
    who, what, score = who[order], what[order], score[order]
    first = np.flatnonzero(np.r_[True, np.diff(who) > 0])
    kept = np.arange(len(who)) - np.repeat(first, np.diff(np.r_[first, len(who)])) < limit
    return who[kept], rows[what[kept]], score[kept]


def nearest_each(points: DataFrame, queries: DataFrame, limit: int, id_column: str) -> DataFrame:
    """(query_id, id, score, rank) for a table of queries (query_id,
    query_vector), among points of the same dimension.  Parts of the points (at
    least as many as the session has shuffle partitions) meet blocks of the
    queries in cells, whose number follows from the counts; every cell keeps
    the best of its part by a matrix product, exact scores and the order of
    ids, and then the parts meet."""
    if limit < 1:
        raise ValueError("the number of neighbours must be at least 1")
    own = points.where("embedding is not null").select(F.col(id_column).alias("id"), "embedding", F.size("embedding").alias("d"))
    asked = queries.where("query_vector is not null").select("query_id", "query_vector", F.size("query_vector").alias("d"))
    values, many = own.agg(F.sum(F.col("d").cast("bigint"))).first()[0] or 0, asked.count()
    parts, blocks = max(int(points.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-values // MOST_VALUES)), max(1, -(-many // MOST_QUERIES))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    own = own.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int")).withColumn("block", every(blocks))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("query_id", "query_vector"), F.lit(blocks)).cast("int")).withColumn("part", every(parts))
    kinds = dict(own.dtypes) | dict(asked.dtypes)

    def meet(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left) or not len(right):
            return pa.table({"query_id": right["query_id"].slice(0, 0), "id": left["id"].slice(0, 0), "score": pa.array([], pa.float64())})
        left = left.take(pc.sort_indices(left["id"], null_placement="at_start"))
        who, what, score = _best(_vectors(left["embedding"], key[0].as_py()), _vectors(right["query_vector"], key[0].as_py()), limit)
        return pa.table({"query_id": right["query_id"].take(pa.array(who)), "id": left["id"].take(pa.array(what)), "score": pa.array(score)})

    cell = ["d", "part", "block"]
    first = own.groupBy(*cell).cogroup(asked.groupBy(*cell)).applyInArrow(meet, f"query_id {kinds['query_id']}, id {kinds['id']}, score double")
    order = [F.desc("score"), F.col("id")]
    return first.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(*order))).where(F.col("rank") <= limit).select("query_id", "id", "score", "rank")


def nearest_for_ref(points: DataFrame, ref_files: DataFrame, repository_id: str, ref_id: str, vector: list[float], limit: int) -> DataFrame:
    """Only points of files of the ref count toward the limit."""
    own = ref_files.where((F.col("repository_ref_id") == ref_id) & (F.col("repository_id") == repository_id)).select("file_id")
    return nearest(points.where(F.col("repository_id") == repository_id).join(own, "file_id", "left_semi"), vector, limit)


def nearest_for_files(points: DataFrame, repository_id: str, file_ids: list[str], vector: list[float], limit: int) -> DataFrame:
    """Only points of the listed files; no files, no result."""
    check_query(vector, limit)
    return nearest(points.where((F.col("repository_id") == repository_id) & F.col("file_id").isin(*file_ids)) if file_ids else points.limit(0), vector, limit)


def scroll(points: DataFrame, repository_id: str) -> DataFrame:
    """All payload rows of a repository, by point id; vectors are not read."""
    return points.where(F.col("repository_id") == repository_id).drop("embedding").orderBy("vector_point_id")


def expected(embeddings: DataFrame, chunks: DataFrame, files: DataFrame, layer: str, generation_id: str) -> DataFrame:
    """Points that the latest generation of a layer should have."""
    own = embeddings.where((F.col("semantic_layer") == layer) & (F.col("generation_id") == generation_id) & (F.col("status") == "current"))
    c = chunks.select(F.col("id").alias("chunk_id"), "start_line", "end_line")
    f = files.select(F.col("id").alias("file_id"), "path")
    return own.join(c, "chunk_id").join(f, "file_id").select("vector_point_id", *CHECKED)


def verify(want: DataFrame, have: DataFrame, key: str = "vector_point_id", checked: tuple[str, ...] = CHECKED) -> DataFrame:
    """(id, state, severity, mismatches) of points that are not as expected:
    missing (error), stale or orphaned (warning).  A null expectation of model
    or dimension is not compared."""
    w = want.select(F.col(key), F.struct(*[c for c in checked if c in want.columns]).alias("w"))
    h = have.select(F.col(key), F.struct(*[c for c in checked if c in have.columns]).alias("h"))
    names = [c for c in checked if c in want.columns and c in have.columns]
    differ = []
    for c in names:
        free = F.col(f"w.{c}").isNull() if c.startswith("embedding_") else F.lit(False)
        differ.append(F.when(~free & ~F.col(f"w.{c}").eqNullSafe(F.col(f"h.{c}")), F.lit(c)))
    both = w.join(h, key, "full_outer").withColumn("mismatches", F.when(F.col("w").isNotNull() & F.col("h").isNotNull(), F.array_compact(F.array(*differ))))
    state = F.when(F.col("h").isNull(), "missing").when(F.col("w").isNull(), "orphaned").when(F.size("mismatches") > 0, "stale")
    rows = both.withColumn("state", state).where("state is not null")
    return rows.select(key, "state", F.when(F.col("state") == "missing", "error").otherwise("warning").alias("severity"), "mismatches")


def verify_summary(rows: DataFrame, layer: str, table_exists: bool) -> DataFrame:
    return rows.agg(
        F.lit(layer).alias("semantic_layer"), F.lit(table_exists).alias("table_exists"),
        *[F.count_if(F.col("state") == s).alias(s) for s in ("missing", "stale", "orphaned")],
    )


def verify_all(summaries: DataFrame) -> DataFrame:
    """One row over all layers: sums, and whether all tables are there."""
    return summaries.agg(*[F.sum(s).alias(s) for s in ("missing", "stale", "orphaned")], F.bool_and("table_exists").alias("table_exists"), F.array_sort(F.collect_list("semantic_layer")).alias("layers"))


def repair_plan(rows: DataFrame, layer: str) -> DataFrame:
    """What to do about each point: orphans are deleted, the rest made again."""
    again = "reindex" if layer == "fast" else "quality_worker"
    return rows.withColumn("action", F.when(F.col("state") == "orphaned", "delete").otherwise(again))


def stale_points(points: DataFrame, changed_paths: DataFrame, active_paths: DataFrame, protected: DataFrame) -> DataFrame:
    """Ids to delete: points of changed or vanished paths that no ref needs."""
    changed = points.join(changed_paths, "path", "left_semi").select("vector_point_id")
    gone = points.join(active_paths, "path", "left_anti").select("vector_point_id")
    return changed.union(gone).distinct().join(protected.select("vector_point_id"), "vector_point_id", "left_anti")


def protected_points(embeddings: DataFrame, ref_files: DataFrame) -> DataFrame:
    return embeddings.join(ref_files.select("file_id"), "file_id", "left_semi").select("vector_point_id").distinct()


def generation_id(embeddings: DataFrame) -> DataFrame:
    """(repository_id, generation_id): md5 over the sorted manifest.

    Rows are hashed first and only hashes are gathered per repository.
    """
    each = embeddings.select("repository_id", F.md5(F.concat_ws("|", "chunk_id", "content_hash", "text_hash", "embedding_model", F.col("embedding_dimension").cast("string"))).alias("h"))
    folded = each.groupBy("repository_id", F.substring("h", 1, 3).alias("bucket")).agg(F.md5(F.array_join(F.array_sort(F.collect_list("h")), "")).alias("h"))
    return folded.groupBy("repository_id").agg(F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("bucket", "h"))), lambda x: x["h"]), "")).alias("generation_id"))


def carry_forward(previous: DataFrame, manifest: DataFrame, new_generation: str) -> DataFrame:
    """Quality rows whose chunk, hashes and model are in the new manifest."""
    on = ["chunk_id", "content_hash", "text_hash", "embedding_model"]
    return previous.join(manifest.select(*on).distinct(), on, "left_semi").withColumn("generation_id", F.lit(new_generation))


def missing_jobs(candidates: DataFrame, embedded: DataFrame, finished: DataFrame) -> DataFrame:
    """Candidates neither embedded already nor in a terminal job."""
    return candidates.join(embedded.select("chunk_id", "text_hash"), ["chunk_id", "text_hash"], "left_anti").join(finished.select("chunk_id", "text_hash"), ["chunk_id", "text_hash"], "left_anti")


def job_sources(jobs: DataFrame, files: DataFrame, chunks: DataFrame) -> DataFrame:
    """Jobs with what is current for them, and whether they are stale."""
    f = files.select(F.col("id").alias("file_id"), F.col("content_hash").alias("current_content_hash"))
    c = chunks.select(F.col("id").alias("chunk_id"), F.col("text_hash").alias("current_text_hash"))
    both = jobs.join(f, "file_id", "left").join(c, "chunk_id", "left")
    return both.withColumn("is_stale", ~(F.col("content_hash").eqNullSafe(F.col("current_content_hash")) & F.col("text_hash").eqNullSafe(F.col("current_text_hash"))))


def neighborhood(points: DataFrame) -> DataFrame:
    """Vector-backed chunks as metadata, without a score."""
    return points.drop("embedding").withColumn("score", F.lit(None).cast("double")).orderBy("path", "start_line", "vector_point_id")


def with_point_id(embeddings: DataFrame) -> DataFrame:
    hex32 = ids.stable_id(*[F.col(c) for c in ("chunk_id", "semantic_layer", "embedding_model")])
    return embeddings.withColumn("vector_point_id", ids.vector_point_id(hex32)).withColumn("vector_rowid", ids.vector_rowid(F.col("vector_point_id")))
