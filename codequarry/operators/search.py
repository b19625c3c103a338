"""Symbol search, location predicates and lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from codequarry.functions import paths, reasons, status


def match_rank(query: Column, name: str = "name", qualified: str = "qualified_name") -> Column:
    """0 qualified name, 1 name, 2 qualified suffix, 3 contained."""
    return F.when(F.col(qualified) == query, 0).when(F.col(name) == query, 1).when(F.col(qualified).endswith(query), 2).otherwise(3)


def symbols(symbols_: DataFrame, query: str, limit: int | None = None) -> DataFrame:
    """Symbols whose id is the query or whose (qualified) name contains it,
    ASCII case ignored, best match first.  ``symbols_`` is joined with files."""
    q = F.lit(query)
    low = F.lower(q)
    hits = symbols_.where((F.col("id") == q) | F.lower("name").contains(low) | F.lower("qualified_name").contains(low))
    rows = hits.withColumn("match_rank", match_rank(q)).withColumn("reasons", reasons.symbol_match(q))
    return rows.orderBy("match_rank", "qualified_name", "path", "start_line", "id").limit(status.clamp(limit, 25))


def exact(symbols_: DataFrame, query: str) -> DataFrame:
    """Symbols of exactly this id, name or qualified name (for graph queries)."""
    return symbols_.where((F.col("id") == query) | (F.col("name") == query) | (F.col("qualified_name") == query))


def scoped(rows: DataFrame, ref_files: DataFrame | None, ref_id: str | None, file_id: str = "file_id") -> DataFrame:
    """Rows of the files of a ref; all rows if no ref is known."""
    if ref_files is None or ref_id is None:
        return rows
    own = ref_files.where(F.col("repository_ref_id") == ref_id).select(F.col("file_id").alias(file_id)).distinct()
    return rows.join(own, file_id, "left_semi")


def at_location(symbols_: DataFrame, path: str, line: int) -> DataFrame:
    return symbols_.where((F.col("path") == path) & (F.col("start_line") <= line) & (F.col("end_line") >= line))


def intersecting(symbols_: DataFrame, targets: DataFrame, limit: int = 25) -> DataFrame:
    """(target columns as ``target_*``, symbol): ranges that touch, all targets
    at once; equi join on path, lines as residual, at most ``limit`` a target."""
    t = targets.select(*[F.col(c).alias(f"target_{c}") for c in targets.columns])
    both = t.join(symbols_, (F.col("target_path") == F.col("path")) & (F.col("start_line") <= F.col("target_end_line")) & (F.col("end_line") >= F.col("target_start_line")))
    order = W.partitionBy("target_path", "target_start_line", "target_end_line").orderBy("start_line", "qualified_name", "id")
    return both.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= limit).drop("nth")


def calls_at(edges: DataFrame, path: str, line: int) -> DataFrame:
    return edges.where((F.col("caller_path") == path) & (F.col("call_line") == line))


def provenance(files: DataFrame, path: str | None = None) -> DataFrame:
    """The latest file row of each path."""
    rows = files if path is None else files.where(F.col("path") == path)
    cols = [c for c in ("id", "content_hash", "index_run_id", "parser_version", "indexed_at") if c in files.columns]
    return rows.groupBy("path").agg(F.max_by(F.struct(*cols), F.struct("indexed_at", "id")).alias("f")).select("path", "f.*")


def unchanged(discovered: DataFrame, indexed: DataFrame, parser_version: str) -> DataFrame:
    """Discovered files that are indexed already, by the same parser."""
    known = indexed.where(F.col("parser_version") == parser_version).select("path", "id", "content_hash")
    return discovered.join(known, ["path", "id", "content_hash"], "left_semi")


def map_failing_tests(failing: DataFrame, tests: DataFrame) -> DataFrame:
    """(test, qualified_name): the tests that a runtime test name means; the
    longest candidate spelling that has a match wins."""
    each = failing.select("test", F.posexplode(paths.test_name_candidates(F.col("test"))).alias("place", "candidate")).withColumn("tail", F.element_at(F.split("candidate", "::"), -1))
    named = tests.select("qualified_name", F.element_at(F.split("qualified_name", "::"), -1).alias("tail"))
    hits = each.join(named, "tail").where("qualified_name = candidate or endswith(qualified_name, concat('::', candidate))")
    best = hits.withColumn("best", F.min("place").over(W.partitionBy("test")))
    return best.where("place = best").select("test", "qualified_name").distinct()


def outside_scope(explicit: DataFrame, allowed: DataFrame) -> list[str]:
    """Explicit paths that are not in the allowed ones (few; for an error text)."""
    return sorted(r["path"] for r in explicit.join(allowed, "path", "left_anti").limit(25).collect())


def outline(symbols_: DataFrame, depth: int = 8) -> DataFrame:
    """Symbols with depth below their parents and number of children."""
    children = symbols_.where("parent_symbol_id is not null").groupBy(F.col("parent_symbol_id").alias("id")).agg(F.count("*").alias("child_count"))
    level = symbols_.where("parent_symbol_id is null").select("id", F.lit(0).alias("depth"))
    out = level
    for k in range(1, depth + 1):
        level = symbols_.select("id", F.col("parent_symbol_id").alias("p")).join(level.select(F.col("id").alias("p")), "p").select("id", F.lit(k).alias("depth"))
        out = out.union(level)
    return symbols_.join(out, "id").join(children, "id", "left").na.fill(0, ["child_count"])
