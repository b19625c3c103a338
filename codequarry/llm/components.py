"""Connected components of an edge table, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from codequarry.scratch import Scratch


def loose(df: DataFrame, key: str) -> DataFrame:
    """The same rows, known to Catalyst without the partitioning by ``key`` (a
    bigint) that an aggregate gave them.  A join by the key then shuffles both
    sides itself, which is what AQE needs to split a key that has very many
    rows on the other side; only the aggregate's rows are moved once more."""
    return df.withColumn(key, F.expr(f"{key} ^ 0L"))


def _least_neighbour(edges: DataFrame) -> DataFrame:
    """For each larger end the least of its smaller ends (combined map-side)."""
    return edges.groupBy("u").agg(F.min("v").alias("m"))


def components(edges: DataFrame, scratch: Scratch, name: str = "cc") -> DataFrame:
    """(node, component) for every node of ``edges`` (columns a, b: bigint).

    ``component`` is the least node reachable.  Each round makes every node
    point to the least neighbour it knows (large star), then to the least of
    its smaller neighbours (small star); the number of rounds is logarithmic.
    Only minima are aggregated (map-side combined), and the edges meet them in a
    join that AQE can split (``loose``), so a node with very many neighbours is
    never gathered in one task.  Self loops and repeated edges do no harm; an empty edge table
    gives an empty result.
    """
    state = scratch.save(
        edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(),
        f"{name}0",
    )
    before, step = None, 0
    while True:
        both = state.select("u", "v").union(state.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = loose(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m")), "u")
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = loose(_least_neighbour(large), "u")
        small = (
            large.join(least, "u")
            .select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
            .select("e.u", "e.v")
            .where("u <> v")
            .distinct()
        )
        step += 1
        state = scratch.save(small, f"{name}{step}")
        now = state.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0)).alias("h")).first()
        if step > 1:
            scratch.drop(f"{name}{step - 2}")
        if before is not None and (now["n"], now["h"]) == before:
            break
        before = (now["n"], now["h"])
    roots = state.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return state.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
