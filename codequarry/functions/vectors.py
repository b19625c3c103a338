"""Vector arithmetic on array columns, in doubles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 for a vector of length 0."""
    scale = norm(a) * norm(b)
    return F.when(scale > 0, dot(a, b) / scale).otherwise(0.0)


def normalized(a: Column) -> Column:
    size = norm(a)
    return F.when(size > 0, F.transform(a, lambda x: x.cast("double") / size)).otherwise(F.transform(a, lambda x: x.cast("double")))


def weighted_mean(df: DataFrame, key: str, vector: str, weight: str) -> DataFrame:
    """(key, mean): token-weighted mean of the vectors of a key, scaled to unit
    length; a single vector passes unchanged.

    Sums are taken per (key, place), so partial sums are combined before the
    shuffle and no key's vectors are gathered.
    """
    each = df.select(key, F.col(weight).cast("double").alias("w"), F.posexplode(vector).alias("place", "value"))
    sums = each.groupBy(key, "place").agg((F.sum(F.col("value").cast("double") * F.col("w")) / F.sum("w")).alias("value"), F.count("*").alias("n"), F.first(F.col("value").cast("double")).alias("one"))
    whole = sums.groupBy(key).agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("place", "value", "one"))).alias("p"))
    mean = F.transform("p", lambda x: x["value"])
    return whole.select(key, F.when(F.col("n") == 1, F.transform("p", lambda x: x["one"])).otherwise(normalized(mean)).alias("mean"))
