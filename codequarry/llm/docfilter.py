"""Fetch the texts of chosen documents without moving all texts.

The chosen ids are first folded into a bitmap of fixed size (2**22 bits in at
most 65,536 words of 64 bits), whatever their number.  That table is small
enough to broadcast by construction; it removes most other rows before the
exact semi-join, so that only texts likely to be wanted are shuffled.  When the
ids are so many that the bitmap is full, the semi-join still is exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

BITS = 22


def _slot(column: str) -> Column:
    return F.xxhash64(F.col(column).cast("bigint")).bitwiseAND(F.lit((1 << BITS) - 1))


def bitmap(ids: DataFrame, column: str = "doc_id") -> DataFrame:
    """(word, bits): at most 65,536 rows, one for each used word of the map."""
    slot = _slot(column)
    one = F.expr(f"shiftleft(1L, cast(xxhash64(cast({column} as bigint)) & 63 as int))")
    return ids.select(F.shiftright(slot, 6).alias("word"), one.alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits"))


def prefilter(docs: DataFrame, ids: DataFrame, column: str = "doc_id") -> DataFrame:
    """Rows of ``docs`` whose id may be among ``ids`` (some others pass too)."""
    marks = F.broadcast(bitmap(ids, column))
    slot = _slot(column)
    hit = F.expr(f"(bits & shiftleft(1L, cast(xxhash64(cast({column} as bigint)) & 63 as int))) <> 0")
    keyed = docs.withColumn("word", F.shiftright(slot, 6))
    return keyed.join(marks, "word").where(hit).select(*docs.columns)


def with_ids(docs: DataFrame, ids: DataFrame, column: str = "doc_id") -> DataFrame:
    """Exactly the rows of ``docs`` whose id is among ``ids`` (distinct)."""
    return prefilter(docs, ids, column).join(ids, column, "left_semi")


def without(docs: DataFrame, ids: DataFrame, column: str = "doc_id") -> DataFrame:
    """Rows whose id is certainly not among ``ids``; the complement of
    ``prefilter``.  Rows without an id are here."""
    marks = F.broadcast(bitmap(ids, column))
    slot = _slot(column)
    miss = F.expr(f"bits is null or {column} is null or (bits & shiftleft(1L, cast(xxhash64(cast({column} as bigint)) & 63 as int))) = 0")
    keyed = docs.withColumn("word", F.when(F.col(column).isNotNull(), F.shiftright(slot, 6)))
    return keyed.join(marks, "word", "left").where(miss).select(*docs.columns)
