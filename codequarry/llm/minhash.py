"""Near-duplicate detection by min-max hashing.

A text's set is its distinct 5-word shingles.  Each of ``PERMUTATIONS`` hash
permutations is evaluated once per shingle and keeps both its minimum and its
maximum: two unbiased signature rows for one evaluation.  Bands of two
permutations (four rows) are the bucket keys; texts that share a bucket are
candidates and are confirmed on their full shingle sets.

Plan: texts with equal sets form a class (one row each after map-side
combining, whatever the size of the group).  In every bucket all classes are
first compared with one pivot.  Links are contracted to components; only
buckets that still hold several components are looked at again, where the
classes outside the bucket's largest component are compared, in blocks of
bounded size, with all classes of the bucket.  Pairs within one component need
no comparison, so no group is expanded into all of its pairs, and no pair of
classes that share a bucket and differ in component goes unchecked.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from codequarry.llm.components import components, loose
from codequarry.llm.docfilter import prefilter, with_ids, without
from codequarry.llm.textkernel import lean, mix, shingle_sets
from codequarry.scratch import Scratch

WIDTH = 5
PERMUTATIONS = 80
PER_BAND = 2
BLOCK = 256

_rng = np.random.default_rng(7919)
_A = _rng.integers(1, 1 << 63, PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 1 << 63, PERMUTATIONS, dtype=np.uint64)
_SALT = mix(np.arange(1, PERMUTATIONS // PER_BAND + 1, dtype=np.uint64))


def minmax_signature(shingles: np.ndarray) -> np.ndarray:
    """(minimum, maximum) of each permutation, shape (PERMUTATIONS, 2)."""
    low = np.full(PERMUTATIONS, np.iinfo(np.uint64).max, dtype=np.uint64)
    high = np.zeros(PERMUTATIONS, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for at in range(0, len(shingles), 4096):
            values = np.multiply.outer(_A, shingles[at : at + 4096]) + _B[:, None]
            np.minimum(low, values.min(axis=1), out=low)
            np.maximum(high, values.max(axis=1), out=high)
    return np.stack([low, high], axis=1)


def band_keys(signature: np.ndarray) -> np.ndarray:
    """One 64-bit bucket key per band of two permutations' minima and maxima."""
    rows = signature.reshape(PERMUTATIONS // PER_BAND, 2 * PER_BAND)
    with np.errstate(over="ignore"):
        key = _SALT.copy()
        for k in range(2 * PER_BAND):
            key = mix(key * np.uint64(0x9E3779B97F4A7C15) + rows[:, k])
    return key.view(np.int64)


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Exactly: 100 * |a & b| >= percent * |a | b| for sorted distinct arrays."""
    na, nb = len(a), len(b)
    if not na or not nb or 100 * min(na, nb) < percent * max(na, nb):
        return False
    both = np.concatenate([a, b])
    both.sort(kind="stable")
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= percent * (na + nb - common)


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes, digests, keys = [], [], []
        for s in shingle_sets(batch.column("text"), WIDTH):
            sizes.append(len(s))
            digests.append(hashlib.md5(s.tobytes()).digest() if len(s) else None)
            keys.append(band_keys(minmax_signature(s)) if len(s) else np.zeros(0, np.int64))
        counts = np.fromiter(map(len, keys), np.int32, len(keys))
        flat = np.concatenate(keys) if keys else np.zeros(0, np.int64)
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(flat))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), lists], ["doc_id", "n_shingles", "digest", "bands"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, blobs, size = [], [], 0
        for i, s in zip(batch.column("doc_id").to_pylist(), shingle_sets(batch.column("text"), WIDTH), strict=True):
            ids.append(i)
            blobs.append(s.tobytes())
            size += s.nbytes
            if size > 1 << 23:
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(blobs, pa.binary())], ["id", "shingles"])
                ids, blobs, size = [], [], 0
        if ids:
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(blobs, pa.binary())], ["id", "shingles"])


def _confirm(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = batch.column("x"), batch.column("y")
            keep = [linked(np.frombuffer(x[i].as_buffer(), np.uint64), np.frombuffer(y[i].as_buffer(), np.uint64), percent) for i in range(batch.num_rows)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _cell(percent: int):
    """Links between the rows of one cell: side 0 (few) against side 1 (all)."""

    def run(table: pa.Table) -> pa.Table:
        side = np.asarray(table.column("side").to_numpy())
        ids = np.asarray(table.column("id").to_numpy())
        comp = np.asarray(table.column("component").to_numpy())
        blobs = table.column("shingles").combine_chunks()
        sets = [np.frombuffer(blobs[i].as_buffer(), np.uint64) for i in range(len(ids))]
        root = {int(c): int(c) for c in comp}

        def find(c: int) -> int:
            while root[c] != c:
                root[c] = root[root[c]]
                c = root[c]
            return c

        a, b = [], []
        right = np.flatnonzero(side == 1)
        for i in np.flatnonzero(side == 0):
            for j in right:
                p, q = find(int(comp[i])), find(int(comp[j]))
                if p != q and linked(sets[i], sets[j], percent):
                    root[max(p, q)] = min(p, q)
                    a.append(int(ids[i]))
                    b.append(int(ids[j]))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def near_duplicates(docs: DataFrame, percent: int = 75, label: str = "minhash") -> DataFrame:
    """Every document with its near-duplicate class.

    ``docs`` needs ``doc_id`` (bigint) and ``text``; other columns are not
    read.  Result: doc_id, n_shingles (size of the shingle set), component_id
    (least doc_id reachable over links, its own included) and kept (doc_id =
    component_id).  Two documents are linked when their sets' similarity is at
    least ``percent`` per cent.  A null text counts as empty; empty sets are
    linked with nothing.  A null doc_id belongs to the class of its text, if
    another row has an id, and is never kept.  Repeated rows stay repeated and
    share a class; equal texts always share one.  Empty input, empty result.
    """
    scratch = Scratch(docs.sparkSession, label)
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    rows = scratch.save(docs.mapInArrow(lean(_describe), "doc_id bigint, n_shingles bigint, digest binary, bands array<bigint>"), "rows")

    classes = rows.where("digest is not null and doc_id is not null").groupBy("digest").agg(F.min(F.struct("doc_id", "bands")).alias("r")).select("digest", F.col("r.doc_id").alias("rep"), F.col("r.bands").alias("bands"))
    members = scratch.save(classes.select("rep", F.explode("bands").alias("key")), "members")
    buckets = members.groupBy("key").agg(F.min("rep").alias("pivot"), F.max("rep").alias("other"), F.count("*").alias("n")).where("pivot <> other")
    # loose: the join can split a bucket that very many classes share
    shared = scratch.save(members.join(loose(buckets.select("key", "pivot", "n"), "key"), "key"), "shared")
    scratch.drop("members")

    ends = shared.select(F.col("rep").alias("doc_id")).distinct()
    sets = scratch.save(with_ids(docs, ends).mapInArrow(lean(_sets), "id bigint, shingles binary").dropDuplicates(["id"]), "sets")

    pairs = shared.where("rep <> pivot").select(F.col("rep").alias("a"), F.col("pivot").alias("b")).distinct()
    both = pairs.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("x")), "a").join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("y")), "b")
    links = scratch.save(both.select("a", "b", "x", "y").mapInArrow(_confirm(percent), "a bigint, b bigint"), "links")
    found = scratch.save(components(links, scratch, "first"), "found")

    more = _open_buckets(scratch, shared, sets, found, percent)
    if more is not None:
        found = scratch.save(components(links.union(more), scratch, "second"), "final")
    for name in ("sets", "shared"):
        scratch.drop(name)

    joined = classes.select("digest", "rep").join(found, F.col("rep") == F.col("node"), "left").select("digest", F.coalesce("component", "rep").alias("component_id"))
    names = scratch.save(joined, "classes")
    return (
        rows.select("doc_id", "n_shingles", "digest")
        .join(names, "digest", "left")
        .select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))
    )


def _open_buckets(scratch: Scratch, shared: DataFrame, sets: DataFrame, found: DataFrame, percent: int) -> DataFrame | None:
    """Links missed by the pivots: buckets of three classes or more that still
    hold several components, each set of classes once."""
    named = shared.where("n > 2").join(found.withColumnRenamed("node", "rep"), "rep", "left").select("key", "rep", F.coalesce("component", "rep").alias("component"))
    sizes = named.groupBy("key", "component").agg(F.count("*").alias("n"), F.sum(F.xxhash64("rep").cast("decimal(38,0)")).alias("h"))
    whole = sizes.groupBy("key").agg(F.max(F.struct("n", "component")).alias("top"), F.sum("n").alias("n"), F.count("*").alias("parts"), F.sum("h").alias("h")).where("parts > 1")
    whole = whole.groupBy("n", "h").agg(F.min(F.struct("key", F.col("top.component").alias("component"), F.col("top.n").alias("top_n"))).alias("k"))
    opened = whole.select("k.key", F.col("k.component").alias("top"), (F.ceil(F.col("n") / BLOCK)).cast("int").alias("blocks"), F.ceil((F.col("n") - F.col("k.top_n")) / BLOCK).cast("int").alias("few"))
    todo = scratch.save(named.join(opened, "key"), "todo")
    if todo.isEmpty():
        return None
    from_zero = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(n).cast("bigint") - 1))
    block = lambda n: F.pmod(F.xxhash64("rep"), F.col(n).cast("bigint"))
    few = todo.where("component <> top").select("key", F.col("rep").alias("id"), "component", block("few").alias("i"), from_zero("blocks").alias("j"), F.lit(0).alias("side"))
    every = todo.select("key", F.col("rep").alias("id"), "component", from_zero("few").alias("i"), block("blocks").alias("j"), F.lit(1).alias("side"))
    cells = few.union(every).join(sets, "id")
    return scratch.save(cells.groupBy("key", "i", "j").applyInArrow(_cell(percent), "a bigint, b bigint"), "more")


def keep_one(docs: DataFrame, percent: int = 75, label: str = "minhash") -> DataFrame:
    """The rows of ``docs`` that stand for their class, with all their columns.

    Of rows that repeat an id and a text one stays; rows without doc_id stay.
    Rows whose id is certainly not to go are passed on where they lie; only the
    others are shuffled and decided on exactly.
    """
    scratch = Scratch(docs.sparkSession, label)
    judged = near_duplicates(docs, percent, label)
    doubtful = judged.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("rows"), F.count_if("kept").alias("stay")).where("rows > 1 or stay = 0")
    doubtful = scratch.save(doubtful.withColumnRenamed("doc_id", "id"), "doubtful")
    packed = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    ids = doubtful.select(F.col("id").alias("doc_id"))
    order = W.partitionBy("doc_id", F.xxhash64("row.text")).orderBy(F.xxhash64("row"))
    decided = prefilter(packed, ids).join(doubtful, F.col("doc_id") == F.col("id"), "left").where("rows is null or stay > 0")
    decided = decided.withColumn("nth", F.when(F.col("rows") > 1, F.row_number().over(order)).otherwise(F.lit(1))).where("nth = 1")
    return without(packed, ids).select("row.*").union(decided.select("row.*"))
