"""Repeated passages by enhanced suffix arrays and their common-prefix interval trees.

A passage of ``LENGTH`` bytes that occurs twice holds the same anchor, the
least hash among its ``GRAM``-byte substrings (the last one of equals), at the
same offset.  So each document is cut into runs of windows with one anchor; a
run and the bytes of its windows are a context.  Suffixes can share ``LENGTH``
bytes only within one anchor, which splits the corpus into independent suffix
arrays.

* Anchors that occur once are dropped; what is left are repeat candidates.
* Equal contexts of an anchor are one suffix with all its occurrences: they are
  combined before anything is gathered, whatever their number.
* Anchors with different contexts go to suffix-array shards of bounded bytes.
  A shard sorts the suffixes that start a possible maximal repeat (their
  preceding bytes differ among the occurrences, or the context begins there),
  computes common-prefix lengths, and scans them with a stack.  An interval of
  length ``LENGTH`` or more whose left extensions differ is a maximal repeat
  group; all its members are occurrences.
* An anchor whose contexts do not fit a shard is not gathered: its part of the
  tree is opened from the root by aggregates.  A group of suffixes that share
  ``LENGTH`` bytes is an interval; its length is the common prefix of its least
  and its greatest suffix, its left extensions differ if the least and the
  greatest preceding byte do, and its children are its suffixes by the next
  byte.  Least and greatest are combined map-side.  Children that fit a shard
  go to one.  What is removed follows from the root intervals alone.

A repeat longer than a context is reported in overlapping pieces, one for each
anchor in it; their union is exact.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from codequarry.llm.docfilter import prefilter
from codequarry.llm.textkernel import Prefix, chunks, lean, mix
from codequarry.scratch import Scratch

LENGTH = 200
GRAM = 48
WIDE = LENGTH - GRAM + 1
#: Bytes of contexts in a shard, about; the arrays over its suffixes take some 50 times that.
SHARD_BYTES = 1 << 20
#: An anchor with more bytes of different contexts is opened by aggregates.
ANCHOR_BYTES = 4 << 20
#: A context with more than one of so many parts of all runs is dealt to several tasks.
HOT_PARTS = 4096
A_SCHEMA = "anchor bigint, id bigint, key bigint, at int, n int, context bigint"


def selected(h: np.ndarray) -> np.ndarray:
    """For each run of ``WIDE`` hashes the index of its least, last of equals."""
    value, index, have = h, np.arange(len(h), dtype=np.int32), 1
    while have < WIDE:
        step = min(have, WIDE - have)
        right = value[step:] <= value[:-step]
        value = np.where(right, value[step:], value[:-step])
        index = np.where(right, index[step:], index[:-step])
        have += step
    return index


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, keys = (np.asarray(batch.column(c).to_numpy(zero_copy_only=False)) for c in ("id", "key"))
        for chunk in chunks(batch.column("text")):
            if len(chunk.data) < LENGTH:
                continue
            prefix = Prefix(chunk.data)
            h = prefix.windows(GRAM)
            chosen = selected(h)
            ok = np.zeros(len(chunk.data) + 1, np.int32)
            last = np.maximum(chunk.offsets[1:] - LENGTH + 1, chunk.offsets[:-1])
            np.add.at(ok, chunk.offsets[:-1], 1)
            np.add.at(ok, last, -1)
            valid = np.cumsum(ok)[: len(chosen)] > 0
            new = np.ones(len(chosen), bool)
            new[1:] = (chosen[1:] != chosen[:-1]) | ~valid[:-1]
            new[chunk.offsets[chunk.offsets < len(chosen)]] = True
            first = np.flatnonzero(valid & new)
            if not len(first):
                continue
            # a run ends where the next begins or where windows stop being valid
            stop = np.flatnonzero(new | ~valid)
            end = np.append(stop, len(chosen))[np.searchsorted(stop, first, side="right")]
            n = end - first
            doc = np.searchsorted(chunk.offsets, first, side="right") - 1
            context = prefix.hashes(first, first + n + LENGTH - 1)
            yield pa.RecordBatch.from_arrays(
                [pa.array(h[chosen[first]].view(np.int64)), pa.array(ids[chunk.first + doc]), pa.array(keys[chunk.first + doc]), pa.array((first - chunk.offsets[doc]).astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(context.view(np.int64))],
                ["anchor", "id", "key", "at", "n", "context"],
            )


def enhanced_array(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes [start, end), and common-prefix lengths of neighbours.

    ``lcp[i]`` is that of the suffixes in places i - 1 and i (0 at the ends).
    """
    n, longest = len(starts), int((ends - starts).max())
    padded = np.append(data, np.zeros(longest + 8, np.uint8))
    # sort by eight bytes at a time, places of equals refined until none are
    # left: a few words a suffix are held, never the suffixes side by side
    order, rank = np.arange(n), np.zeros(n, np.int64)
    for at in range(0, longest, 8):
        key = np.zeros(n, np.uint64)
        for k in range(at, at + 8):
            key = (key << np.uint64(8)) | np.where(starts + k < ends, padded[np.minimum(starts + k, len(padded) - 1)], 0).astype(np.uint64)
        order = np.lexsort((key, rank))
        new = np.append(0, (rank[order[1:]] != rank[order[:-1]]) | (key[order[1:]] != key[order[:-1]]))
        rank[order] = np.cumsum(new)
        if new.sum() == n - 1:
            break
    # suffixes that differ in nothing but trailing zeros: the shorter one first
    order = np.lexsort((ends - starts, rank))
    lcp = np.zeros(n + 1, np.int64)
    wide = np.lib.stride_tricks.sliding_window_view(padded, longest)
    for lo in range(1, n, 16384):
        b = order[lo : lo + 16384]
        a = order[lo - 1 : lo - 1 + len(b)]
        differ = wide[starts[a]] != wide[starts[b]]
        same = np.where(differ.any(axis=1), differ.argmax(axis=1), longest)
        lcp[lo : lo + len(b)] = np.minimum(same, np.minimum((ends - starts)[a], (ends - starts)[b]))
    return order, lcp


def intervals(lcp: np.ndarray, least: int) -> Iterator[tuple[int, int, int]]:
    """(length, first, last) of all common-prefix intervals of at least ``least``,
    inner before outer, by one scan with a stack."""
    stack: list[tuple[int, int]] = []
    for i in range(1, len(lcp)):
        value, left = int(lcp[i]), i - 1
        while stack and stack[-1][0] > value:
            length, left = stack.pop()
            yield length, left, i - 1
        if value >= least and (not stack or stack[-1][0] < value):
            stack.append((value, left))


def _leaves(order: np.ndarray, lcp: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Which suffixes are no prefix of another: groups of their own if they occur
    twice or more."""
    out = np.empty(len(order), bool)
    out[order] = np.maximum(lcp[:-1], lcp[1:]) < length[order]
    return out


def shard_repeats(contexts: list[bytes], weights: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Maximal repeat groups among ``contexts``: (length, context, offset) arrays.

    ``weights`` count how often a context occurs; two or more make all of it a
    repeat by itself.
    """
    data = np.frombuffer(b"".join(contexts), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(c) for c in contexts])])
    prefix = Prefix(data)
    n = np.diff(offsets) - LENGTH + 1
    context = np.repeat(np.arange(len(contexts)), n)
    place = np.arange(n.sum()) - np.repeat(np.concatenate([[0], np.cumsum(n)[:-1]]), n)
    start = offsets[context] + place
    h = prefix.hashes(start, start + LENGTH)
    _, kind, members = np.unique(h, return_inverse=True, return_counts=True)
    total = np.bincount(kind, weights=weights[context])
    # preceding byte, -1 at the beginning of a context
    before = np.where(place > 0, data[np.maximum(start - 1, 0)].astype(np.int64), -1)
    low = np.full(len(members), 256)
    high = np.full(len(members), -2)
    np.minimum.at(low, kind, before)
    np.maximum.at(high, kind, before)
    diverse = (total >= 2) & ((low < 0) | (low != high))
    use = np.flatnonzero(diverse[kind])
    if not len(use):
        return
    starts, ends = start[use], offsets[context[use] + 1]
    order, lcp = enhanced_array(data, starts, ends)
    for i in use[_leaves(order, lcp, ends - starts) & (place[use] == 0) & (weights[context[use]] > 1)]:
        yield int(offsets[context[i] + 1] - start[i]), context[i : i + 1], place[i : i + 1]
    for length, a, b in intervals(lcp, LENGTH):
        own = use[order[a : b + 1]]
        left = before[own]
        if left.min() < 0 or left.min() != left.max():
            yield length, context[own], place[own]


def _columns(table: pa.Table, *names: str) -> list[np.ndarray]:
    return [np.asarray(table.column(c).to_numpy()) for c in names]


def _shard(table: pa.Table) -> pa.Table:
    """Longest repeat from each suffix of a context that occurs once."""
    blobs = table.column("bytes").to_pylist()
    weights, ids, keys, at = _columns(table, "weight", "id", "key", "at")
    best: dict[tuple[int, int], int] = {}
    for length, context, place in shard_repeats(blobs, weights):
        for c, p in zip(context.tolist(), place.tolist(), strict=True):
            if weights[c] == 1 and best.get((c, p), 0) < length:
                best[c, p] = length
    c = np.fromiter((k[0] for k in best), np.int64, len(best))
    p = np.fromiter((k[1] for k in best), np.int64, len(best))
    length = np.fromiter(best.values(), np.int64, len(best))
    begin = at[c] + p if len(best) else np.zeros(0, np.int64)
    return pa.table({"id": pa.array(ids[c], pa.int64()), "key": pa.array(keys[c], pa.int64()), "start": pa.array(begin, pa.int32()), "end": pa.array(begin + length, pa.int32())})


def _groups(table: pa.Table) -> pa.Table:
    blobs = table.column("bytes").to_pylist()
    weights, anchors, contexts = _columns(table, "weight", "anchor", "context")
    cols: list[list] = [[], [], [], [], []]
    for number, (length, context, place) in enumerate(shard_repeats(blobs, weights)):
        for c, p in zip(context.tolist(), place.tolist(), strict=True):
            for col, v in zip(cols, (anchors[c], number, length, contexts[c], p), strict=True):
                col.append(int(v))
    return pa.table({k: pa.array(v, pa.int64()) for k, v in zip(GROUP, cols, strict=True)})


GROUP = ("anchor", "number", "length", "context", "shift")
GROUP_SCHEMA = ", ".join(f"{c} bigint" for c in GROUP)


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every window of the contexts: its content hash, weight and place."""
    for batch in batches:
        anchors, ids, keys, at, weight, blobs = (batch.column(c).to_pylist() for c in ("anchor", "id", "key", "at", "weight", "bytes"))
        for o, i, k, a, w, blob in zip(anchors, ids, keys, at, weight, blobs, strict=True):
            data = np.frombuffer(blob, np.uint8)
            n = len(data) - LENGTH + 1
            h = Prefix(data).hashes(np.arange(n), np.arange(n) + LENGTH).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, o)), pa.array(h), pa.array(np.full(n, w)), pa.array(np.full(n, i)), pa.array(np.full(n, k)), pa.array((np.arange(n) + a).astype(np.int32))], ["anchor", "content", "weight", "id", "key", "start"])


SUFFIX_SCHEMA = "anchor bigint, number bigint, context bigint, shift bigint, weight bigint, before int, suffix binary"


def _suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every suffix of the contexts, with the hash of its first ``LENGTH`` bytes."""
    for batch in batches:
        anchors, contexts, weight, blobs = (batch.column(c).to_pylist() for c in ("anchor", "context", "weight", "bytes"))
        for a, c, w, blob in zip(anchors, contexts, weight, blobs, strict=True):
            data = np.frombuffer(blob, np.uint8)
            n = len(data) - LENGTH + 1
            h = Prefix(data).hashes(np.arange(n), np.arange(n) + LENGTH).view(np.int64)
            before = np.append(-1, data[: n - 1].astype(np.int32))[:n]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, a)), pa.array(h), pa.array(np.full(n, c)), pa.array(np.arange(n)), pa.array(np.full(n, w)), pa.array(before, pa.int32()), pa.array([blob[p:] for p in range(n)], pa.binary())],
                ["anchor", "number", "context", "shift", "weight", "before", "suffix"],
            )


def _common(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replace least and greatest suffix by the length of their common prefix."""
    for batch in batches:
        length = []
        for lo, hi in zip(batch.column("lo").to_pylist(), batch.column("hi").to_pylist(), strict=True):
            n = min(len(lo), len(hi))
            differ = np.flatnonzero(np.frombuffer(lo, np.uint8, n) != np.frombuffer(hi, np.uint8, n))
            length.append(int(differ[0]) if len(differ) else n)
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("anchor", "number", "diverse", "fits")), pa.array(length, pa.int64())], ["anchor", "number", "diverse", "fits", "length"])


def _subtrees(table: pa.Table) -> pa.Table:
    """All maximal repeat groups of whole groups of suffixes, each by itself:
    groups with one parent share bytes beyond their own tree."""
    table = table.sort_by("number")
    _, first = np.unique(np.asarray(table.column("number").to_numpy()), return_index=True)
    cols: list[list] = [[], [], [], [], []]
    for a, z in zip(first, np.append(first[1:], table.num_rows), strict=True):
        part = table.slice(a, z - a)
        blobs = part.column("suffix").to_pylist()
        anchors, numbers, contexts, shifts, weights, before = _columns(part, "anchor", "number", "context", "shift", "weight", "before")
        length = np.array([len(b) for b in blobs])
        ends = np.cumsum(length)
        order, lcp = enhanced_array(np.frombuffer(b"".join(blobs), np.uint8), ends - length, ends)
        found = [(int(length[i]), np.array([i])) for i in np.flatnonzero(_leaves(order, lcp, length) & (before < 0) & (weights > 1))]
        for size, lo, hi in intervals(lcp, LENGTH):
            own = order[lo : hi + 1]
            if before[own].min() < 0 or before[own].min() != before[own].max():
                found.append((size, own))
        names = mix(np.arange(len(found), dtype=np.uint64) + numbers[:1].astype(np.uint64)).view(np.int64)
        for name, (size, own) in zip(names, found, strict=True):
            for col, v in zip(cols, (anchors[own], np.full(len(own), name), np.full(len(own), size), contexts[own], shifts[own]), strict=True):
                col.extend(v.tolist())
    return pa.table({k: pa.array(v, pa.int64()) for k, v in zip(GROUP, cols, strict=True)})


def _opened(suffixes: DataFrame, scratch: Scratch) -> list[DataFrame]:
    """Maximal repeat groups of anchors too large for a shard, from the roots of
    their trees down; a level opens only groups that do not fit."""
    out, level = [], 0
    while True:
        by = suffixes.groupBy("anchor", "number").agg(
            F.sum("weight").alias("total"), F.count("*").alias("kinds"), F.min("suffix").alias("lo"), F.max("suffix").alias("hi"),
            (F.min("before").eqNullSafe(F.lit(-1)) | (F.min("before") != F.max("before"))).alias("diverse"), (F.sum(F.octet_length("suffix")) <= ANCHOR_BYTES).alias("fits"),
        )
        found = scratch.save(by.where("total > 1").drop("total", "kinds").mapInArrow(_common, "anchor bigint, number bigint, diverse boolean, fits boolean, length bigint"), f"tree{level}")
        if found.isEmpty():
            return out
        inner = suffixes.join(found.where("fits").select("anchor", "number"), ["anchor", "number"])
        size = inner.agg(F.sum(F.octet_length("suffix"))).first()[0] or 0
        inner = inner.withColumn("shard", F.pmod(F.xxhash64("anchor", "number"), F.lit(max(1, -(-size // SHARD_BYTES)))))
        out.append(scratch.save(inner.groupBy("shard").applyInArrow(_subtrees, GROUP_SCHEMA), f"inner{level}"))
        wide = scratch.save(suffixes.join(found.where("not fits").drop("fits"), ["anchor", "number"]), f"wide{level}")
        out.append(wide.where("diverse").select(*GROUP))
        # a suffix that ends with its group has no child
        child = F.xxhash64("number", F.expr("substring(suffix, 1, cast(length as int) + 1)"))
        suffixes = wide.where(F.octet_length("suffix") > F.col("length")).withColumn("number", child).drop("diverse", "length")
        level += 1


def _keyed(docs: DataFrame) -> DataFrame:
    """Documents with (id, key), which name a row by its id and its text."""
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return docs.withColumn("id", F.coalesce("doc_id", F.lit(0).cast("bigint"))).withColumn("key", F.xxhash64(F.col("doc_id").isNull(), "text"))


def _candidates(keyed: DataFrame, scratch: Scratch, which: str = "kinds > 1 and single > 0") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Repeated runs, their distinct contexts with weights, and the contexts
    that need a suffix array (``which``), with their bytes."""
    every = scratch.save(keyed.select("id", "key", "text").mapInArrow(lean(_anchors), A_SCHEMA), "anchors")
    # written, so that the join has a shuffle of its own on both sides and can
    # split an anchor with very many occurrences
    twice = scratch.save(every.groupBy("anchor").agg(F.count("*").alias("times")).where("times > 1").select("anchor"), "twice")
    runs = scratch.save(every.join(twice, "anchor", "left_semi"), "runs")
    scratch.drop("anchors")
    scratch.drop("twice")
    contexts = runs.groupBy("anchor", "context", "n").agg(F.count("*").alias("weight"), F.min(F.struct("id", "key", "at")).alias("one"))
    contexts = scratch.save(contexts.select("anchor", "context", "n", "weight", "one.id", "one.key", "one.at"), "contexts")
    mixed = contexts.groupBy("anchor").agg(F.count("*").alias("kinds"), F.count_if(F.col("weight") == 1).alias("single"), F.sum(F.col("n") + LENGTH - 1).alias("anchor_bytes")).where(which).select("anchor", "anchor_bytes")
    # written for the same reason: an anchor may have very many contexts
    wanted = scratch.save(contexts.join(scratch.save(mixed, "mixed"), "anchor"), "wanted")
    cut = f"substring(cast(text as binary), at + 1, n + {LENGTH - 1})"
    texts = prefilter(keyed.select("id", "key", "text"), wanted, "key")
    loaded = wanted.join(texts, ["id", "key"]).select("anchor", "context", "weight", "anchor_bytes", "id", "key", "at", F.expr(cut).alias("bytes"))
    return runs, contexts, scratch.save(loaded.dropDuplicates(["anchor", "context"]), "bytes")


def _sharded(loaded: DataFrame) -> DataFrame:
    own = loaded.where(F.col("anchor_bytes") <= ANCHOR_BYTES)
    size = own.agg(F.sum(F.octet_length("bytes"))).first()[0] or 0
    return own.withColumn("shard", F.pmod("anchor", F.lit(max(1, -(-size // SHARD_BYTES)))))


def _occurrences(runs: DataFrame, contexts: DataFrame, wanted: DataFrame) -> DataFrame:
    """``runs`` joined with ``wanted`` by anchor and context.

    A context with more than 1 / ``HOT_PARTS`` of all runs is salted: its runs
    are dealt to as many tasks as it has such parts, its wanted rows to each.
    There are fewer than ``HOT_PARTS`` of them, whatever the table, so their
    list is broadcast.
    """
    total = contexts.agg(F.sum("weight")).first()[0] or 0
    hot = contexts.where(F.col("weight") * HOT_PARTS > total).groupBy("anchor", "context").agg(F.ceil(F.sum("weight") * HOT_PARTS / F.lit(max(total, 1))).alias("fan"))
    fan = F.coalesce("fan", F.lit(1).cast("bigint"))
    left = runs.join(F.broadcast(hot), ["anchor", "context"], "left").withColumn("salt", F.pmod(F.xxhash64("id", "key", "at"), fan)).drop("fan")
    right = wanted.join(F.broadcast(hot), ["anchor", "context"], "left").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), fan - 1))).drop("fan")
    return left.join(right, ["anchor", "context", "salt"]).drop("salt")


def repeated_spans(docs: DataFrame, label: str = "suffix", scratch: Scratch | None = None) -> DataFrame:
    """(id, key, start, end): pieces whose union are all bytes covered by repeats.

    ``id`` and ``key`` name a document (``_keyed``); places are bytes, end exclusive.
    """
    scratch = scratch or Scratch(docs.sparkSession, label)
    runs, contexts, loaded = _candidates(_keyed(docs), scratch)
    equal = _occurrences(runs, contexts, contexts.where("weight > 1").select("anchor", "context").distinct())
    equal = equal.select("id", "key", F.col("at").alias("start"), F.expr(f"at + n + {LENGTH - 1}").alias("end"))
    sorted_ = _sharded(loaded).groupBy("shard").applyInArrow(_shard, "id bigint, key bigint, start int, end int")
    spread = loaded.where(F.col("anchor_bytes") > ANCHOR_BYTES).select("anchor", "id", "key", "at", "weight", "bytes").mapInArrow(lean(_windows), "anchor bigint, content bigint, weight bigint, id bigint, key bigint, start int")
    spread = scratch.save(spread, "windows")
    often = scratch.save(spread.groupBy("anchor", "content").agg(F.sum("weight").alias("times")).where("times > 1").select("anchor", "content"), "often")
    hot = spread.where("weight = 1").join(often, ["anchor", "content"], "left_semi").select("id", "key", "start", (F.col("start") + LENGTH).alias("end"))
    return equal.union(sorted_).union(hot)


def maximal_repeats(docs: DataFrame, label: str = "repeats") -> DataFrame:
    """(anchor, number, length, doc_id, start): maximal repeat groups of at least
    ``LENGTH`` bytes with all occurrences.

    A group is named by its anchor and number.  Equal contexts are listed with
    every document that has them, also where an anchor has no other context.
    """
    scratch = Scratch(docs.sparkSession, label)
    keyed = _keyed(docs)
    runs, contexts, loaded = _candidates(keyed, scratch, "kinds > 1")
    places = _sharded(loaded).groupBy("shard").applyInArrow(_groups, GROUP_SCHEMA)
    # anchors with one context only
    equal = contexts.where("weight > 1").join(loaded.select("anchor").distinct(), "anchor", "left_anti").select("anchor", F.col("context").alias("number"), F.expr(f"cast(n + {LENGTH - 1} as bigint)").alias("length"), "context", F.lit(0).cast("bigint").alias("shift"))
    every = places.union(equal)
    spread = scratch.save(loaded.where(F.col("anchor_bytes") > ANCHOR_BYTES).select("anchor", "context", "weight", "bytes").mapInArrow(lean(_suffixes), SUFFIX_SCHEMA), "suffixes")
    for part in _opened(spread, scratch):
        every = every.union(part)
    every = _occurrences(runs.select("anchor", "context", "id", "key", "at"), contexts, scratch.save(every, "groups"))
    # rows that are repeated are places of their own already
    return every.join(keyed.select("id", "key", "doc_id").dropDuplicates(["id", "key"]), ["id", "key"]).select("anchor", "number", "length", "doc_id", (F.col("at") + F.col("shift")).alias("start"))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("text").cast(pa.binary())
        sizes, removed, spans, digests = [], [], [], []
        starts, ends = batch.column("starts"), batch.column("ends")
        for i in range(batch.num_rows):
            text = texts[i].as_py()
            mark = np.zeros(len(text) + 1, np.int32)
            np.add.at(mark, starts[i].values.to_numpy(), 1)
            np.add.at(mark, ends[i].values.to_numpy(), -1)
            gone = np.cumsum(mark)[:-1] > 0
            sizes.append(len(text))
            removed.append(int(gone.sum()))
            spans.append(int((gone & ~np.append(False, gone[:-1])).sum()))
            digests.append(hashlib.sha256(np.frombuffer(text, np.uint8)[~gone].tobytes()).hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(digests, pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def remove_repeats(docs: DataFrame, label: str = "suffix") -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    Every byte covered by a ``LENGTH``-byte string that starts anywhere else too
    is removed; strings are judged on the input and matches stay inside a
    document.  Needs ``doc_id`` and ``text``; other columns are not read.  Null
    texts count as empty.  Null and repeated doc_ids are kept, a row for a row:
    a repeated row is another place where its strings start.
    """
    scratch = Scratch(docs.sparkSession, label)
    pieces = repeated_spans(docs, label, scratch)
    spans = scratch.save(pieces.groupBy("id", "key").agg(F.collect_list("start").alias("starts"), F.collect_list("end").alias("ends")), "spans")
    keyed = _keyed(docs)
    hit = prefilter(keyed, spans, "key").join(spans, ["id", "key"]).select("doc_id", "text", "starts", "ends")
    changed = hit.mapInArrow(lean(_cut), "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")
    rest = keyed.select("doc_id", "id", "key", F.octet_length("text").cast("bigint").alias("n_bytes"), F.sha2("text", 256).alias("kept_sha256")).join(spans.select("id", "key"), ["id", "key"], "left_anti")
    return changed.union(rest.select("doc_id", "n_bytes", F.lit(0).cast("bigint").alias("n_removed"), F.lit(0).cast("bigint").alias("n_spans"), "kept_sha256"))
