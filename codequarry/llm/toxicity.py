"""Toxicity by cumulative-link ordinal regression on sparse text features.

Features are words and word beginnings (``PREFIXES`` bytes), hashed.  Those over-represented in toxic
texts are selected; P(grade > k) = sigmoid(w.x - cut[k]) with one weight vector
for all ordered cuts.  Grades: 0 not toxic; toxic texts have grade 1, or 2 from
the median number of selected features on.  The expected grade is the severity.

The model is fitted on at most ``SAMPLE`` labelled rows (those with the least
seeded hash), ``FEATURES`` features; all documents are scored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from codequarry.llm.textkernel import LOWER, Prefix, chunks, mix
from codequarry.scratch import Scratch

SAMPLE = 20_000
FEATURES = 512
PREFIXES = (4, 5, 6, 7, 8, 10)
BUCKETS = 1 << 22
LEAST_Z = 5.0
LEAST_ROWS = 3
GRADES = 3
#: Least probability of a grade above 0 that is called toxic: a toxic text let
#: through costs more than a clean one lost.
THRESHOLD = 0.3
#: Bytes of words: letters, digits and all of UTF-8 beyond ASCII.
_SOLID = np.zeros(256, dtype=bool)
_SOLID[48:58] = _SOLID[65:91] = _SOLID[97:123] = _SOLID[128:] = True


def features(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """For chunks of texts: first row, rows, words per row, and (row, bucket)
    of every feature occurrence."""
    for chunk in chunks(column):
        data = LOWER[chunk.data]
        if not len(data):
            empty = np.zeros(0, np.int64)
            yield chunk.first, chunk.n, np.zeros(chunk.n, np.int64), empty, empty
            continue
        solid = _SOLID[data]
        border = np.zeros(len(data) + 1, dtype=bool)
        border[chunk.offsets] = True
        start = np.flatnonzero(solid & (~np.append(False, solid[:-1]) | border[:-1]))
        end = np.flatnonzero(solid & (~np.append(solid[1:], False) | border[1:])) + 1
        row = np.searchsorted(chunk.offsets, start, side="right") - 1
        prefix = Prefix(data)
        rows, buckets = [row], [prefix.hashes(start, end)]
        for k in PREFIXES:
            long = end - start > k
            rows.append(row[long])
            buckets.append(mix(prefix.hashes(start[long], start[long] + k) + np.uint64(k)))
        bucket = (np.concatenate(buckets) & np.uint64(BUCKETS - 1)).astype(np.int64)
        yield chunk.first, chunk.n, np.bincount(row, minlength=chunk.n), np.concatenate(rows), bucket


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of each class that have a bucket."""
    for batch in batches:
        toxic = np.asarray(batch.column("toxic").to_numpy(zero_copy_only=False)) > 0
        for first, _, _, row, bucket in features(batch.column("text")):
            pair = np.unique((row + first) * BUCKETS + bucket)
            is_toxic = toxic[pair // BUCKETS]
            which, at = np.unique(pair % BUCKETS, return_inverse=True)
            bad = np.bincount(at, weights=is_toxic, minlength=len(which)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(which), pa.array(bad), pa.array(np.bincount(at, minlength=len(which)) - bad)], ["bucket", "bad", "good"])


@dataclass
class Model:
    buckets: np.ndarray  # selected buckets, ascending
    weights: np.ndarray  # one per bucket, then one for log(words)
    cuts: np.ndarray  # ascending, GRADES - 1

    def vectors(self, column: pa.Array):
        """Per chunk: first row, rows, (row, feature, log(1 + count)), log(1 + words)."""
        slot = np.zeros(BUCKETS, np.int16)
        slot[self.buckets] = np.arange(1, len(self.buckets) + 1)
        for first, n, length, row, bucket in features(column):
            at = slot[bucket]
            hit = at > 0
            pair, times = np.unique(row[hit] * (FEATURES + 1) + at[hit], return_counts=True)
            yield first, n, pair // (FEATURES + 1), pair % (FEATURES + 1) - 1, np.log1p(times), np.log1p(length)

    def above(self, score: np.ndarray) -> np.ndarray:
        """P(grade > k) for each score, one column per cut."""
        return 1 / (1 + np.exp(-np.clip(score[:, None] - self.cuts[None, :], -40, 40)))


def fit(row: np.ndarray, feature: np.ndarray, value: np.ndarray, length: np.ndarray, grade: np.ndarray, n_features: int, rounds: int = 2000, decay: float = 2e-5) -> tuple[np.ndarray, np.ndarray]:
    """Weights and cuts of the ordinal model by gradient descent (Adam)."""
    n, k = len(grade), GRADES - 1
    w = np.zeros(n_features + 1)
    share = np.array([max((grade > c).mean(), 1e-4) for c in range(k)])
    first = np.log((1 - share[0]) / share[0])
    theta = np.concatenate([[first], np.log(np.maximum(np.diff(np.log((1 - share) / share)), 0.05))])
    m = v = np.zeros(len(w) + k)
    for t in range(1, rounds + 1):
        cuts = theta[0] + np.concatenate([[0.0], np.cumsum(np.exp(theta[1:]))])
        score = np.bincount(row, weights=w[feature] * value, minlength=n) + w[-1] * (length - 5)
        p = 1 / (1 + np.exp(-np.clip(score[:, None] - cuts, -40, 40)))
        upper = np.concatenate([np.ones((n, 1)), p], axis=1)
        lower = np.concatenate([p, np.zeros((n, 1))], axis=1)
        at = np.arange(n)
        a, b = upper[at, grade], lower[at, grade]
        prob = np.maximum(a - b, 1e-9)
        da, db = a * (1 - a) / prob, b * (1 - b) / prob
        d_score = -(da - db) / n
        d_cut = np.zeros(k)
        for c in range(k):
            d_cut[c] = ((grade == c + 1) * da - (grade == c) * db).sum() / n
        d_theta = np.array([d_cut.sum(), *(d_cut[c:].sum() * np.exp(theta[c]) for c in range(1, k))])
        g = np.concatenate([np.append(np.bincount(feature, weights=d_score[row] * value, minlength=n_features), (d_score * (length - 5)).sum()) + decay * w, d_theta])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
        w, theta = w - step[: len(w)], theta - step[len(w) :]
    return w, theta[0] + np.concatenate([[0.0], np.cumsum(np.exp(theta[1:]))])


def train(docs: DataFrame, labels: DataFrame, scratch: Scratch, sample: int = SAMPLE) -> Model:
    """Fit on at most ``sample`` labelled rows.

    Of the rows that repeat a doc_id one takes part, so ``sample`` bounds what
    is gathered whatever the tables hold; the fit is the same however they are
    partitioned.  Without labels of both classes, or without a telling feature, the model
    has no weights and calls nothing toxic.
    """
    nothing = Model(np.zeros(0, np.int64), np.zeros(1), np.array([40.0] * (GRADES - 1)))
    chosen = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64(F.lit(23), "doc_id"), "doc_id").limit(sample)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").where("text is not null").join(F.broadcast(chosen), "doc_id")
    rows = scratch.save(rows.groupBy("doc_id").agg(F.max_by("text", F.struct(F.xxhash64("text"), F.length("text"))).alias("text"), F.max(F.col("toxic").cast("int")).alias("toxic")), "sample")
    sizes = rows.agg(F.coalesce(F.count_if(F.col("toxic") > 0), F.lit(0)).alias("bad"), F.coalesce(F.count_if(F.col("toxic") <= 0), F.lit(0)).alias("good")).first()
    bad, good = sizes["bad"], sizes["good"]
    if not bad or not good:
        return nothing
    seen = rows.mapInArrow(_counts, "bucket bigint, bad bigint, good bigint").groupBy("bucket").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    share = F.expr(f"(bad + good) / {float(bad + good)!r}D")
    z = (F.col("bad") / bad - F.col("good") / good) / F.sqrt(share * (1 - share) * (1 / bad + 1 / good) + 1e-12)
    best = seen.where(F.col("bad") >= LEAST_ROWS).withColumn("z", z).where((F.col("z") >= LEAST_Z) & (F.col("bad") / bad >= 3 * F.col("good") / good)).orderBy(F.desc("z"), "bucket").limit(FEATURES)
    buckets = np.array(sorted(r["bucket"] for r in best.select("bucket").collect()), np.int64)
    if not len(buckets):
        return nothing
    model = Model(buckets, np.zeros(len(buckets) + 1), np.zeros(GRADES - 1))

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, n, row, feature, value, length in model.vectors(batch.column("text")):
                cut = np.searchsorted(row, np.arange(n + 1))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(first, n), batch.column("toxic").slice(first, n), pa.array(length), pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(feature)), pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(value))],
                    ["doc_id", "toxic", "length", "feature", "value"],
                )

    # rows come in any order: sorted, so that sums, and so the fit, are the same
    got = rows.mapInArrow(vectors, "doc_id bigint, toxic int, length double, feature array<bigint>, value array<double>").toArrow().sort_by("doc_id")
    toxic = got.column("toxic").to_numpy() > 0
    length = got.column("length").to_numpy()
    feature, value = got.column("feature").combine_chunks(), got.column("value").combine_chunks()
    many = np.asarray(feature.value_lengths().to_numpy(zero_copy_only=False))
    row = np.repeat(np.arange(len(many)), many)
    feature, value = feature.flatten().to_numpy(), value.flatten().to_numpy()
    hits = np.bincount(row, weights=np.expm1(value), minlength=len(many))
    typical = np.median(hits[toxic & (hits > 0)]) if (toxic & (hits > 0)).any() else 1.0
    grade = np.where(toxic, np.where(hits >= max(typical, 1.0), 2, 1), 0)
    model.weights, model.cuts = fit(row, feature, value, length, grade, len(buckets))
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Per document: doc_id, severity (expected grade), grade (likeliest), toxic.

    ``toxic``: a grade above 0 has at least the probability ``THRESHOLD``.  Null and empty
    texts have severity 0 and are not toxic.  Rows with a null or repeated
    doc_id are kept; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            severity, grade, toxic = [np.zeros(0)], [np.zeros(0, np.int64)], [np.zeros(0, bool)]
            for _, n, row, feature, value, length in model.vectors(batch.column("text")):
                s = np.bincount(row, weights=model.weights[feature] * value, minlength=n) + model.weights[-1] * (length - 5)
                p = model.above(s)
                p[np.bincount(row, minlength=n) == 0] = 0.0  # without any telling feature
                each = np.concatenate([np.ones((n, 1)), p], axis=1) - np.concatenate([p, np.zeros((n, 1))], axis=1)
                severity.append(p.sum(axis=1))
                grade.append(each.argmax(axis=1))
                toxic.append(p[:, 0] >= THRESHOLD)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.concatenate(severity)), pa.array(np.concatenate(grade)), pa.array(np.concatenate(toxic))], ["doc_id", "severity", "grade", "toxic"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, severity double, grade bigint, toxic boolean")


def judge(docs: DataFrame, labels: DataFrame, label: str = "toxicity") -> DataFrame:
    """Train on ``labels`` (doc_id, toxic) of ``docs`` and score every document."""
    return score(docs, train(docs, labels, Scratch(docs.sparkSession, label)))


def keep_clean(docs: DataFrame, labels: DataFrame, label: str = "toxicity") -> DataFrame:
    """The rows of ``docs`` that are not toxic, with all their columns."""
    model = train(docs, labels, Scratch(docs.sparkSession, label))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for _, n, row, feature, value, length in model.vectors(batch.column("text")):
                s = np.bincount(row, weights=model.weights[feature] * value, minlength=n) + model.weights[-1] * (length - 5)
                keep.append((model.above(s)[:, 0] < THRESHOLD) | (np.bincount(row, minlength=n) == 0))
            yield batch.filter(pa.array(np.concatenate(keep))) if keep else batch

    return docs.mapInArrow(run, docs.schema)
