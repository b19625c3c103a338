import random
import re

from codequarry.llm import mixing as M
from pyspark.sql import functions as F

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def targets(sizes):
    """Level by level, from the definition."""
    order = sorted([s for s in sizes if s is not None]) + ([None] if None in sizes else [])
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    out, open_, left = {}, set(order), float(sum(sizes.values()))
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = [s for s in open_ if level * weight[s] > 3 * sizes[s]]
        if not over:
            return out | {s: level * weight[s] for s in open_}
        for s in over:
            out[s] = 3.0 * sizes[s]
            left -= out[s]
            open_.discard(s)
    return out


def corpus():
    rng = random.Random(11)
    rows = []
    for s, n, size in (("a", 60, 40), ("b", 3, 10), ("c", 30, 80), ("é", 2, 700), ("B", 10, 30), (None, 20, 25), ("empty", 3, 0)):
        rows += [(len(rows) + i, " ".join(["w"] * rng.randrange(size + 1)), s) for i in range(n)]
    return rows + [(900, None, "a"), (901, " \n", "c"), (None, "x y z", "a")]


def test_targets_and_taken(make, monkeypatch):
    for shard in (1_000_000, 300):
        monkeypatch.setattr(M, "SHARD", shard)
        rows = corpus()
        out = M.mix(make(rows)).collect()
        sizes = {}
        for _, t, s in rows:
            sizes[s] = sizes.get(s, 0) + len(WORD.findall(t or ""))
        want = targets(sizes)
        assert len(out) == len(rows)
        taken = {}
        for r in out:
            assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6 and 0 <= r.taken <= 3 * r.size
            taken[r.source] = taken.get(r.source, 0) + r.taken
        for s in sizes:
            assert abs(taken[s] - want[s]) <= M.BLOCK * (1 + sizes[s] / shard), s
        again = M.mix(make(rows, parts=7)).collect()
        key = lambda r: (r.doc_id is None, r.doc_id, r.source or "", r.size, r.taken)
        assert sorted(map(key, out)) == sorted(map(key, again))
    assert M.mix(make([])).collect() == []
    assert [r.taken for r in M.mix(make([(1, None, "s"), (2, "", "t")])).collect()] == [0, 0]


def test_repeated_rows_count_each(make):
    out = M.mix(make([(1, "a b c", "s")] * 4)).collect()
    assert len(out) == 4 and out[0].source_size == 12 and all(r.taken <= 9 for r in out)


def test_apportion_is_by_highest_quotient(spark):
    rng = random.Random(3)
    for weights, seats in (([53, 24, 23], 7), ([1, 1, 1], 2), ([0, 0], 5), ([100, 1, 1, 1], 9), ([rng.random() * 50 for _ in range(30)], 41), ([7.5] * 8, 12), ([0, 3], 4)):
        seats_of = [0] * len(weights)
        for _ in range(seats if sum(weights) else 0):
            best = max(range(len(weights)), key=lambda i: (weights[i] / (2 * seats_of[i] + 1), -i))
            seats_of[best] += 1
        df = spark.createDataFrame([(1, i, float(w), seats) for i, w in enumerate(weights)], "g int, k int, w double, n bigint")
        got = [r.quota for r in M.apportion(df, ["g"], "k", "w", "n").orderBy("k").collect()]
        assert got == seats_of, (weights, seats)


def heap_seats(weights, seats):
    """Seat by seat to the greatest quotient, ties to the least place."""
    import heapq

    out, heap = [0] * len(weights), [(-w, i) for i, w in enumerate(weights)]
    heapq.heapify(heap)
    for _ in range(seats):
        _, i = heapq.heappop(heap)
        out[i] += 1
        heapq.heappush(heap, (-weights[i] / (2 * out[i] + 1), i))
    return out


def test_apportion_with_dominant_weights_equals_a_heap(spark):
    rng = random.Random(5)
    cases = [([450.0] + [0.1] * 500, 500), ([450.0] + [0.9] * 500, 500), ([0.6] * 400 + [1000.0, 777.0], 1700), ([5.0] + [0.51] * 900, 460)]
    cases += [([rng.expovariate(1) ** 4 + 1e-3 for _ in range(300)], n) for n in (7, 150, 3000)]
    rows = [(g, i, w, n) for g, (ws, n) in enumerate(cases) for i, w in enumerate(ws)]
    got = {}
    for r in M.apportion(spark.createDataFrame(rows, "g int, k int, w double, n bigint"), ["g"], "k", "w", "n").collect():
        got.setdefault(r.g, {})[r.k] = r.quota
    for g, (ws, n) in enumerate(cases):
        assert [got[g][i] for i in range(len(ws))] == heap_seats(ws, n), g


def test_bins_of_shards_keep_the_targets(make, monkeypatch):
    monkeypatch.setattr(M, "SHARD", 100)
    monkeypatch.setattr(M, "BIN", 4)
    rows = corpus()
    taken, want = {}, {}
    for r in M.mix(make(rows)).collect():
        taken[r.source] = taken.get(r.source, 0) + r.taken
        want[r.source] = (r.target, r.source_size)
        assert 0 <= r.taken <= 3 * r.size
    for s, (t, size) in want.items():
        assert abs(taken[s] - t) <= M.BLOCK * (2 + size / 100), s


def test_null_sources_come_last(make):
    out = M.mix(make([(1, "a " * 60, "x"), (2, "a " * 60, None)])).select("source", F.round("target").alias("t")).collect()
    assert {r.source: r.t for r in out} == {"x": 40.0, None: 80.0}
