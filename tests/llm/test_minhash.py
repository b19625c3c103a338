import random

import brute
import numpy as np
from codequarry.llm import minhash
from codequarry.llm.components import components
from codequarry.scratch import Scratch


def words(rng, n):
    return [f"w{rng.randrange(5000)}" for _ in range(n)]


def corpus():
    rng = random.Random(5)
    rows, base = [], words(rng, 120)
    for i in range(60):  # a family of near copies, each with a few words changed
        copy = list(base)
        for _ in range(rng.randrange(4)):
            copy[rng.randrange(len(copy))] = f"x{rng.randrange(99)}"
        rows.append((1000 + i, " ".join(copy)))
    rows += [(i, " ".join(words(rng, rng.randrange(1, 60)))) for i in range(40)]
    rows += [(500, rows[-1][1]), (501, rows[-1][1].upper()), (502, "one two"), (503, "One  two\n"), (504, ""), (505, None), (506, "two one"), (507, " \t")]
    rows += [(600, " ".join(words(rng, 30000)))]
    return rows


def test_classes_equal_brute_force(make):
    rows = corpus()
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(make(rows)).collect()}
    assert got == brute.near_classes(rows)


def test_real_documents(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    out = minhash.near_duplicates(docs).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in out} == brute.near_classes(rows)
    assert all(r.kept == (r.doc_id == r.component_id) for r in out)


def test_chain_of_copies_whose_ends_are_not_alike(make):
    rng = random.Random(9)
    text, rows = words(rng, 80), []
    for i in range(30):  # each differs a little from the one before
        rows.append((i, " ".join(text)))
        text = list(text)
        text[(7 * i) % 80] = f"y{i}"
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(make(rows)).collect()}
    assert got == brute.near_classes(rows)


def test_nulls_repeats_and_empty_tables(make):
    assert minhash.near_duplicates(make([])).collect() == []
    same = "a b c d e f g"
    out = minhash.near_duplicates(make([(3, same), (3, same), (None, same), (2, same), (None, None)])).collect()
    assert sorted(map(repr, map(tuple, out))) == sorted(map(repr, [(3, 3, 2, False), (3, 3, 2, False), (None, 3, 2, False), (2, 3, 2, True), (None, 0, None, False)]))


def test_keep_one_keeps_columns_and_one_of_each(make):
    docs = make([(3, "a b c d e f g"), (2, "A b c d e f g"), (9, "q r s"), (9, "q r s"), (4, None), (None, "lone text here")])
    out = minhash.keep_one(docs)
    assert out.columns == docs.columns
    assert sorted((r.doc_id is None, r.doc_id, r.text) for r in out.collect()) == [(False, 2, "A b c d e f g"), (False, 4, None), (False, 9, "q r s"), (True, None, "lone text here")]


def test_minmax_rows_estimate_similarity():
    rng = np.random.default_rng(1)
    pool = rng.integers(0, 1 << 63, 3000, dtype=np.uint64)
    a, b = np.unique(pool[:2000]), np.unique(pool[500:2500])
    true = 1500 / 2500
    same = (minhash.minmax_signature(a) == minhash.minmax_signature(b)).mean()
    assert abs(same - true) < 0.12


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 7), (200, 201), (201, 200), (300, 300)]
    out = components(spark.createDataFrame(edges, "a bigint, b bigint"), Scratch(spark, "t"))
    assert {r.node: r.component for r in out.collect()} == {**{i: 1 for i in [*range(1, 41), 100]}, 200: 200, 201: 200}
    assert components(spark.createDataFrame([], "a bigint, b bigint"), Scratch(spark, "t")).collect() == []


def test_buckets_are_finished_in_blocks(make, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 7)
    rows = corpus()
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(make(rows)).collect()}
    assert got == brute.near_classes(rows)
