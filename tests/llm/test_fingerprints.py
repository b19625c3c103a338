import hashlib
import random

import brute
from codequarry.llm import fingerprints as P


def check(rows, out):
    texts = {i: t or "" for i, t in rows}
    order = sorted(texts, reverse=True)
    like = lambda a, b: 1.0 if not a and not b else 0.0 if not a or not b else sum(a[k : k + 8] == b[k : k + 8] for k in range(0, 512, 8)) / 64
    for n, i in enumerate(order):
        t, after = texts[i], texts[order[(n + 1) % len(order)]]
        cut = len(t) // 3
        edited = t[: len(t) - cut] + after[:cut]
        a, b, c = map(brute.order_minhash, (t, edited, after))
        want = (i, len(t), hashlib.sha256(edited.encode()).hexdigest(), a, b, like(a, b), like(a, c))
        assert tuple(out[i]) == want, i


def test_equals_brute_force(make):
    rng = random.Random(6)
    words = lambda n: " ".join(rng.choice(["the", "of", "ö", f"w{rng.randrange(200)}"]) for _ in range(n))
    rows = [(7 * i, words(rng.randrange(60))) for i in range(40)] + [(1, ""), (2, None), (3, "one"), (4, "a b"), (5, "a a a a a a a"), (6, " \n "), (8, words(9000)), (1000, "x" * 70000)]
    out = P.edited_likeness(make(rows)).collect()
    assert len(out) == len(rows)
    check(rows, {r.doc_id: r for r in out})


def test_edges(make):
    assert P.edited_likeness(make([])).collect() == []
    one = P.edited_likeness(make([(5, "only one text here")])).collect()
    check([(5, "only one text here")], {5: one[0]})
    rows = [(1, "a b c"), (1, "a b c"), (2, "d e f"), (None, "g")]
    out = P.edited_likeness(make(rows)).collect()
    assert sorted(r.doc_id for r in out) == [1, 2]
    check([(1, "a b c"), (2, "d e f")], {r.doc_id: r for r in out})


def test_order_matters_and_equal_texts_are_equal(spark):
    a = " ".join(f"w{i}" for i in range(300))
    b = " ".join([f"w{i}" for i in range(150, 300)] + [f"w{i}" for i in range(150)])
    df = spark.createDataFrame([(a, b, a)], "a string, b string, c string")
    for c in "abc":
        df = P.add_fingerprint(df, c, f"f{c}")
    row = df.select(P.likeness("fa", "fb").alias("moved"), P.likeness("fa", "fc").alias("same")).first()
    assert row.same == 1.0 and 0.2 < row.moved < 0.8  # nearly the same k-mers in another order


def test_plan_has_no_python(make):
    df = P.add_fingerprint(make([(1, "a b")]), "text", "f")
    plan = df._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
