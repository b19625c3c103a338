import random

import numpy as np
from codequarry.llm import toxicity as T
from codequarry.scratch import Scratch

BAD = ["zorg", "blark", "frint"]


def corpus(n=600, seed=1):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        w = [f"word{rng.randrange(400)}" for _ in range(rng.randrange(5, 80))]
        toxic = i % 6 == 0
        if toxic:
            for _ in range(rng.randrange(2, 9)):
                w.insert(rng.randrange(len(w)), rng.choice(BAD) + rng.choice(["", ".", "!!"]))
        rows.append((i, " ".join(w)))
        labels.append((i, 1, int(toxic)))
    return rows, labels


def frame(spark, labels):
    return spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")


def test_held_out_accuracy(spark, make):
    rows, labels = corpus()
    train = labels[:400]
    out = {r.doc_id: r for r in T.judge(make(rows), frame(spark, train)).collect()}
    held = labels[400:]
    assert sum(out[i].toxic == bool(t) for i, _, t in held) / len(held) > 0.97
    few, many = ([out[i].severity for i, text in rows if sum(text.count(b) for b in BAD) in k] for k in ((2, 3), (7, 8)))
    assert np.mean(many) > np.mean(few) > 0.5  # severity grows with the evidence
    assert all(0 <= r.severity <= T.GRADES - 1 and 0 <= r.grade < T.GRADES for r in out.values())
    again = {r.doc_id: r.severity for r in T.judge(make(rows, parts=5), frame(spark, train).repartition(4)).collect()}
    assert again == {i: r.severity for i, r in out.items()}


def test_real_documents(spark, small):
    d = small.replace("0.001", "0.01")
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    out = T.judge(docs, labels).join(labels.withColumnRenamed("toxic", "label"), "doc_id").collect()
    clean = [r for r in out if not r.label]
    assert sum(r.toxic for r in clean) <= 0.01 * len(clean)
    assert sum(r.toxic for r in out if r.label) >= 0.6 * sum(r.label for r in out)


def test_odd_input(spark, make):
    rows, labels = corpus(120)
    odd = [(900, None), (901, ""), (902, "zorg " * 30000), (None, "zorg blark frint zorg blark"), (0, rows[0][1]), (903, "ZORG! blark, Frint zorg")]
    docs = make(rows + odd)
    out = T.judge(docs, frame(spark, labels + [(None, 1, 1), (5, None, None), (0, 1, 1), (99999, 0, 1)])).collect()
    assert len(out) == len(rows) + len(odd)
    by = {r.doc_id: r for r in out}
    assert (by[900].severity, by[900].toxic, by[901].toxic) == (0.0, False, False) and by[902].toxic and by[None].toxic and by[903].toxic
    kept = T.keep_clean(docs, frame(spark, labels))
    assert kept.columns == docs.columns and {900, 901} <= {r.doc_id for r in kept.collect()} and 902 not in {r.doc_id for r in kept.collect()}
    assert T.judge(make([]), frame(spark, labels)).collect() == []
    assert not any(r.toxic for r in T.judge(make(rows), frame(spark, [])).collect())
    assert not any(r.toxic for r in T.judge(make(rows), frame(spark, [(1, 1, 0)])).collect())
    assert T.keep_clean(make(rows), frame(spark, [])).count() == len(rows)


def test_sample_is_bounded(spark, make):
    rows, labels = corpus(200)
    scratch = Scratch(spark, "t")
    T.train(make(rows * 20), frame(spark, labels * 2), scratch, sample=50)
    assert spark.read.parquet(f"{scratch.root}/sample").count() == 50


def test_fit_orders_its_cuts():
    rng = np.random.default_rng(0)
    x = rng.normal(size=2000)
    grade = (x + 0.3 * rng.normal(size=2000) > 0).astype(int) + (x + 0.3 * rng.normal(size=2000) > 1)
    row = np.arange(2000)
    w, cuts = T.fit(row, np.zeros(2000, int), x, np.full(2000, 5.0), grade, 1)
    assert w[0] > 2 and cuts[0] < cuts[1]
    p = 1 / (1 + np.exp(-(w[0] * x[:, None] - cuts)))
    assert abs(p.sum(axis=1).mean() - grade.mean()) < 0.03


def loss(w, cuts, row, feature, value, length, grade, decay=2e-5):
    """Negative mean log-likelihood of the ordinal model, by definition."""
    score = np.zeros(len(grade))
    for r, f, v in zip(row, feature, value):
        score[r] += w[f] * v
    score += w[-1] * (length - 5)
    total = 0.0
    for s, g in zip(score, grade):
        above = [1.0] + [1 / (1 + np.exp(-(s - c))) for c in cuts] + [0.0]
        total -= np.log(above[g] - above[g + 1])
    return total / len(grade) + decay / 2 * float((w**2).sum())


def test_fit_reaches_the_least_loss():
    """Against a plain search that only evaluates the loss."""
    rng = np.random.default_rng(3)
    n = 160
    row = np.repeat(np.arange(n), 2)
    feature, value = rng.integers(0, 3, 2 * n), rng.uniform(0.2, 1.5, 2 * n)
    length = rng.uniform(4, 6, n)
    score = np.bincount(row, weights=np.array([1.5, -1.0, 0.4])[feature] * value, minlength=n) + rng.logistic(size=n)
    grade = (score > 0).astype(int) + (score > 1.2)
    w, cuts = T.fit(row, feature, value, length, grade, 3)
    at, step = np.array([0.0, 0.0, 0.0, 0.0, -0.1, 0.1]), 0.5
    f = lambda x: loss(x[:4], x[4:], row, feature, value, length, grade) if x[4] < x[5] else np.inf
    best = f(at)
    while step > 2e-3:
        moved = False
        for k in range(6):
            for d in (step, -step):
                trial = at.copy()
                trial[k] += d
                if (now := f(trial)) < best:
                    at, best, moved = trial, now, True
        step = step if moved else step / 2
    own = loss(w, cuts, row, feature, value, length, grade)
    assert own <= best + 1e-4
    assert np.abs(w - at[:4]).max() < 0.1 and np.abs(cuts - at[4:]).max() < 0.1
