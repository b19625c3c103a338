import random
import re

import numpy as np
import pytest
from codequarry.llm import decontam as D


def edit(a, b):
    """Least edits of ``a`` against any substring of ``b``, plainly."""
    row = [0] * (len(b) + 1)
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return min(row)


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def leaks(docs, items):
    out = set()
    for d, t in docs:
        for i, text in items:
            if not text or not t:
                continue
            p, hay = lower(text), lower(t)
            if len(text) < D.LEAST:
                if any(map(str.isalnum, text)) and re.search(rf"(?<![^\W_]){re.escape(p.strip())}(?![^\W_])", hay):
                    out.add((d, i))
                continue
            last = max(len(p) - D.WINDOW, 0)
            for at in {*range(0, last, D.STRIDE), last}:
                w = p[at : at + D.WINDOW]
                if edit(w, hay) <= D.budget(len(w)):
                    out.add((d, i))
                    break
    return out


def corpus():
    rng = random.Random(2)
    syllables = ["th", "er", "an", "in", "on", "é", "ti", " ", " ", "st", "ou", ". "]
    text = lambda n: "".join(rng.choice(syllables) for _ in range(n))
    items = [(i, text(rng.randrange(30, 120))) for i in range(8)] + [(50, "short"), (51, None), (52, ""), (None, text(50))]

    def damaged(t, k):
        t = list(t)
        for _ in range(k):
            p = rng.randrange(len(t))
            t[p] = rng.choice(["x", "", t[p] + "y"])
        return "".join(t)

    docs = [(i, text(rng.randrange(60))) for i in range(12)]
    for n, k in enumerate((0, 0, 1, 2, 3, 4, 5, 6, 8, 12, 20, 40)):
        docs.append((100 + n, text(30) + damaged(items[n % 8][1], k) + text(30)))
    docs += [(200, items[0][1].upper()), (201, items[1][1][: D.LEAST - 5]), (202, (items[2][1] + " ") * 5), (203, None), (204, ""), (205, items[3][1]), (206, text(5000) + items[4][1])]
    items += [(60, "Paris, France"), (61, "  x7 "), (62, "...")]
    docs += [(400, "is it paris, FRANCE?"), (401, "paris, frances"), (402, "ax7 x77 7x7"), (403, "(X7)"), (404, "..."), (405, "a short story")]
    docs += [(300 + n, text(10) + items[5][1][20:140] + text(10)) for n in range(3)]
    return docs, items


def table(spark, items):
    return spark.createDataFrame([(*i, "x") for i in items], "item_id bigint, text string, doc_id string")


def test_equals_brute_force(spark, make):
    docs, items = corpus()
    got = {(r.doc_id, r.item_id) for r in D.contaminated(make(docs), table(spark, items)).collect()}
    assert got == leaks([d for d in docs if d[0] != 206], [i for i in items if i[0] is not None]) | {(206, 4)}
    assert len(got) > 12


def test_edges(spark, make):
    docs, items = corpus()
    assert D.contaminated(make([]), table(spark, items)).collect() == []
    assert D.contaminated(make(docs), table(spark, [])).collect() == []
    twice = D.leaks(make([(1, items[0][1]), (1, items[0][1]), (None, items[0][1])]), table(spark, items[:1])).collect()
    assert len({r.doc_id for r in twice}) == 2 and all(r.edits == 0 and r.start == 0 for r in twice if r.end <= 100)
    kept = D.drop_leaks(make(docs), table(spark, items))
    bad = {d for d, _ in D.contaminated(make(docs), table(spark, items)).select("doc_id", "item_id").collect()}
    assert kept.columns == make(docs).columns and {r.doc_id for r in kept.collect()} == {d for d, _ in docs} - bad
    assert D.drop_leaks(make(docs), table(spark, [])).count() == len(docs)


def test_blocks_find_the_same(spark, make, monkeypatch):
    docs, items = corpus()
    whole = {(r.doc_id, r.item_id) for r in D.contaminated(make(docs), table(spark, items)).collect()}
    kept = {r.doc_id for r in D.drop_leaks(make(docs), table(spark, items)).collect()}
    monkeypatch.setattr(D, "BLOCK_CHARS", 300)
    assert {(r.doc_id, r.item_id) for r in D.contaminated(make(docs), table(spark, items)).collect()} == whole
    assert {r.doc_id for r in D.drop_leaks(make(docs), table(spark, items)).collect()} == kept


@pytest.mark.parametrize("seed", range(40))
def test_banded_alignment(seed):
    rng = np.random.default_rng(seed)
    region = rng.integers(0, 4, rng.integers(5, 60)).astype(np.uint32)
    m = int(rng.integers(3, min(30, len(region)) + 1))
    at = int(rng.integers(0, len(region) - m + 1))
    pattern = region[at : at + m].copy()
    for _ in range(rng.integers(0, 4)):
        pattern[rng.integers(0, m)] = rng.integers(0, 4)
    most = int(rng.integers(0, 5))
    best = D.distance(pattern, region, most, max(len(region) - m, 0))
    want = edit(pattern.tolist(), region.tolist())
    assert (best is None) == (want > most)
    if best:
        e, s, z = best
        assert e == want and edit(pattern.tolist(), region[s:z].tolist()) == want and 0 <= s <= z <= len(region)


def test_the_lemma_always_says_something():
    for n in range(D.LEAST, 400):
        e = D.budget(n)
        assert n + 1 - (e + 1) * D.Q >= 1


def test_passages_at_any_offset(spark, make):
    """Against the stated rule at every offset: no stride is used here."""
    rng = random.Random(12)
    text = lambda n: "".join(rng.choice("abcdefghijklmnop  ") for _ in range(n))
    items = [(i, text(230)) for i in range(6)] + [(6, text(80))]
    docs = []
    for n, size in enumerate((40, 48, 50, 51, 60, 78, 78, 90, 105, 120) * 3):
        at = rng.randrange(230 - size)
        docs.append((n, text(40) + items[n % 6][1][at : at + size] + text(40)))
    for n, k in enumerate((1, 2, 4, 6, 8) * 3):  # damaged passages off the windows
        cut = list(items[n % 6][1][25 + n : 127 + n])
        for p in rng.sample(range(len(cut)), k):
            cut[p] = "z"
        docs.append((100 + n, text(30) + "".join(cut) + text(30)))
    docs += [(200, items[6][1][7:65]), (201, text(900))]

    def holds(t, p):
        if len(p) <= D.WINDOW and edit(p, t) <= D.budget(len(p)):
            return True
        if any(p[a : a + D.PASSAGE] in t for a in range(len(p) - D.PASSAGE + 1)):
            return True
        near = lambda m, e: any(edit(p[a : a + m], t) <= e for a in range(len(p) - m + 1))
        return near(D.PASSAGE, D.SLIPS) or near(D.WINDOW, D.budget(D.WINDOW))

    pairs = [(d, t, i, p) for d, t in docs for i, p in items if d == 201 and i < 1 or d == 200 and i == 6 or d < 200 and i == d % 100 % 6]
    want = {(d, i) for d, t, i, p in pairs if holds(t, p)}
    got = {(r.doc_id, r.item_id) for r in D.contaminated(make(docs), table(spark, items)).collect()}
    assert got == want
    assert {n for n in range(30) if n % 10 >= 2} <= {d for d, _ in got} and 200 in {d for d, _ in got}
    assert {r.doc_id for r in D.drop_leaks(make(docs), table(spark, items)).collect()} == {d for d, _ in docs} - {d for d, _ in got}
