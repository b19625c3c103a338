import random

import brute
import numpy as np
import pytest
from codequarry.llm import suffixdedup as S


def key(row):
    return (row[0] is None, row[0] or 0, row[1:])


def corpus():
    rng = random.Random(3)
    text = lambda n: "".join(rng.choice("abcdefgh é\n") for _ in range(n))
    p, q = text(700), text(230)
    rows = [(i, text(rng.randrange(900))) for i in range(25)]
    rows += [(100 + i, text(rng.randrange(300)) + p[rng.randrange(300) :] + text(50)) for i in range(20)]
    rows += [(200 + i, text(40) + q + text(40)) for i in range(15)]
    rows += [(300, "ab" * 400), (301, "x" * 1000), (302, p + p), (303, ""), (304, None), (305, "z" * 199), (306, "z" * 200), (307, "\0" * 450)]
    rows += [(400, text(60000)), (401, rows[0][1]), (None, p)]
    return rows


def test_equals_brute_force(make):
    rows = corpus()
    got = [tuple(r) for r in S.remove_repeats(make(rows)).collect()]
    assert sorted(got, key=key) == sorted(brute.repeats(rows), key=key)


def test_hot_anchors_are_exact(make, monkeypatch):
    monkeypatch.setattr(S, "ANCHOR_BYTES", 900)
    monkeypatch.setattr(S, "HOT_PARTS", 8)
    rows = corpus()
    got = [tuple(r) for r in S.remove_repeats(make(rows)).collect()]
    assert sorted(got, key=key) == sorted(brute.repeats(rows), key=key)


def test_repeated_rows_are_places_of_their_own(make):
    long, short = "q" * 3 + "abcdefghij" * 30, "short"
    out = S.remove_repeats(make([(1, long), (1, long), (2, short), (2, short)])).collect()
    assert sorted((r.doc_id, r.n_removed) for r in out) == [(1, 303), (1, 303), (2, 0), (2, 0)]
    assert S.remove_repeats(make([])).collect() == []


def test_intervals_are_those_of_the_suffix_array():
    data = b"banana$bandana$"
    arr = np.frombuffer(data, np.uint8)
    starts = np.arange(len(data))
    order, lcp = S.enhanced_array(arr, starts, np.full(len(data), len(data)))
    suffixes = sorted(range(len(data)), key=lambda i: data[i:])
    assert order.tolist() == suffixes
    common = lambda a, b: next((k for k in range(min(len(a), len(b))) if a[k] != b[k]), min(len(a), len(b)))
    assert lcp[1:-1].tolist() == [common(data[a:], data[b:]) for a, b in zip(suffixes, suffixes[1:])]
    found = {(n, tuple(sorted(order[a : b + 1].tolist()))) for n, a, b in S.intervals(lcp, 2)}
    want = set()
    for i in range(len(data)):
        for n in range(2, len(data) - i + 1):
            places = tuple(j for j in range(len(data)) if data[j : j + n] == data[i : i + n])
            if len(places) > 1 and len({data[j + n : j + n + 1] for j in places}) > 1:
                want.add((n, places))
    assert found == want


def test_groups_list_all_occurrences(make):
    rng = random.Random(8)
    text = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    p = text(260)
    docs = {i: text(100) + p + text(100) for i in range(4)}
    rows = S.maximal_repeats(make(list(docs.items()))).collect()
    assert {r.doc_id for r in rows} == set(docs)
    groups = {}
    for r in rows:
        groups.setdefault((r.anchor, r.number), set()).add(docs[r.doc_id][r.start : r.start + r.length])
    assert groups and all(len(g) == 1 and len(next(iter(g))) >= 200 for g in groups.values())


@pytest.mark.parametrize("most", (S.ANCHOR_BYTES, 1, 3000))
def test_every_repeated_window_is_in_a_group(make, monkeypatch, most):
    monkeypatch.setattr(S, "ANCHOR_BYTES", most)
    monkeypatch.setattr(S, "HOT_PARTS", 16)
    rng = random.Random(15)
    text = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    copy, p, a, b, long = text(500), text(240), text(90), text(90), text(900)
    texts = [copy, copy, copy] + [x + p + x for x in (a, a, b, b)] + [text(50) + long + text(50) for _ in range(2)] + [text(80) + p + text(80), text(600)]
    docs = dict(enumerate(texts))
    groups = {}
    for r in S.maximal_repeats(make(list(docs.items()))).collect():
        groups.setdefault((r.anchor, r.number, r.length), []).append((r.doc_id, r.start))
    held = {}
    for (_, _, n), places in groups.items():
        assert n >= S.LENGTH and len(set(places)) == len(places) > 1 and len({docs[d][s : s + n] for d, s in places}) == 1
        for k in range(n - S.LENGTH + 1):
            w = docs[places[0][0]][places[0][1] + k :][: S.LENGTH]
            held.setdefault(w, []).append({(d, s + k) for d, s in places})
    want = {}
    for d, t in docs.items():
        for k in range(len(t) - S.LENGTH + 1):
            want.setdefault(t[k : k + S.LENGTH], set()).add((d, k))
    want = {w: places for w, places in want.items() if len(places) > 1}
    assert set(held) == set(want) and all(places in held[w] for w, places in want.items())


def test_opening_by_aggregates_gives_the_groups_of_the_suffix_array(make, monkeypatch):
    rng = random.Random(21)
    text = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    p, ends = text(230), [text(60) for _ in range(3)]
    docs = [text(30) + p + rng.choice(ends)[: rng.randrange(20, 60)] + text(90) for _ in range(14)] + [p] * 3
    found = []
    for most in (S.ANCHOR_BYTES, 1, 2000):
        monkeypatch.setattr(S, "ANCHOR_BYTES", most)
        groups = {}
        for r in S.maximal_repeats(make(list(enumerate(docs)))).collect():
            groups.setdefault((r.anchor, r.number, r.length), set()).add((r.doc_id, r.start))
        found.append(sorted((n, tuple(sorted(g))) for (_, _, n), g in groups.items()))
    assert found[0] == found[1] == found[2] and len(found[0]) > 3
