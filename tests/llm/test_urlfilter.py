from codequarry.llm import urlfilter as U
from codequarry.scratch import Scratch


def pages(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], "page_id bigint, url string, html string, host string, verdict string")


def test_hosts_paths_and_rules(spark):
    rows = [
        (1, "http://A.Example.COM/En/x?q#f", None),
        (2, "https://www.example.com/en/1", ""),
        (3, "https://example.com/en/1", ""),
        (4, "https://sub.www.example.com/en/", ""),
        (5, "http://notexample.com/en/", ""),
        (6, "http://x.net/es/1", ""),
        (7, "http://com", ""),
        (8, "no scheme", ""),
        (9, None, "<a href='http://x'>"),
        (10, "a://b://c/d", ""),
        (11, "http://h?x=://y/z", ""),
        (12, "http://example.comx/en/", ""),
        (12, "http://example.comx/en/", ""),
        (None, "http://net/fr/#a", ""),
    ]
    out = {(r.page_id, r.host, r.path, r.rule, r.verdict) for r in U.judge(pages(spark, rows)).collect()}
    assert out == {
        (1, "a.example.com", "/En/x", "com/", "allow"),
        (2, "www.example.com", "/en/1", "www.example.com/en/", "allow"),
        (3, "example.com", "/en/1", "example.com/en/", "block"),
        (4, "sub.www.example.com", "/en/", "www.example.com/en/", "allow"),
        (5, "notexample.com", "/en/", "com/", "allow"),
        (6, "x.net", "/es/1", "net/es/", "block"),
        (7, "com", "", None, "allow"),
        (8, "", "", None, "allow"),
        (9, "", "", None, "allow"),
        (10, "b:", "//c/d", None, "allow"),
        (11, "h", "", None, "allow"),
        (12, "example.comx", "/en/", None, "allow"),
        (None, "net", "/fr/", "net/fr/", "block"),
    }
    assert U.judge(pages(spark, [])).collect() == []


def rank(edges, seeds, rounds=4000):
    """Power iteration by definition; hosts without links return to the seeds."""
    out, total = {}, sum(seeds.values())
    for (s, _), w in edges.items():
        out[s] = out.get(s, 0) + w
    start = {h: v / total for h, v in seeds.items() if v}
    score = dict(start)
    for _ in range(rounds):
        lost = sum(v for h, v in score.items() if h not in out)
        new = {h: v * (1 - U.DAMPING + U.DAMPING * lost) for h, v in start.items()}
        for (s, d), w in edges.items():
            if s in score:
                new[d] = new.get(d, 0) + score[s] * w / out[s] * U.DAMPING
        score = new
    return score


def test_trust_follows_links_and_distrust_runs_back(spark):
    link = lambda *hosts: "".join(f'<A class=x HREF="http://{h}/p">l</a>' for h in hosts)
    rows = [
        (1, "http://good.com/", link("mid.org", "mid.org", "far.org")),
        (2, "http://mid.org/", link("far.org", "self.org")),
        (3, "http://bad.net/es/", link("nobody.org")),
        (4, "http://spam.org/", link("bad.net", "bad.net")),
        (5, "http://feeder.org/", "<a href='//spam.org/x?y'>l</a><a href='//[bad'>"),
        (6, "http://far.org/", "<a href='/rel'>"),
        (7, "http://lone.org/", None),
    ]
    out = {r.page_id: r for r in U.judge(pages(spark, rows)).collect()}
    assert {i: r.verdict for i, r in out.items()} == {1: "allow", 2: "allow", 3: "block", 4: "block", 5: "block", 6: "allow", 7: "allow"}
    edges = {("good.com", "mid.org"): 2, ("good.com", "far.org"): 1, ("mid.org", "far.org"): 1, ("mid.org", "self.org"): 1, ("bad.net", "nobody.org"): 1, ("spam.org", "bad.net"): 2, ("feeder.org", "spam.org"): 1}
    trust, distrust = rank(edges, {"good.com": 1}), rank({(d, s): w for (s, d), w in edges.items()}, {"bad.net": 1})
    for r in out.values():
        assert abs(r.trust - trust.get(r.host, 0)) < 1e-9 and abs(r.distrust - distrust.get(r.host, 0)) < 1e-9


def test_walks_over_cycles_end_within_the_tolerance(spark, monkeypatch):
    monkeypatch.setattr(U, "TOLERANCE", 0.05)
    edges = {("a", "b"): 2.0, ("b", "c"): 1.0, ("c", "a"): 1.0, ("b", "d"): 3.0, ("x", "a"): 1.0, ("d", "b"): 1.0}
    e = spark.createDataFrame([(s, d, w) for (s, d), w in edges.items()], "src string, dst string, weight double")
    got = {r.host: r.score for r in U.spread(e, spark.createDataFrame([("a", 2.0), ("x", 1.0), ("z", 0.0)], "host string, seed double"), Scratch(spark, "t"), "w").collect()}
    want = rank(edges, {"a": 2, "x": 1})
    assert set(got) == set(want) and sum(abs(got[h] - want[h]) for h in want) <= 2 * U.TOLERANCE
