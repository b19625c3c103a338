"""Operators whose plan changes with size: each against a plain version."""

from __future__ import annotations

import hashlib
import random
import re
from types import SimpleNamespace

import pytest
from pyspark.sql import Window as W, functions as F

from codequarry import scratch
from codequarry.functions import tokens, trust, vectors as vec
from codequarry.operators import graph, resolve, vectors
from codequarry.sources import discovery, embedder


def _session(master: str, folder: str | None):
    return SimpleNamespace(conf=SimpleNamespace(get=lambda key, other: folder or other), sparkContext=SimpleNamespace(master=master, applicationId="none"))


def test_a_cluster_needs_a_shared_folder():
    for master in ("yarn", "spark://host:7077", "local-cluster[2,1,1024]", "k8s://https://host"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            scratch.shared_dir(_session(master, None))
        assert scratch.shared_dir(_session(master, "s3a://bucket/checkpoints/")) == "s3a://bucket/checkpoints"


def _plain_segments(text: str, budget: int) -> list[str]:
    found = re.findall(r"\s+|[A-Za-z0-9_]{1,4}|[^\sA-Za-z0-9_]", text)
    shared = 0 if budget < 8 else min(budget // 5, 64, budget - 1)
    out, at = [], 0
    while found:
        end = min(at + budget, len(found))
        if end < len(found):
            end = next((k for k in range(end, at + max(budget // 2, 1) - 1, -1) if "\n" in found[k - 1]), end)
        out.append("".join(found[at:end]))
        if end == len(found):
            break
        at = max(end - shared, at + 1)
    return out


def test_segments_equal_the_plain_rule(spark):
    rng = random.Random(5)
    texts = ["", "\n", "word", " \n ", "ж" * 30] + ["".join(rng.choice(["ab", "words_and_more", " ", "\n", " \n", ".", "é"]) for _ in range(rng.randint(1, 200))) for _ in range(40)]
    for budget in (1, 2, 7, 8, 20, 64):
        for text in texts:
            assert tokens.segments(text, budget) == _plain_segments(text, budget)
    rows = [(k, t, "extra") for k, t in enumerate(texts)] + [(99, None, None)]
    out = tokens.segment_table(spark.createDataFrame(rows, "id int, body string, run string"), "body", 20).collect()
    want = sorted((k, n, part, len(tokens._TOKEN.findall(part))) for k, t, _ in rows for n, part in enumerate(_plain_segments(t or "", 20)))
    assert sorted((r.id, r.segment_index, r.segment, r.segment_tokens) for r in out) == want
    assert all(r.run == "extra" and r.body == texts[r.id] for r in out)
    assert tokens.segment_table(spark.createDataFrame([], "body string"), "body", 20).collect() == []


def test_hashed_vectors_equal_a_loop_over_tokens():
    text = "fn add(a: i64, b: i64) { a + b } FN fn é \n"
    v = [0.0] * 64
    for token in tokens._TOKEN.findall(text):
        h = int.from_bytes(hashlib.blake2b(token.lower().encode(), digest_size=8).digest(), "little")
        v[h % 64] += 1.0 if h >> 63 else -1.0
    length = sum(x * x for x in v) ** 0.5
    assert embedder.hashed([text, ""]) == [[x / length for x in v], [0.0] * 64]


def test_calls_across_files_match_whole_parts(spark):
    symbols = spark.createDataFrame(
        [("s1", "f1", "new", "crate::bar::new"), ("s2", "f2", "new", "crate::foo::mybar::new"), ("s3", "f3", "run", "crate::a::job::run"), ("s4", "f4", "run", "crate::b::job::run")]
        + [(f"t{k}", "f9", "new", f"crate::many::T{k}::new") for k in range(50)],
        "id string, file_id string, name string, qualified_name string",
    )
    calls = spark.createDataFrame(
        [("c1", "f0", "bar::new", "x::y"), ("c2", "f0", "job::run", "x::y"), ("c3", "f0", "b::job::run", "x::y"), ("c4", "f0", "new", "x::y"), ("c5", "f0", "T7::new", "x::y"), ("c6", "f0", "ar::new", "x::y"), ("c7", "f0", "crate::new", "x::y"), ("c8", "f0", None, "x::y")],
        "call_id string, file_id string, callee_text string, caller_name string",
    )
    got = {r.call_id: (r.resolution_status, r.callee_symbol_id) for r in resolve.callees(calls, symbols, across_files=True).collect()}
    assert got == {
        "c1": ("resolved_exact", "s1"),
        "c2": ("ambiguous", None),
        "c3": ("resolved_exact", "s4"),
        "c4": ("unresolved", None),
        "c5": ("resolved_local_candidate", "t7"),
        "c6": ("unresolved", None),
        "c7": ("ambiguous", None),
        "c8": ("unresolved", None),
    }


def test_many_queries_find_the_same_neighbours(spark, monkeypatch):
    rng = random.Random(3)
    vec = lambda n: [rng.uniform(-1, 1) for _ in range(n)]
    points = spark.createDataFrame([(k, vec(4)) for k in range(60)] + [(100, vec(3)), (101, None)], "id int, embedding array<double>")
    queries = spark.createDataFrame([(k, vec(4)) for k in range(9)] + [(9, vec(3))], "query_id int, query_vector array<double>")
    few = vectors.nearest_each(points, queries, 5, "id").orderBy("query_id", "rank").collect()
    monkeypatch.setattr(vectors, "MOST_QUERIES", 3)
    assert vectors.nearest_each(points, queries, 5, "id").orderBy("query_id", "rank").collect() == few
    assert len(few) == 9 * 5 + 1


def test_neighbours_with_copies_and_odd_vectors(spark):
    """Ties by id among many copies; lengths of 0; found without pairs as rows."""
    rng = random.Random(8)
    rows = [(f"p{k}", [rng.uniform(-1, 1) for _ in range(4)]) for k in range(300)] + [(f"c{k}", [1.0, 2.0, 0.5, -1.0]) for k in range(200)] + [("z1", [0.0] * 4), ("z2", [1.0, None, 1.0, 1.0]), ("e", [])]
    asked = [(0, [1.0, 2.0, 0.5, -1.0]), (1, [0.0] * 4), (2, rows[5][1]), (3, [])]
    points, queries = spark.createDataFrame(rows, "id string, embedding array<float>"), spark.createDataFrame(asked, "query_id int, query_vector array<float>")
    found = vectors.nearest_each(points, queries, 7, "id")
    assert "NestedLoop" not in found._jdf.queryExecution().toString()
    plain = points.join(queries, F.size("embedding") == F.size("query_vector")).select("query_id", "id", vec.cosine(F.col("embedding"), F.col("query_vector")).alias("score"))
    plain = plain.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "id"))).where("rank <= 7")
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, plain.collect()))


def test_walks_equal_a_search_in_memory(spark):
    rng = random.Random(11)
    edges = [(f"e{k}", f"n{rng.randrange(9)}", rng.choice([None, *(f"n{j}" for j in range(9))])) for k in range(22)]
    rows = [(c, a, b, "resolved_exact" if b else "unresolved", 0.5, b or "out") for c, a, b in edges]
    table = spark.createDataFrame(rows, "call_id string, caller_symbol_id string, callee_symbol_id string, resolution_status string, confidence double, callee_text string")
    for depth in (1, 2, 4):
        want, open_ = [], [("n0", ["n0"], [])]
        for _ in range(depth):
            after = []
            for node, seen, calls in open_:
                for c, a, b in edges:
                    if a == node and (b is None or b not in seen):
                        want.append((">".join([*calls, c]), b))
                        if b is not None:
                            after.append((b, [*seen, b], [*calls, c]))
            open_ = after
        got = graph.paths_from(table, spark.createDataFrame([("n0",)], "id string"), depth).collect()
        assert sorted((">".join(r.calls), r.node or "") for r in got) == sorted((c, b or "") for c, b in want)
    assert graph.paths_from(table, spark.createDataFrame([("nowhere",)], "id string"), 8).collect() == []


def test_listed_paths_are_those_of_a_walk(spark, tmp_path):
    lines = {"": ["build/", "f1*.rs", "!f11*.rs", "logs", "!logs/keep.rs", "*.ts", "!sub/"], "sub": ["keep/*.rs", "!build/f2.rs"]}
    paths = ["sub/build/f11.rs", "sub/build/f2.rs", "a/f11.rs", "a/f12.rs", "f1.rs", "logs/keep.rs", "sub/keep/x.rs", "sub/keep/y/x.rs", "a/build/b/c.rs", "sub/f.ts", "b.rs", "sub/a.rs", "vendor/a.rs", "x/target.rs"]
    for path in paths:
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).exists() or (tmp_path / path).write_text("")
    for scope, own in lines.items():
        (tmp_path / scope / ".gitignore").write_text("\n".join(own))
    rules = [discovery.parse_ignore(scope, line) for scope, own in lines.items() for line in own]
    table = spark.createDataFrame([(k, r.scope, r.regex, r.negated, r.dir_only) for k, r in enumerate(rules)], "ordinal int, scope string, regex string, negated boolean, dir_only boolean")
    got = discovery.select_paths(spark.createDataFrame([(x,) for x in paths], "path string"), table)
    assert sorted(r.path for r in got.collect()) == list(discovery.walk(str(tmp_path)))
    plain = discovery.select_paths(spark.createDataFrame([("sub/build/f1116.rs",), ("src/f1116.rs",)], "path string"), table.drop("dir_only").where("ordinal < 3"))
    assert [r.path for r in plain.collect()] == ["src/f1116.rs"]


def test_mean_trust_does_not_depend_on_the_tasks(spark):
    rng = random.Random(2)
    rows = [(k, rng.randrange(300), rng.choice([None, *(min(1.0, d / 100 * 10) for d in range(11))])) for k in range(1500)]
    want = {}
    for _, key, score in rows:
        total, n = want.get(key, (0.0, 0))
        want[key] = (total, n) if score is None else (total + score, n + 1)
    want = {key: int(total / n * 100 + 0.5) / 100 if n else 0.41 for key, (total, n) in want.items()}
    table = spark.createDataFrame(rows, "line int, key int, score double")
    for parts in (1, 7):
        got = table.repartition(parts, "line").groupBy("key").agg(trust.aggregate_score(F.col("score"), F.col("line")).alias("trust"))
        assert {r.key: r.trust for r in got.collect()} == want
    assert [r.t for r in table.limit(0).agg(trust.aggregate_score(F.col("score"), F.col("line")).alias("t")).collect()] == [0.41]


def test_call_facts_parse_each_file_once(spark):
    """The plan of the resolution reads written records; it parses nothing again."""
    from codequarry.registry import QUERIES

    plan = QUERIES["rust_call_facts"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "MapInArrow" not in plan and "record_kind" not in plan
