from codequarry.functions import frames, ids, paths, secret_rules, status, tokens, trust
from codequarry.schema import KEYS, TABLES
from pyspark.sql import functions as F
import pytest


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)) if values else spark.range(1)
    return df.select(column.alias("x")).first()["x"]


def test_tokens_and_segments():
    assert tokens._TOKEN.findall("alpha += 42\nβ") == ["alph", "a", " ", "+", "=", " ", "42", "\n", "β"]
    assert tokens.segments("one two\nthree four\nfive six", 6) == ["one two\n", "three four\n", "five six"]
    assert tokens.overlap(6) == 0 and tokens.overlap(100) == 20 and tokens.overlap(10_000) == 64
    text = "word " * 500
    parts = tokens.segments(text, 64)
    assert all(len(tokens._TOKEN.findall(p)) <= 64 for p in parts) and parts[0].startswith("word") and text.endswith(parts[-1])
    assert tokens.segments("", 5) == []


def test_ids(spark):
    assert ids.fnv1a_128(b"") == "6c62272e07bb014262b821756295c58d"
    assert ids.fnv1a_128(b"a") == "d228cb696f1a8caf78912b704e4a8964"
    assert one(spark, ids.vector_point_id(F.col("h")), h="0" * 32) == "00000000-0000-0000-0000-000000000000"
    assert one(spark, ids.vector_point_id(F.col("h")), h="xyz") is None
    assert one(spark, ids.vector_rowid(F.col("h")), h="00000000-0000-0000-0000-000000000000") == 1
    assert one(spark, ids.vector_rowid(F.col("h")), h="ffffffff-ffff-ffff-0000-000000000000") == (1 << 63) - 1
    assert one(spark, ids.fnv128(F.col("t")), t="x") == ids.fnv1a_128(b"content\0x")
    assert one(spark, ids.vector_table_name(F.col("a"), F.col("b")), a="My Repo!", b="nomic-embed:v1") == "vectors_my_repo_nomic_embed_v1"


def test_trust_values(spark):
    p = {"content_hash": "h", "index_run_id": "r", "parser_version": "p", "indexed_at": "t"}
    cases = [("fresh", p, 1.0, 1.0, "high"), ("stale", p | {"parser_version": None, "indexed_at": None}, 0.5, None, None), ("unknown", dict.fromkeys(p), None, 0.41, "low")]
    for label, prov, confidence, score, level in cases:
        df = spark.createDataFrame([(label, *prov.values(), confidence)], "freshness string, content_hash string, index_run_id string, parser_version string, indexed_at string, c double")
        row = trust.with_trust(df, confidence=F.col("c")).first()
        if score is not None:
            assert (row["trust_score"], row["trust_level"]) == (score, level)


def test_paths(spark):
    assert one(spark, paths.normalize_runtime(F.col("p"), "/r/"), p="file:///r/src/a.rs") == "src/a.rs"
    assert one(spark, paths.normalize_runtime(F.col("p"), "/r"), p="/other/a.rs") is None
    assert one(spark, paths.normalize_runtime(F.col("p"), "/r"), p="./src/a.rs") == "src/a.rs"
    assert one(spark, paths.relative_candidates(F.col("t"), F.col("q")), t="super::x", q="crate::a::b::f") == ["super::x", "crate::a::x"]
    assert one(spark, paths.import_path(F.col("t")), t="use sqlx::SqlitePool;") == "sqlx::SqlitePool"
    assert one(spark, paths.import_path(F.col("t")), t='import x from "@a/b/c"') == "@a/b/c"
    assert one(spark, paths.test_name_candidates(F.col("t")), t="a::b::c") == ["a::b::c", "b::c", "c"]
    assert one(spark, paths.error_summary(F.col("t")), t="  a \n b " + "x" * 600) == ("a b " + "x" * 600)[:512]
    assert one(spark, paths.timestamp(F.col("t")).cast("bigint"), t="1700000000") == 1700000000
    assert one(spark, paths.qualified_name("crate", F.col("p"), F.array(F.lit("A")), F.lit("f")), p="src/worker/mod.rs") == "crate::worker::A::f"


def test_vocabulary():
    assert status.clamp(None, 8) == 8 and status.clamp(99, 8) == 25 and status.clamp(0, 8) == 1 and status.clamp(12, 4, 1, 8) == 8
    assert status.parse("freshness", "stale") == "stale"
    with pytest.raises(ValueError):
        status.parse("freshness", "rotten")
    assert set(KEYS) == set(TABLES) and all(set(KEYS[t]) <= set(TABLES[t].fieldNames()) for t in TABLES)


def test_secret_rules(spark):
    assert one(spark, secret_rules.exclusion_reason(F.col("t")), t='let api_key = "abcdefghijklmnopqrstuvwxyz123456"') == "likely_credential_assignment"
    assert one(spark, secret_rules.exclusion_reason(F.col("t")), t='let api_key = "safe-placeholder"') is None
    assert one(spark, secret_rules.exclusion_reason(F.col("t")), t="postgres://me:secret@host/db") == "likely_connection_string"


def test_location_only_lines(spark):
    lines = ["at src/Program.cs:10:5", "web/app.jsx:4:1", "web/util.ts:8:3", "web/component.tsx:12:7"]
    df = spark.createDataFrame([(x,) for x in lines], "t string").select(frames.classify(F.col("t")).alias("c")).select("c.kind", "c.frame.path", "c.frame.line", "c.frame.column")
    assert [tuple(r) for r in df.collect()] == [("location", "src/Program.cs", 10, 5), ("location", "web/app.jsx", 4, 1), ("location", "web/util.ts", 8, 3), ("location", "web/component.tsx", 12, 7)]
