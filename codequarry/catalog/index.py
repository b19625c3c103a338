"""Queries over a small repository given in line: parsing, discovery, debugging."""

from __future__ import annotations

from pyspark.sql import functions as F

from codequarry.catalog.base import Values, query
from codequarry.functions import ids
from codequarry.operators import graph, resolve, search, store, summaries
from codequarry.plans import context, impact as imp
from codequarry.sources import discovery, parser, targets
from codequarry.tables import table

_MAIN = "use crate::worker::Task;\nfn helper() -> u8 { 1 }\nfn caller() { helper(); external::thing(); }\nstruct Job;\nimpl Job {\n    fn run(&self) { helper(); println!(\"x\"); }\n}\n#[test]\nfn covers_helper() { helper(); }\n"
_CS = "using System;\nnamespace Demo {\n class CalculatorTests {\n  [Test]\n  public void AddsNumbers() { Run(); }\n  void Run() { }\n }\n}\n"
_TS = "import { test } from 'vitest';\nexport const helper = (x: number) => x;\nfunction typed(a: Widget) { return helper(a); }\ntest('adds', typed);\n"
_SECRET = "fn key() {\n let api_key = \"abcdefghijklmnopqrstuvwxyz123456\";\n}\nfn safe() { let api_key = \"short\"; }\n"
_SOURCES = Values("path string, language string, content string", [("src/main.rs", "rust", _MAIN), ("tests/Calc.cs", "csharp", _CS), ("web/util.test.ts", "typescript", _TS), ("src/secret.rs", "rust", _SECRET), ("config/app.yaml", "yaml", "a: 1\n"), ("empty.toml", "toml", "")])


def _facts(spark):
    files = _SOURCES.df(spark)
    keyed = files.withColumn("repository_id", F.lit("r")).withColumn("content_hash", F.md5("content")).withColumn("id", ids.stable_id(F.lit("r"), F.col("path"), F.md5("content")))
    return keyed, parser.facts(parser.extract(files), keyed, "run", "1")


@query("""select * from (values ('src/main.rs', 'helper', 'crate::helper', 'function', 2, 2), ('src/main.rs', 'caller', 'crate::caller', 'function', 3, 3), ('src/main.rs', 'run', 'crate::Job::run', 'method', 6, 6), ('src/main.rs', 'covers_helper', 'crate::covers_helper', 'function', 9, 9),
 ('tests/Calc.cs', 'AddsNumbers', 'tests::Calc::Demo::CalculatorTests::AddsNumbers', 'method', 5, 5), ('tests/Calc.cs', 'Run', 'tests::Calc::Demo::CalculatorTests::Run', 'method', 6, 6),
 ('web/util.test.ts', 'helper', 'web::util.test::helper', 'function', 2, 2), ('web/util.test.ts', 'typed', 'web::util.test::typed', 'function', 3, 3), ('src/secret.rs', 'key', 'crate::secret::key', 'function', 1, 3), ('src/secret.rs', 'safe', 'crate::secret::safe', 'function', 4, 4))
 v(path, name, qualified_name, kind, start_line, end_line)""", start_line="bigint", end_line="bigint")
def parsed_symbols(spark, sf):
    return _facts(spark)[1]["symbols"].select("path", "name", "qualified_name", "kind", "start_line", "end_line")


@query("""select * from (values ('crate::caller', 'helper', 3, 'resolved_exact'), ('crate::caller', 'external::thing', 3, 'unresolved'), ('crate::Job::run', 'helper', 6, 'resolved_exact'), ('crate::Job::run', 'println!', 6, 'unresolved'), ('crate::covers_helper', 'helper', 9, 'resolved_exact'),
 ('tests::Calc::Demo::CalculatorTests::AddsNumbers', 'Run', 5, 'resolved_exact'), ('web::util.test::typed', 'helper', 3, 'resolved_exact')) v(caller_name, callee_text, call_line, resolution_status)""", call_line="bigint")
def parsed_calls(spark, sf):
    facts = _facts(spark)[1]
    rows = resolve.callees(facts["calls"].withColumnRenamed("id", "call_id"), facts["symbols"])
    return rows.select("caller_name", "callee_text", "call_line", "resolution_status")


@query("select * from (values ('covers_helper', 'rust_test', true), ('AddsNumbers', 'nunit', true), ('adds', 'vitest', true)) v(name, framework, linked)")
def parsed_tests(spark, sf):
    return _facts(spark)[1]["tests"].select("name", "framework", F.col("symbol_id").isNotNull().alias("linked"))


@query("""select * from (values ('function', null, 6), ('method', null, 3), ('type_definition', null, 1), ('impl_summary', null, 1), ('file_fallback', null, 1), ('function', 'likely_credential_assignment', 1)) v(kind, excluded_reason, n)""", n="bigint")
def parsed_chunks(spark, sf):
    return _facts(spark)[1]["chunks"].groupBy("kind", "excluded_reason").agg(F.count("*").alias("n"))


@query("""select * from (values ('src/main.rs', 'import', 'use crate::worker::Task;'), ('src/main.rs', 'attribute', 'test'), ('src/main.rs', 'implementation', 'Job'), ('tests/Calc.cs', 'import', 'using System;'), ('tests/Calc.cs', 'attribute', 'Test'),
 ('web/util.test.ts', 'import', 'import { test } from ''vitest'''), ('web/util.test.ts', 'type_reference', 'Widget')) v(path, reference_kind, reference_text)""")
def parsed_references(spark, sf):
    files, facts = _facts(spark)
    rows = facts["symbol_references"].join(files.select(F.col("id").alias("file_id"), "path"), "file_id")
    return rows.select("path", "reference_kind", F.when(F.col("path").like("web%"), F.regexp_replace("reference_text", ";$", "")).otherwise(F.col("reference_text")).alias("reference_text"))


_PATHS = Values("path string", [(p,) for p in ("src/a.rs", "src/gen/b.rs", "src/gen/keep.rs", "target/x.rs", "node_modules/p/i.js", "docs/c.json", "config/d.json", "x.txt", "build/e.rs", "sub/build/f.rs", "sub/local.ts", "a/vendor/v.rs")])
_RULES = [(k, r.scope, r.regex, r.negated) for k, r in enumerate(discovery.parse_ignore(s, line) for s, line in (("", "build/"), ("", "/src/gen/*.rs"), ("", "!src/gen/keep.rs"), ("sub", "local.*")))]


@query("select * from (values ('src/a.rs'), ('src/gen/keep.rs'), ('config/d.json')) v(path)")
def discovered_paths(spark, sf):
    rules = spark.createDataFrame(_RULES, "ordinal int, scope string, regex string, negated boolean")
    return discovery.select_paths(_PATHS.df(spark), rules, "config")


_TARGET_JSON = '[{"path": "src/a.rs", "start_line": 1, "end_line": 2, "description": "x"}, {"path": "src\\\\b.rs", "start_line": 5, "end_line": 5, "description": "y"}]'


@query("select * from (values (0, 'src/a.rs', 1, 2, 'x'), (1, 'src/b.rs', 5, 5, 'y')) v(ordinal, path, start_line, end_line, description)", start_line="bigint", end_line="bigint")
def change_targets(spark, sf):
    return targets.read_targets(spark, _TARGET_JSON)


# the callee / fresh / stale / deleted repository -----------------------------------
_F = Values("id string, path string, content_hash string, index_run_id string, parser_version string, indexed_at string", [(f"file-{n}", p, h, "run", "parser", "now") for n, p, h in (("fresh", "src/fresh.rs", "hash-fresh"), ("stale", "src/stale.rs", "hash-old"), ("deleted", "src/deleted.rs", "hash-deleted"), ("callee", "src/callee.rs", "hash-callee"), ("test", "src/fresh_tests.rs", "hash-test"))])
_S = Values("id string, file_id string, name string, qualified_name string, start_line bigint, end_line bigint, index_run_id string, parser_version string", [(f"sym-{n}", f"file-{n}", s.split("::")[-1], s, 1, 3, "run", "parser") for n, s in (("fresh", "crate::fresh"), ("stale", "crate::stale"), ("deleted", "crate::deleted"), ("callee", "crate::callee"), ("test", "crate::tests::covers_callee"))])
_C = Values("id string, caller_symbol_id string, callee_symbol_id string, callee_text string, call_line bigint, confidence double, resolution_status string", [("call-fresh-callee", "sym-fresh", "sym-callee", "callee", 2, 1.0, "resolved_exact"), ("call-test-callee", "sym-test", "sym-callee", "callee", 3, 1.0, "resolved_exact")])
_LIVE = Values("path string, content_hash string", [("src/fresh.rs", "hash-fresh"), ("src/stale.rs", "hash-new")])
_LOG = "0: crate::fresh\n   at /work/repo/src/fresh.rs:2:1\nat /work/repo/src/stale.rs:2:1\nat /work/repo/src/deleted.rs:2:1\nat /work/repo/src/unknown.rs:9:1\nat broken.rs:x\n"


def _graph(spark):
    f, s = _F.df(spark), _S.df(spark)
    return f, s.join(f.select(F.col("id").alias("file_id"), "path"), "file_id"), graph.enriched_edges(_C.df(spark), s, f), _LIVE.df(spark)


@query("""select * from (values (0, 'fresh', 'crate::fresh', 1, 1.0, 'high', true), (1, 'stale', 'crate::stale', 0, 0.84, 'medium', true), (2, 'deleted', 'crate::deleted', 0, 0.74, 'medium', true), (3, 'unknown', null, 0, 0.41, 'low', false))
 v(ordinal, freshness, symbol_name, calls_at_line, trust_score, trust_level, matched)""", ordinal="bigint", calls_at_line="bigint", trust_score="double")
def debug_context(spark, sf):
    logs = spark.createDataFrame([("a", _LOG)], "log_id string, text string")
    return context.debug(logs, "/work/repo", *_graph(spark))["frames"].select("ordinal", "freshness", "symbol_name", "calls_at_line", "trust_score", "trust_level", "matched")


@query("select * from (values ('call-fresh-callee', 'fresh', 1.0, 'high'), ('call-test-callee', 'deleted', 0.74, 'medium')) v(call_id, freshness, trust_score, trust_level)", trust_score="double")
def impact_callers(spark, sf):
    f, s, e, now = _graph(spark)
    return imp.impact(search.exact(s, "callee"), e, now)["callers"].select("call_id", "freshness", "trust_score", "trust_level")


@query("select * from (values ('src/callee.rs', 2), ('src/fresh.rs', 2), ('src/fresh_tests.rs', 2)) v(path, relationship_count)", relationship_count="bigint")
def impact_files(spark, sf):
    f, s, e, now = _graph(spark)
    return imp.impact(search.exact(s, "callee"), e, now)["files"].select("path", "relationship_count")


@query("select * from (values ('crate::callee', 'src/callee.rs')) v(qualified_name, path)")
def explain_change_symbols(spark, sf):
    f, s, e, now = _graph(spark)
    t = targets.read_targets(spark, '[{"path": "src/callee.rs", "start_line": 1, "end_line": 2, "description": "edit"}]')
    return imp.explain_change(t, s, e, now)["symbols"].select("qualified_name", "path")


@query("select * from (values ('a::b::works', 'm::a::b::works'), ('works', 'm::a::b::works'), ('works', 'n::works')) v(test, qualified_name)")
def failing_test_map(spark, sf):
    t = spark.createDataFrame([("m::a::b::works",), ("n::works",)], "qualified_name string")
    return search.map_failing_tests(spark.createDataFrame([("a::b::works",), ("works",), ("gone",)], "test string"), t)


@query("select * from (values ('a', 0, 2), ('b', 1, 1), ('c', 1, 0), ('d', 2, 0), ('e', 0, 0)) v(id, depth, child_count)", child_count="bigint")
def symbol_outline(spark, sf):
    rows = [("a", None), ("b", "a"), ("c", "a"), ("d", "b"), ("e", None)]
    return search.outline(spark.createDataFrame(rows, "id string, parent_symbol_id string"), 4).select("id", "depth", "child_count")


# documents as chunks ------------------------------------------------------------------
def _chunks(spark, sf):
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    chunks = d.select(F.col("doc_id").alias("id"), F.col("source").alias("file_id"), F.when(F.col("toxic") == 1, "toxic").alias("excluded_reason"))
    embedded = d.where("quality is not null").select(F.col("doc_id").alias("chunk_id"), F.when(F.col("quality") == 1, "current").otherwise("stale").alias("status"), F.concat(F.lit("m-"), "lang").alias("embedding_model"), F.lit(64).alias("embedding_dimension"), F.when(F.col("lang") == "en", "fast").otherwise("quality").alias("semantic_layer"))
    return chunks, embedded


_CHUNKS = "d as (select * from documents left join labels using (doc_id))"


@query(f"with {_CHUNKS}, r as (select o_orderpriority as embedding_model, o_custkey as embedding_dimension from orders where o_orderstatus = 'F' order by o_orderdate desc, o_orderkey desc limit 1) select count(*) as chunks, count_if(coalesce(toxic, 0) = 0) as embeddable, count_if(toxic = 1) as excluded, count_if(quality = 1) as vector_backed, count_if(coalesce(toxic, 0) = 0 and coalesce(quality, 0) = 0) as missing, any_value(embedding_model) as embedding_model, any_value(embedding_dimension) as embedding_dimension from d, r", embeddable="bigint", excluded="bigint", vector_backed="bigint", missing="bigint")
def embedding_coverage(spark, sf):
    runs = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "F", "success").alias("status"), F.col("o_orderpriority").alias("embedding_model"), F.col("o_custkey").alias("embedding_dimension"), F.col("o_orderdate").alias("started_at"))
    return summaries.embedding_coverage(*_chunks(spark, sf), runs)


@query(f"""with {_CHUNKS}, c as (select count_if(coalesce(toxic, 0) = 0 and coalesce(quality, 0) = 0) as missing, count_if(toxic = 1) as excluded, count(distinct case when quality is not null then lang end) as models from d)
select 'vector_table' as "check", 'Ok' as status, 'true' as detail union all select 'missing_vectors', case when missing > 0 then 'Error' else 'Ok' end, cast(missing as varchar) from c union all select 'excluded_chunks', case when excluded > 0 then 'Warning' else 'Ok' end, cast(excluded as varchar) from c
union all select 'model_drift', case when models > 1 then 'Warning' else 'Ok' end, cast(models as varchar) from c union all select 'dimension_drift', 'Ok', '1'""")
def cross_store_health(spark, sf):
    return summaries.health(*_chunks(spark, sf), True)


@query(f"""with {_CHUNKS}, e as (select case when lang = 'en' then 'fast' else 'quality' end as semantic_layer, quality from d where quality is not null), w as (select * from (values ('fast', 100), ('quality', 1000000)) v(semantic_layer, expected))
select semantic_layer, expected, count_if(quality = 1) as current, count_if(quality = 0) as stale, count(*) as total, count_if(quality = 1) >= expected as is_complete from w join e using (semantic_layer) group by 1, 2""", expected="bigint", current="bigint", stale="bigint")
def layer_summary(spark, sf):
    want = spark.createDataFrame([("fast", 100), ("quality", 1000000)], "semantic_layer string, expected bigint")
    return summaries.layers(_chunks(spark, sf)[1], want).select("semantic_layer", "expected", "current", "stale", "total", "is_complete")


@query("select string_agg(distinct lang, ',' order by lang) as parser_versions from documents")
def parser_versions(spark, sf):
    return summaries.parser_versions(table(spark, sf, "documents").select(F.col("lang").alias("parser_version")))


@query("select o_custkey as generation_id, arg_max(o_orderpriority, (o_orderdate, o_orderkey)) as error_summary from orders where o_orderstatus = 'F' group by 1")
def latest_errors(spark, sf):
    o = table(spark, sf, "orders")
    return summaries.latest_error(o.select(F.col("o_custkey").alias("generation_id"), F.when(F.col("o_orderstatus") == "F", "failed").alias("status"), F.col("o_orderpriority").alias("error_summary"), F.col("o_orderdate").alias("updated_at"), F.col("o_orderkey").alias("id")))


@query("select doc_id from documents where lang = 'en'")
def unchanged_files(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.col("doc_id").cast("string").alias("path"), F.col("doc_id").alias("id"), F.md5("text").alias("content_hash"), F.col("lang").alias("parser_version"))
    return search.unchanged(d.drop("parser_version"), d, "en").select("doc_id")


@query("select coalesce(a.n_name, b.c) as ref_identity, b.c is not null as is_current, b.c is null as gone from nation a full join (select distinct 'main' as c union all select n_name from nation where n_regionkey < 3) b on a.n_name = b.c")
def ref_sync(spark, sf):
    n = table(spark, sf, "nation")
    base = [F.lit("r").alias("repository_id"), F.lit("branch").alias("ref_kind")]
    stored = n.select(*base, F.col("n_name").alias("ref_identity"), F.lit("0").alias("head_oid"), F.lit(False).alias("is_current"), F.lit(None).cast("timestamp").alias("deleted_at"), F.lit(None).cast("timestamp").alias("last_seen_at"))
    found = n.where("n_regionkey < 3").select(*base, F.col("n_name").alias("ref_identity"), F.lit("1").alias("head_oid"), F.lit(True).alias("is_current"))
    found = found.union(spark.createDataFrame([("r", "branch", "main", "1", True)], found.schema))
    return store.sync_refs(stored, found, F.current_timestamp()).select("ref_identity", "is_current", F.col("deleted_at").isNotNull().alias("gone"))


@query("select (select count(distinct source) from documents) as eligible_files, count(*) as eligible_symbols, (select count(*) from documents where lang in ('en', 'fr')) as eligible_calls from documents")
def enrichment_plan(spark, sf):
    d = table(spark, sf, "documents")
    fs = d.select(F.col("source").alias("id"), F.lit("rust").alias("language")).distinct()
    calls = d.select(F.col("doc_id").alias("caller_symbol_id"), F.when(F.col("lang") == "en", "unresolved").when(F.col("lang") == "fr", "ambiguous").otherwise("resolved_exact").alias("resolution_status"))
    return summaries.enrichment_plan(fs, d.select(F.col("doc_id").alias("id"), F.col("source").alias("file_id")), calls)
