"""Queries whose sources, stores and streams are made from the driver's tables.

Each part, supplier and nation gives a source file by a template; what the
parser must find in it is a template, too, filled in by the oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from codequarry.catalog.base import EDGES_SQL, edges, literal, query
from codequarry.catalog.evidence import LEVEL_SQL, TRUST_SQL, WEIGHT_SQL
from codequarry.functions import ids, reasons, status, trust
from codequarry.functions import vectors as vec
from codequarry.operators import freshness as fresh, graph, resolve, search, store as st, summaries, vectors
from codequarry.plans import api, impact, semantic
from codequarry.scratch import Scratch
from codequarry.sources import discovery, parser
from codequarry.streaming import jobs, snapshots
from codequarry.tables import table

# source files from rows --------------------------------------------------------------
_RUST = 'use crate::store::Row as R;\npub struct Part{k};\nimpl Part{k} {\n    pub fn brand(&self) -> {b} { size_3(1); R::load(); }\n}\nfn plain_{k}(x: Kind) {\n    println!("x", x);\n    brand();\n}\n#[test]\nfn covers_{k}() { plain_{k}(); }\n'
_SHARP = "using System.Text;\nnamespace Shop.S{k} {\n class Order{k} : BaseOrder {\n  [Fact]\n  public void Adds{k}() { Load(7); }\n  int Load(int a) { return Parse(a); }\n }\n}\n"
_TYPED = "import { test } from 'vitest';\nexport class C{k} extends Base {\n  run(a: Widget) { return load{k}(a); }\n  over = (b: Widget) => load{k}(b);\n}\nconst load{k} = (x: number) => x;\nfunction go{k}() { load{k}(1); }\ntest('adds {k}', go{k});\n"
#: Files of a language: table, key, path, template and the word {b}.
_MADE = {
    "rust": ("part", "p_partkey", "src/p{k}.rs", _RUST, "replace(p_brand, '#', '')"),
    "csharp": ("supplier", "s_suppkey", "src/S{k}.cs", _SHARP, "''"),
    "typescript": ("customer", "c_custkey", "web/c{k}.test.ts", _TYPED, "''"),
}


def _sources(spark, sf, language: str, parts: int | None = None) -> DataFrame:
    """The files of a language; their rows are dealt out to ``parts`` tasks first."""
    name, key, path, text, word = _MADE[language]
    fill = lambda t: F.replace(F.replace(F.lit(t), F.lit("{k}"), F.col("k")), F.lit("{b}"), F.col("b"))
    rows = table(spark, sf, name).select(F.col(key).cast("string").alias("k"), F.expr(word).alias("b"))
    rows = rows if parts is None else rows.repartition(parts, "k")
    return rows.select(fill(path).alias("path"), F.lit(language).alias("language"), fill(text).alias("content"))


def _expected(language: str, columns: str, rows: list[tuple]) -> str:
    """SQL: the rows, filled in for every file of the language."""
    name, key, path, _, word = _MADE[language]
    names = columns.split()
    fill = ", ".join(f"replace(replace(v.{c}, '{{k}}', cast({key} as varchar)), '{{b}}', {word}) as {c}" if any(isinstance(r[i], str) for r in rows) else f"v.{c}::bigint as {c}" for i, c in enumerate(names))
    cells = ", ".join("(" + ", ".join(literal(x) for x in r) + ")" for r in rows)
    return f"select replace('{path}', '{{k}}', cast({key} as varchar)) as path, {fill} from {name}, (values {cells}) v({', '.join(names)})"


def _found(spark, sf, language: str, kind: str, *columns: str) -> DataFrame:
    return parser.extract(_sources(spark, sf, language)).where(F.col("record_kind") == kind).select("path", *columns)


_SYMBOL = "kind name qualified_name signature start_line end_line"


@query(_expected("rust", _SYMBOL, [("method", "brand", "crate::p{k}::Part{k}::brand", "pub fn brand(&self) -> {b}", 4, 4), ("function", "plain_{k}", "crate::p{k}::plain_{k}", "fn plain_{k}(x: Kind)", 6, 9), ("function", "covers_{k}", "crate::p{k}::covers_{k}", "fn covers_{k}()", 11, 11)]))
def rust_symbols(spark, sf):
    return _found(spark, sf, "rust", "symbol", *_SYMBOL.split())


@query(_expected("csharp", _SYMBOL, [("method", "Adds{k}", "S{k}::Shop::S{k}::Order{k}::Adds{k}", "public void Adds{k}()", 5, 5), ("method", "Load", "S{k}::Shop::S{k}::Order{k}::Load", "int Load(int a)", 6, 6)]))
def csharp_symbols(spark, sf):
    return _found(spark, sf, "csharp", "symbol", *_SYMBOL.split())


@query(_expected("typescript", _SYMBOL, [("method", "run", "web::c{k}.test::C{k}::run", "run(a: Widget)", 3, 3), ("method", "over", "web::c{k}.test::C{k}::over", "over = (b: Widget) =>", 4, 4), ("function", "load{k}", "web::c{k}.test::load{k}", "const load{k} = (x: number) =>", 6, 6), ("function", "go{k}", "web::c{k}.test::go{k}", "function go{k}()", 7, 7)]))
def typescript_symbols(spark, sf):
    return _found(spark, sf, "typescript", "symbol", *_SYMBOL.split())


@query(_expected("rust", "kind owner text start_line end_line", [
    ("type_definition", None, "pub struct Part{k};", 2, 2), ("impl_summary", None, "impl Part{k} {\n    pub fn brand(&self) -> {b} { size_3(1); R::load(); }\n}", 3, 5), ("method", "crate::p{k}::Part{k}::brand", "pub fn brand(&self) -> {b} { size_3(1); R::load(); }", 4, 4),
    ("function", "crate::p{k}::plain_{k}", 'fn plain_{k}(x: Kind) {\n    println!("x", x);\n    brand();\n}', 6, 9), ("function", "crate::p{k}::covers_{k}", "fn covers_{k}() { plain_{k}(); }", 11, 11),
]))
def rust_chunks(spark, sf):
    return _found(spark, sf, "rust", "chunk", "kind", "owner", "text", "start_line", "end_line")


@query(_expected("rust", "owner text start_line", [("crate::p{k}::Part{k}::brand", "size_3", 4), ("crate::p{k}::Part{k}::brand", "crate::store::Row::load", 4), ("crate::p{k}::plain_{k}", "println!", 7), ("crate::p{k}::plain_{k}", "brand", 8), ("crate::p{k}::covers_{k}", "plain_{k}", 11)]))
def rust_calls(spark, sf):
    return _found(spark, sf, "rust", "call", "owner", "text", "start_line")


@query(_expected("rust", "kind text start_line confidence", [("import", "use crate::store::Row as R;", 1, "0.4"), ("attribute", "test", 10, "0.3"), ("implementation", "Part{k}", 3, "0.5"), ("type_reference", "{b}", 4, "0.45"), ("type_reference", "Kind", 6, "0.45")]))
def rust_references(spark, sf):
    return _found(spark, sf, "rust", "reference", "kind", "text", "start_line", F.col("confidence").cast("string").alias("confidence"))


@query(_expected("csharp", "kind text start_line", [("import", "using System.Text;", 1), ("attribute", "Fact", 4), ("inheritance", "BaseOrder", 3), ("type_reference", "BaseOrder", 3)]))
def csharp_references(spark, sf):
    return _found(spark, sf, "csharp", "reference", "kind", "text", "start_line")


@query(_expected("typescript", "kind text start_line", [("import", "import { test } from 'vitest'", 1), ("inheritance", "Base", 2), ("type_reference", "Widget", 3), ("type_reference", "Widget", 4)]))
def typescript_references(spark, sf):
    rows = _found(spark, sf, "typescript", "reference", "kind", "text", "start_line")
    return rows.withColumn("text", F.regexp_replace("text", ";$", ""))


_TEST = "name qualified_name owner framework start_line"


@query(" union all ".join([_expected("rust", _TEST, [("covers_{k}", "crate::p{k}::covers_{k}", "crate::p{k}::covers_{k}", "rust_test", 11)]), _expected("csharp", _TEST, [("Adds{k}", "S{k}::Shop::S{k}::Order{k}::Adds{k}", "S{k}::Shop::S{k}::Order{k}::Adds{k}", "xunit", 5)]), _expected("typescript", _TEST, [("adds {k}", "adds {k}", "web::c{k}.test::go{k}", "vitest", 8)])]))
def tests_found(spark, sf):
    parts = [_found(spark, sf, x, "test", *_TEST.split()) for x in _MADE]
    return parts[0].union(parts[1]).union(parts[2])


@query("select 'src/s' || s_suppkey || '.rs' as path, 'error' as kind, 'unbalanced braces' as text from supplier where s_suppkey % 3 = 0 union all " + _expected("rust", "kind text", [("macro", "println!")]))
def parse_diagnostics(spark, sf):
    key = F.col("s_suppkey").cast("string")
    torn = table(spark, sf, "supplier").select(F.concat(F.lit("src/s"), key, F.lit(".rs")).alias("path"), F.lit("rust").alias("language"), F.when(F.col("s_suppkey") % 3 == 0, "fn a() {").otherwise("fn a() {}").alias("content"))
    return parser.extract(torn.union(_sources(spark, sf, "rust"))).where("record_kind = 'diagnostic'").select("path", "kind", "text")


@query(r"""select doc_id, 'file_fallback' as kind, md5(text) as text_hash, 1::bigint as start_line, (len(text) - len(replace(text, chr(10), '')) - ends_with(text, chr(10))::int + 1)::bigint as end_line, octet_length(encode(text))::bigint as end_byte
from documents where regexp_matches(coalesce(text, ''), '\S')""")
def config_chunks(spark, sf):
    files = table(spark, sf, "documents").select(F.concat(F.lit("conf/"), F.col("doc_id").cast("string"), F.lit(".yaml")).alias("path"), F.lit("yaml").alias("language"), F.col("text").alias("content"))
    rows = parser.extract(files).where("record_kind = 'chunk'")
    return rows.select(F.regexp_extract("path", r"(\d+)", 1).cast("bigint").alias("doc_id"), "kind", F.md5("text").alias("text_hash"), "start_line", "end_line", "end_byte")


@query("with r as (" + _expected("rust", "caller callee_text callee", [("crate::p{k}::Part{k}::brand", "size_3", None), ("crate::p{k}::Part{k}::brand", "crate::store::Row::load", None), ("crate::p{k}::plain_{k}", "println!", None), ("crate::p{k}::plain_{k}", "brand", "crate::p{k}::Part{k}::brand"), ("crate::p{k}::covers_{k}", "plain_{k}", "crate::p{k}::plain_{k}")]) + """)
select path, caller, callee_text, callee, case when callee is null then 'unresolved' when callee_text = 'brand' then 'resolved_local_candidate' else 'resolved_exact' end as resolution_status,
  case when callee_text = 'println!' then 0.2 when callee is null then 0.25 when callee_text = 'brand' then 0.75 else 1.0 end::double as confidence from r""")
def rust_call_facts(spark, sf):
    """Records to fact tables with ids, and calls resolved inside their files.

    Each file is parsed once, by as many tasks as shuffles have; what the joins
    read again is written first, so they know its size (a table of parts is
    small, the records of its files are not) and broadcast nothing large.
    """
    scratch = Scratch(spark, "rust-calls")
    sources = _sources(spark, sf, "rust", int(spark.conf.get("spark.sql.shuffle.partitions")))
    files = scratch.save(discovery.file_facts(sources, "r"), "files")
    facts = parser.facts(scratch.save(parser.extract(sources).where(F.col("record_kind").isin("symbol", "call")), "records"), files, "run", "1")
    facts = {kind: scratch.save(facts[kind], kind) for kind in ("symbols", "calls")}
    calls = resolve.callees(facts["calls"].withColumnRenamed("id", "call_id"), facts["symbols"])
    named = facts["symbols"].select(F.col("id").alias("callee_symbol_id"), F.col("qualified_name").alias("callee"))
    rows = calls.join(named, "callee_symbol_id", "left").join(files.select(F.col("id").alias("file_id"), "path"), "file_id")
    return rows.select("path", F.col("caller_name").alias("caller"), "callee_text", "callee", "resolution_status", "confidence")


# trees -------------------------------------------------------------------------------
_EXT = ("rs", "cs", "ts", "json", "yaml", "toml", "txt", "mjs", "json")
_DIR = ("src", "vendor/a", "target", "config", "docs", "node_modules/x/y", "sub/build", "lib", "sub/keep", ".git/a")
_PATH = f"list_extract({list(_DIR)}, (doc_id % {len(_DIR)} + 1)::int) || '/f' || doc_id || '.' || list_extract({list(_EXT)}, (doc_id % {len(_EXT)} + 1)::int)"
_IGNORE = [(k, r.scope, r.regex, r.negated) for k, r in enumerate(discovery.parse_ignore(s, line) for s, line in (("", "build/"), ("sub", "keep/*.ts"), ("", "f1*.rs"), ("", "!f11*.rs")))]


def _tree(spark, sf) -> DataFrame:
    pick = lambda names: F.element_at(F.array(*[F.lit(x) for x in names]), (F.col("doc_id") % len(names) + 1).cast("int"))
    return table(spark, sf, "documents").select("doc_id", F.concat(pick(_DIR), F.lit("/f"), F.col("doc_id").cast("string"), F.lit("."), pick(_EXT)).alias("path"))


@query(f"""with t as (select doc_id, {_PATH} as path from documents) select doc_id, path from t where not regexp_matches(path, '(^|/)(vendor|target|node_modules|\\.git)/') and not contains(path, 'build/') and not regexp_matches(path, '^sub/keep/[^/]*\\.ts$')
and not (regexp_matches(path, '(^|/)f1[^/]*\\.rs$') and not regexp_matches(path, '(^|/)f11[^/]*\\.rs$')) and not ends_with(path, '.txt') and (not ends_with(path, '.json') or starts_with(path, 'config/'))""")
def tree_selection(spark, sf):
    rules = spark.createDataFrame(_IGNORE, "ordinal int, scope string, regex string, negated boolean")
    return discovery.select_paths(_tree(spark, sf), rules, "config")


@query(f"with t as (select {_PATH} as path from documents), l as (select path, case regexp_extract(path, '\\.([a-z]+)$', 1) when 'rs' then 'rust' when 'cs' then 'csharp' when 'ts' then 'typescript' when 'json' then 'json' when 'yaml' then 'yaml' when 'toml' then 'toml' when 'mjs' then 'javascript' end as language from t) select path, language, language = 'rust' as is_rust from l where language is not null")
def path_languages(spark, sf):
    rows = _tree(spark, sf).select("path", status.language(F.col("path")).alias("language")).where("language is not null")
    rust = discovery.of_language(rows, "rust").select("path", F.lit(True).alias("is_rust"))
    return rows.join(rust, "path", "left").select("path", status.known("language", F.col("language")).alias("language"), F.coalesce("is_rust", F.lit(False)).alias("is_rust"))


@query("select source as repository_id, 'd' || doc_id || '.rs' as path, md5(coalesce(text, '')) as content_hash, md5(concat_ws(chr(0), 'r', 'd' || doc_id || '.rs', md5(coalesce(text, '')))) as id from documents")
def file_table(spark, sf):
    d = table(spark, sf, "documents")
    files = d.select("source", F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.lit(".rs")).alias("path"), F.lit("rust").alias("language"), F.coalesce("text", F.lit("")).alias("content"))
    facts = discovery.file_facts(files, "r")
    return facts.join(files.select("source", "path"), "path").select(F.col("source").alias("repository_id"), "path", "content_hash", "id")


# the call graph as a store -------------------------------------------------------------
_NODES = f"e as materialized ({EDGES_SQL}), n as (select caller_symbol_id as id from e union select callee_symbol_id from e where callee_symbol_id is not null), f as (select distinct string_split(id, ' ')[1] as path from n), l as (select path, case when path = 'size' then 'new' else md5(path) end as h from f where not ends_with(path, '1'))"
_STORES: dict[tuple[str, str], st.Store] = {}


def _engine(spark, sf) -> api.Engine:
    """An engine over a store of the parts' graph; written once a session."""
    key = (spark.sparkContext.applicationId, sf)
    e = edges(spark, sf)
    file_of = lambda c: F.element_at(F.split(c, " "), 1)
    node = e.select(F.col("caller_symbol_id").alias("id")).union(e.where("callee_symbol_id is not null").select("callee_symbol_id")).distinct()
    files = node.select(file_of("id").alias("path")).distinct()
    if key not in _STORES:
        store = st.Store(spark, f"{Scratch(spark, 'graph').root}/store", buckets=4)
        now = F.timestamp_seconds(F.lit(0))
        store.replace("files", files.select(F.col("path").alias("id"), F.lit("r").alias("repository_id"), "path", F.lit("rust").alias("language"), F.md5("path").alias("content_hash"), now.alias("indexed_at"), F.lit("run").alias("index_run_id"), F.lit("p").alias("parser_version")))
        places = {c: F.lit(v).cast("bigint") for c, v in (("start_line", 1), ("end_line", 3), ("start_byte", 0), ("end_byte", 9))}
        store.replace("symbols", node.select("id", file_of("id").alias("file_id"), F.col("id").alias("name"), F.concat(F.lit("crate::"), "id").alias("qualified_name"), F.lit("function").alias("kind")).withColumns(places))
        store.replace("calls", e.select(F.col("call_id").alias("id"), "caller_symbol_id", "callee_text", "callee_symbol_id", F.lit(1).cast("bigint").alias("call_line"), "confidence", "resolution_status"))
        _STORES[key] = store
    live = files.where(~F.col("path").endswith("1")).select("path", F.when(F.col("path") == "size", "new").otherwise(F.md5("path")).alias("content_hash"))
    return api.Engine(spark, _STORES[key], None, "r", live=live)


def _evidence_sql(where: str, side: str) -> str:
    return f"""with {_NODES}, r as (select e.*, string_split({side}, ' ')[1] as path from e where {where}),
    x as (select r.*, case when r.path is null or not exists (select 1 from l where l.path = r.path) then 'deleted' when (select h from l where l.path = r.path) = md5(string_split(caller_symbol_id, ' ')[1]) then 'fresh' else 'stale' end as freshness,
      md5(string_split(caller_symbol_id, ' ')[1]) as content_hash, 'run' as index_run_id, 'p' as parser_version, 'now' as indexed_at from r),
    s as (select *, {WEIGHT_SQL} as weight from x), t as (select *, {TRUST_SQL} as trust_score from s)
    select caller_symbol_id, callee_text, confidence, freshness, trust_score, {LEVEL_SQL} as trust_level from t"""


_SHOWN = ("caller_symbol_id", "callee_text", "confidence", "freshness", "trust_score", "trust_level")


@query(_evidence_sql("callee_symbol_id = 'Brand#2'", "caller_symbol_id"))
def engine_callers(spark, sf):
    return _engine(spark, sf).callers("Brand#2").select(*_SHOWN)


@query(_evidence_sql("caller_symbol_id = 'size 7'", "callee_symbol_id"))
def engine_callees(spark, sf):
    return api.call(_engine(spark, sf), "callees", symbol="crate::size 7").select(*_SHOWN)


@query(f"with {_NODES} select coalesce(f.path, l.path) as path, case when l.path is null then 'deleted' when l.h = md5(f.path) then 'fresh' else 'stale' end as freshness from f full join l using (path)")
def engine_staleness(spark, sf):
    return _engine(spark, sf).staleness().select("path", "freshness")


@query(f"with {_NODES} select 'crate::' || id as qualified_name, case when id = 'size 1' then 1 when ends_with(id, 'size 1') then 2 else 3 end as match_rank, case when id = 'size 1' then 'symbol_id_exact,name_exact,qualified_name_suffix,sqlite_like' else 'sqlite_like' end as reasons from n where contains(id, 'size 1') order by match_rank, qualified_name, id limit 25")
def engine_find_symbol(spark, sf):
    return _engine(spark, sf).find_symbol("size 1").select("qualified_name", "match_rank", F.array_join("reasons", ",").alias("reasons"))


@query(f"""with {_NODES}, s as (select id, string_split(id, ' ')[1] as path from n where id = 'Brand#2' or contains('crate::' || id, 'Brand#2') order by case when id = 'Brand#2' then 1 when ends_with(id, 'Brand#2') then 2 else 3 end, id limit 5),
i as (select 'symbol' as kind, id as item, path from s),
c as (select 'caller' as kind, caller_symbol_id as item, string_split(caller_symbol_id, ' ')[1] as path from e where callee_symbol_id = 'Brand#2' order by caller_symbol_id limit 5),
d as (select 'callee' as kind, callee_text as item, string_split(callee_symbol_id, ' ')[1] as path from e where caller_symbol_id = 'Brand#2' order by callee_text limit 5),
u as (select * from i union all select * from c union all select * from d) select kind, item, path from u union all select distinct 'file', path, path from u where path is not null""")
def engine_context_pack(spark, sf):
    from codequarry.plans import context

    engine = _engine(spark, sf)
    e = engine.edges()
    parts = context.pack(search.symbols(engine.symbols(), "Brand#2", 5), graph.callers(e, "Brand#2"), graph.callees(e, "Brand#2"), 5)
    rows = parts["symbols"].select(F.lit("symbol").alias("kind"), F.col("id").alias("item"), "path").union(parts["callers"].select(F.lit("caller"), "caller_symbol_id", "caller_path"))
    return rows.union(parts["callees"].select(F.lit("callee"), "callee_text", "callee_path")).union(parts["files"].select(F.lit("file"), "path", "path"))


@query(f"with {_NODES} select 'files' as \"table\", (select count(*) from f) as rows union all select 'symbols', (select count(*) from n) union all select 'calls', (select count(*) from e) union all select x, 0 from (values ('chunks'), ('symbol_references'), ('dependencies'), ('tests')) v(x)")
def engine_index_status(spark, sf):
    return _engine(spark, sf).index_status()


@query(f"with {_NODES} select min(h) as hops from (select 1 as h from e where caller_symbol_id = 'Brand#2' and callee_symbol_id is not null) having count(*) > 0")
def engine_call_path(spark, sf):
    engine = _engine(spark, sf)
    first = graph.callees(engine.edges(), "Brand#2").where("callee_symbol_id is not null").orderBy("callee_text").limit(1).select("callee_symbol_id").first()[0]
    return engine.call_path("Brand#2", first, 2).agg(F.min("hops").alias("hops"))


@query(f"with {_NODES} select caller_symbol_id, callee_text, callee_symbol_id, string_split(caller_symbol_id, ' ')[1] as caller_path, string_split(callee_symbol_id, ' ')[1] as callee_path, md5(string_split(caller_symbol_id, ' ')[1]) as content_hash from e")
def enriched_call_edges(spark, sf):
    return _engine(spark, sf).edges().select("caller_symbol_id", "callee_text", "callee_symbol_id", "caller_path", "callee_path", "content_hash")


@query(f"with {_NODES} select 'at' as what, 'crate::' || id as name from n where string_split(id, ' ')[1] = 'Brand#2' union all select 'call', caller_symbol_id || '->' || callee_text from e where string_split(caller_symbol_id, ' ')[1] = 'Brand#2' union all select 'file', path from f where path = 'Brand#2'")
def location_lookups(spark, sf):
    engine = _engine(spark, sf)
    at = search.at_location(engine.symbols(), "Brand#2", 2).select(F.lit("at").alias("what"), F.col("qualified_name").alias("name"))
    calls = search.calls_at(engine.edges(), "Brand#2", 1).select(F.lit("call"), "call_id")
    return at.union(calls).union(search.provenance(engine.table("files"), "Brand#2").select(F.lit("file"), "path"))


@query(f"with {_NODES} select 'table:' || t as label, case when t in ('files', 'symbols', 'calls') then 'Ok' else 'Warning' end as state from (values {', '.join(f'({literal(t)})' for t in st.TABLES)}) v(t) union all select 'provenance', 'Warning' union all select 'last_run', 'Warning' union all select 'engine', 'Ok' union all select 'freshness', case when exists (select 1 from f left join l using (path) where h is null or h <> md5(path)) then 'Warning' else 'Ok' end")
def engine_doctor(spark, sf):
    from codequarry.plans import doctor

    engine = _engine(spark, sf)
    return doctor.diagnose(spark, engine.store, engine.staleness()).select("label", "state")


@query(f"""with {_NODES}, s as (select *, 'size' as path, 'stale' as freshness from e where caller_symbol_id = 'size 7' or callee_symbol_id = 'Brand#2') select count(*) as edges, count(distinct caller_symbol_id) as callers, round(min(confidence), 4) as least from s""")
def graph_set_operations(spark, sf):
    """Edges out of one node and into another: union, without repeats."""
    e = _engine(spark, sf).edges()
    both = graph.callees(e, "size 7").unionByName(graph.callers(e, "Brand#2")).dropDuplicates(["call_id"])
    return both.agg(F.count("*").alias("edges"), F.count_distinct("caller_symbol_id").alias("callers"), F.round(F.min("confidence"), 4).alias("least"))


# writes ----------------------------------------------------------------------------------
@query("""with o as (select o_custkey, count(*) as n from orders group by 1) select c_custkey::varchar as id, case when n is not null then 'h2' else 'h1' end as content_hash from customer left join o on o_custkey = c_custkey where c_custkey % 7 <> 0
union all select 'x' || n_nationkey, 'h3' from nation""")
def store_writes(spark, sf):
    """Create, replace, change and append on a bucketed table, then read it."""
    store = st.Store(spark, f"{Scratch(spark, 'writes').root}/store", buckets=4)
    store.create("files")
    rest = {c: F.lit("x") for c in ("repository_id", "path", "language")}
    c = table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("id"), F.lit("h1").alias("content_hash")).withColumns(rest)
    store.replace("files", c)
    new = table(spark, sf, "orders").select(F.col("o_custkey").cast("string").alias("id"), F.lit("h2").alias("content_hash")).distinct().withColumns(rest)
    store.change("files", new=new.join(c.select("id"), "id", "left_semi").where("cast(id as bigint) % 7 <> 0"), gone=c.where("cast(id as bigint) % 7 = 0").select("id"))
    store.append("files", table(spark, sf, "nation").select(F.concat(F.lit("x"), F.col("n_nationkey").cast("string")).alias("id"), F.lit("h3").alias("content_hash")).withColumns(rest))
    if not store.exists("files") or store.exists("symbols"):
        raise ValueError("a table is there that is not, or the other way round")
    return store.read("files").select("id", "content_hash")


@query("""select vec_id as vector_rowid, 'p' || (vec_id % 40) as vector_point_id from (select max(vec_id) as vec_id from embeddings group by vec_id % 40) where vec_id % 40 <> 3""")
def point_writes(spark, sf):
    """Upsert vectors twice, delete by id, scroll without vectors."""
    store = st.Store(spark, f"{Scratch(spark, 'points').root}/store", buckets=4)
    e = table(spark, sf, "embeddings")
    text = {c: F.lit("x") for c in ("vector_store", "vector_table", "repository_id", "file_id", "chunk_id", "path", "language", "chunk_kind", "content_hash", "text_hash", "embedding_model", "semantic_layer")}
    last = e.groupBy((F.col("vec_id") % 40).alias("k")).agg(F.max("vec_id").alias("m"))
    rows = e.join(last, (F.col("vec_id") % 40) == F.col("k")).select(F.concat(F.lit("p"), F.col("k").cast("string")).alias("vector_point_id"), F.col("vec_id").alias("vector_rowid"), "embedding", F.size("embedding").cast("bigint").alias("embedding_dimension"), "m").withColumns(text).withColumns({c: F.lit(1).cast("bigint") for c in ("start_line", "end_line")})
    store.upsert_points(rows.where("vector_rowid < m").orderBy("vector_rowid").drop("m"))
    store.upsert_points(rows.where("vector_rowid = m").drop("m"))
    store.delete("vector_points", spark.createDataFrame([("p3",)], "vector_point_id string"))
    return vectors.scroll(store.read("vector_points"), "x").select("vector_rowid", "vector_point_id")


@query("select 'run-' || n_nationkey as id, case when n_regionkey = 0 then 'failed' else 'success' end as status, case when n_regionkey = 0 then 'error ' || n_name end as error_summary, n_nationkey::bigint as files_seen from nation")
def run_records(spark, sf):
    rows = [(r["n_nationkey"], r["n_name"], r["n_regionkey"]) for r in table(spark, sf, "nation").collect()]
    store = st.Store(spark, f"{Scratch(spark, 'runs').root}/store", buckets=2)
    runs = [st.started_run(spark, f"run-{k}", "r", "offline", "1") for k, _, _ in rows]
    ended = [st.finished_run(run, "failed" if region == 0 else "success", f"error {name}" if region == 0 else None, files_seen=k) for run, (k, name, region) in zip(runs, rows, strict=True)]
    union = lambda parts: parts[0] if len(parts) == 1 else union([a.unionByName(b) for a, b in zip(parts[::2], parts[1::2])] + parts[len(parts) // 2 * 2 :])
    store.upsert("index_runs", union(runs))
    store.upsert("index_runs", union(ended))
    return store.read("index_runs").select("id", "status", "error_summary", "files_seen")


@query("""select 'ref-' || (c_nationkey % 3) as repository_ref_id, c_name as path, c_custkey::varchar as file_id from customer where c_nationkey % 3 <> 1 or c_custkey % 2 = 0""")
def ref_file_links(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("id"), F.lit("r").alias("repository_id"), F.col("c_name").alias("path"), (F.col("c_nationkey") % 3).alias("g"), "c_custkey")
    links = [st.link_files(f"ref-{g}", c.where(F.col("g") == g), "run") for g in range(3)]
    rows = links[0].unionByName(links[1]).unionByName(links[2])
    return st.remove_missing_ref_files(rows, "ref-1", c.where("c_custkey % 2 = 0").select("path")).select("repository_ref_id", "path", "file_id")


# queues and streams ------------------------------------------------------------------------
@query("""select d.doc_id::varchar as chunk_id, case when l.toxic = 1 then 'skipped_stale' when l.quality = 0 then 'skipped_excluded' else 'succeeded' end as status, 1::bigint as attempts, coalesce(l.toxic, 0) = 0 and coalesce(l.quality, 1) = 1 as has_vector from documents d left join labels l using (doc_id)""")
def quality_batches(spark, sf):
    """The queue worked off in batches; stale and textless jobs give no vector."""
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left").select(F.col("doc_id").cast("string").alias("chunk_id"), "source", "toxic", "quality", F.md5("text").alias("text_hash"), F.length("text").cast("string").alias("size"))
    store = st.Store(spark, f"{Scratch(spark, 'queue').root}/store", buckets=4)
    now, one = F.timestamp_seconds(F.lit(0)), F.lit(1).cast("bigint")
    store.replace("files", d.select(F.col("source").alias("id")).distinct().select("id", F.lit("r").alias("repository_id"), F.col("id").alias("path"), F.lit("rust").alias("language"), F.lit("h").alias("content_hash")))
    store.replace("chunks", d.select(F.col("chunk_id").alias("id"), F.col("source").alias("file_id"), F.lit("function").alias("kind"), "text_hash", *[one.alias(c) for c in ("start_line", "end_line", "start_byte", "end_byte")]))
    queue = d.select(F.concat(F.lit("j"), "chunk_id").alias("id"), F.lit("r").alias("repository_id"), F.lit("g").alias("generation_id"), "chunk_id", F.col("source").alias("file_id"), F.col("source").alias("path"), F.lit("h").alias("content_hash"), F.when(F.col("toxic") == 1, "old").otherwise(F.col("text_hash")).alias("text_hash"), F.lit("pending").alias("status"), F.lit(0).cast("bigint").alias("attempts"), now.alias("created_at"), now.alias("updated_at"))
    store.replace("quality_embedding_jobs", queue)
    texts = d.where("coalesce(quality, 1) = 1").select("chunk_id", F.col("size").alias("text"))
    total = queue.count()
    jobs.run_all(store, "g", texts, max(1, -(-total // 3)), embed=lambda texts: [[float(t or 0), 1.0] for t in texts])
    have = store.read("vector_points").select("chunk_id", F.lit(True).alias("has_vector"))
    return store.read("quality_embedding_jobs").join(have, "chunk_id", "left").select("chunk_id", "status", "attempts", F.coalesce("has_vector", F.lit(False)).alias("has_vector"))


_POLL = "select doc_id::varchar as path, case when doc_id % 5 = {0} then 'h{0}' else 'h' end as hash from documents where doc_id % 11 <> {0}"


@query(f"""with p0 as ({_POLL.format(0)}), p2 as ({_POLL.format(2)}), p3 as ({_POLL.format(3)}),
a as (select 0 as batch, path, 'created' as change from p0), c as (select 2 as batch, coalesce(x.path, y.path) as path, case when x.path is null then 'created' when y.path is null then 'deleted' when x.hash <> y.hash then 'modified' end as change from p0 x full join p2 y on x.path = y.path),
d as (select 3 as batch, coalesce(x.path, y.path) as path, case when x.path is null then 'created' when y.path is null then 'deleted' when x.hash <> y.hash then 'modified' end as change from p2 x full join p3 y on x.path = y.path)
select batch, path, change from a union all select * from c where change is not null union all select * from d where change is not null""", batch="int")
def tree_changes(spark, sf):
    """Four polls of a tree: the second meets a busy writer, so the third gives
    both their changes; the fourth is taken by a tracker that starts anew."""
    scratch = Scratch(spark, "polls")
    d = table(spark, sf, "documents")

    def take(changes, batch):
        if batch == 1:
            raise snapshots.Busy
        scratch.save(changes.select(F.lit(batch).alias("batch"), "path", "change"), f"out/{batch}")

    for batch in range(4):
        tracker = snapshots.Tracker(spark, f"{scratch.root}/state", take)
        now = d.where(F.col("doc_id") % 11 != batch).select(F.lit(batch).cast("bigint").alias("poll"), F.col("doc_id").cast("string").alias("path"), F.when(F.col("doc_id") % 5 == batch, f"h{batch}").otherwise("h").alias("content_hash"))
        tracker(now, batch)
    return spark.read.schema("batch int, path string, change string").parquet(*[f"{scratch.root}/out/{k}" for k in (0, 2, 3)])


# summaries ---------------------------------------------------------------------------------
@query("""with g as (select c_nationkey as repository_id, max(c_custkey) as id from customer group by 1), j as (select o_custkey as id, count_if(o_orderstatus = 'O') as pending, count_if(o_orderstatus = 'F') as failed, count(*) as total from orders group by 1)
select repository_id, id, coalesce(pending, 0)::bigint as pending, coalesce(failed, 0)::bigint as failed, coalesce(total, 0)::bigint as total, 'missing' as quality_status from g left join j using (id)""")
def generation_status(spark, sf):
    c, o = table(spark, sf, "customer"), table(spark, sf, "orders")
    generations = c.select("c_nationkey", F.col("c_nationkey").alias("repository_id"), F.col("c_custkey").alias("id"), F.col("c_custkey").alias("created_at"), F.lit(None).cast("string").alias("quality_status"), F.lit(None).cast("string").alias("active_layer")).drop("c_nationkey")
    queue = o.select(F.col("o_custkey").alias("generation_id"), F.when(F.col("o_orderstatus") == "O", "pending").when(F.col("o_orderstatus") == "F", "failed").otherwise("running").alias("status"))
    return semantic.semantic_status(generations, queue).select("repository_id", "id", "pending", "failed", "total", "quality_status")


@query("select (select count(*) from customer) as files, (select count(*) from orders) as chunks, (select count(*) from part) as symbols, (select arg_max(o_orderkey, (o_orderdate, o_orderkey)) from orders where o_orderstatus = 'F')::varchar as last_id, (select max(n_name) from nation where n_regionkey = 1) as current_ref")
def repository_counts(spark, sf):
    o = table(spark, sf, "orders")
    runs = o.select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "F", "success").otherwise("failed").alias("status"), F.lit("m").alias("embedding_model"), F.lit(1).alias("embedding_dimension"), F.col("o_orderdate").alias("finished_at"), F.col("o_orderdate").alias("started_at"))
    refs = table(spark, sf, "nation").select((F.col("n_regionkey") == 1).alias("is_current"), F.lit(None).alias("deleted_at"), F.col("n_name").alias("ref_name"), F.col("n_name").alias("updated_at"))
    rows = semantic.repository_status(table(spark, sf, "customer"), o, table(spark, sf, "part"), runs, refs)
    return rows.select("files", "chunks", "symbols", F.col("last_run.id").cast("string").alias("last_id"), "current_ref")


@query("select doc_id from documents left join labels using (doc_id) where coalesce(toxic, 0) = 0 and trim(coalesce(text, '')) <> ''")
def embeddable_chunks(spark, sf):
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    return semantic.embeddable(d.select("doc_id", "text", F.when(F.col("toxic") == 1, "toxic").alias("excluded_reason"))).select("doc_id")


@query("select l_orderkey as o, case when count(*) = 0 then 0.41 else floor(avg(least(1.0, l_discount * 10)) * 100 + 0.5) / 100 end as trust, (floor(avg(least(1.0, l_discount * 10)) * 100 + 0.5) / 100) >= 0.65 as is_sure from lineitem group by 1")
def path_trust(spark, sf):
    """Scores are summed in the order of the table's rows, as its SQL does in one thread."""
    place = (F.col("_metadata.file_path"), F.col("_metadata.row_index"))
    lines = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o"), F.least(F.lit(1.0), F.col("l_discount") * 10).alias("score"), place[0].alias("file"), place[1].alias("line"))
    rows = lines.groupBy("o").agg(trust.aggregate_score(F.col("score"), F.col("file"), F.col("line")).alias("trust"))
    return rows.withColumn("is_sure", trust.level(F.col("trust")).isin("high", "medium"))


@query("select (select count(*) from customer) as files_seen, (select count(*) from customer where c_custkey in (select o_custkey from orders)) as files_indexed, (select count(*) from part) as chunks, (select sum(case when o_orderstatus <> 'P' then o_custkey end) from orders)::bigint as prompt_tokens")
def run_totals(spark, sf):
    o = table(spark, sf, "orders")
    seen = o.select(F.col("o_custkey").alias("c_custkey")).distinct().withColumn("seen", F.lit(True))
    files = table(spark, sf, "customer").join(seen, "c_custkey", "left").select(F.coalesce("seen", F.lit(False)).alias("indexed"))
    tokens = summaries.prompt_tokens(o.select(F.when(F.col("o_orderstatus") != "P", F.col("o_custkey")).alias("prompt_eval_count")))
    return summaries.run_counters(files, table(spark, sf, "part")).join(F.broadcast(tokens), F.lit(True))


@query("select n_nationkey, n_name, 'metadata_only' as content, true as read_only from nation")
def evidence_envelope(spark, sf):
    rows = api.envelope(table(spark, sf, "nation").select("n_nationkey", "n_name"))
    parsed = rows.select(F.from_json("json", "contract struct<content:string,read_only:boolean,order:string>, data struct<n_nationkey:int,n_name:string>").alias("j"))
    return parsed.select("j.data.n_nationkey", "j.data.n_name", "j.contract.content", "j.contract.read_only")


@query("select label::varchar as path, vec_id, row_number() over (order by label::varchar, vec_id) as place from embeddings", place="bigint")
def vector_neighborhood(spark, sf):
    p = table(spark, sf, "embeddings").select(F.col("label").cast("string").alias("path"), F.lit(1).alias("start_line"), F.col("vec_id").alias("vector_point_id"), "embedding")
    order = W.orderBy("path", "start_line", "vector_point_id")
    return vectors.neighborhood(p).withColumn("place", F.row_number().over(order).cast("bigint")).select("path", F.col("vector_point_id").alias("vec_id"), "place")


@query("select vec_id, round(sqrt(list_sum(list_transform(embedding::double[], lambda x: x * x))), 5) as length, 1.0::double as unit from embeddings")
def vector_lengths(spark, sf):
    e = F.col("embedding")
    return table(spark, sf, "embeddings").select("vec_id", F.round(vec.norm(e), 5).alias("length"), F.round(vec.norm(vec.normalized(e)), 5).alias("unit"))


@query("select d.doc_id::varchar as vector_point_id, md5(d.text) as content_hash, d.source as path, d.doc_id as start_line from documents d join labels l using (doc_id) where quality = 1 and lang in ('en', 'fr')")
def expected_points(spark, sf):
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    key = F.col("doc_id").cast("string")
    rows = d.select(key.alias("vector_point_id"), key.alias("chunk_id"), F.col("source").alias("file_id"), F.when(F.col("lang").isin("en", "fr"), "fast").otherwise("quality").alias("semantic_layer"), F.lit("g").alias("generation_id"), F.when(F.col("quality") == 1, "current").otherwise("stale").alias("status"), F.md5("text").alias("content_hash"), F.md5("lang").alias("text_hash"), F.lit("m").alias("embedding_model"), F.lit(64).alias("embedding_dimension"))
    chunks = d.select(key.alias("id"), F.col("doc_id").alias("start_line"), F.col("doc_id").alias("end_line"))
    files = d.select(F.col("source").alias("id"), F.col("source").alias("path")).distinct()
    return vectors.expected(rows, chunks, files, "fast", "g").select("vector_point_id", "content_hash", "path", "start_line")


@query("select l_orderkey as usage, l_partkey as symbol, p_name as package_name, s_name as path from lineitem join part on p_partkey = l_partkey join supplier on s_suppkey = l_suppkey where l_partkey % 10 = 3")
def dependency_lookup(spark, sf):
    li = table(spark, sf, "lineitem")
    usages = li.select(F.col("l_orderkey").alias("id"), F.col("l_partkey").alias("source_symbol_id"), F.col("l_partkey").alias("dependency_id"), F.col("l_suppkey").alias("file_id"))
    deps = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("package_name"), F.lit("1").alias("version_req"), F.lit("runtime").alias("dependency_kind"))
    files = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("path"), F.lit("h").alias("content_hash"), F.lit("t").alias("indexed_at"))
    wanted = table(spark, sf, "part").where("p_partkey % 10 = 3").select(F.col("p_partkey").alias("id"))
    return impact.dependency_usages(usages, deps, files, wanted).select(F.col("id").alias("usage"), F.col("source_symbol_id").alias("symbol"), "package_name", "path")


@query("select c_custkey as case_id, n_nationkey as symbol_id from customer join nation on n_nationkey = c_nationkey where n_nationkey % 5 <> 0")
def callback_links(spark, sf):
    n = table(spark, sf, "nation").select(F.col("n_nationkey").alias("id"), F.lit("f").alias("file_id"), F.concat(F.lit("cb"), F.col("n_nationkey").cast("string")).alias("name"))
    twice = n.union(n.where("id % 5 = 0").select(F.col("id") + 1000, "file_id", "name"))
    cases = table(spark, sf, "customer").select(F.col("c_custkey").alias("case_id"), F.lit("f").alias("file_id"), F.concat(F.lit("cb"), F.col("c_nationkey").cast("string")).alias("callback"))
    return resolve.callback_symbols(cases, twice)


@query("select event_type as kind, list_aggregate(list_sort(list(distinct 'reason:' || (user_id % 4))), 'string_agg', ',') as merged from events group by 1")
def reason_merges(spark, sf):
    """Reasons of many rows, each once, in order."""
    rows = table(spark, sf, "events").select(F.col("event_type").alias("path"), F.lit(1).cast("bigint").alias("relationship_count"), reasons.present(reasons.tag("reason", F.col("user_id") % 4), F.lit(None).cast("string")).alias("reasons"), F.lit("fresh").alias("freshness"), F.lit(0.5).alias("trust_score"), F.lit("medium").alias("trust_level"))
    return summaries.merge_related(rows).select(F.col("path").alias("kind"), F.array_join("reasons", ",").alias("merged"))


@query("""select path from (select source || '/' || doc_id as path from documents) where starts_with(path, 'src1/') order by path limit 25""")
def scope_violations(spark, sf):
    d = table(spark, sf, "documents").select(F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("path"))
    bad = search.outside_scope(d.orderBy("path"), d.where(~F.col("path").startswith("src1/")))
    return spark.createDataFrame([(x,) for x in bad], "path string").limit(status.clamp(99, 8))


@query("select o_orderkey as run, o_orderdate::date as day, dense_rank() over (order by o_orderpriority) as kind from orders where o_orderstatus = 'P'", kind="bigint")
def listed_runs(spark, sf):
    """A stable order of facts: ranks by a closed vocabulary's order."""
    o = table(spark, sf, "orders").where("o_orderstatus = 'P'")
    kinds = fresh.counts(o.select(F.lit("fresh").alias("freshness"))).where("n > 0")
    rows = o.select(F.col("o_orderkey").alias("run"), F.to_date("o_orderdate").alias("day"), "o_orderpriority").join(F.broadcast(kinds), F.lit(True))
    return rows.withColumn("kind", F.dense_rank().over(W.orderBy("o_orderpriority")).cast("bigint")).select("run", "day", "kind")
