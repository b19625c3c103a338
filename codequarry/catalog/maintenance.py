"""Vector, resolution, manifest, queue and storage queries."""

from __future__ import annotations

from pyspark.sql import Window as W, functions as F

from codequarry.catalog.base import Values, query
from codequarry.functions import ids, vectors as vec
from codequarry.operators import resolve, store, summaries, vectors
from codequarry.sources import embedder, manifests, runtime_log
from codequarry.streaming import state
from codequarry.tables import table


# vectors ---------------------------------------------------------------------------
def _points(spark, sf):
    e = table(spark, sf, "embeddings")
    return e.select("vec_id", "embedding", F.col("label").cast("string").alias("file_id"), F.lit("repo").alias("repository_id"))


def _queries(spark, sf):
    e = table(spark, sf, "embeddings").where("vec_id % 50 = 0")
    return e.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))


_KNN = """q as (select vec_id as query_id, embedding as query_vector from embeddings where vec_id % 50 = 0),
s as (select query_id, vec_id as id, list_cosine_similarity(embedding::double[], query_vector::double[]) as score from embeddings, q {where}),
r as (select *, row_number() over (partition by query_id order by score desc, id) as rank from s)"""


@query(f"with {_KNN.format(where='')} select query_id, id, round(score, 6) as score, rank from r where rank <= 5")
def knn_topk(spark, sf):
    out = vectors.nearest_each(_points(spark, sf), _queries(spark, sf), 5, "vec_id")
    return out.select("query_id", "id", F.round("score", 6).alias("score"), F.col("rank").cast("bigint").alias("rank"))


@query("""with s as (select vec_id, list_cosine_similarity(embedding::double[], (select embedding::double[] from embeddings where vec_id = 7)) as score from embeddings where label in (1, 2, 3))
select vec_id, round(score, 6) as score from s order by score desc, vec_id limit 10""")
def knn_ref_filtered(spark, sf):
    p = _points(spark, sf)
    q = [float(x) for x in p.where("vec_id = 7").first()["embedding"]]
    ref = spark.createDataFrame([("ref", "repo", x) for x in ("1", "2", "3")], "repository_ref_id string, repository_id string, file_id string")
    return vectors.nearest_for_ref(p.withColumn("vector_point_id", F.col("vec_id")), ref, "repo", "ref", q, 10).select("vec_id", F.round("score", 6).alias("score"))


@query("""with e as (select label, 1 + vec_id % 5 as w, unnest(embedding::double[]) as v, generate_subscripts(embedding, 1) as i from embeddings),
m as (select label, i, sum(v * w) / sum(w) as v from e group by 1, 2), n as (select label, sqrt(sum(v * v)) as len from m group by 1)
select label, i - 1 as place, round(v / len, 6) as value from m join n using (label)""", place="int")
def weighted_mean_vector(spark, sf):
    e = table(spark, sf, "embeddings").withColumn("w", 1 + F.col("vec_id") % 5)
    return vec.weighted_mean(e, "label", "embedding", "w").select("label", F.posexplode("mean").alias("place", "v")).select("label", "place", F.round("v", 6).alias("value"))


# documents as the expected manifest, labels and pages as what is stored
def _manifest(spark, sf):
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    want = d.select(F.col("doc_id").alias("vector_point_id"), F.md5("text").alias("content_hash"), F.when(F.col("lang") == "en", "m1").alias("embedding_model"), "lang")
    have = d.where("coalesce(quality, 1) = 1").select(F.col("doc_id").alias("vector_point_id"), F.when(F.col("toxic") == 1, "old").otherwise(F.md5("text")).alias("content_hash"), F.when(F.col("lang") == "en", F.when(F.col("source") == "src0", "m0").otherwise("m1")).otherwise("m2").alias("embedding_model"), "lang")
    return want, have.union(table(spark, sf, "pages").select((-1 - F.col("page_id")), F.md5("html"), F.lit("m1"), F.lit("en")))


_VERIFY = """d as (select doc_id, md5(text) as h, lang, source, quality, toxic from documents left join labels using (doc_id)),
v as (select doc_id as vector_point_id, lang, case when coalesce(quality, 1) = 0 then 'missing' when toxic = 1 or (lang = 'en' and source = 'src0') then 'stale' end as state,
  case when coalesce(quality, 1) = 1 then array_to_string(list_filter([case when toxic = 1 then 'content_hash' end, case when lang = 'en' and source = 'src0' then 'embedding_model' end], lambda x: x is not null), ',') end as mismatches from d
  union all select -1 - page_id, 'en', 'orphaned', null from pages)"""


@query(f"with {_VERIFY} select vector_point_id, state, case state when 'missing' then 'error' else 'warning' end as severity, mismatches from v where state is not null")
def vector_verify(spark, sf):
    want, have = _manifest(spark, sf)
    return vectors.verify(want, have).withColumn("mismatches", F.array_join("mismatches", ","))


@query(f"with {_VERIFY} select vector_point_id, state, case state when 'orphaned' then 'delete' else 'reindex' end as action from v where state is not null")
def repair_plan(spark, sf):
    return vectors.repair_plan(vectors.verify(*_manifest(spark, sf)), "fast").select("vector_point_id", "state", "action")


@query(f"with {_VERIFY} select count_if(state = 'missing')::bigint as missing, count_if(state = 'stale')::bigint as stale, count_if(state = 'orphaned')::bigint as orphaned, true as table_exists, 'de,en,es,fr' as layers from v")
def vector_verify_all(spark, sf):
    want, have = _manifest(spark, sf)
    parts = [vectors.verify_summary(vectors.verify(want.where(F.col("lang") == x), have.where(F.col("lang") == x)), x, True) for x in ("en", "fr", "de", "es")]
    rows = parts[0].union(parts[1]).union(parts[2]).union(parts[3])
    return vectors.verify_all(rows).withColumn("layers", F.array_join("layers", ","))


@query("""select doc_id as vector_point_id from documents d left join labels l using (doc_id) where (toxic = 1 or quality = 0) and source <> 'src3'""")
def stale_points_except(spark, sf):
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left").withColumn("path", F.col("doc_id").cast("string")).withColumn("vector_point_id", F.col("doc_id"))
    active, protected = d.where("coalesce(quality, 1) = 1").select("path"), vectors.protected_points(d.withColumn("file_id", F.col("source")), spark.createDataFrame([("src3",)], "file_id string"))
    return vectors.stale_points(d, d.where("toxic = 1").select("path"), active, protected)


@query("""with r as (select source as repository_id, md5(concat_ws('|', cast(doc_id as varchar), md5(text), md5(lang), 'm', '64')) as h from documents),
f as (select repository_id, substr(h, 1, 3) as bucket, md5(string_agg(h, '' order by h)) as h from r group by 1, 2) select repository_id, md5(string_agg(h, '' order by bucket)) as generation_id from f group by 1""")
def generation_id(spark, sf):
    d = table(spark, sf, "documents")
    rows = d.select(F.col("source").alias("repository_id"), F.col("doc_id").cast("string").alias("chunk_id"), F.md5("text").alias("content_hash"), F.md5("lang").alias("text_hash"), F.lit("m").alias("embedding_model"), F.lit(64).alias("embedding_dimension"))
    return vectors.generation_id(rows)


def _jobs(spark, sf):
    d, lab = table(spark, sf, "documents"), table(spark, sf, "labels")
    return d.select(F.col("doc_id").alias("chunk_id"), F.md5("text").alias("text_hash"), F.md5("text").alias("content_hash"), F.lit("m").alias("embedding_model"), F.lit("g1").alias("generation_id")), lab


@query("select doc_id as chunk_id, 'g2' as generation_id from documents join labels using (doc_id) where quality = 1")
def carry_forward(spark, sf):
    old, lab = _jobs(spark, sf)
    new = old.join(lab.where("quality = 1").select(F.col("doc_id").alias("chunk_id")), "chunk_id", "left_semi")
    return vectors.carry_forward(old, new, "g2").select("chunk_id", "generation_id")


@query("select doc_id as chunk_id from documents d where doc_id not in (select doc_id from labels where quality = 1 or toxic = 1)")
def missing_jobs(spark, sf):
    jobs, lab = _jobs(spark, sf)
    of = lambda cond: jobs.join(lab.where(cond).select(F.col("doc_id").alias("chunk_id")), "chunk_id", "left_semi")
    return vectors.missing_jobs(jobs, of("quality = 1"), of("toxic = 1")).select("chunk_id")


@query("select d.doc_id as chunk_id, coalesce(l.quality, 1) = 0 or coalesce(l.toxic, 0) = 1 as is_stale from documents d left join labels l using (doc_id)")
def job_sources(spark, sf):
    jobs, lab = _jobs(spark, sf)
    both = jobs.join(lab.select(F.col("doc_id").alias("chunk_id"), "quality", "toxic"), "chunk_id", "left")
    fs = both.where("coalesce(quality, 1) = 1").select(F.col("chunk_id").alias("id"), "content_hash")
    chunks = both.select(F.col("chunk_id").alias("id"), F.when(F.col("toxic") == 1, "changed").otherwise(F.col("text_hash")).alias("text_hash"))
    return vectors.job_sources(jobs.withColumn("file_id", F.col("chunk_id")), fs, chunks).select("chunk_id", "is_stale")


# resolution -----------------------------------------------------------------------
_SYMBOLS = Values(
    "id string, file_id string, name string, qualified_name string, path string, start_byte bigint, end_byte bigint, start_line bigint",
    [
        ("s1", "f1", "helper", "crate::m::helper", "src/m.rs", 0, 100, 1), ("s2", "f1", "caller", "crate::m::caller", "src/m.rs", 110, 300, 10), ("s3", "f1", "run", "crate::m::A::run", "src/m.rs", 310, 400, 30),
        ("s4", "f1", "run", "crate::m::B::run", "src/m.rs", 410, 500, 40), ("s5", "f2", "thing", "crate::other::thing", "src/other.rs", 0, 50, 1), ("s6", "f2", "helper", "crate::other::helper", "src/other.rs", 60, 90, 5),
        ("s7", "f3", "test_helper", "crate::m_tests::test_helper", "src/m_tests.rs", 0, 40, 1), ("s8", "f1", "inner", "crate::m::caller::inner", "src/m.rs", 150, 200, 15),
    ],
)
_CALLS = Values(
    "call_id string, file_id string, callee_text string, caller_name string",
    [("c1", "f1", "helper", "crate::m::caller"), ("c2", "f1", "external::thing", "crate::m::caller"), ("c3", "f1", "x.run", "crate::m::caller"), ("c4", "f1", "println!", "crate::m::caller"), ("c5", "f1", "crate::other::thing", "crate::m::caller"), ("c6", "f1", "self::helper", "crate::m::caller"), ("c7", "f1", "super::other::helper", "crate::m::caller"), ("c8", "f1", "obj.caller", "crate::m::helper"), ("c9", "f1", "other::thing", "crate::caller")],
)
_CANDIDATES = r"""cand as (select call_id, file_id, unnest(list_distinct(list_filter([callee_text, case when starts_with(callee_text, 'self::') then module || '::' || substr(callee_text, 7) end, case when starts_with(callee_text, 'super::') then regexp_extract(module, '^(.*)::[^:]+$', 1) || '::' || substr(callee_text, 8) end,
   case when not contains(callee_text, '::') and not contains(callee_text, '.') then module || '::' || callee_text end, case when contains(callee_text, '::') and not regexp_matches(callee_text, '^(crate|self|super|Self)::') then module || '::' || callee_text end], lambda x: x is not null))) as c from (select *, regexp_extract(caller_name, '^(.*)::[^:]+$', 1) as module from c)),
 n as (select distinct call_id, file_id, regexp_replace(c, '^((crate|self|super)(::|$))+', '') as c from cand), sy as (select *, regexp_replace(qualified_name, '^((crate|self|super)(::|$))+', '') as q from s)"""


def _resolution_sql(across: bool) -> str:
    on = "" if across else "and n.file_id = sy.file_id"
    near = "contains(callee_text, '::') and ends_with('::' || sy.qualified_name, '::' || regexp_replace(callee_text, '^((crate|self|super)(::|$))+', ''))" if across else "c.file_id = sy.file_id"
    return f"""with {_SYMBOLS.sql("s")}, {_CALLS.sql("c")}, {_CANDIDATES}, ex as (select call_id, count(distinct sy.id) as k, min(sy.id) as id from n join sy on sy.q = n.c {on} group by 1),
    nr as (select call_id, count(distinct sy.id) as k, min(sy.id) as id from c join sy on sy.name = coalesce(list_filter(string_split_regex(callee_text, '[:.#]'), lambda x: x <> '')[-1], callee_text) and {near} group by 1)
    select c.call_id, callee_text, case when ends_with(callee_text, '!') then null when ex.k = 1 then ex.id when ex.k > 1 then null when nr.k = 1 then nr.id end as callee_symbol_id,
     case when ends_with(callee_text, '!') then 'unresolved' when ex.k = 1 then 'resolved_exact' when ex.k > 1 then 'ambiguous' when nr.k = 1 then 'resolved_local_candidate' when nr.k > 1 then 'ambiguous' else 'unresolved' end as resolution_status,
     case when ends_with(callee_text, '!') then 0.2 when ex.k = 1 then 1.0 when ex.k > 1 then 0.2 when nr.k = 1 then {0.65 if across else 0.75} when nr.k > 1 then 0.2 else 0.25 end::double as confidence from c left join ex using (call_id) left join nr using (call_id)"""


@query(_resolution_sql(False))
def callee_resolution(spark, sf):
    return resolve.callees(_CALLS.df(spark), _SYMBOLS.df(spark)).drop("file_id", "caller_name")


@query(_resolution_sql(True))
def cross_file_resolution(spark, sf):
    return resolve.callees(_CALLS.df(spark), _SYMBOLS.df(spark), across_files=True).drop("file_id", "caller_name")


_REFS = Values("reference_id string, file_id string, reference_text string, confidence double", [("r1", "f1", "crate::m::helper", 0.4), ("r2", "f1", "Thing", 0.45), ("r3", "f1", "A.run", 0.5), ("r4", "f2", "thing", 0.45)])


@query(f"""with {_SYMBOLS.sql("s")}, {_REFS.sql("r")}, h as (select reference_id, count(distinct s.id) as k, min(s.id) as id from r join s on s.file_id = r.file_id and s.name = coalesce(list_filter(string_split_regex(reference_text, '[:.#]'), lambda x: x <> '')[-1], reference_text) group by 1)
select reference_id, case when k = 1 then id end as target_symbol_id, case when k = 1 then 'resolved_local_candidate' when k > 1 then 'ambiguous' else 'unresolved' end as resolution_status, case when k = 1 then 0.7 when k > 1 then 0.35 else confidence end::double as confidence from r left join h using (reference_id)""")
def reference_resolution(spark, sf):
    return resolve.references(_REFS.df(spark), _SYMBOLS.df(spark)).select("reference_id", "target_symbol_id", "resolution_status", "confidence")


@query("""with o as (select o_orderkey, date_diff('day', date '1990-01-01', cast(o_orderdate as date)) as d from orders), l as (select distinct l_orderkey, date_diff('day', date '1990-01-01', cast(l_shipdate as date)) as d from lineitem)
select l_orderkey, l.d as day, case when l.d >= o.d - 5 and l.d + 3 <= o.d + 60 then o_orderkey when o.d - 5 >= l.d + 3 and o.d - l.d <= 20 then o_orderkey end as symbol_id from l join o on l_orderkey = o_orderkey""")
def containment_smallest(spark, sf):
    day = lambda c: F.datediff(F.col(c).cast("date"), F.lit("1990-01-01").cast("date")).cast("bigint")
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderkey").alias("file_id"), (day("o_orderdate") - 5).alias("start_byte"), (day("o_orderdate") + 60).alias("end_byte"), day("o_orderdate").alias("start_line"))
    n = table(spark, sf, "lineitem").select(F.struct("l_orderkey", day("l_shipdate").alias("day")).alias("node_id"), F.col("l_orderkey").alias("file_id"), day("l_shipdate").alias("start_byte"), (day("l_shipdate") + 3).alias("end_byte"), (day("l_shipdate") + 18).alias("end_line"))
    return resolve.containing(n, o).select("node_id.l_orderkey", "node_id.day", "symbol_id")


_IMPORTS = Values("reference_id string, import_path string, confidence double", [("i1", "sqlx::SqlitePool", 0.4), ("i2", "serde_json::Value", 0.4), ("i3", "@scope/pkg/sub", 0.4), ("i4", "std::io", 0.4), ("i5", "insta", 0.9)])
_DEPS = Values("dependency_id string, ordinal bigint, package_name string, dependency_name string", [("d0", 0, "serde", "serde"), ("d1", 1, "serde_json", "serde-json"), ("d2", 2, "sqlx", "sqlx"), ("d3", 3, "@scope/pkg", "@scope/pkg"), ("d4", 4, "insta", "insta"), ("d5", 5, "insta", "insta-again")])


@query(rf"""with {_IMPORTS.sql("i")}, {_DEPS.sql("d")}, h as (select i.*, dependency_id, row_number() over (partition by reference_id order by ordinal) as nth from i join d on lower(replace(regexp_extract(import_path, '^(@[^/]+/[^/]+|[^/:.]+)', 1), '-', '_')) in (lower(replace(package_name, '-', '_')), lower(replace(dependency_name, '-', '_'))))
select reference_id, dependency_id, import_path, nullif(regexp_extract(import_path, '([A-Za-z_][A-Za-z0-9_]*)\W*$', 1), '') as referenced_symbol, round(least(1.0, confidence + 0.35), 4)::double as confidence from h where nth = 1""")
def import_usages(spark, sf):
    return resolve.import_usages(_IMPORTS.df(spark), _DEPS.df(spark))


_TESTS = Values("id string, symbol_id string, file_id string, path string, name string, qualified_name string", [("t1", "s7", "f3", "src/m_tests.rs", "test_helper", "crate::m_tests::test_helper"), ("t2", None, "f1", "src/m.rs", "helper_test", "crate::m::helper_test"), ("t3", None, "f4", "tests/other_test.rs", "it_works", "it_works")])
_EDGES = Values("caller_symbol_id string, callee_symbol_id string, confidence double", [("s7", "s1", 0.9), ("s2", "s5", 1.0), ("s7", None, 0.2)])
_PLAIN = "regexp_replace(lower({0}), '^tests?_?|_?tests?$|^(it|covers|checks)_', '', 'g')"
_STEM = r"regexp_replace(lower(regexp_extract({0}, '([^/]+?)\.[^.]+$', 1)), '_?(tests?|spec)$|\.(tests?|spec)$', '', 'g')"
_TARGETS_SQL = f"""tt as (select t.id as test_id, e.callee_symbol_id as target_symbol_id, s.file_id as target_file_id, 'direct_call' as relationship_kind, e.confidence from t join e on e.caller_symbol_id = t.symbol_id join s on s.id = e.callee_symbol_id
  union all select t.id, s.id, s.file_id, case when {_PLAIN.format("t.name")} = {_PLAIN.format("s.name")} then 'naming_convention' else 'same_module' end, case when {_PLAIN.format("t.name")} = {_PLAIN.format("s.name")} then 0.7 else 0.3 end from t join s on s.file_id = t.file_id and coalesce(t.symbol_id, '') <> s.id
  union all select distinct t.id, null, s.file_id, 'fixture_path', 0.6 from t join s on s.file_id <> t.file_id and {_STEM.format("t.path")} = {_STEM.format("s.path")} and {_STEM.format("t.path")} <> '')"""


@query(f"with {_SYMBOLS.sql('s')}, {_TESTS.sql('t')}, {_EDGES.sql('e')}, {_TARGETS_SQL} select * from tt")
def test_targets(spark, sf):
    return resolve.test_targets(_TESTS.df(spark), _SYMBOLS.df(spark), _EDGES.df(spark))


@query(f"with {_SYMBOLS.sql('s')}, {_TESTS.sql('t')}, {_EDGES.sql('e')}, {_TARGETS_SQL} select distinct qualified_name from t join tt on tt.test_id = t.id where confidence >= 0.6 and (target_symbol_id = 's1' or (target_symbol_id is null and target_file_id = 'f1'))")
def likely_tests(spark, sf):
    t, s = _TESTS.df(spark), _SYMBOLS.df(spark)
    one = lambda v: spark.createDataFrame([(v,)], "id string")
    return resolve.likely_tests(resolve.test_targets(t, s, _EDGES.df(spark)), t, one("s1"), one("f1"))


# manifests and logs -----------------------------------------------------------------
_CARGO = '[package]\nname = "x"\n\n[dependencies]\nsqlx = { version = "0.7", features = ["a"] }\nserde-json = { package = "serde_json", version = "1" }\n# note = "1"\nplain = "2.1"\nlocal.workspace = true\n[dev-dependencies]\ninsta = "1"\n[build-dependencies]\ncc = "1.0"\n[profile.release]\nlto = "fat"\n'
_NPM = '{"name": "x", "dependencies": {"@scope/pkg": "^1.2.0"}, "devDependencies": {"vitest": "latest"}, "peerDependencies": {"react": "18"}, "optionalDependencies": {"fsevents": "*"}}'
_FILES = Values("file_id string, path string, content string", [("m1", "Cargo.toml", _CARGO), ("m2", "package.json", _NPM), ("m3", "sub/Cargo.toml", _CARGO), ("m4", "package.json", "{broken")])


@query(r"""select * from (values ('m1', 'sqlx', 'sqlx', '0.7', 'runtime'), ('m1', 'serde-json', 'serde_json', '1', 'runtime'), ('m1', 'plain', 'plain', '2.1', 'runtime'), ('m1', 'local', 'local', null, 'runtime'), ('m1', 'insta', 'insta', '1', 'dev'), ('m1', 'cc', 'cc', '1.0', 'build'))
 v(file_id, dependency_name, package_name, version_req, dependency_kind)""")
def cargo_manifest(spark, sf):
    return manifests.cargo(_FILES.df(spark)).drop("manifest_path", "package_manager")


@query("""with j(j) as (values ('{"dependencies": {"@scope/pkg": "^1.2.0"}, "devDependencies": {"vitest": "latest"}, "peerDependencies": {"react": "18"}, "optionalDependencies": {"fsevents": "*"}}'::json)),
k as (select s, kind, json_extract(j, '$.' || s) as o from j, (values ('dependencies', 'runtime'), ('devDependencies', 'dev'), ('peerDependencies', 'peer'), ('optionalDependencies', 'optional')) v(s, kind)),
n as (select kind, o, unnest(json_keys(o)) as dependency_name from k) select 'm2' as file_id, dependency_name, json_extract_string(o, '$."' || dependency_name || '"') as version_req, kind as dependency_kind from n""")
def npm_manifest(spark, sf):
    return manifests.npm(_FILES.df(spark)).select("file_id", "dependency_name", "version_req", "dependency_kind")


_LOG = "test tests::fails ... FAILED\nthread 'x' panicked at src/lib.rs:12:5:\nstack backtrace:\n   0: crate::module::run\n             at src/lib.rs:12:5\nnoise\n   1: crate::lonely::frame\n   2: <crate::W as crate::J>::poll\n   at Example.Service.Run(Int32 a) in src/Program.cs:line 42\n  at handleRequest (/repo/web/app.js:12:3)\n at async Object.load (/repo/web/app.js:22:9)\n at node:internal/x (node:internal/x:1:1)\n at broken (web/app.js:nope)\nERROR worker: target=\"crate::w\" file=\"src/w.rs\" line=52 column=7\nfailures:\n    tests::fails\n    tests::other_fails\n"


@query("""select * from (values (0, null, 'src/lib.rs', 12, 5), (1, 'crate::module::run', 'src/lib.rs', 12, 5), (2, 'crate::lonely::frame', null, null, null), (3, '<crate::W as crate::J>::poll', null, null, null), (4, 'Example.Service.Run', 'src/Program.cs', 42, null),
 (5, 'handleRequest', '/repo/web/app.js', 12, 3), (6, 'Object.load', '/repo/web/app.js', 22, 9), (7, 'crate::w', 'src/w.rs', 52, 7)) v(ordinal, symbol, path, line, "column")""", ordinal="bigint", line="bigint", column="bigint")
def runtime_frames(spark, sf):
    logs = spark.createDataFrame([("a", _LOG)], "log_id string, text string")
    return runtime_log.frame_rows(runtime_log.lines(logs)).select("ordinal", "symbol", "path", "line", "column")


@query("select * from (values ('failing', 'tests::fails'), ('failing', 'tests::other_fails'), ('malformed', 'at broken (web/app.js:nope)')) v(kind, text)")
def runtime_failures(spark, sf):
    lines = runtime_log.lines(spark.createDataFrame([("a", _LOG)], "log_id string, text string"))
    return runtime_log.failing_tests(lines).select(F.lit("failing").alias("kind"), F.col("test").alias("text")).union(runtime_log.malformed(lines).select(F.lit("malformed"), "text"))


# queues and writes -----------------------------------------------------------------
_STATUS = "case o_orderstatus when 'O' then 'pending' when 'P' then 'running' else 'succeeded' end"


@query(f"""with j as (select o_orderkey as id, o_orderpriority as generation_id, {_STATUS} as status, o_orderdate as created_at from orders),
r as (select *, row_number() over (partition by generation_id, status order by created_at, id) as nth from j)
select id, case when status = 'pending' and generation_id = '1-URGENT' and nth <= 100 then 'running' else status end as status, (status = 'pending' and generation_id = '1-URGENT' and nth <= 100)::bigint as attempts from r""")
def claim_jobs(spark, sf):
    return store.claim_jobs(_orders(spark, sf), "1-URGENT", 100).select("id", "status", "attempts")


def _orders(spark, sf):
    o = table(spark, sf, "orders")
    state_ = F.when(F.col("o_orderstatus") == "O", "pending").when(F.col("o_orderstatus") == "P", "running").otherwise("succeeded")
    return o.select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("generation_id"), state_.alias("status"), F.col("o_orderdate").alias("created_at"), F.lit(0).cast("bigint").alias("attempts"))


@query(f"select o_orderkey as id, case when o_orderpriority <> '1-URGENT' and {_STATUS} in ('pending', 'running') then 'skipped_stale' else {_STATUS} end as status from orders")
def supersede_jobs(spark, sf):
    return store.supersede(_orders(spark, sf), "1-URGENT").select("id", "status")


@query("select c_custkey as id, case when o.n is not null then 'new' else 'old' end as side, coalesce(o.n, 0) as n from customer left join (select o_custkey, count(*) as n from orders group by 1) o on o_custkey = c_custkey")
def upsert_merge(spark, sf):
    old = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.lit("old").alias("side"), F.lit(0).cast("bigint").alias("n"))
    new = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.lit("new").alias("side"), F.count("*").alias("n"))
    return store.merged(old, new, ("id",))


@query("select doc_id as id, source as file_id, case when source in ('src0', 'src1') then 'new' else 'old' end as run from documents where source <> 'src2' union all select -1, 'src0', 'new'")
def replace_file_facts(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("file_id"), F.lit("old").alias("run"))
    changed, gone = spark.createDataFrame([("src0",), ("src1",)], "file_id string"), spark.createDataFrame([("src2",)], "file_id string")
    new = d.join(changed, "file_id", "left_semi").withColumn("run", F.lit("new")).select("id", "file_id", "run").union(spark.createDataFrame([(-1, "src0", "new")], "id bigint, file_id string, run string"))
    return store.replace_file_facts(d, new, changed, gone)


@query("select c_custkey as id from customer where c_custkey not in (select o_custkey from orders where o_orderstatus = 'P')")
def unreferenced_files(spark, sf):
    return store.unreferenced_files(table(spark, sf, "customer").select(F.col("c_custkey").alias("id")), table(spark, sf, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("file_id")))


# streams as batches -------------------------------------------------------------------
@query("""with g as (select user_id, epoch(ts) - lag(epoch(ts)) over (partition by user_id order by ts) as gap from events) select user_id, count_if(gap > 3600) + 1 as leases, round(max(gap), 3) as longest_gap from g group by 1""", leases="bigint")
def lease_gaps(spark, sf):
    return state.lease_gaps(table(spark, sf, "events"), "user_id", "ts", 3600.0).select("user_id", "leases", F.round("longest_gap", 3).alias("longest_gap"))


@query("""select user_id as repository_id, arg_max(case event_type when 'error' then 'error' when 'purchase' then 'pending' else 'watching' end, (ts, event_id)) as state, arg_max(event_id, (ts, event_id)) as files_seen from events group by 1""")
def watcher_status(spark, sf):
    e = table(spark, sf, "events")
    name = F.when(F.col("event_type") == "error", "batch_failed").when(F.col("event_type") == "purchase", "changes_pending").otherwise("idle")
    rows = e.select(F.col("user_id").alias("repository_id"), F.col("ts").alias("at"), F.col("event_id").alias("seq"), name.alias("event"), F.col("event_id").alias("files_seen"), F.lit(1).alias("queued"), F.lit("p").alias("path"), F.lit("e").alias("error"))
    return state.watcher_status(rows).select("repository_id", "state", "files_seen")


@query("select event_type as repository_id, count(*) as clients, string_agg(distinct cast(user_id % 7 as varchar), ',' order by cast(user_id % 7 as varchar)) as kinds from events where ts >= (select max(ts) from events) - interval 1 day group by 1")
def client_rollup(spark, sf):
    e = table(spark, sf, "events")
    now = e.agg(F.max("ts").alias("now"))
    rows = e.select(F.col("event_type").alias("repository_id"), F.col("ts").alias("heartbeat_at"), (F.col("user_id") % 7).cast("string").alias("client_kind")).join(F.broadcast(now), F.lit(True))
    return summaries.clients(rows, F.col("now"), 86400).select("repository_id", "clients", F.array_join("kinds", ",").alias("kinds"))


@query("select event_id from events where ts + interval 24 hour > (select max(ts) from events)")
def live_observations(spark, sf):
    e = table(spark, sf, "events")
    now = e.agg(F.max("ts").alias("now"))
    rows = e.join(F.broadcast(now), F.lit(True)).withColumn("expires_at", F.col("ts") + F.expr("interval 24 hours"))
    return store.prune_observations(rows, F.col("now")).select("event_id")


# ids and functions in Python -------------------------------------------------------------
@query("""with h as (select doc_id, md5(concat_ws(chr(0), cast(doc_id as varchar), source)) as stable_id from documents)
select doc_id, stable_id, substr(stable_id, 1, 8) || '-' || substr(stable_id, 9, 4) || '-' || substr(stable_id, 13, 4) || '-' || substr(stable_id, 17, 4) || '-' || substr(stable_id, 21) as point_id,
 greatest(1, (('0x' || substr(stable_id, 1, 8))::bigint % 2147483648) * 4294967296 + ('0x' || substr(stable_id, 9, 8))::bigint)::bigint as rowid_ from h""")
def vector_ids(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", ids.stable_id(F.col("doc_id"), F.col("source")).alias("stable_id"))
    return d.withColumn("point_id", ids.vector_point_id(F.col("stable_id"))).withColumn("rowid_", ids.vector_rowid(F.col("point_id")))


@query()
def embedded_documents(spark, sf):
    """Hashed embeddings of all documents (no SQL form); vectors as one number."""
    rows = embedder.with_embedding(table(spark, sf, "documents").select("doc_id", "text"), "text")
    return rows.select("doc_id", F.size("embedding").alias("dimension"), F.round(vec.norm(F.col("embedding")), 4).alias("length"))


@query()
def document_segments(spark, sf):
    """Overlapping segments of all documents (the step depends on the text)."""
    from codequarry.functions import tokens

    return tokens.segment_table(table(spark, sf, "documents").select("doc_id", "text"), "text", 512).select("doc_id", "segment_index", "segment_tokens", F.md5("segment").alias("segment_hash"))
