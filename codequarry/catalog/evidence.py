"""Freshness, trust, search, coverage, routing, context and lookup queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from codequarry.catalog.base import EDGES_SQL, FILES_SQL, LIVE_SQL, Values, edges, files, live, query
from codequarry.functions import paths, reasons, secret_rules, status, tokens, trust
from codequarry.operators import freshness as fresh, graph, search, summaries
from codequarry.plans import context, impact, routing
from codequarry.tables import table

TRUST_SQL = """floor((weight * 0.35 + ((content_hash is not null)::int + (index_run_id is not null)::int + (parser_version is not null)::int + (indexed_at is not null)::int) / 4.0::double * 0.25
   + least(1.0, greatest(0.0, coalesce(confidence, 1.0)))::double * 0.25 + (case when index_run_id is not null and parser_version is not null then 1.0 when index_run_id is null and parser_version is null then 0.0 else 0.6 end)::double * 0.15) * 100 + 0.5) / 100"""
WEIGHT_SQL = "(case freshness when 'fresh' then 1.0 when 'stale' then 0.55 when 'deleted' then 0.25 when 'missing' then 0.2 else 0.45 end)::double"
LEVEL_SQL = "case when trust_score >= 0.85 then 'high' when trust_score >= 0.65 then 'medium' when trust_score >= 0.35 then 'low' else 'minimal' end"
REPORT_SQL = f"""f as ({FILES_SQL}), l as ({LIVE_SQL}), r as (
  select coalesce(f.path, l.path) as path, f.content_hash as indexed_hash, l.content_hash as current_hash, f.content_hash, f.index_run_id, f.parser_version, f.indexed_at, cast(null as double) as confidence,
    case when f.path is null then 'missing' when l.path is null then 'deleted' when f.content_hash = l.content_hash then 'fresh' else 'stale' end as freshness
  from f full join l on f.path = l.path)"""


@query(f"""with {REPORT_SQL}, s as (select *, {WEIGHT_SQL} as weight from r), t as (select path, freshness, {TRUST_SQL} as trust_score from s)
select path, freshness, trust_score, {LEVEL_SQL} as trust_level from t""")
def freshness_report(spark, sf):
    f = files(spark, sf)
    rows = fresh.report(f, live(spark, sf)).select("path", "freshness").join(f, "path", "left")
    return trust.with_trust(rows).select("path", "freshness", "trust_score", "trust_level")


@query(f"with {REPORT_SQL} select v.freshness, count(r.path) as n from (values ('fresh'), ('stale'), ('deleted'), ('missing'), ('unknown')) v(freshness) left join r using (freshness) group by 1")
def freshness_counts(spark, sf):
    return fresh.counts(fresh.report(files(spark, sf), live(spark, sf)))


@query(f"with {REPORT_SQL} select path, case freshness when 'missing' then 'created' when 'deleted' then 'deleted' else 'modified' end as change, indexed_hash as old_hash, current_hash as new_hash from r where freshness <> 'fresh'")
def snapshot_diff(spark, sf):
    return fresh.diff(files(spark, sf), live(spark, sf)).select("path", "change", "old_hash", "new_hash")


@query(f"with l as ({LIVE_SQL}) select path, content_hash from l")
def diff_apply(spark, sf):
    old, new = files(spark, sf), live(spark, sf)
    return fresh.apply(old, fresh.diff(old, new))


@query(f"""with {REPORT_SQL} select path, 'run-1' as index_run_id, indexed_hash as old_content_hash, current_hash as new_content_hash, case freshness when 'missing' then 'created' when 'deleted' then 'deleted' else 'updated' end as action,
  case freshness when 'missing' then 'new_file' when 'deleted' then 'missing_from_discovery' else 'content_changed' end as reason, 'success' as status from r where freshness <> 'fresh'""")
def file_events(spark, sf):
    return fresh.file_events(fresh.diff(files(spark, sf), live(spark, sf)), "run-1")


@query(f"""with {REPORT_SQL} select count(*) as event_count, string_agg(case when freshness = 'stale' then path end, ',' order by path) as modified_paths, min(case when freshness = 'stale' then path end) as latest
from r where freshness <> 'fresh'""")
def change_counts(spark, sf):
    return fresh.change_counts(fresh.diff(files(spark, sf), live(spark, sf))).select("event_count", F.array_join("modified", ",").alias("modified_paths"), "latest")


_MATRIX = Values(
    "freshness string, content_hash string, index_run_id string, parser_version string, indexed_at string, confidence double",
    [(f, *p, c) for f in ("fresh", "stale", "deleted", "missing", "unknown") for p in (("h", "r", "p", "t"), ("h", None, "p", None), ("h", "r", None, "t"), (None, None, None, None)) for c in (None, 1.0, 0.5, 0.35, -1.0, 2.0)],
)


@query(f"""with {_MATRIX.sql("m")}, s as (select *, {WEIGHT_SQL} as weight from m), t as (select *, {TRUST_SQL} as trust_score from s)
select freshness, content_hash, index_run_id, parser_version, indexed_at, confidence, trust_score, {LEVEL_SQL} as trust_level,
  'freshness:' || freshness || ',confidence:' || case when confidence is null then 'not_applicable' else printf('%.2f', least(1.0, greatest(0.0, confidence))) end || ',provenance:' ||
  case ((content_hash is not null)::int + (index_run_id is not null)::int + (parser_version is not null)::int + (indexed_at is not null)::int) when 4 then 'complete' when 3 then 'partial' when 2 then 'partial' else 'missing' end || ',index_metadata:' ||
  case when index_run_id is not null and parser_version is not null then 'complete' when index_run_id is null and parser_version is null then 'missing' else 'partial' end as factors from t""")
def trust_scores(spark, sf):
    rows = trust.with_trust(_MATRIX.df(spark), confidence=F.col("confidence"))
    return rows.withColumn("factors", F.array_join("trust_factors", ",")).drop("trust_factors")


@query("""select p_partkey, p_name, case when p_name = 'ring' then 0 when ends_with(p_name, 'ring') then 2 else 3 end as match_rank from part
where contains(lower(p_name), 'ring') order by match_rank, p_name, lpad(cast(p_partkey as varchar), 12, '0') limit 25""")
def symbol_search_ranked(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("id"), F.col("p_name").alias("name"), F.col("p_name").alias("qualified_name"), F.lpad(F.col("p_partkey").cast("string"), 12, "0").alias("path"), F.lit(1).alias("start_line"), "p_partkey")
    return search.symbols(p, "ring", 25).select("p_partkey", F.col("name").alias("p_name"), "match_rank")


_TARGETS = Values("path string, start_line bigint, end_line bigint", [("F", 10, 20), ("O", 100, 400), ("O", 1000, 1000), ("P", 1, 5000), ("X", 1, 9)])


@query(f"""with {_TARGETS.sql("t")} select t.path as target_path, t.start_line as target_start_line, o.o_orderkey, cast(o.o_custkey as bigint) as first_line
from t join orders o on o.o_orderstatus = t.path and o.o_custkey <= t.end_line and o.o_custkey + 5 >= t.start_line
qualify row_number() over (partition by t.path, t.start_line, t.end_line order by o.o_custkey, cast(o.o_orderkey as varchar)) <= 25""")
def range_intersection(spark, sf):
    o = table(spark, sf, "orders")
    s = o.select(F.col("o_orderkey").cast("string").alias("id"), "o_orderkey", F.col("o_orderstatus").alias("path"), F.col("o_custkey").alias("start_line"), (F.col("o_custkey") + 5).alias("end_line"), F.lit("").alias("qualified_name"))
    return search.intersecting(s, _TARGETS.df(spark)).select("target_path", "target_start_line", "o_orderkey", F.col("start_line").alias("first_line"))


@query("""select source, count(*) as documents, count_if(l.doc_id is not null) as labelled, count_if(l.toxic = 1) as excluded, count_if(l.quality = 1) as backed,
 case when count_if(l.toxic = 1) = count(*) then 'excluded' when count_if(l.quality = 1) = 0 then 'metadata-only' when count(*) - count_if(l.toxic = 1) > count_if(l.quality = 1) then 'missing-vector' else 'covered' end as status
from documents d left join labels l using (doc_id) group by source""", labelled="bigint", excluded="bigint", backed="bigint")
def coverage_by_file(spark, sf):
    d, lab = table(spark, sf, "documents"), table(spark, sf, "labels")
    fs = d.select(F.col("source").alias("id"), F.col("source").alias("path"), F.lit("en").alias("language")).distinct()
    chunks = d.join(lab, "doc_id", "left").select(F.col("doc_id").alias("id"), F.col("source").alias("file_id"), F.when(F.col("toxic") == 1, "toxic").alias("excluded_reason"), F.col("toxic").isNotNull().alias("labelled"))
    embedded = lab.where("quality = 1").select(F.col("doc_id").alias("chunk_id"), F.lit("current").alias("status"))
    symbols = lab.join(d, "doc_id").select(F.col("doc_id").alias("id"), F.col("source").alias("file_id"))
    none = symbols.select(F.col("id").alias("caller_symbol_id")).limit(0)
    rows = summaries.coverage(fs, chunks, symbols, none, embedded)
    return rows.select(F.col("path").alias("source"), F.col("chunk_count").alias("documents"), F.col("symbol_count").alias("labelled"), F.col("excluded_count").alias("excluded"), F.col("vector_count").alias("backed"), "status")


@query("select 'documents' as \"table\", count(*) as rows from documents union all select 'labels', count(*) from labels union all select 'pages', count(*) from pages union all select 'events', count(*) from events")
def storage_counts(spark, sf):
    return summaries.storage({n: table(spark, sf, n) for n in ("documents", "labels", "pages", "events")})


@query("""select l_returnflag as resolution_status, case when 1 - l_discount * 6 >= 0.85 then 'High' when 1 - l_discount * 6 >= 0.5 then 'Medium' else 'Low' end as confidence_bucket, count(*) as calls,
  round(avg(1 - l_discount * 6), 6) as avg_confidence from lineitem group by 1, 2""")
def resolution_buckets(spark, sf):
    calls = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("resolution_status"), (1 - F.col("l_discount") * 6).alias("confidence"))
    return summaries.resolution(calls)


@query("select o_orderkey, cast(o_orderdate as date) as started_on, o_orderstatus as status from orders order by o_orderdate desc, o_orderkey limit 50")
def runs_timeline(spark, sf):
    runs = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("started_at"), F.col("o_orderstatus").alias("status"))
    return summaries.timeline(runs).select(F.col("id").alias("o_orderkey"), F.to_date("started_at").alias("started_on"), "status")


@query("select user_id, event_id, event_type from events qualify row_number() over (partition by user_id order by ts desc, event_id desc) = 1")
def latest_by_key(spark, sf):
    return summaries.latest_by(table(spark, sf, "events").select("user_id", "event_id", "event_type", "ts"), ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "event_type")


_STATUS_SQL = "case event_type when 'click' then 'succeeded' when 'view' then 'succeeded' when 'signup' then 'pending' when 'purchase' then 'running' when 'error' then 'failed' end"


@query(f"""with j as (select user_id as generation_id, {_STATUS_SQL} as status from events)
select generation_id, count_if(status = 'pending') as pending, count_if(status = 'running') as running, count_if(status = 'succeeded') as succeeded, count_if(status = 'failed') as failed, count(*) as total,
 case when count_if(status = 'failed') > 0 then 'quality_failed' when count_if(status in ('pending', 'running')) > 0 then 'quality_pending' else 'quality_ready' end as quality_status,
 case when count_if(status = 'failed') = 0 and count_if(status in ('pending', 'running')) = 0 then 'quality' else 'fast' end as active_layer from j group by 1""", pending="bigint", running="bigint", succeeded="bigint", failed="bigint")
def job_progress(spark, sf):
    e = table(spark, sf, "events")
    state = F.when(F.col("event_type").isin("click", "view"), "succeeded").when(F.col("event_type") == "signup", "pending").when(F.col("event_type") == "purchase", "running").otherwise("failed")
    rows = summaries.progress(e.select(F.col("user_id").alias("generation_id"), state.alias("status")))
    rows = rows.withColumn("eligible", F.col("total")).withColumn("embedded", F.col("succeeded")).withColumn("model", F.lit("m")).withColumn("dimension", F.lit(64)).withColumn("is_latest", F.lit(True))
    return summaries.activation(rows).select("generation_id", "pending", "running", "succeeded", "failed", "total", "quality_status", "active_layer")


_ROUTES = Values(
    "mode string, active_layer string, quality_status string, quality_model string, is_complete boolean, is_latest boolean",
    [(m, a, s, q, c, n) for m in ("auto", "fast", "quality") for a in ("fast", "quality") for s in ("quality_ready", "quality_pending", "quality_stale") for q in ("big", None) for c in (True, False) for n in (True, False)],
)


@query(f"""with {_ROUTES.sql("r")}, w as (select *, case when quality_model is null then 'quality_not_configured' when active_layer <> 'quality' then 'quality_layer_inactive' when quality_status <> 'quality_ready' then quality_status
  when not is_complete then 'quality_manifest_incomplete' when not is_latest then 'quality_generation_outdated' end as why from r)
select * exclude (why), case when mode = 'fast' then 'fast' when why is null then 'quality' when mode = 'auto' then 'fast' end as layer, case when mode <> 'fast' then why end as reason from w""")
def fallback_routing(spark, sf):
    return routing.route(_ROUTES.df(spark))


_STEPS = [(a, b) for a in status.TRANSITIONS for b in status.TRANSITIONS]


@query(f"""with {Values("a string, b string", _STEPS).sql("s")} select a, b, a = b or (a, b) in ({", ".join(f"('{a}', '{b}')" for a, nexts in status.TRANSITIONS.items() for b in nexts)}) as allowed from s""")
def status_transitions(spark, sf):
    return Values("a string, b string", _STEPS).df(spark).withColumn("allowed", status.allowed("a", "b"))


@query(r"select doc_id, len(regexp_extract_all(text, '[\t\n\x0B\f\r ]+|[A-Za-z0-9_]{1,4}|[^\t\n\x0B\f\r A-Za-z0-9_]')) as tokens from documents")
def approximate_tokens(spark, sf):
    return table(spark, sf, "documents").select("doc_id", tokens.count(F.col("text")).alias("tokens"))


@query(
    "with r as (select doc_id, case "
    + " ".join(f"when regexp_matches(text, '{p.replace(chr(39), chr(39) * 2)}') then '{n}'" for n, p in secret_rules.RULES)
    + " end as excluded_reason from documents) select excluded_reason, count(*) as n from r where excluded_reason is not null group by 1"
)
def secret_exclusions(spark, sf):
    return summaries.exclusion_histogram(table(spark, sf, "documents").select(secret_rules.exclusion_reason(F.col("text")).alias("excluded_reason")))


@query("select md5(text) as text_hash, min(doc_id) as doc_id, count(*) as copies from documents group by 1")
def dedup_exact(spark, sf):
    return summaries.copies(table(spark, sf, "documents").select(F.md5("text").alias("text_hash"), "doc_id"), ["text_hash"], "doc_id")


# call graph ----------------------------------------------------------------------
@query(f"with e as ({EDGES_SQL}) select caller_symbol_id, callee_text, resolution_status, confidence from e where coalesce(callee_symbol_id, '') = 'Brand#2' or (callee_symbol_id is null and callee_text = 'Brand#2')")
def callers(spark, sf):
    return graph.callers(edges(spark, sf).withColumn("call_line", F.lit(1)), "Brand#2").select("caller_symbol_id", "callee_text", "resolution_status", "confidence")


@query(f"with e as ({EDGES_SQL}) select caller_symbol_id, callee_symbol_id, callee_text, resolution_status, confidence from e where caller_symbol_id = 'Brand#2'")
def callees(spark, sf):
    return graph.callees(edges(spark, sf).withColumn("call_line", F.lit(1)), "Brand#2").select("caller_symbol_id", "callee_symbol_id", "callee_text", "resolution_status", "confidence")


def _walk_sql(start: str, depth: int, backward: bool = False) -> str:
    a, b = ("callee_symbol_id", "caller_symbol_id") if backward else ("caller_symbol_id", "callee_symbol_id")
    only = "where callee_symbol_id is not null and resolution_status like 'resolved%'" if backward else ""
    call = "caller_symbol_id || '->' || callee_text"
    join = f"{call} || '>' || w.calls" if backward else f"w.calls || '>' || {call}"
    return f"""e as materialized ({EDGES_SQL}), g as (select * from e {only}), w(node, hops, calls, visited, min_confidence, status) as (
  select {b}, 1, {call}, case when {b} is null then [{a}] else [{a}, {b}] end, confidence, resolution_status from g where {a} = '{start}' and ({b} is null or {b} <> {a})
  union all select g.{b}, w.hops + 1, {join}, case when g.{b} is null then w.visited else list_append(w.visited, g.{b}) end, least(w.min_confidence, g.confidence), g.resolution_status
  from w join g on g.{a} = w.node where w.hops < {depth} and w.status like 'resolved%' and (g.{b} is null or not list_contains(w.visited, g.{b})))"""


_START = "Brand#11"


def _start(spark):
    return spark.createDataFrame([(_START,)], "id string")


@query(f"with recursive {_walk_sql(_START, 3)} select node, hops, calls, min_confidence, status as terminal_resolution_status from w")
def call_paths_from(spark, sf):
    return graph.paths_from(edges(spark, sf), _start(spark), 3).select("node", "hops", F.array_join("calls", ">").alias("calls"), "min_confidence", "terminal_resolution_status")


@query(f"with recursive {_walk_sql(_START, 3, True)} select node, hops, calls, min_confidence from w")
def call_paths_to(spark, sf):
    return graph.paths_to(edges(spark, sf), _start(spark), 3).select("node", "hops", F.array_join("calls", ">").alias("calls"), "min_confidence")


@query(f"with recursive {_walk_sql(_START, 3)} select hops, calls from w where node = 'Brand#12' or (node is null and calls like '%->size 41')")
def call_paths_between(spark, sf):
    e = edges(spark, sf)
    ends = spark.createDataFrame([("Brand#12",)], "id string")
    return graph.paths_between(e, _start(spark), ends, "size 41", 3).select("hops", F.array_join("calls", ">").alias("calls"))


@query(f"""with recursive {_walk_sql(_START, 2)}, x as (select calls, unnest(string_split(calls, '>')) as part from (select replace(calls, '->', '=>') as c, calls from w)),
d as (select e.* from e where caller_symbol_id = '{_START}' or callee_symbol_id = '{_START}'), p as (select distinct caller_symbol_id || '->' || callee_text as call_id, * from e),
steps as (select unnest(list_transform(string_split(replace(replace(calls, '->', chr(1)), '>', chr(2)), chr(2)), lambda s: replace(s, chr(1), '->'))) as call_id from w)
select path, count(*) as relationship_count from (
  select string_split(case when callee_symbol_id = '{_START}' then caller_symbol_id else callee_symbol_id end, ' ')[1] as path from d
  union all select string_split(caller_symbol_id, ' ')[1] from steps join p using (call_id)
  union all select string_split(callee_symbol_id, ' ')[1] from steps join p using (call_id)) where path is not null group by 1""")
def impact_related_files(spark, sf):
    e = edges(spark, sf)
    direct = e.where(F.col("callee_symbol_id") == _START).select(F.col("caller_path").alias("path")).union(e.where(F.col("caller_symbol_id") == _START).select("callee_path"))
    steps = graph.path_edges(graph.paths_from(e, _start(spark), 2), e, "transitive_callee")
    return summaries.related_files(direct, steps)


# name functions ------------------------------------------------------------------
_NAMES = Values("t string", [(x,) for x in ("crate::a::b", "self.run", "A#m", "std::io::Write", "a.b.c", "::", "", "super::x::y", "plain", "@scope/pkg/sub", "serde_json::Value", "left-pad", "src/lib/worker.rs", "a\\b\\c.ts", "/abs/x.rs", "a/../b.rs", "./x.rs", "crate::tests::covers_callee", "HTTP  Server / v2")])


@query(rf"""with {_NAMES.sql("n")} select t, coalesce(list_filter(string_split_regex(t, '[:.#]'), lambda x: x <> '')[-1], t) as suffix, regexp_replace(t, '\s+', '', 'g') as tight,
 regexp_replace(array_to_string(list_filter(string_split(t, '::'), lambda x: x <> ''), '::'), '^((crate|self|super)(::|$))+', '') as normal, regexp_extract(t, '^(.*)::[^:]+$', 1) as module,
 regexp_extract(t, '^(@[^/]+/[^/]+|[^/:.]+)', 1) as root, lower(replace(t, '-', '_')) as token,
 case when trim(regexp_replace(lower(t), '[^a-z0-9]+', '_', 'g'), '_') = '' then 'unknown' else trim(regexp_replace(lower(t), '[^a-z0-9]+', '_', 'g'), '_') end as slug,
 case when not (regexp_matches(replace(t, chr(92), '/'), '^([A-Za-z]:)?/') or len(list_filter(string_split(replace(t, chr(92), '/'), '/'), lambda x: x in ('', '.', '..'))) > 0) then replace(t, chr(92), '/') end as path from n""")
def name_functions(spark, sf):
    from codequarry.functions import ids

    t = F.col("t")
    return _NAMES.df(spark).select(
        "t", paths.symbol_suffix(t).alias("suffix"), paths.without_space(t).alias("tight"), paths.normalize_rust(t).alias("normal"), paths.module_path(t).alias("module"),
        paths.package_root(t).alias("root"), paths.package_token(t).alias("token"), ids.slug(t).alias("slug"), paths.normalize(t).alias("path"),
    )


_ERRORS = Values("e string", [(x,) for x in ("no such table: vectors", "Connection refused (os error 111)", "embedding model not found", "syntax error", "timed out waiting", "missing vector collection")])


@query(f"""with {_ERRORS.sql("x")} select e, case when regexp_matches(lower(e), 'missing vector|vector table|collection|no such table') then 'missing_vector_collection' when regexp_matches(lower(e), 'connection refused|connect|timed out|unreachable') then 'local_service_unavailable'
 when regexp_matches(lower(e), 'embed|ollama|model') then 'embedding_unavailable' else 'query_error' end as category from x""")
def error_categories(spark, sf):
    return _ERRORS.df(spark).select("e", reasons.error_category(F.col("e")).alias("category"))


# context -------------------------------------------------------------------------
@query("""with s as (select 'symbol:' || doc_id as item_id, source as path, 0 as ord, cast(null as double) as score from documents),
m as (select case when q.quality = 1 then 'symbol:' || q.doc_id else 'chunk:' || q.doc_id end as item_id, 'labels' as path, 1 as ord, q.doc_id / 1000.0::double as score from labels q),
u as (select item_id, case when count(distinct ord) = 2 then 'both' when min(ord) = 0 then 'structural' else 'semantic' end as source, max(score) as score, arg_min(path, ord) as path, arg_min(case when ord = 0 then 'symbol' else 'chunk' end, ord) as item_kind from (select * from s union all select * from m) group by 1)
select item_id, source, item_kind, path, score from u""")
def context_pack_merge(spark, sf):
    d, lab = table(spark, sf, "documents"), table(spark, sf, "labels")
    sym = context.symbol_items(d.select(F.col("doc_id").cast("string").alias("id"), F.col("source").alias("path"), F.lit(1).cast("bigint").alias("start_line"), F.lit(1).cast("bigint").alias("end_line")))
    hits = lab.select(F.when(F.col("quality") == 1, F.col("doc_id").cast("string")).alias("symbol_id"), F.col("doc_id").cast("string").alias("chunk_id"), F.lit("labels").alias("path"), F.lit(1).cast("bigint").alias("start_line"), F.lit(1).cast("bigint").alias("end_line"), (F.col("doc_id") / 1000.0).alias("score"))
    return context.merge(sym, context.chunk_items(hits)).select("item_id", "source", "item_kind", "path", "score")


@query("""with u as (select 'chunk:' || doc_id as item_id, doc_id / 1000.0::double as score from labels) select item_id, score, row_number() over (order by score desc, item_id) as place from u order by score desc, item_id limit 25""")
def context_pack_order(spark, sf):
    lab = table(spark, sf, "labels")
    hits = lab.select(F.lit(None).cast("string").alias("symbol_id"), F.col("doc_id").cast("string").alias("chunk_id"), F.lit("labels").alias("path"), F.lit(1).cast("bigint").alias("start_line"), F.lit(1).cast("bigint").alias("end_line"), (F.col("doc_id") / 1000.0).alias("score"))
    return context.ordered(context.chunk_items(hits), 25).select("item_id", "score", F.col("place").cast("bigint").alias("place"))


@query(f"with e as ({EDGES_SQL}) select coalesce(string_split(caller_symbol_id, ' ')[1], '<unknown>') || ':' || caller_symbol_id || ':' || callee_text || ':1' as evidence_key, min(caller_symbol_id || '->' || callee_text) as call_id from e group by 1")
def evidence_dedup(spark, sf):
    rows = edges(spark, sf).withColumn("path", F.col("caller_path")).withColumn("call_line", F.lit(1))
    return impact.distinct_calls(rows).select("evidence_key", "call_id")
