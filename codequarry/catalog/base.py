"""Registration of queries, and the tables re-read as facts of a code index.

Documents stand for files (path = source/doc_id, hash = md5 of the text).  The
live tree is the same documents, but those labelled toxic have changed and
those of quality 0 are gone; conversations are files that were never indexed.
Parts stand for call edges: brand -> type -> size -> brand.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from codequarry.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None, **types: str):
    """Register the function under its name, with its SQL; ``types`` are columns
    whose type in DuckDB is another than in Spark (sums, counts and literals)."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            casts = ", ".join(f'"{c}"::{t} as "{c}"' for c, t in types.items())
            ORACLE[f.__name__] = f"select * replace ({casts}) from ({sql})" if types else sql
        return f

    return add


# documents as files ----------------------------------------------------------
FILES_SQL = "select source || '/' || doc_id as path, md5(text) as content_hash, case when lang = 'en' then 'run' end as index_run_id, case when lang in ('en', 'fr') then 'p1' end as parser_version, case when lang <> 'es' then 'now' end as indexed_at from documents"
LIVE_SQL = """select d.source || '/' || d.doc_id as path, case when l.toxic = 1 then md5(d.text || 'changed') else md5(d.text) end as content_hash
  from documents d left join labels l using (doc_id) where coalesce(l.quality, 1) = 1
  union all select 'talk/' || conv_id as path, md5(string_agg(text, chr(10) order by turn)) as content_hash from conversations group by conv_id"""


def files(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    return d.select(
        F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("path"), F.md5("text").alias("content_hash"), F.when(F.col("lang") == "en", "run").alias("index_run_id"),
        F.when(F.col("lang").isin("en", "fr"), "p1").alias("parser_version"), F.when(F.col("lang") != "es", "now").alias("indexed_at"),
    )


def live(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left").where("coalesce(quality, 1) = 1")
    kept = d.select(F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("path"), F.when(F.col("toxic") == 1, F.md5(F.concat("text", F.lit("changed")))).otherwise(F.md5("text")).alias("content_hash"))
    t = table(spark, sf, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("t"))
    return kept.union(t.select(F.concat(F.lit("talk/"), F.col("conv_id").cast("string")), F.md5(F.array_join(F.transform("t", lambda x: x["text"]), "\n"))))


# parts as calls ----------------------------------------------------------------
EDGES_SQL = """select distinct caller_symbol_id, case when callee_text like 'size 4%' then null else callee_text end as callee_symbol_id, callee_text,
    case when callee_text like 'size 4%' then 'unresolved' when callee_text like 'size%' then 'resolved_local_candidate' else 'resolved_exact' end as resolution_status,
    case when callee_text like 'size 4%' then 0.25 when callee_text like 'size%' then 0.75 else 1.0 end::double as confidence
  from (select p_brand as caller_symbol_id, p_type as callee_text from part union all select p_type, 'size ' || p_size from part union all select 'size ' || p_size, p_brand from part)"""


def edges(spark: SparkSession, sf: str) -> DataFrame:
    """Calls with the columns that the graph operators need."""
    p = table(spark, sf, "part")
    size = F.concat(F.lit("size "), F.col("p_size").cast("string"))
    raw = p.select(F.col("p_brand").alias("a"), F.col("p_type").alias("b")).union(p.select("p_type", size)).union(p.select(size, "p_brand")).distinct()
    lost, near = F.col("b").like("size 4%"), F.col("b").like("size%")
    return raw.select(
        F.col("a").alias("caller_symbol_id"), F.when(~lost, F.col("b")).alias("callee_symbol_id"), F.col("b").alias("callee_text"),
        F.when(lost, "unresolved").when(near, "resolved_local_candidate").otherwise("resolved_exact").alias("resolution_status"),
        F.when(lost, 0.25).when(near, 0.75).otherwise(1.0).alias("confidence"), F.concat_ws("->", "a", "b").alias("call_id"),
        F.col("a").alias("caller_short"), F.col("a").alias("caller_name"), F.when(~lost, F.col("b")).alias("callee_short"), F.when(~lost, F.col("b")).alias("callee_name"),
        F.element_at(F.split("a", " "), 1).alias("caller_path"), F.when(~lost, F.element_at(F.split("b", " "), 1)).alias("callee_path"),
    )


# inlined tables ------------------------------------------------------------------
def literal(value) -> str:
    if value is None:
        return "null"
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, (int, float)):
        return repr(value)
    return "'" + value.replace("'", "''") + "'"


class Values:
    """A small table that both engines get: ``Values("a string, b bigint", rows)``."""

    def __init__(self, schema: str, rows: list[tuple]):
        self.schema, self.rows = schema, rows

    def df(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows, self.schema)

    def sql(self, name: str) -> str:
        """``name(columns) as (values ...)`` for a WITH clause, typed."""
        kinds = {"string": "varchar", "bigint": "bigint", "double": "double", "boolean": "boolean", "int": "integer"}
        columns = [c.split() for c in self.schema.split(", ")]
        cells = ", ".join("(" + ", ".join(literal(v) for v in r) + ")" for r in self.rows)
        typed = ", ".join(f"cast({n} as {kinds[k]}) as {n}" for n, k in columns)
        return f"{name} as (select {typed} from (values {cells}) v({', '.join(n for n, _ in columns)}))"
