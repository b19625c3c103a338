"""The query catalogue as Python functions over a store.

``TOOLS`` names every operation with its arguments, the way a service would
list them; ``call`` validates arguments and returns DataFrames.  ``envelope``
turns a DataFrame into rows of JSON with the evidence contract.
"""

from __future__ import annotations

import inspect
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from codequarry.functions import ids, paths, status
from codequarry.operators import freshness as fresh, graph, resolve, search, store as st, summaries, vectors
from codequarry.plans import context, doctor, impact as imp, routing, semantic as sem
from codequarry.scratch import Scratch
from codequarry.sources import discovery, embedder, git, manifests, parser, runtime_log, targets


@dataclass
class Engine:
    """One repository's tables and the questions about them."""

    spark: SparkSession
    store: st.Store
    root: str | None = None
    repository_id: str = "repo"
    ref_id: str | None = None
    #: Live paths and hashes, where they come from elsewhere than a tree at ``root``.
    live: DataFrame | None = None

    # tables -----------------------------------------------------------------
    def table(self, name: str) -> DataFrame:
        return self.store.read(name)

    def symbols(self) -> DataFrame:
        files = self.table("files").select(F.col("id").alias("file_id"), "path")
        return search.scoped(self.table("symbols").join(files, "file_id"), self.table("ref_files"), self.ref_id)

    def edges(self) -> DataFrame:
        own = self.symbols().select(F.col("id").alias("caller_symbol_id"))
        calls = self.table("calls").join(own, "caller_symbol_id", "left_semi")
        return graph.enriched_edges(calls, self.table("symbols"), self.table("files"))

    def current(self) -> DataFrame:
        """Live paths and hashes of the working tree."""
        if self.live is not None:
            return self.live
        return discovery.file_facts(discovery.read(self.spark, self.root), self.repository_id).select("path", "content_hash")

    # writes -----------------------------------------------------------------
    def index(self, run_id: str, parser_version: str = "1", semantic: bool = False) -> dict[str, int]:
        """Discover, parse, resolve and store; changed files only.

        A run row is written first and ended last, ``failed`` with the error if
        anything stops it; each table's pointer flips after its snapshot is
        written.  With ``semantic`` the chunks are embedded, too.
        """
        run = st.started_run(self.spark, run_id, self.repository_id, "semantic" if semantic else "offline", parser_version, self.ref_id)
        self.store.upsert("index_runs", run)
        try:
            counts = self._index(run_id, parser_version, semantic)
        except Exception as e:
            self.store.upsert("index_runs", st.finished_run(run, "failed", str(e)))
            raise
        self.store.upsert("index_runs", st.finished_run(run, "success", **counts))
        return counts

    def _index(self, run_id: str, parser_version: str, semantic: bool) -> dict[str, int]:
        found = discovery.read(self.spark, self.root)
        files = discovery.file_facts(found, self.repository_id)
        old = self.table("files").where(F.col("repository_id") == self.repository_id)
        skip = search.unchanged(files, old, parser_version).select("path")
        todo = found.join(skip, "path", "left_anti").join(files.select("path", "id", "content_hash", "repository_id"), "path")
        stamped = todo.select("id", "repository_id", "path", "language", "content_hash", F.current_timestamp().alias("indexed_at"), F.lit(run_id).alias("index_run_id"), F.lit(parser_version).alias("parser_version"))
        # written between the steps: plans stay small and files are parsed once
        scratch = Scratch(self.spark, "index")
        records = scratch.save(parser.extract(todo), "records")
        new = parser.facts(records, stamped.select("path", "id", "repository_id"), run_id, parser_version)
        gone = old.join(files.select("path"), "path", "left_anti").select(F.col("id").alias("file_id"))
        changed = old.join(todo.select("path"), "path", "left_semi").select(F.col("id").alias("file_id"))
        # ids of files whose facts go; those of other repositories are not read
        out = scratch.save(gone.union(changed).distinct(), "out")
        stamp = lambda df: df.withColumn("index_run_id", F.lit(run_id)).withColumn("parser_version", F.lit(parser_version))

        changes = fresh.diff(old.select("path", "content_hash"), files.select("path", "content_hash"))
        events = fresh.file_events(changes, run_id, new["diagnostics"]).withColumn("repository_id", F.lit(self.repository_id)).withColumn("occurred_at", F.current_timestamp())
        events = events.withColumn("id", ids.stable_id(F.col("index_run_id"), F.col("path"))).withColumn("repository_ref_id", F.lit(self.ref_id).cast("string"))

        # names: first inside the file, then what is left across files
        symbols = scratch.save(new["symbols"], "symbols")
        raw = scratch.save(new["calls"].withColumnRenamed("id", "call_id"), "raw")
        calls = scratch.save(resolve.callees(raw, symbols), "local")
        mine = self.own("symbols")
        left = mine.join(out, "file_id", "left_semi").select(F.col("id").alias("caller_symbol_id"))
        known = scratch.save(st.replace_file_facts(mine, symbols.drop("path"), out, out).select("id", "file_id", "name", "qualified_name"), "known")
        rust = todo.where("language = 'rust'").select(F.col("id").alias("file_id"))
        open_ = calls.where("resolution_status = 'unresolved'").join(rust, "file_id", "left_semi").select(*raw.columns)
        across = scratch.save(resolve.callees(scratch.save(open_, "open"), known, across_files=True), "across")
        calls = calls.join(across.select("call_id"), "call_id", "left_anti").unionByName(across).withColumnRenamed("call_id", "id")

        refs = scratch.save(new["symbol_references"].withColumnRenamed("id", "reference_id"), "references")
        around = resolve.containing(refs.select(F.col("reference_id").alias("node_id"), "file_id", "start_byte", "end_byte", "end_line"), symbols)
        refs = resolve.references(refs, symbols).join(around.select(F.col("node_id").alias("reference_id"), F.col("symbol_id").alias("source_symbol_id")), "reference_id", "left").withColumnRenamed("reference_id", "id")
        deps = stamp(manifests.dependencies(todo.select(F.col("id").alias("file_id"), "path", "content"), self.repository_id))

        self.store.append("file_index_events", events)
        lost = scratch.save(left, "lost")
        moved = scratch.save(_relinked(self.table("calls").join(lost, "caller_symbol_id", "left_anti"), known), "moved")
        self.store.change("calls", new=calls.unionByName(moved, allowMissingColumns=True), gone=lost)
        for name, rows in (("symbols", symbols.drop("path")), ("chunks", new["chunks"]), ("symbol_references", refs), ("tests", new["tests"]), ("dependencies", deps)):
            self.store.change(name, new=rows, gone=out)
        self.store.change("files", new=stamped, gone=out.select(F.col("file_id").alias("id")))
        self._relate()
        if self.ref_id is not None:
            now = self.table("files").where(F.col("repository_id") == self.repository_id)
            self.store.upsert("ref_files", st.link_files(self.ref_id, now, run_id))
            left = self.table("ref_files").where(F.col("repository_ref_id") == self.ref_id).join(now.select("path"), "path", "left_anti")
            self.store.delete("ref_files", left.select("repository_ref_id", "path"))
        embedded = 0
        if semantic:
            every = parser.extract(found).where("record_kind = 'chunk'")
            named = every.join(self.table("files").select("path", F.col("id").alias("file_id")), "path").withColumn("chunk_id", ids.stable_id(F.col("file_id"), F.col("kind"), F.col("start_byte"), F.col("end_byte"), F.md5("text")))
            sem.embed_chunks(self.store, named.select("chunk_id", "text"), self.repository_id)
            embedded = self.table("chunk_embeddings").count()
        return {"files_seen": files.count(), "files_indexed": self.table("files").where(F.col("index_run_id") == run_id).count(), "chunks_embedded": embedded}

    def own(self, name: str) -> DataFrame:
        """Facts of this repository's files (column file_id)."""
        files = self.table("files").where(F.col("repository_id") == self.repository_id).select(F.col("id").alias("file_id"))
        return self.table(name).join(files, "file_id", "left_semi")

    def _relate(self) -> None:
        """Facts that join other facts of the same repository: dependency usages
        and test targets."""
        files = self.table("files").where(F.col("repository_id") == self.repository_id).select(F.col("id").alias("file_id"), "path")
        imports = self.own("symbol_references").where("reference_kind = 'import'").select(F.col("id").alias("reference_id"), "file_id", "source_symbol_id", "line", "confidence", paths.import_path(F.col("reference_text")).alias("import_path")).where("import_path is not null")
        order = W.partitionBy("repository_id").orderBy("manifest_path", "dependency_name", "id")
        deps = self.own("dependencies").withColumn("ordinal", F.row_number().over(order)).select(F.col("id").alias("dependency_id"), "ordinal", "package_name", "dependency_name")
        used = resolve.import_usages(imports, deps).join(imports.select("reference_id", "file_id", "source_symbol_id", "line"), "reference_id")
        usages = used.select(ids.stable_id(F.col("reference_id"), F.col("dependency_id")).alias("id"), F.lit(self.repository_id).alias("repository_id"), "dependency_id", "file_id", "source_symbol_id", F.lit("import").alias("usage_kind"), "import_path", "referenced_symbol", "line", "confidence", F.lit("import_root_matches_manifest").alias("reason"))
        here = self.spark.createDataFrame([(self.repository_id,)], "repository_id string")
        self.store.change("dependency_usages", new=usages, gone=here)
        symbols = self.own("symbols").join(files, "file_id")
        calls = self.table("calls").join(symbols.select(F.col("id").alias("caller_symbol_id")), "caller_symbol_id", "left_semi")
        aims = resolve.test_targets(self.own("tests"), symbols, calls)
        rows = aims.withColumn("id", ids.stable_id(F.col("test_id"), F.col("relationship_kind"), F.col("target_symbol_id"), F.col("target_file_id"))).withColumn("repository_id", F.lit(self.repository_id)).withColumn("reason", F.col("relationship_kind"))
        self.store.change("test_targets", new=rows, gone=here)

    # questions ----------------------------------------------------------------
    def find_symbol(self, query: str, limit: int | None = None) -> DataFrame:
        return search.symbols(self.symbols(), query, limit)

    def callers(self, symbol: str) -> DataFrame:
        return graph.evidence(graph.callers(self.edges(), symbol), self.current(), "caller")

    def callees(self, symbol: str) -> DataFrame:
        return graph.evidence(graph.callees(self.edges(), symbol), self.current(), "callee")

    def call_path(self, source: str, target: str, max_depth: int | None = None) -> DataFrame:
        s = self.symbols()
        return graph.paths_between(self.edges(), search.exact(s, source), search.exact(s, target), target, max_depth)

    def impact(self, symbol: str, max_depth: int | None = None) -> dict[str, DataFrame]:
        tables = {n: self.table(n) for n in ("dependency_usages", "dependencies", "files", "test_targets", "tests")}
        return imp.impact(search.exact(self.symbols(), symbol), self.edges(), self.current(), tables, max_depth)

    def explain_change(self, changes: str, max_depth: int | None = None) -> dict[str, DataFrame]:
        return imp.explain_change(targets.read_targets(self.spark, changes), self.symbols(), self.edges(), self.current(), None, max_depth)

    def staleness(self, symbol: str | None = None, paths: list[str] | None = None) -> DataFrame:
        scope = None
        if symbol is not None:
            scope = search.symbols(self.symbols(), symbol).select("path").distinct()
        if paths is not None:
            listed = self.spark.createDataFrame([(p,) for p in dict.fromkeys(paths)], "path string")
            if scope is not None and (bad := search.outside_scope(listed, scope)):
                raise ValueError(f"paths outside the symbol's files: {', '.join(bad)}")
            scope = listed
        indexed = search.provenance(self.table("files"))
        return fresh.report(indexed, self.current(), scope).orderBy("path")

    def search(self, query: str, limit: int | None = None, mode: str = "auto", embed=embedder.hashed) -> DataFrame:
        status.parse("semantic_mode", mode)
        if not query.strip():
            raise ValueError("the query is empty")
        points = self.table("vector_points").where((F.col("repository_id") == self.repository_id) & (F.col("semantic_layer") == self.layer(mode)[0]))
        return vectors.nearest(points, embed([query])[0], status.clamp(limit, 8))

    def layer(self, mode: str) -> tuple[str, str | None]:
        g = summaries.latest_by(self.table("semantic_generations"), ["repository_id"], ["created_at", "id"]).where(F.col("repository_id") == self.repository_id)
        done = (F.col("embeddable_chunks") > 0) & (F.col("quality_embedded_chunks") >= F.col("embeddable_chunks"))
        rows = g.select(F.lit(mode).alias("mode"), "active_layer", "quality_status", "quality_model", done.alias("is_complete"), F.lit(True).alias("is_latest"))
        return routing.choose(rows)

    def context_pack(self, query: str, limit: int | None = None) -> DataFrame:
        edges = self.edges()
        parts = context.pack(search.symbols(self.symbols(), query, limit), graph.callers(edges, query), graph.callees(edges, query), limit)
        hits = self.search(query, limit) if self.store.exists("vector_points") else None
        return context.unified(parts, hits, limit)

    def semantic_status(self) -> DataFrame:
        return sem.semantic_status(self.table("semantic_generations"), self.table("quality_embedding_jobs"))

    def repository_status(self) -> DataFrame:
        return sem.repository_status(*[self.table(n) for n in ("files", "chunks", "symbols", "index_runs", "repository_refs")])

    def debug_context(self, log: str, limit: int | None = None) -> dict[str, DataFrame]:
        logs = self.spark.createDataFrame([("input", runtime_log.runtime_input(log))], "log_id string, text string")
        return context.debug(logs, self.root or "", self.table("files"), self.symbols(), self.edges(), self.current(), limit)

    def vector_verify(self, layer: str = "fast") -> DataFrame:
        status.parse("semantic_layer", layer)
        g = summaries.latest_by(self.table("semantic_generations"), ["repository_id"], ["created_at", "id"]).select(F.col("id").alias("generation_id"))
        want = self.table("chunk_embeddings").where((F.col("semantic_layer") == layer) & (F.col("status") == "current")).join(g, "generation_id", "left_semi")
        want = want.join(self.table("chunks").select(F.col("id").alias("chunk_id"), "start_line", "end_line"), "chunk_id").join(self.table("files").select(F.col("id").alias("file_id"), "path"), "file_id")
        have = vectors.scroll(self.table("vector_points").where(F.col("semantic_layer") == layer), self.repository_id)
        return vectors.verify(want, have)

    def vector_repair(self, layer: str = "fast") -> DataFrame:
        return vectors.repair_plan(self.vector_verify(layer), layer)

    def index_status(self) -> DataFrame:
        return summaries.storage({n: self.table(n) for n in ("files", "chunks", "symbols", "calls", "symbol_references", "dependencies", "tests")})

    def coverage(self) -> DataFrame:
        return summaries.coverage(*[self.table(n) for n in ("files", "chunks", "symbols", "calls", "chunk_embeddings")])

    def timeline(self) -> DataFrame:
        return summaries.timeline(self.table("index_runs"))

    def git(self) -> DataFrame:
        return git.read(self.spark, self.root)

    def doctor(self) -> DataFrame:
        return doctor.diagnose(self.spark, self.store, self.staleness() if self.root else None)


def _relinked(calls: DataFrame, symbols: DataFrame) -> DataFrame:
    """Calls by ``symbols`` whose target is not among them any more, resolved
    again (ids follow from content, so a changed file has new symbols)."""
    caller = symbols.select(F.col("id").alias("caller_symbol_id"), F.col("qualified_name").alias("caller_name"), "file_id")
    lost = calls.where("callee_symbol_id is not null").join(symbols.select(F.col("id").alias("callee_symbol_id")), "callee_symbol_id", "left_anti")
    open_ = lost.select(F.col("id").alias("call_id"), "caller_symbol_id", "callee_text", "call_line", "index_run_id", "parser_version").join(caller, "caller_symbol_id")
    return resolve.callees(open_, symbols, across_files=True).withColumnRenamed("call_id", "id")


#: Operation -> method of ``Engine``.
TOOLS = {
    n: getattr(Engine, n)
    for n in ("search", "find_symbol", "callers", "callees", "call_path", "impact", "explain_change", "staleness", "context_pack", "debug_context", "index_status", "repository_status", "semantic_status", "coverage", "timeline", "vector_verify", "vector_repair", "doctor")
}


def catalogue() -> list[dict]:
    """Name, description and arguments of every operation."""
    out = []
    for name, f in TOOLS.items():
        args = [{"name": p.name, "type": str(p.annotation), "required": p.default is p.empty} for p in list(inspect.signature(f).parameters.values())[1:]]
        out.append({"name": name, "description": (inspect.getdoc(f) or name.replace("_", " ")).split("\n")[0], "arguments": args})
    return out


def call(engine: Engine, name: str, **arguments):
    """Run an operation; ValueError for unknown names and arguments."""
    if name not in TOOLS:
        raise ValueError(f"unknown operation {name!r}")
    try:
        bound = inspect.signature(TOOLS[name]).bind(engine, **arguments)
    except TypeError as e:
        raise ValueError(str(e)) from None
    return TOOLS[name](*bound.args, **bound.kwargs)


def envelope(df: DataFrame, read_only: bool = True) -> DataFrame:
    """Rows as JSON, each with the contract that says what evidence is."""
    contract = F.struct(F.lit("metadata_only").alias("content"), F.lit(read_only).alias("read_only"), F.lit("deterministic").alias("order"))
    return df.select(F.to_json(F.struct(contract.alias("contract"), F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("data"))).alias("json"))
