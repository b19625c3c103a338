"""Resolution of names: callees, references, imports, tests, containment."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from codequarry.functions import paths


def _by_spelling(named: DataFrame, on: list[str]) -> DataFrame:
    """Number of symbols and least id of each spelling.  The keys are rebuilt,
    so that a join shuffles both sides itself and AQE can split a hot one."""
    found = named.groupBy(*on).agg(F.countDistinct("sid").alias("n"), F.min("sid").alias("sid"))
    return found.select(*[F.concat(c, F.lit("")).alias(c) for c in on], "n", "sid")


def callees(calls: DataFrame, symbols: DataFrame, across_files: bool = False) -> DataFrame:
    """Resolve calls (call_id, file_id, callee_text, caller_name) to symbols
    (id, file_id, name, qualified_name).

    An exact qualified name among the candidate spellings: one match is
    resolved_exact (1.0), several ambiguous (0.2).  Else a match of the last
    part: one is resolved_local_candidate (0.75 in the file, 0.65 across
    files), several ambiguous.  Else unresolved (0.25).  Macros (``name!``) are
    unresolved with 0.2.  Across files the last parts of the qualified name must
    be those of the call, whole parts only.  Every step is an equi join of calls
    with one row a spelling (number of symbols, least id), so a name that very
    many symbols and calls share gives no more rows than it has calls.
    """
    own = calls.withColumn("suffix", paths.symbol_suffix(F.col("callee_text")))
    each = own.select("call_id", "file_id", F.explode(paths.relative_candidates(F.col("callee_text"), F.col("caller_name"))).alias("candidate"))
    each = each.withColumn("candidate", paths.normalize_rust(F.col("candidate"))).distinct()
    named = symbols.select(F.col("id").alias("sid"), "file_id", "name", paths.normalize_rust(F.col("qualified_name")).alias("candidate"), "qualified_name")
    on = ["candidate"] if across_files else ["candidate", "file_id"]
    exact = each.join(_by_spelling(named, on), on).groupBy("call_id").agg(F.sum("n").alias("exact_n"), F.min("sid").alias("exact_id"))
    local = own.select("call_id", "file_id", "callee_text", F.col("suffix").alias("name"))
    if across_files:
        local = local.where("contains(callee_text, '::')").withColumn("tail", paths.normalize_rust(F.col("callee_text")))
        named = named.withColumn("tail", F.explode(paths.test_name_candidates(F.col("qualified_name"))))
    on = ["name", "tail"] if across_files else ["name", "file_id"]
    near = local.join(_by_spelling(named, on), on).groupBy("call_id").agg(F.max("n").alias("near_n"), F.min("sid").alias("near_id"))
    both = calls.join(exact, "call_id", "left").join(near, "call_id", "left").na.fill(0, ["exact_n", "near_n"])
    macro = F.col("callee_text").endswith("!")
    case = lambda *v: F.when(macro, v[0]).when(F.col("exact_n") == 1, v[1]).when(F.col("exact_n") > 1, v[2]).when(F.col("near_n") == 1, v[3]).when(F.col("near_n") > 1, v[2]).otherwise(v[4])
    null = F.lit(None).cast("string")
    return both.select(
        *[c for c in calls.columns],
        case(null, F.col("exact_id"), null, F.col("near_id"), null).alias("callee_symbol_id"),
        case("unresolved", "resolved_exact", "ambiguous", "resolved_local_candidate", "unresolved").alias("resolution_status"),
        case(F.lit(0.2), F.lit(1.0), F.lit(0.2), F.lit(0.65 if across_files else 0.75), F.lit(0.25)).alias("confidence"),
    )


def references(refs: DataFrame, symbols: DataFrame) -> DataFrame:
    """Resolve references (reference_id, file_id, reference_text, confidence):
    one symbol of the last part's name 0.7, several ambiguous 0.35, none keeps
    the confidence of its kind."""
    own = refs.withColumn("name", paths.symbol_suffix(F.col("reference_text")))
    hits = own.select("reference_id", "file_id", "name").join(symbols.select(F.col("id").alias("sid"), "file_id", "name"), ["file_id", "name"])
    found = hits.groupBy("reference_id").agg(F.countDistinct("sid").alias("n"), F.min("sid").alias("sid"))
    both = refs.join(found, "reference_id", "left").na.fill(0, ["n"])
    return both.select(
        *[c for c in refs.columns if c != "confidence"],
        F.when(F.col("n") == 1, F.col("sid")).alias("target_symbol_id"),
        F.when(F.col("n") == 1, "resolved_local_candidate").when(F.col("n") > 1, "ambiguous").otherwise("unresolved").alias("resolution_status"),
        F.when(F.col("n") == 1, 0.7).when(F.col("n") > 1, 0.35).otherwise(F.col("confidence")).alias("confidence"),
    )


def containing(nodes: DataFrame, symbols: DataFrame) -> DataFrame:
    """(node_id, symbol_id): the smallest symbol around a node (byte range), or
    else the next symbol that starts within two lines after it.  Equi join on
    the file, ranges as residual."""
    s = symbols.select(F.col("id").alias("symbol_id"), "file_id", F.col("start_byte").alias("sb"), F.col("end_byte").alias("eb"), F.col("start_line").alias("sl"))
    pairs = nodes.select("node_id", "file_id", "start_byte", "end_byte", "end_line").join(s, "file_id", "left")
    around = (F.col("sb") <= F.col("start_byte")) & (F.col("end_byte") <= F.col("eb"))
    after = (F.col("sb") >= F.col("end_byte")) & (F.col("sl") - F.col("end_line") <= 2)
    inner = F.min(F.when(around, F.struct(F.col("eb") - F.col("sb"), F.col("symbol_id"))))
    follow = F.min(F.when(after, F.struct(F.col("sb") - F.col("end_byte"), F.col("symbol_id"))))
    return pairs.groupBy("node_id").agg(F.coalesce(inner["symbol_id"], follow["symbol_id"]).alias("symbol_id"))


def import_usages(imports: DataFrame, dependencies: DataFrame) -> DataFrame:
    """Imports (reference_id, import_path, confidence) with the first manifest
    dependency (dependency_id, ordinal, package_name, dependency_name) that
    their root names; segment-aligned, ``-`` and ``_`` alike.  The confidence
    grows by 0.35, at most to 1."""
    own = imports.withColumn("token", paths.package_token(paths.package_root(F.col("import_path"))))
    named = dependencies.select("dependency_id", "ordinal", F.explode(F.array_distinct(F.array(paths.package_token(F.col("package_name")), paths.package_token(F.col("dependency_name"))))).alias("token"))
    hits = own.join(named, "token").withColumn("nth", F.row_number().over(W.partitionBy("reference_id").orderBy("ordinal", "dependency_id"))).where("nth = 1")
    return hits.select("reference_id", "dependency_id", "import_path", paths.referenced_symbol(F.col("import_path")).alias("referenced_symbol"), F.round(F.least(F.lit(1.0), F.col("confidence") + 0.35), 4).alias("confidence"))


def test_targets(tests: DataFrame, symbols: DataFrame, calls: DataFrame) -> DataFrame:
    """(test_id, target_symbol_id, target_file_id, relationship_kind, confidence).

    direct_call 1.0 x the call's confidence, naming_convention 0.7 (same
    normalised name in the file), fixture_path 0.6 (same file stem),
    same_module 0.3 (same file).
    """
    t = tests.select(F.col("id").alias("test_id"), F.col("symbol_id").alias("test_symbol"), F.col("file_id").alias("test_file"), F.col("path").alias("test_path"), F.col("name").alias("test_name"))
    s = symbols.select(F.col("id").alias("target_symbol_id"), F.col("file_id").alias("target_file_id"), "name", "path")
    plain = lambda c: F.regexp_replace(F.lower(c), r"^tests?_?|_?tests?$|^(it|covers|checks)_", "")
    stem = lambda c: F.regexp_replace(F.lower(F.regexp_extract(c, r"([^/]+?)\.[^.]+$", 1)), r"_?(tests?|spec)$|\.(tests?|spec)$", "")
    direct = t.join(calls.where("callee_symbol_id is not null").select(F.col("caller_symbol_id").alias("test_symbol"), F.col("callee_symbol_id").alias("target_symbol_id"), "confidence"), "test_symbol").join(s, "target_symbol_id").select("test_id", "target_symbol_id", "target_file_id", F.lit("direct_call").alias("relationship_kind"), "confidence")
    same = t.join(s, (F.col("test_file") == F.col("target_file_id")) & (F.coalesce("test_symbol", F.lit("")) != F.col("target_symbol_id")))
    alike = plain(F.col("test_name")) == plain(F.col("name"))
    naming = same.where(alike).select("test_id", "target_symbol_id", "target_file_id", F.lit("naming_convention").alias("relationship_kind"), F.lit(0.7).alias("confidence"))
    module = same.where(~alike).select("test_id", "target_symbol_id", "target_file_id", F.lit("same_module").alias("relationship_kind"), F.lit(0.3).alias("confidence"))
    fixture = t.withColumn("stem", stem(F.col("test_path"))).join(s.select("target_file_id", "path").distinct().withColumn("stem", stem(F.col("path"))), "stem").where("test_file <> target_file_id and stem <> ''")
    fixture = fixture.select("test_id", F.lit(None).cast("string").alias("target_symbol_id"), "target_file_id", F.lit("fixture_path").alias("relationship_kind"), F.lit(0.6).alias("confidence")).distinct()
    return direct.unionByName(naming).unionByName(fixture).unionByName(module)


def likely_tests(targets: DataFrame, tests: DataFrame, symbol_ids: DataFrame, file_ids: DataFrame, least: float = 0.6) -> DataFrame:
    """Distinct qualified names of tests for the symbols or their files."""
    sure = targets.where(F.col("confidence") >= least)
    hit = sure.join(symbol_ids.select(F.col("id").alias("target_symbol_id")), "target_symbol_id", "left_semi").select("test_id")
    hit = hit.union(sure.where("target_symbol_id is null").join(file_ids.select(F.col("id").alias("target_file_id")), "target_file_id", "left_semi").select("test_id"))
    return tests.join(hit.withColumnRenamed("test_id", "id"), "id", "left_semi").select("qualified_name").distinct().orderBy("qualified_name")


def callback_symbols(cases: DataFrame, symbols: DataFrame) -> DataFrame:
    """(case_id, symbol_id) where the callback's name is that of one symbol."""
    hits = cases.select("case_id", "file_id", F.col("callback").alias("name")).join(symbols.select(F.col("id").alias("symbol_id"), "file_id", "name"), ["file_id", "name"])
    return hits.withColumn("n", F.count("*").over(W.partitionBy("case_id"))).where("n = 1").select("case_id", "symbol_id")
