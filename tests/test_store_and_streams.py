import os

import pytest
from codequarry.operators import freshness, store as st, vectors
from codequarry.operators.store import Store
from codequarry.plans import api, doctor, routing
from codequarry.schema import TABLES
from codequarry.sources import discovery, embedder, git, targets
from codequarry.streaming import jobs, snapshots, state
from pyspark.sql import functions as F


@pytest.fixture
def repo(tmp_path):
    root = tmp_path / "repo"
    for path, text in {
        "src/lib.rs": "pub fn helper() {}\npub fn caller() { helper(); }\n", "src/other.rs": "use crate::helper;\nfn far() { crate::helper(); }\n", "Cargo.toml": '[dependencies]\nsqlx = "0.7"\n',
        "web/app.js": "function go() {}\n", "target/x.rs": "fn no() {}", "node_modules/a.js": "x", "config/a.json": "{}", "docs/b.json": "{}", ".gitignore": "ignored/\n*.gen.rs\n!keep.gen.rs\n", "ignored/a.rs": "fn a() {}", "src/a.gen.rs": "fn b() {}", "src/keep.gen.rs": "fn c() {}", "_hidden.rs": "fn h() {}",
    }.items():
        p = root / path
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)
    os.symlink(root / "src", root / "link")
    return str(root)


def test_discovery(spark, repo):
    assert list(discovery.walk(repo, "config")) == ["Cargo.toml", "_hidden.rs", "config/a.json", "src/keep.gen.rs", "src/lib.rs", "src/other.rs", "web/app.js"]
    rows = discovery.file_facts(discovery.read(spark, repo, "config"), "r").collect()
    assert len(rows) == 7 and len({r.id for r in rows}) == 7 and all(len(r.id) == 32 for r in rows)
    assert discovery.json_roots(" a/b/ ,/abs, c:x, ., ../x") == ["a/b", "."]
    assert discovery.of_language(discovery.read(spark, repo), "rust").count() == 4


def test_git(spark, tmp_path):
    root = tmp_path / "g"
    (root / ".git/refs/heads").mkdir(parents=True)
    assert git.detect(str(tmp_path))["ref_kind"] == "non_git"
    (root / ".git/HEAD").write_text("ref: refs/heads/main\n")
    (root / ".git/refs/heads/main").write_text("a" * 40 + "\n")
    (root / ".git/packed-refs").write_text(f"# pack\n{'b' * 40} refs/heads/old\n{'c' * 40} refs/heads/main\n")
    row = git.read(spark, str(root)).first()
    assert (row.ref_kind, row.ref_name, row.head_oid, row.branches) == ("branch", "main", "a" * 40, ["main", "old"])
    (root / ".git/HEAD").write_text("d" * 40)
    assert git.detect(str(root))["ref_kind"] == "detached"


def test_store_merges_and_points(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}/store")
    assert s.create("files") and not s.create("files")
    row = lambda i, h: {"id": i, "repository_id": "r", "path": f"{i}.rs", "language": "rust", "content_hash": h}
    files = lambda *rows: spark.createDataFrame(list(rows), "id string, repository_id string, path string, language string, content_hash string")
    s.upsert("files", files(row("a", "1"), row("b", "1")))
    s.upsert("files", files(row("b", "2"), row("c", "1")))
    assert {(r.id, r.content_hash) for r in s.read("files").collect()} == {("a", "1"), ("b", "2"), ("c", "1")}
    s.delete("files", spark.createDataFrame([("a",)], "id string"))
    assert s.read("files").count() == 2 and s.read("files").schema.simpleString() == TABLES["files"].simpleString()
    point = lambda i, v, n=None: (f"p{i}", v, n or len(v))
    points = lambda *rows: spark.createDataFrame(list(rows), "vector_point_id string, embedding array<float>, embedding_dimension bigint").withColumns({c: F.lit("x") for c in ("vector_store", "vector_table", "repository_id", "file_id", "chunk_id", "path", "language", "chunk_kind", "content_hash", "text_hash", "embedding_model", "semantic_layer")}).withColumns({c: F.lit(1).cast("bigint") for c in ("vector_rowid", "start_line", "end_line")})
    s.upsert_points(points(point(1, [1.0, 0.0]), point(2, [0.0, 1.0]), point(1, [0.6, 0.8])))
    assert s.read("vector_points").count() == 2
    assert [r.vector_point_id for r in vectors.nearest(s.read("vector_points"), [0.0, 1.0], 5).collect()] == ["p2", "p1"]
    for bad in (points(point(1, [1.0]), point(2, [1.0, 2.0])), points(point(1, [])), points(point(1, [1.0], 3))):
        with pytest.raises(ValueError):
            s.upsert_points(bad)
    for vector, k, dim in (([], 1, None), ([1.0], 0, None), ([1.0], 1, 2)):
        with pytest.raises(ValueError):
            vectors.check_query(vector, k, dim)
    assert vectors.nearest_for_files(s.read("vector_points"), "x", [], [1.0, 0.0], 3).collect() == []


def test_a_stop_at_any_step_leaves_the_old_or_the_new_table(spark, tmp_path, monkeypatch):
    rows = lambda *r: spark.createDataFrame(list(r), "id string, content_hash string").withColumns({c: F.lit("x") for c in ("repository_id", "path", "language")})
    old, new = {("a", "1"), ("b", "1")}, {("a", "1"), ("b", "2"), ("c", "1")}
    for n, step in enumerate(("_write", "_commit", "version", "_clean", "_names", "_manifest")):
        for skip in range(4):
            s = Store(spark, f"file://{tmp_path}/stop{n}{skip}")
            s.upsert("files", rows(("a", "1"), ("b", "1")))
            real, calls = getattr(Store, step), [0]

            def stop(self, *a, real=real, calls=calls, skip=skip):
                calls[0] += 1
                if calls[0] > skip:
                    raise KeyboardInterrupt
                return real(self, *a)

            monkeypatch.setattr(Store, step, stop)
            try:
                s.upsert("files", rows(("b", "2"), ("c", "1")))
                ended = True
            except KeyboardInterrupt:
                ended = False
            monkeypatch.undo()
            fresh = Store(spark, s.root)
            got = {(r.id, r.content_hash) for r in fresh.read("files").collect()}
            assert fresh.exists("files") and got in ((new,) if ended else (old, new)), (step, skip)
            fresh.upsert("files", rows(("b", "2"), ("c", "1")))  # and the table can be written on
            assert {(r.id, r.content_hash) for r in fresh.read("files").collect()} == new
            if ended:
                break


def test_writes_touch_their_buckets_and_readers_keep_theirs(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}/b", buckets=8)
    rows = lambda ids, h: spark.createDataFrame([(str(i), h) for i in ids], "id string, content_hash string").withColumns({c: F.lit("x") for c in ("repository_id", "path", "language")})
    s.upsert("files", rows(range(100), "1"))
    before, reader = s._manifest("files", s.version("files"))["parts"], s.read("files")
    s.upsert("files", rows([7], "2"))
    after = s._manifest("files", s.version("files"))["parts"]
    assert len(before) == len(after) == 8 and len({tuple(p) for p in before} & {tuple(p) for p in after}) == 7
    assert reader.count() == 100 and reader.where("content_hash = '2'").count() == 0  # planned before the write
    assert s.read("files").where("content_hash = '2'").count() == 1
    for k in range(5):
        s.append("files", rows([1000 + k], "3"))
    assert s.read("files").count() == 105 and s.version("files") == 7
    other = Store(spark, s.root)
    other._write, real = (lambda *a: (s.upsert("files", rows([8], "4")), real(*a))[1]), other._write
    with pytest.raises(st.Conflict):
        other.upsert("files", rows([9], "5"))
    assert s.read("files").where("content_hash = '4'").count() == 1 and s.read("files").where("content_hash = '5'").count() == 0


def test_facts_stay_in_their_repository(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/two", buckets=2)
    for name, files in {
        "a": {"Cargo.toml": '[dependencies]\nsqlx = "0.7"\n', "src/lib.rs": "use sqlx::Pool;\npub fn only_in_a() {}\n#[test]\nfn covers() { only_in_a(); }\n"},
        "b": {"src/lib.rs": "use sqlx::Pool;\npub fn here() { crate::only_in_a(); }\n"},
    }.items():
        for path, text in files.items():
            p = tmp_path / name / path
            p.parent.mkdir(parents=True, exist_ok=True)
            p.write_text(text)
    engines = {n: api.Engine(spark, store, str(tmp_path / n), n) for n in "ab"}
    for n in "aba":
        engines[n].index(f"run-{n}")
    assert {(r.repository_id, r.import_path) for r in store.read("dependency_usages").collect()} == {("a", "sqlx::Pool")}
    calls = {r.callee_text: r for r in store.read("calls").collect()}
    assert calls["crate::only_in_a"].resolution_status == "unresolved" and calls["only_in_a"].resolution_status == "resolved_exact"
    assert {r.repository_id for r in store.read("test_targets").collect()} == {"a"}
    assert {(r.repository_id, r.path) for r in store.read("files").collect()} == {("a", "Cargo.toml"), ("a", "src/lib.rs"), ("b", "src/lib.rs")}


def test_diff_then_apply_is_the_new_snapshot(spark):
    old = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "1")], "path string, content_hash string")
    new = spark.createDataFrame([("a", "1"), ("b", "2"), ("d", "1")], "path string, content_hash string")
    diff = freshness.diff(old, new)
    assert {(r.path, r.change) for r in diff.collect()} == {("b", "modified"), ("c", "deleted"), ("d", "created")}
    assert sorted(map(tuple, freshness.apply(old, diff).collect())) == sorted(map(tuple, new.collect()))
    row = freshness.change_counts(diff).first()
    assert (row.event_count, row.latest) == (3, "b")
    unknown = freshness.report(old.limit(0), new.limit(0), spark.createDataFrame([("src/unknown.rs",)], "path string")).first()
    assert unknown.freshness == "unknown"


def test_index_and_questions(spark, repo, tmp_path):
    engine = api.Engine(spark, Store(spark, f"file://{tmp_path}/idx"), repo, "r")
    engine.index("run1")
    assert {r.qualified_name for r in engine.find_symbol("helper").collect()} == {"crate::helper"}
    assert {(r.caller_name, r.freshness) for r in engine.callers("helper").collect()} == {("crate::caller", "fresh"), ("crate::other::far", "fresh")}
    assert [r.hops for r in engine.call_path("caller", "helper").collect()] == [1]
    assert {r.dependency_name for r in engine.table("dependencies").collect()} == {"sqlx"}
    with open(f"{repo}/src/lib.rs", "a") as f:
        f.write("pub fn added() { caller(); }\n")
    os.remove(f"{repo}/web/app.js")
    labels = {r.path: r.freshness for r in engine.staleness().collect()}
    assert labels["src/lib.rs"] == "stale" and labels["web/app.js"] == "deleted" and labels["src/other.rs"] == "fresh"
    engine.index("run2")
    assert set(r.freshness for r in engine.staleness().collect()) == {"fresh"}
    assert engine.find_symbol("go").count() == 0 and engine.find_symbol("added").count() == 1
    assert engine.table("files").where("index_run_id = 'run1'").count() == 4  # unchanged files were skipped
    assert [r.qualified_name for r in engine.impact("helper")["callers_transitive"].join(engine.symbols(), F.col("node") == F.col("id")).orderBy("hops", "qualified_name").collect()] == ["crate::caller", "crate::other::far", "crate::added"]
    assert engine.context_pack("helper").where("item_kind = 'symbol'").count() == 1
    frames = engine.debug_context(f"0: crate::caller\n  at {repo}/src/lib.rs:2:1\n")["frames"].collect()
    assert [(f.symbol_name, f.matched) for f in frames] == [("crate::caller", True)]
    assert {"search", "impact", "doctor"} <= {t["name"] for t in api.catalogue()}
    with pytest.raises(ValueError):
        api.call(engine, "nothing")
    with pytest.raises(ValueError):
        api.call(engine, "callers")
    with pytest.raises(ValueError):
        engine.staleness("helper", ["web/app.js"])
    assert '"contract"' in api.envelope(api.call(engine, "index_status")).first()["json"]
    assert engine.doctor().where("label = 'freshness'").first()["state"] == "Ok"


def test_routing_errors(spark):
    row = spark.createDataFrame([("quality", "fast", "quality_ready", "m", True, True)], "mode string, active_layer string, quality_status string, quality_model string, is_complete boolean, is_latest boolean")
    with pytest.raises(ValueError):
        routing.choose(row)
    assert routing.choose(row.withColumn("mode", F.lit("auto"))) == ("fast", "quality_layer_inactive")


def test_targets_are_checked(spark):
    for bad in ('[{"path": "/abs", "start_line": 1, "end_line": 1, "description": "x"}]', '[{"path": "a", "start_line": 0, "end_line": 1, "description": "x"}]', '[{"path": "a", "start_line": 3, "end_line": 1, "description": "x"}]', '[{"path": "a", "start_line": 1, "end_line": 1, "description": " "}]'):
        with pytest.raises(ValueError):
            targets.read_targets(spark, bad)
    config = targets.EmbedConfig.from_values({"FAST_MAX_BYTES": "4096", "QUALITY_MAX_TOKENS": "100", "FAST_BATCH": "x"})
    assert (config.fast_tokens, config.quality_tokens, config.fast_batch) == (1024, 100, 16)


def test_watch_folds_changes_and_survives_a_busy_writer(spark, repo, tmp_path):
    seen, busy = [], [True]

    def on_change(changes, batch):
        if busy[0] and seen:
            busy[0] = False
            raise snapshots.Busy
        seen.append({(r.path, r.change) for r in changes.collect()})

    tracker = snapshots.Tracker(spark, f"file://{tmp_path}/state", on_change)
    reader = snapshots.TreeReader({"path": repo})
    poll = lambda k: tracker(spark.createDataFrame(reader._rows(k), "poll bigint, path string, content_hash string"), k)
    poll(0)
    with open(f"{repo}/src/new.rs", "w") as f:
        f.write("fn n() {}")
    poll(1)  # the writer is busy
    os.remove(f"{repo}/web/app.js")
    poll(2)
    poll(2)
    poll(3)
    assert len(seen) == 2 and len(seen[0]) == 6 and seen[1] == {("src/new.rs", "created"), ("web/app.js", "deleted")}


def test_watch_query(spark, repo, tmp_path):
    seen = []
    query = snapshots.watch(spark, repo, f"file://{tmp_path}/s", f"{tmp_path}/c", lambda c, b: seen.append(c.count()), poll="0 seconds", debounce=0)
    for _ in range(150):
        if seen:
            break
        query.awaitTermination(0.2)
    query.stop()
    assert seen == [6]


def test_quality_queue(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}/q")
    now = F.current_timestamp()
    s.replace("files", spark.createDataFrame([("f", "r", "a.rs", "rust", "h")], "id string, repository_id string, path string, language string, content_hash string"))
    chunks = [(f"c{k}", f"t{k}") for k in range(5)]
    s.replace("chunks", spark.createDataFrame([(c, "f", "function", t, 1, 1, 0, 1) for c, t in chunks], "id string, file_id string, kind string, text_hash string, start_line bigint, end_line bigint, start_byte bigint, end_byte bigint"))
    rows = [(f"j{k}", "r", "g", c, "f", "a.rs", "h", t if k else "changed", "pending", 0) for k, (c, t) in enumerate(chunks)]
    s.replace("quality_embedding_jobs", spark.createDataFrame(rows, "id string, repository_id string, generation_id string, chunk_id string, file_id string, path string, content_hash string, text_hash string, status string, attempts bigint").withColumn("created_at", now).withColumn("updated_at", now))
    texts = spark.createDataFrame([(c, f"text {c}") for c, _ in chunks[:4]], "chunk_id string, text string")
    assert jobs.run_batch(s, "g", texts, 2) == {"pending": 3, "skipped_stale": 1, "succeeded": 1}
    assert jobs.run_all(s, "g", texts, 2) == {"skipped_stale": 1, "succeeded": 3, "skipped_excluded": 1}
    assert s.read("vector_points").count() == 3
    assert st.requeue(s.read("quality_embedding_jobs"), spark.createDataFrame([("c0", "changed")], "chunk_id string, text_hash string")).where("status = 'pending'").count() == 1
    assert doctor.diagnose(spark, s).where("label = 'table:files'").first()["state"] == "Ok"


def test_leases():
    assert state.may_stop(1, 5.0, 9.0) == (False, None)
    assert state.may_stop(0, None, 9.0) == (False, 9.0)
    assert state.may_stop(0, 9.0, 19.0) == (True, 9.0)


def test_embedder_is_deterministic_and_unit_length():
    a, b = embedder.hashed(["fn x() {}", ""]), embedder.hashed(["fn x() {}", ""])
    assert a == b and abs(sum(x * x for x in a[0]) - 1) < 1e-9 and not any(a[1]) and embedder.dimension(embedder.hashed) == 64


def test_stateful_changes(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    schema = "poll bigint, path string, content_hash string"
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for k, rows in enumerate([[(0, "a", "1"), (0, "b", "1")], [(1, "a", "2"), (1, "b", None)]]):
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(str(src))
            out = state.changes(spark.readStream.schema(schema).json(str(src)))
            q = out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
            q.awaitTermination(60)
        got = {(r.path, r.change) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
        assert got == {("a", "created"), ("b", "created"), ("a", "modified"), ("b", "deleted")}
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def test_semantic_index(spark, repo, tmp_path):
    engine = api.Engine(spark, Store(spark, f"file://{tmp_path}/sem"), repo, "r", ref_id="main")
    counts = engine.index("run1", semantic=True)
    assert counts == {"files_seen": 6, "files_indexed": 6, "chunks_embedded": engine.table("chunks").count()}
    assert engine.table("index_runs").first()["status"] == "success"
    assert {(r.action, r.reason) for r in engine.table("file_index_events").collect()} == {("created", "new_file")}
    assert {(r.import_path, r.confidence) for r in engine.table("dependency_usages").collect()} == set()
    assert engine.vector_verify("fast").collect() == []
    top = engine.search("pub fn helper() {}", 1).first()
    assert top.path == "src/lib.rs" and abs(top.score - 1) < 1e-6
    assert engine.layer("auto") == ("fast", "quality_not_configured")
    assert engine.semantic_status().first()["quality_status"] == "fast_ready"
    assert engine.repository_status().first()["files"] == 6
    before = {r.id for r in engine.table("semantic_generations").collect()}
    with open(f"{repo}/src/lib.rs", "a") as f:
        f.write("use sqlx::SqlitePool;\npub fn added() { crate::other::far(); }\n")
    os.remove(f"{repo}/web/app.js")
    engine.index("run2", semantic=True)
    assert len({r.id for r in engine.table("semantic_generations").collect()} - before) == 1
    assert engine.vector_verify("fast").collect() == [] and engine.table("vector_points").count() == engine.table("chunks").count()
    assert [(r.import_path, r.referenced_symbol) for r in engine.table("dependency_usages").collect()] == [("sqlx::SqlitePool", "SqlitePool")]
    call = engine.table("calls").where("callee_text = 'crate::other::far'").first()
    assert (call.resolution_status, call.confidence) == ("resolved_exact", 1.0) and call.callee_symbol_id
    assert {r.path for r in engine.table("ref_files").collect()} == {r.path for r in engine.table("files").collect()}
    assert engine.context_pack("helper").where("source = 'both'").count() == 1
    with pytest.raises(Exception):
        api.Engine(spark, engine.store, "/nowhere/at/all", "r").index("run3")
    assert engine.table("index_runs").where("id = 'run3'").first()["status"] == "failed"


def test_paths_inside_the_root(repo):
    from codequarry.functions.status import inside_root

    assert inside_root(repo, "src/../src/lib.rs") == "src/lib.rs"
    for bad in ("../x", "/etc/passwd", "src/none.rs"):
        with pytest.raises(ValueError):
            inside_root(repo, bad)
