"""Writes: keyed merges on Parquet parts under numbered manifests.

A table is cut into buckets by one column; a manifest lists the folders of each
bucket.  A write puts new folders beside the old ones and then a manifest of the
next number, renamed into place: readers see the table of the highest number,
old or new, whatever step a writer stops at.  Only the buckets that a change
touches are written again.  A second writer finds its number taken and fails;
it never overwrites.  The folders of the manifest before stay for readers whose
plans still name them; older ones go.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from codequarry.schema import BUCKET_BY, KEYS, TABLES

#: Folders of a bucket beyond which an append writes it anew.
MOST_PARTS = 16


class Conflict(Exception):
    """Another writer committed first; read again and retry."""


class Store:
    """Tables of ``codequarry.schema`` below a path that executors share."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = 16):
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self, path: str) -> list[str]:
        p, fs = self._fs(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    # manifests ----------------------------------------------------------------
    def version(self, name: str) -> int:
        """Number of the current manifest, 0 without one."""
        return max((int(n) for n in self._names(f"{self.root}/{name}/versions") if n.isdigit()), default=0)

    def _manifest(self, name: str, version: int) -> dict:
        if not version:
            return {"buckets": self.buckets, "parts": []}
        p, fs = self._fs(f"{self.root}/{name}/versions/{version:012d}")
        stream = fs.open(p)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _commit(self, name: str, base: int, buckets: int, parts: list[list]) -> None:
        """Make ``parts`` the table, if it is still at version ``base``."""
        folder = f"{self.root}/{name}/versions"
        staged, fs = self._fs(f"{folder}/staged-{uuid.uuid4().hex}")
        target, _ = self._fs(f"{folder}/{base + 1:012d}")
        stream = fs.create(staged, True)
        stream.write(bytearray(json.dumps({"buckets": buckets, "parts": parts}).encode()))
        stream.close()
        if self.version(name) != base or not fs.rename(staged, target):
            fs.delete(staged, False)
            raise Conflict(f"{name} is not at version {base} any more")
        self._clean(name, base + 1)

    def _clean(self, name: str, version: int) -> None:
        """Remove what neither this manifest nor the one before names."""
        kept = {f.partition("/")[0] for v in (version, version - 1) if v > 0 for _, f in self._manifest(name, v)["parts"]}
        for n in self._names(f"{self.root}/{name}/versions"):
            if n.isdigit() and int(n) < version - 1:
                p, fs = self._fs(f"{self.root}/{name}/versions/{n}")
                # folders are written before their manifest: only those of older
                # manifests are known to be no writer's work in progress
                for folder in {f.partition("/")[0] for _, f in self._manifest(name, int(n))["parts"]} - kept:
                    fs.delete(self._fs(f"{self.root}/{name}/data/{folder}")[0], True)
                fs.delete(p, False)

    # parts --------------------------------------------------------------------
    def _bucket(self, name: str, buckets: int) -> Column:
        return F.pmod(F.xxhash64(F.col(BUCKET_BY[name]).cast("string")), F.lit(buckets)).cast("int")

    def _write(self, name: str, rows: DataFrame, buckets: int) -> list[list]:
        fields = [F.col(f.name).cast(f.dataType).alias(f.name) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in TABLES[name].fields]
        folder = uuid.uuid4().hex
        rows.select(*fields).withColumn("bucket_", self._bucket(name, buckets)).repartition("bucket_").write.partitionBy("bucket_").parquet(f"{self.root}/{name}/data/{folder}")
        return [[int(n.partition("=")[2]), f"{folder}/{n}"] for n in self._names(f"{self.root}/{name}/data/{folder}") if n.startswith("bucket_=")]

    def _load(self, name: str, parts: list[list]) -> DataFrame:
        if not parts:
            return self.spark.createDataFrame([], TABLES[name])
        return self.spark.read.schema(TABLES[name]).parquet(*[f"{self.root}/{name}/data/{f}" for _, f in parts])

    # tables -------------------------------------------------------------------
    def exists(self, name: str) -> bool:
        return self.version(name) > 0

    def create(self, name: str) -> bool:
        """Make an empty table; False if it is there already."""
        if self.exists(name):
            return False
        self._commit(name, 0, self.buckets, [])
        return True

    def read(self, name: str) -> DataFrame:
        return self._load(name, self._manifest(name, self.version(name))["parts"])

    def replace(self, name: str, rows: DataFrame) -> None:
        """All rows anew."""
        base = self.version(name)
        self._commit(name, base, self.buckets, self._write(name, rows, self.buckets))

    def append(self, name: str, rows: DataFrame) -> None:
        """More rows, beside those there are."""
        base = self.version(name)
        m = self._manifest(name, base)
        held = [b for b, _ in m["parts"]]
        if any(held.count(b) >= MOST_PARTS for b in set(held)):
            self.replace(name, self.read(name).unionByName(rows, allowMissingColumns=True))
        else:
            self._commit(name, base, m["buckets"], m["parts"] + self._write(name, rows, m["buckets"]))

    def change(self, name: str, new: DataFrame | None = None, gone: DataFrame | None = None) -> None:
        """Remove the rows whose columns match ``gone``, then put ``new`` over
        the rows of the same key; one commit.

        Buckets without a row of either stay as they are; where ``gone`` lacks
        the bucket column, all are looked through.
        """
        base = self.version(name)
        m = self._manifest(name, base)
        touched: set[int] = set()
        for df in (new, gone):
            if df is not None and BUCKET_BY[name] in df.columns:
                touched |= {r[0] for r in df.select(self._bucket(name, m["buckets"])).distinct().collect()}  # at most one row a bucket
            elif df is not None:
                touched |= set(range(m["buckets"]))
        rows = self._load(name, [p for p in m["parts"] if p[0] in touched])
        if gone is not None:
            rows = rows.join(gone.distinct(), gone.columns, "left_anti")
        if new is not None:
            rows = merged(rows, new, KEYS[name])
        rest = [p for p in m["parts"] if p[0] not in touched]
        self._commit(name, base, m["buckets"], rest + (self._write(name, rows, m["buckets"]) if touched else []))

    def upsert(self, name: str, rows: DataFrame) -> None:
        self.change(name, new=rows)

    def delete(self, name: str, keys: DataFrame) -> None:
        """Remove rows whose key columns (those of ``keys``) are listed."""
        self.change(name, gone=keys)

    def upsert_points(self, rows: DataFrame) -> None:
        """Vectors of one dimension only, none empty."""
        sizes = rows.agg(F.min(F.size("embedding")).alias("a"), F.max(F.size("embedding")).alias("b"), F.min("embedding_dimension").alias("c"), F.max("embedding_dimension").alias("d")).first()
        if sizes["a"] is None:
            return
        if sizes["a"] < 1 or len({sizes["a"], sizes["b"], sizes["c"], sizes["d"]}) > 1:
            raise ValueError("vectors are empty or of several dimensions")
        self.upsert("vector_points", rows)


def merged(old: DataFrame, new: DataFrame, key: tuple[str, ...]) -> DataFrame:
    """``new`` over ``old``; of new rows with one key the last one given wins."""
    fresh = new.withColumn("__n", F.monotonically_increasing_id())
    rest = [c for c in new.columns if c not in key]
    fresh = fresh.groupBy(*key).agg(F.max_by(F.struct(*rest), "__n").alias("r")).select(*key, *[F.col(f"r.{c}").alias(c) for c in rest]) if rest else new.distinct()
    return old.join(fresh.select(*key), list(key), "left_anti").unionByName(fresh, allowMissingColumns=True)


def replace_file_facts(old: DataFrame, new: DataFrame, changed_files: DataFrame, removed_files: DataFrame) -> DataFrame:
    """Facts after a run: those of changed and removed files go, new ones come."""
    gone = changed_files.select("file_id").union(removed_files.select("file_id")).distinct()
    return old.join(gone, "file_id", "left_anti").unionByName(new, allowMissingColumns=True)


def remove_missing_ref_files(ref_files: DataFrame, ref_id: str, active: DataFrame) -> DataFrame:
    own = F.col("repository_ref_id") == ref_id
    return ref_files.where(~own).unionByName(ref_files.where(own).join(active.select("path"), "path", "left_semi").select(*ref_files.columns))


def unreferenced_files(files: DataFrame, ref_files: DataFrame) -> DataFrame:
    """Snapshots that no ref points at."""
    return files.join(ref_files.select(F.col("file_id").alias("id")), "id", "left_anti")


def cascade(facts: DataFrame, files: DataFrame) -> DataFrame:
    """Facts of files that still exist."""
    return facts.join(files.select(F.col("id").alias("file_id")), "file_id", "left_semi")


def sync_refs(stored: DataFrame, found: DataFrame, now) -> DataFrame:
    """Refs after looking at git: vanished branches get ``deleted_at``."""
    f = found.select("repository_id", "ref_kind", "ref_identity", F.col("head_oid").alias("__oid"), F.col("is_current").alias("__current"), F.lit(True).alias("__seen"))
    both = stored.join(f, ["repository_id", "ref_kind", "ref_identity"], "full_outer")
    return both.withColumn("head_oid", F.coalesce("__oid", "head_oid")).withColumn("is_current", F.coalesce("__current", F.lit(False))).withColumn(
        "deleted_at", F.when(F.col("__seen").isNull(), F.coalesce("deleted_at", now))
    ).withColumn("last_seen_at", F.when(F.col("__seen"), now).otherwise(F.col("last_seen_at"))).drop("__oid", "__current", "__seen")


def link_files(ref_id: str, files: DataFrame, run_id: str | None = None) -> DataFrame:
    """Rows of ref_files for the files of a ref."""
    return files.select(F.lit(ref_id).alias("repository_ref_id"), "repository_id", "path", F.col("id").alias("file_id"), F.current_timestamp().alias("indexed_at"), F.lit(run_id).cast("string").alias("index_run_id"))


def started_run(spark: SparkSession, run_id: str, repository_id: str, kind: str, parser_version: str, ref_id: str | None = None, model: str = "") -> DataFrame:
    """A run row with status ``running``."""
    row = spark.createDataFrame([(run_id, repository_id, ref_id, "running", model, kind, parser_version)], "id string, repository_id string, repository_ref_id string, status string, embedding_model string, run_kind string, parser_version string")
    return row.withColumn("started_at", F.current_timestamp()).withColumns({c: F.lit(0).cast("bigint") for c in ("files_seen", "files_indexed", "chunks_embedded")})


def finished_run(run: DataFrame, status: str, error=None, **counts: int) -> DataFrame:
    """A run row with its end; the error is shortened."""
    from codequarry.functions.paths import error_summary

    out = run.withColumn("status", F.lit(status)).withColumn("finished_at", F.current_timestamp()).withColumn("error_summary", error_summary(F.lit(error)))
    for name, value in counts.items():
        out = out.withColumn(name, F.lit(value).cast("bigint"))
    return out


def oldest_pending(jobs: DataFrame, generation_id: str, limit: int) -> DataFrame:
    """The oldest pending jobs of a generation: each task keeps ``limit`` rows."""
    return jobs.where((F.col("generation_id") == generation_id) & (F.col("status") == "pending")).orderBy("created_at", "id").limit(limit)


def claimed(jobs: DataFrame) -> DataFrame:
    """The rows as they are once claimed."""
    return jobs.withColumn("attempts", F.col("attempts") + 1).withColumn("status", F.lit("running"))


def claim_jobs(jobs: DataFrame, generation_id: str, limit: int) -> DataFrame:
    """Jobs after claiming the oldest pending ones (``limit`` ids are broadcast)."""
    taken = F.broadcast(oldest_pending(jobs, generation_id, limit).select("id").withColumn("__taken", F.lit(True)))
    rows = jobs.join(taken, "id", "left")
    return rows.withColumn("attempts", F.when(F.col("__taken"), F.col("attempts") + 1).otherwise(F.col("attempts"))).withColumn("status", F.when(F.col("__taken"), "running").otherwise(F.col("status"))).select(*jobs.columns)


def requeue(jobs: DataFrame, current: DataFrame) -> DataFrame:
    """Terminal stale jobs whose chunk is current again are pending."""
    now = current.select("chunk_id", "text_hash").distinct().withColumn("__now", F.lit(True))
    rows = jobs.join(now, ["chunk_id", "text_hash"], "left")
    return rows.withColumn("status", F.when(F.col("__now") & F.col("status").isin("skipped_stale", "failed"), "pending").otherwise(F.col("status"))).drop("__now").select(*jobs.columns)


def supersede(jobs: DataFrame, generation_id: str) -> DataFrame:
    """Open jobs of other generations are stale once a new one begins."""
    old = (F.col("generation_id") != generation_id) & F.col("status").isin("pending", "running")
    return jobs.withColumn("status", F.when(old, "skipped_stale").otherwise(F.col("status")))


def prune_observations(rows: DataFrame, now) -> DataFrame:
    return rows.where(F.col("expires_at") > now)
