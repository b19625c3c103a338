"""Dependency manifests: Cargo.toml lines and package.json maps, with built-ins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from codequarry.functions import ids

SECTIONS = {"dependencies": "runtime", "dev-dependencies": "dev", "build-dependencies": "build"}
NPM = {"dependencies": "runtime", "devDependencies": "dev", "peerDependencies": "peer", "optionalDependencies": "optional"}
COLUMNS = ("file_id", "manifest_path", "package_manager", "dependency_name", "package_name", "version_req", "dependency_kind")


def _filled(text: str):
    return F.nullif(text, F.lit("")) if not isinstance(text, str) else F.nullif(F.col(text), F.lit(""))


def cargo(files: DataFrame) -> DataFrame:
    """Dependencies in root ``Cargo.toml`` files (file_id, path, content).

    A section header holds for the lines after it; the window is over one file.
    """
    lines = files.where("path = 'Cargo.toml'").select("file_id", "path", F.posexplode(F.split("content", "\r?\n")).alias("line", "text"))
    lines = lines.withColumn("text", F.trim(F.regexp_replace("text", r"^\s*#.*$", "")))
    header = _filled(F.regexp_extract("text", r"^\[([^\]]+)\]", 1))
    over = W.partitionBy("file_id").orderBy("line").rowsBetween(W.unboundedPreceding, 0)
    lines = lines.withColumn("section", F.last(header, ignorenulls=True).over(over))
    kind = F.lit(None).cast("string")
    for section, label in SECTIONS.items():
        kind = F.when(F.col("section") == section, label).otherwise(kind)
    name = _filled(F.regexp_extract("text", r'^"?([A-Za-z0-9_.-]+?)"?(?:\.workspace)?\s*=', 1))
    value = F.regexp_extract("text", r"=\s*(.+)$", 1)
    alias = _filled(F.regexp_extract(value, r'\bpackage\s*=\s*"([^"]+)"', 1))
    version = F.coalesce(_filled(F.regexp_extract(value, r'^"([^"]*)"', 1)), _filled(F.regexp_extract(value, r'\bversion\s*=\s*"([^"]+)"', 1)))
    rows = lines.withColumn("dependency_kind", kind).where("dependency_kind is not null").withColumn("dependency_name", name).where("dependency_name is not null")
    return rows.select("file_id", F.col("path").alias("manifest_path"), F.lit("cargo").alias("package_manager"), "dependency_name", F.coalesce(alias, "dependency_name").alias("package_name"), version.alias("version_req"), "dependency_kind")


def npm(files: DataFrame) -> DataFrame:
    """Dependencies in root ``package.json`` files; invalid JSON gives none."""
    fields = ", ".join(f"{n}: map<string,string>" for n in NPM)
    parsed = files.where("path = 'package.json'").select("file_id", F.col("path").alias("manifest_path"), F.from_json("content", f"struct<{fields}>").alias("j"))
    parts = [
        parsed.select("file_id", "manifest_path", F.explode(f"j.{name}").alias("dependency_name", "version_req"), F.lit(kind).alias("dependency_kind"))
        for name, kind in NPM.items()
    ]
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    return rows.withColumn("package_manager", F.lit("npm")).withColumn("package_name", F.col("dependency_name")).select(*COLUMNS)


def dependencies(files: DataFrame, repository_id: str) -> DataFrame:
    """Both kinds as rows of the table ``dependencies``."""
    rows = cargo(files).unionByName(npm(files)).withColumn("repository_id", F.lit(repository_id))
    return rows.withColumn("id", ids.stable_id(*[F.col(c) for c in ("repository_id", "file_id", "dependency_name", "dependency_kind")]))
