"""File-tree source: which files of a repository are indexed, with their hashes.

The walk over names happens on the driver (or in a Python data source); file
contents are read and hashed on the executors, one path a row.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from codequarry.functions import ids, status
from codequarry.schema import EXTENSIONS

# Directories that are never indexed (with our own).
EXCLUDED = (".git", ".hg", ".svn", ".direnv", "target", "node_modules", "vendor", ".codequarry", "qdrant_storage")
SCHEMA = "path string, language string, content string"


@dataclass(frozen=True)
class IgnoreRule:
    """One line of an ignore file: its scope, pattern and kind."""

    scope: str
    regex: str
    negated: bool
    dir_only: bool

    def matches(self, path: str, is_dir: bool) -> bool:
        if self.scope and not path.startswith(self.scope + "/"):
            return False
        own = path[len(self.scope) + 1 :] if self.scope else path
        return (is_dir or not self.dir_only) and re.fullmatch(self.regex, own) is not None


def _glob(pattern: str) -> str:
    out, k = "", 0
    while k < len(pattern):
        if pattern.startswith("**/", k):
            out, k = out + "(?:.*/)?", k + 3
        elif pattern.startswith("**", k):
            out, k = out + ".*", k + 2
        else:
            c = pattern[k]
            if c == "[" and "]" in pattern[k + 2 :]:
                end = pattern.index("]", k + 2)
                out, k = out + "[" + pattern[k + 1 : end].replace("!", "^", 1 if pattern[k + 1] == "!" else 0) + "]", end + 1
                continue
            out, k = out + {"*": "[^/]*", "?": "[^/]"}.get(c, re.escape(c)), k + 1
    return out


def parse_ignore(scope: str, line: str) -> IgnoreRule | None:
    """A rule of an ignore file in directory ``scope``; None for blanks and comments."""
    text = line.rstrip("\n").rstrip()
    if not text or text.startswith("#"):
        return None
    negated = text.startswith("!")
    text = text.removeprefix("!")
    dir_only = text.endswith("/")
    text = text.rstrip("/")
    if not text:
        return None
    anchored = "/" in text
    regex = _glob(text.lstrip("/"))
    return IgnoreRule(scope, regex if anchored else f"(?:.*/)?{regex}", negated, dir_only)


def ignored(path: str, is_dir: bool, rules: list[IgnoreRule]) -> bool:
    """Whether the last rule that matches ignores the path."""
    verdict = False
    for rule in rules:
        if rule.matches(path, is_dir):
            verdict = not rule.negated
    return verdict


def json_roots(value: str | None) -> list[str]:
    """Directories below which ``.json`` files count: comma list, relative only."""
    roots = []
    for part in (value or "").split(","):
        p = part.strip().replace("\\", "/").rstrip("/").removeprefix("./")
        if p and not p.startswith("/") and ":" not in p and ".." not in p.split("/"):
            roots.append(p)
    return roots


def json_included(path: str, roots: list[str]) -> bool:
    return any(r == "." or path == r or path.startswith(r + "/") for r in roots)


def walk(root: str, include_json: str | None = None) -> Iterator[str]:
    """Relative paths of the files to index, in byte order of their names.

    Symbolic links are skipped; excluded directories cannot be brought back by
    a negated rule, ignored ones can only by a rule that names them.
    """
    roots, found = json_roots(include_json), []

    def visit(rel: str, rules: list[IgnoreRule]) -> None:
        here = os.path.join(root, rel) if rel else root
        own = os.path.join(here, ".gitignore")
        if os.path.isfile(own) and not os.path.islink(own):
            with open(own, encoding="utf-8", errors="replace") as lines:
                rules = rules + [r for r in (parse_ignore(rel, line) for line in lines) if r]
        with os.scandir(here) as entries:
            for e in entries:
                path = f"{rel}/{e.name}" if rel else e.name
                if e.is_symlink():
                    continue
                if e.is_dir():
                    if e.name not in EXCLUDED and not ignored(path, True, rules):
                        visit(path, rules)
                elif not ignored(path, False, rules):
                    language = EXTENSIONS.get(path.rpartition(".")[2] if "." in e.name else "")
                    if language and (language != "json" or json_included(path, roots)):
                        found.append(path)

    visit("", [])
    return iter(sorted(found, key=str.encode))


@dataclass
class Part(InputPartition):
    paths: list[str] = field(default_factory=list)


class RepositoryReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root, self.json, self.size = options["path"], options.get("jsonroots"), int(options.get("filesperpartition", 200))

    def partitions(self) -> list[InputPartition]:
        paths = list(walk(self.root, self.json))
        return [Part(paths[k : k + self.size]) for k in range(0, len(paths), self.size)] or [Part([])]

    def read(self, partition: Part) -> Iterator[tuple]:
        for path in partition.paths:
            with open(os.path.join(self.root, path), "rb") as f:
                text = f.read().decode("utf-8", "replace")
            yield path, EXTENSIONS[path.rpartition(".")[2]], text


class RepositorySource(DataSource):
    """``spark.read.format("repository").load(root)``: path, language, content."""

    @classmethod
    def name(cls) -> str:
        return "repository"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return RepositoryReader({k.lower(): v for k, v in self.options.items()})


def read(spark: SparkSession, root: str, json: str | None = None) -> DataFrame:
    """The repository's files with content (for parsing and embedding only)."""
    spark.dataSource.register(RepositorySource)
    reader = spark.read.format("repository")
    return (reader.option("jsonroots", json) if json else reader).load(root)


def file_facts(files: DataFrame, repository_id: str) -> DataFrame:
    """Rows of the table ``files``: content-addressed ids, no text."""
    facts = files.select(F.lit(repository_id).alias("repository_id"), "path", "language", ids.content_hash(F.col("content")).alias("content_hash"))
    return facts.withColumn("id", ids.stable_id(F.col("repository_id"), F.col("path"), F.col("content_hash")))


def of_language(files: DataFrame, language: str) -> DataFrame:
    return files.where(F.col("language") == status.parse("language", language))


def select_paths(paths: DataFrame, rules: DataFrame, include_json: str | None = None) -> DataFrame:
    """The relational form, for listings that come as tables.

    ``paths`` has ``path``; ``rules`` has ordinal, scope, regex, negated and, if
    it likes, dir_only.  As in ``walk``, a path goes when the last rule that
    matches it, or one of its directories, ignores that one: a negated rule
    brings nothing back from a directory that stays ignored.  The rules are few
    and joined by prefix; a path without rules is one row.
    """
    parts = F.split("path", "/")
    dirs = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
    open_ = paths.where(~F.arrays_overlap(dirs, F.array(*[F.lit(x) for x in EXCLUDED])) | (F.size(dirs) == 0))
    rules = rules if "dir_only" in rules.columns else rules.withColumn("dir_only", F.lit(False))
    levels = open_.select("path").distinct().select("path", F.explode(F.sequence(F.lit(1), F.size(parts))).alias("level"))
    own = levels.select("path", "level", F.array_join(F.slice(parts, F.lit(1), F.col("level")), "/").alias("own"), (F.col("level") < F.size(parts)).alias("is_dir"))
    scoped = F.when(F.col("scope") == "", F.col("own")).otherwise(F.expr("substring(own, length(scope) + 2)"))
    meets = F.expr("(scope = '' or startswith(own, concat(scope, '/'))) and (is_dir or not dir_only)")
    hits = own.join(F.broadcast(rules), meets).where(F.regexp_like(scoped, F.concat(F.lit(r"(?d)\A(?:"), F.col("regex"), F.lit(r")\z"))))
    last = hits.groupBy("path", "level").agg(F.max_by("negated", "ordinal").alias("negated"))
    kept = open_.join(last.where("not negated").select("path").distinct(), "path", "left_anti").select(*paths.columns)
    roots = json_roots(include_json)
    inside = F.lit(False)
    for r in roots:
        inside = inside | F.lit(r == ".") | (F.col("path") == r) | F.col("path").startswith(r + "/")
    tongue = status.language(F.col("path"))
    return kept.where(tongue.isNotNull() & ((tongue != "json") | inside))
