"""Git metadata without a git process: HEAD, loose and packed refs."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession


def _read(path: str) -> str | None:
    try:
        with open(path, encoding="utf-8") as f:
            return f.read()
    except (OSError, UnicodeDecodeError):
        return None


def git_dir(root: str) -> str | None:
    path = os.path.join(root, ".git")
    if os.path.isfile(path):
        line = (_read(path) or "").strip()
        if not line.startswith("gitdir: "):
            return None
        path = os.path.normpath(os.path.join(root, line.removeprefix("gitdir: ")))
    return path if os.path.isdir(path) else None


def refs(git: str) -> dict[str, str]:
    """Full ref name -> object id; loose refs win over packed ones."""
    common = (_read(os.path.join(git, "commondir")) or "").strip()
    base = os.path.normpath(os.path.join(git, common)) if common else git
    out: dict[str, str] = {}
    for line in (_read(os.path.join(base, "packed-refs")) or "").splitlines():
        if line and line[0] not in "#^" and " " in line:
            oid, name = line.split(" ", 1)
            out[name.strip()] = oid
    for folder, _, names in os.walk(os.path.join(base, "refs")):
        for n in names:
            path = os.path.join(folder, n)
            text = (_read(path) or "").strip()
            if text and not text.startswith("ref:"):
                out[os.path.relpath(path, base).replace(os.sep, "/")] = text
    return out


def detect(root: str) -> dict:
    """ref_kind, ref_name, ref_identity, head_oid and the local branches."""
    git = git_dir(root)
    head = (_read(os.path.join(git, "HEAD")) or "").strip() if git else ""
    if not head:
        return {"ref_kind": "non_git", "ref_name": None, "ref_identity": "non_git", "head_oid": None, "branches": []}
    known = refs(git)
    branches = sorted(n.removeprefix("refs/heads/") for n in known if n.startswith("refs/heads/"))
    if not head.startswith("ref:"):
        return {"ref_kind": "detached", "ref_name": None, "ref_identity": head, "head_oid": head, "branches": branches}
    name = head.removeprefix("ref:").strip()
    kind = "branch" if name.startswith("refs/heads/") else "other"
    return {"ref_kind": kind, "ref_name": name.removeprefix("refs/heads/"), "ref_identity": name, "head_oid": known.get(name), "branches": branches}


def read(spark: SparkSession, root: str) -> DataFrame:
    """One row of git metadata."""
    return spark.createDataFrame([detect(root)], "ref_kind string, ref_name string, ref_identity string, head_oid string, branches array<string>")
