"""Closed vocabularies, status transitions and argument clamps."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from codequarry.schema import VOCABULARY

# Legal transitions of a semantic status.
TRANSITIONS: dict[str, tuple[str, ...]] = {
    "missing": ("fast_ready",),
    "fast_ready": ("quality_pending", "quality_blocked", "quality_failed"),
    "quality_pending": ("quality_ready", "quality_stale", "quality_blocked", "quality_failed"),
    "quality_ready": ("quality_stale",),
    "quality_stale": ("quality_pending", "quality_blocked", "quality_failed"),
    "quality_blocked": ("quality_pending",),
    "quality_failed": ("quality_pending",),
}


def clamp(value: int | None, default: int, least: int = 1, most: int = 25) -> int:
    """A limit or depth argument in its range."""
    return max(least, min(default if value is None else int(value), most))


def inside_root(root: str, path: str) -> str:
    """Path of an existing file relative to ``root``; ValueError if it lies
    outside, through links or not."""
    import os

    base, real = os.path.realpath(root), os.path.realpath(os.path.join(root, path))
    if not os.path.exists(real) or os.path.commonpath([base, real]) != base:
        raise ValueError(f"no such path inside the repository: {path}")
    return os.path.relpath(real, base).replace(os.sep, "/")


def parse(kind: str, value: str) -> str:
    """``value`` if it is in the vocabulary ``kind``; ValueError otherwise."""
    if value not in VOCABULARY[kind]:
        raise ValueError(f"unknown {kind}: {value!r}")
    return value


def known(kind: str, column: Column) -> Column:
    """The column, failing the query on a value outside the vocabulary."""
    ok = column.isNull() | column.isin(*VOCABULARY[kind])
    return F.when(ok, column).otherwise(F.raise_error(F.concat(F.lit(f"unknown {kind}: "), column)))


def allowed(before: str, after: str) -> Column:
    """Whether the step between two status columns is legal (staying is)."""
    out = F.col(before) == F.col(after)
    for state, nexts in TRANSITIONS.items():
        out = out | ((F.col(before) == state) & F.col(after).isin(*nexts))
    return out




def language(path: Column) -> Column:
    """Language of a path by its extension, null if none is known."""
    from codequarry.schema import EXTENSIONS

    ext = F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1)
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in EXTENSIONS.items() for x in pair]), ext)
