"""Paths, module paths, symbol names and import paths, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Path parts that say nothing about the module.
PLAIN_PARTS = ("src", "lib", "main", "mod", "index", "Program", "program")


def normalize(path: Column) -> Column:
    """Forward slashes; null for absolute, empty, ``.`` and ``..`` parts."""
    p = F.regexp_replace(path, r"\\", "/")
    bad = p.rlike("^([A-Za-z]:)?/") | F.exists(F.split(p, "/"), lambda x: x.isin("", ".", ".."))
    return F.when(~bad, p)


def normalize_runtime(path: Column, root: str) -> Column:
    """A path of a runtime log, relative to ``root``; null if outside."""
    p = F.regexp_replace(F.regexp_replace(F.regexp_replace(path, r"\\", "/"), "^file://", ""), r"^(\./)+", "")
    base = root.rstrip("/") + "/"
    inside = F.when(p.startswith(base), F.substring(p, len(base) + 1, 1 << 20)).when(~p.rlike("^([A-Za-z]:)?/"), p)
    return F.when(~F.exists(F.split(inside, "/"), lambda x: x.isin("", "..")), inside)


def symbol_suffix(text: Column) -> Column:
    """The last non-empty part between ``:``, ``.`` and ``#``."""
    parts = F.filter(F.split(text, "[:.#]"), lambda x: x != "")
    return F.coalesce(F.try_element_at(parts, F.lit(-1)), text)


def without_space(text: Column) -> Column:
    return F.regexp_replace(text, r"\s+", "")


def module_parts(path: Column) -> Column:
    stem = F.regexp_replace(path, r"\.[^./]+$", "")
    return F.filter(F.split(stem, "/"), lambda x: (x != "") & ~x.isin(*PLAIN_PARTS))


def qualified_name(root: str, path: Column, containers: Column, name: Column) -> Column:
    return F.array_join(F.concat(F.array(F.lit(root)), module_parts(path), containers, F.array(name)), "::")


def normalize_rust(path: Column) -> Column:
    """Without leading ``crate``, ``self`` and ``super`` parts and empty ones."""
    return F.regexp_replace(F.array_join(F.filter(F.split(path, "::"), lambda x: x != ""), "::"), "^((crate|self|super)(::|$))+", "")


def module_path(qualified: Column) -> Column:
    return F.regexp_extract(qualified, "^(.*)::[^:]+$", 1)


def super_path(module: Column) -> Column:
    return F.regexp_extract(module, "^(.*)::[^:]+$", 1)


def join_path(module: Column, rest: Column) -> Column:
    return F.when(module == "", rest).otherwise(F.concat(module, F.lit("::"), rest))


def relative_candidates(callee: Column, caller_qualified: Column) -> Column:
    """Qualified names that a callee text may mean inside its caller's module,
    in order, without repeats."""
    module = module_path(caller_qualified)
    after = lambda p: F.regexp_replace(callee, f"^{p}", "")
    return F.array_distinct(
        F.array_compact(
            F.array(
                callee,
                F.when(callee.startswith("self::"), join_path(module, after("self::"))),
                F.when(callee.startswith("super::"), join_path(super_path(module), after("super::"))),
                F.when(callee.startswith("Self::"), join_path(module, after("Self::"))),
                F.when(callee.startswith("self."), join_path(module, after(r"self\."))),
                F.when(~callee.contains("::") & ~callee.contains("."), join_path(module, callee)),
                F.when(callee.contains("::") & ~callee.rlike("^(crate|self|super|Self)::"), join_path(module, callee)),
            )
        )
    )


def import_path(reference: Column) -> Column:
    """The path in ``use x;``, ``using x;``, ``... from "m"`` or ``import "m"``."""
    quoted = F.regexp_extract(reference, "(?:from|import)\\s*[\"']([^\"']+)[\"']", 1)
    used = F.regexp_extract(reference, r"^\s*(?:pub\s+)?(?:use|using)\s+(?:static\s+)?([^;]+?)\s*;?\s*$", 1)
    return F.coalesce(F.nullif(quoted, F.lit("")), F.nullif(F.trim(used), F.lit("")))


def package_root(path: Column) -> Column:
    """First part of an import path; two for scoped npm packages."""
    return F.regexp_extract(path, "^(@[^/]+/[^/]+|[^/:.]+)", 1)


def package_token(name: Column) -> Column:
    return F.lower(F.regexp_replace(name, "-", "_"))


def referenced_symbol(path: Column) -> Column:
    return F.nullif(F.regexp_extract(path, r"([A-Za-z_][A-Za-z0-9_]*)\W*$", 1), F.lit(""))


def test_name_candidates(name: Column) -> Column:
    """The full name and each ``::`` suffix, longest first."""
    parts = F.split(name, "::")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "::"))


def error_summary(text: Column) -> Column:
    return F.substring(F.regexp_replace(F.trim(text), r"\s+", " "), 1, 512)


def percent(count: Column, total: Column) -> Column:
    return F.when(total <= 0, 0).otherwise(F.least(F.lit(100), F.floor(count * 100 / total))).cast("int")


def timestamp(text: Column) -> Column:
    """Epoch seconds or ISO text as a timestamp."""
    return F.coalesce(F.timestamp_seconds(text.try_cast("bigint")), text.try_cast("timestamp"))


def seconds_before(epoch: Column, seconds: int) -> Column:
    return F.greatest(epoch - seconds, F.lit(0).cast("bigint"))
