"""Runtime log lines: stack frames, failing tests and noise, by regular expression.

Each line is classified on its own (``classify``); what depends on other lines
- a symbol line that waits for its location, the section a line is in - is done
by windows in ``codequarry.sources.runtime_log``.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: File extensions that mark a source location.
SOURCES = "rs|cs|jsx|js|tsx|ts|mjs|cjs|mts|cts"
_PATH = rf"((?:file://)?(?:[A-Za-z]:)?[^\s():]*\.(?:{SOURCES}))"
CSHARP = rf"^at\s+(.+?)\s+in\s+(.+\.(?:{SOURCES})):line\s+(\d+)"
V8 = rf"^at\s+(?:async\s+)?([^\s(]+(?:\s\[as\s[^\]]+\])?)\s+\({_PATH}:(\d+):(\d+)\)"
INLINE = rf"^(?:\d+:\s+)?(?:0x[0-9a-f]+\s+-\s+)?([A-Za-z_<][^\s]*::[^\s]*|<.+>::[^\s]+)\s+at\s+{_PATH}:(\d+)(?::(\d+))?"
TRACING = rf"\bfile=\"?([^\s\"]+\.(?:{SOURCES}))\"?.*?\bline=\"?(\d+)"
LOCATION = rf"{_PATH}:(\d+)(?::(\d+))?"
SYMBOL = r"^\d+:\s+(?:0x[0-9a-fA-F]+\s+-\s+)?(<.+|[A-Za-z_][^\s]*::[^\s]*|[A-Za-z_][A-Za-z0-9_]*)$"
NOISE = rf"^at\s|panicked at|\.(?:{SOURCES}):"
HEADER = r"(?i)^(stack backtrace|backtrace|caused by):?$"


def _got(line: Column, pattern: str, group: int) -> Column:
    return F.nullif(F.regexp_extract(line, pattern, group), F.lit(""))


def _number(text: Column) -> Column:
    return text.try_cast("bigint")


def _frame(symbol, path, line, column) -> Column:
    none = F.lit(None)
    return F.struct((none.cast("string") if symbol is None else symbol).alias("symbol"), path.alias("path"), line.alias("line"), (none.cast("bigint") if column is None else column).alias("column"))


def clean_symbol(text: Column) -> Column:
    """Without a leading frame number and address and without a hash suffix."""
    return F.regexp_replace(F.regexp_replace(text, r"^(\d+:\s*)?(0x[0-9a-fA-F]+\s+-\s+)?", ""), r"::h[0-9a-f]{16}$", "")


def classify(line: Column) -> Column:
    """struct(kind, frame): kind is blank, failures, header, full, location,
    symbol, noise or other; the first shape that fits wins."""
    t = F.trim(line)
    internal = t.rlike(r"\(node:|\bnode:internal/")
    csharp = _frame(F.regexp_replace(_got(t, CSHARP, 1), r"\(.*\)$", ""), _got(t, CSHARP, 2), _number(_got(t, CSHARP, 3)), None)
    v8 = _frame(_got(t, V8, 1), _got(t, V8, 2), _number(_got(t, V8, 3)), _number(_got(t, V8, 4)))
    inline = _frame(clean_symbol(_got(t, INLINE, 1)), _got(t, INLINE, 2), _number(_got(t, INLINE, 3)), _number(_got(t, INLINE, 4)))
    tracing = _frame(_got(t, r"\btarget=\"?([^\s\"]+)", 1), _got(t, TRACING, 1), _number(_got(t, TRACING, 2)), _number(_got(t, r"\bcolumn=\"?(\d+)", 1)))
    location = _frame(None, _got(t, LOCATION, 1), _number(_got(t, LOCATION, 2)), _number(_got(t, LOCATION, 3)))
    symbol = clean_symbol(_got(t, SYMBOL, 1))
    nothing = _frame(None, F.lit(None).cast("string"), F.lit(None).cast("bigint"), None)
    named = lambda kind, frame: F.struct(F.lit(kind).alias("kind"), frame.alias("frame"))
    return (
        F.when(t == "", named("blank", nothing)).when(t == "failures:", named("failures", nothing)).when(t.rlike(HEADER), named("header", nothing))
        .when(internal, named("other", nothing)).when(t.rlike(CSHARP), named("full", csharp)).when(t.rlike(V8), named("full", v8)).when(t.rlike(INLINE), named("full", inline))
        .when(t.rlike(TRACING), named("full", tracing)).when(t.rlike(LOCATION), named("location", location))
        .when(t.rlike(SYMBOL) & (symbol.contains("::") | symbol.startswith("<")), named("symbol", _frame(symbol, F.lit(None).cast("string"), F.lit(None).cast("bigint"), None)))
        .when(t.rlike(NOISE), named("noise", nothing)).otherwise(named("other", nothing))
    )


def failing_test(line: Column, in_failures: Column) -> Column:
    """Name of the test that a line says failed, or null."""
    t = F.trim(line)
    bare = t.rlike(r"^[A-Za-z_][A-Za-z0-9_]*(::[A-Za-z0-9_]+)+$")
    return F.coalesce(_got(t, r"^test (\S+) \.\.\. FAILED$", 1), _got(t, r"^---- (\S+) stdout ----$", 1), F.when(in_failures & bare, t))
