"""Secret scan: fixed credential patterns and sliding-window entropy.

DataFrame and SQL expressions only.  A text is matched by the JVM's regular
expressions; a match's place follows from the lengths of the pieces between
matches, so no position ever has to be searched for twice.  Beside the fixed
kinds, candidate strings (long runs of key characters) are judged by the
Shannon entropy of every window of ``WINDOW`` characters.  The counts behind
the entropy are kept incrementally: one character enters, one leaves, and two
terms of the sum change.  A window with a well-known placeholder does not count.
Of candidates in which no letter is next to a digit (words, paths, numbers) the
tokens of letters are measured, not the whole.  Each run of hexadecimal digits of one case inside a
candidate is judged with the threshold of its class, and a hit is the whole run;
what is found in one candidate is one span.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

# The patterns and least lengths of the contract.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
#: Matches of HEX are whole runs, so a run of the least length or more is the same span.
HEX_RUN = r"[0-9a-f]{24,}"
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 6, 20, 24
KINDS = ("assign", "access", "hex", "entropy")

#: Characters in an entropy window.
WINDOW = 20
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
#: Hexadecimal runs are judged by themselves, whatever they are glued to.
HEX_CANDIDATES = (r"[0-9a-f]{20,}", r"[0-9A-F]{20,}")
#: Character class -> (alphabet, least entropy in bits of a window).
CLASSES = {
    "hex": ("0123456789abcdef", 2.9),
    "key": ("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-", 3.7),
}
#: A candidate without a letter beside a digit is made of words, paths, rulers
#: or numbers: of these only the letter tokens are measured.
MIXED = r"[A-Za-z][0-9]|[0-9][A-Za-z]"
LETTERS = r"[A-Za-z]{20,}"
#: A window with one of these is no secret; what else is in the candidate may be.
PLACEHOLDER = r"(?i)example|placeholder|changeme|dummy|xxxx|0123456789|abcdefgh"
#: Window starts that are judged at once, and characters around them that matter.
STEP, MARGIN = 1024, 32
#: Longer texts are cut at the first place after so many characters that no
#: match can lie across: a character of no pattern, or a blank that is neither
#: beside another nor beside a colon or equals sign.
CUT = 4096
SEGMENT = rf"""(?s).{{{CUT}}}.*?(?:[^A-Za-z0-9+/_.=\x20:"'-]|(?<![:=\x20])\x20(?![\x20:=])|\z)|.+"""
#: Placeholders that go on: windows that share a character with them are none either.
RULERS = ("0123456789", "abcdefgh")


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _placed(text: str, pattern: str, group: int, least: int, rank: int) -> str:
    """SQL: array of (start, rank, end, found) of the matches of ``pattern`` whose
    ``group`` has ``least`` characters; leftmost, non-overlapping, code points."""
    q = _quoted(pattern)
    none = "cast(array() as array<struct<start:int,rank:int,end:int,found:string>>)"
    walk = f"""aggregate(
      zip_with(zip_with(
          slice(split({text}, {q}, -1), 1, size(regexp_extract_all({text}, {q}, 0))), regexp_extract_all({text}, {q}, 0),
          (g, m) -> named_struct('gap', length(g), 'whole', m)), regexp_extract_all({text}, {q}, {group}),
        (x, p) -> named_struct('gap', x.gap, 'whole', x.whole, 'part', p)),
      named_struct('at', 0, 'out', {none}),
      (s, m) -> named_struct(
        'at', s.at + m.gap + length(m.whole),
        'out', if(length(m.part) >= {least},
          concat(s.out, array(named_struct('start', s.at + m.gap, 'rank', {rank}, 'end', s.at + m.gap + length(m.whole), 'found', m.whole))),
          s.out)),
      s -> s.out)"""
    return f"case when {text} rlike {q} then {walk} else {none} end"


def _allowed(s: str) -> str:
    """SQL: the window of ``s`` that ends at ``i`` holds a placeholder or meets a ruler."""
    met = [f"substring({s}, greatest(i - {WINDOW + len(r) - 3}, 1), i + {len(r)} - greatest(i - {WINDOW + len(r) - 3}, 1) + 1) rlike '(?i){r}'" for r in RULERS]
    return " or ".join([f"substring({s}, i - {WINDOW - 2}, {WINDOW}) rlike {_quoted(PLACEHOLDER)}", *met])


def _entropy_span(kind: str, s: str) -> str:
    """SQL: (first, last) start of the windows of ``s`` that are random enough
    for the class, (-1, -1) if none.

    Counts are updated per character: each symbol has five bits of a row of
    bigints, one symbol enters and one leaves.  Long strings are taken in pieces
    of ``STEP`` window starts with ``MARGIN`` characters around them, so no
    look-up reaches far into a string and the time is linear in its length.
    """
    alphabet, least = CLASSES[kind]
    rows = -(-len(alphabet) // 12)
    terms = "array(" + ", ".join(f"{c * math.log2(c) if c else 0.0:.17e}D" for c in range(WINDOW + 2)) + ")"
    count = "cast(shiftright(get(t.n, cast({0} div 12 as int)), 5 * ({0} % 12)) & 31 as int)"
    one = "if({0} >= 0 and x = {0} div 12, shiftleft(1L, 5 * ({0} % 12)), 0L)"
    change = f"""if(d.e = d.l, 0D, get({terms}, {count.format("d.e")} + 1) - get({terms}, {count.format("d.e")})
        + if(d.l >= 0, get({terms}, {count.format("d.l")} - 1) - get({terms}, {count.format("d.l")}), 0D))"""
    hit = f"i >= w.lo + {WINDOW - 1} and i < w.lo + {STEP + WINDOW - 1} and {math.log2(WINDOW)!r}D - f / {WINDOW}D >= {least!r}D and not ({_allowed('w.s')})"
    step = f"""get(transform(array(named_struct('e', get(w.codes, i), 'l', if(i >= {WINDOW}, get(w.codes, i - {WINDOW}), -1))), d ->
        get(transform(array(t.f + {change}), f -> get(transform(array({hit}), k -> named_struct(
          'n', if(d.e = d.l, t.n, transform(t.n, (v, x) -> v + {one.format("d.e")} - {one.format("d.l")})), 'f', f,
          'first', if(k and t.first < 0, i - {WINDOW - 1}, t.first), 'last', if(k, i - {WINDOW - 1}, t.last))), 0)), 0)), 0)"""
    piece = f"""get(transform(array(substring(z, greatest(at - {MARGIN}, 0) + 1, {STEP + WINDOW - 1 + 2 * MARGIN})), p -> get(transform(
        array(named_struct('s', p, 'lo', least(at, {MARGIN}), 'codes', transform(slice(split(p, ''), 1, length(p)), y -> instr({_quoted(alphabet)}, y) - 1))), w -> aggregate(
          sequence(0, length(w.s) - 1), named_struct('n', array_repeat(0L, {rows}), 'f', 0D, 'first', -1, 'last', -1), (t, i) -> {step},
          t -> named_struct('first', if(t.first < 0, null, t.first + at - w.lo), 'last', if(t.last < 0, -1, t.last + at - w.lo)))), 0)), 0)"""
    return f"""get(transform(array({s}), z -> get(transform(array(transform(sequence(0, greatest(length(z) - {WINDOW}, 0), {STEP}), at -> {piece})),
        r -> named_struct('first', coalesce(array_min(transform(r, q -> q.first)), -1), 'last', array_max(transform(r, q -> q.last)))), 0)), 0)"""


def _segments(text: str) -> str:
    """SQL: array of (at, text): the text cut where no match can lie across."""
    q = _quoted(SEGMENT)
    cut = f"if(length({text}) <= {CUT}, filter(array({text}), v -> v <> ''), regexp_extract_all({text}, {q}, 0))"
    none = "cast(array() as array<struct<at:int,text:string>>)"
    return f"aggregate({cut}, named_struct('at', 0, 'out', {none}), (s, v) -> named_struct('at', s.at + length(v), 'out', concat(s.out, array(named_struct('at', s.at, 'text', v)))), s -> s.out)"


def _scanned(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``segs``: array of (at, text, base, spans); places in the
    segment, spans in order of start, then kind."""
    of = "seg.text"
    base = f"sort_array(concat({_placed(of, ASSIGN, 2, ASSIGN_LEAST, 0)}, {_placed(of, ACCESS, 0, ACCESS_LEAST, 1)}, {_placed(of, HEX_RUN, 0, HEX_LEAST, 2)}))"
    outside = "not exists(seg.base, b -> b.start <= h.start and h.end <= b.end)"
    mixed, letters = _quoted(MIXED), _quoted(LETTERS)
    candidates = f"filter({_placed(of, CANDIDATE, 0, WINDOW, 3)}, c -> c.found rlike {mixed} or c.found rlike {letters})"
    hexes = f"""filter(concat({_placed(of, HEX_CANDIDATES[0], 0, WINDOW, 3)}, {_placed(of, HEX_CANDIDATES[1], 0, WINDOW, 3)}),
        h -> h.found rlike {mixed} and {outside} and ({_entropy_span("hex", "lower(h.found)")}).first >= 0)"""
    tokens = f"""filter(transform(filter({_placed(of, LETTERS, 0, WINDOW, 3)}, h -> {outside} and exists(seg.candidates, c -> c.start <= h.start and h.end <= c.end and not c.found rlike {mixed})),
        h -> named_struct('h', h, 'w', {_entropy_span("key", "h.found")})), x -> x.w.first >= 0)"""
    pieces = f"""transform(seg.candidates, c -> named_struct('c', c, 'parts', concat(
        if(c.found rlike '^([0-9a-f]+|[0-9A-F]+)$' or not c.found rlike {mixed}, cast(array() as array<struct<start:int,end:int>>),
            transform(filter(array({_entropy_span("key", "c.found")}), k -> k.first >= 0), k -> named_struct('start', c.start + k.first, 'end', c.start + k.last + {WINDOW}))),
        transform(filter(seg.hexes, h -> c.start <= h.start and h.end <= c.end), h -> named_struct('start', h.start, 'end', h.end)),
        transform(filter(seg.tokens, x -> c.start <= x.h.start and x.h.end <= c.end), x -> named_struct('start', x.h.start + x.w.first, 'end', x.h.start + x.w.last + {WINDOW})))))"""
    judged = f"""transform(filter({pieces}, x -> size(x.parts) > 0), x -> named_struct('c', x.c,
        'start', array_min(transform(x.parts, y -> y.start)), 'end', array_max(transform(x.parts, y -> y.end))))"""
    added = f"""filter(transform({judged}, x -> named_struct('start', x.start, 'rank', 3,
        'end', x.end, 'found', substring(x.c.found, x.start - x.c.start + 1, x.end - x.start))),
        e -> not exists(seg.base, b -> b.start <= e.start and e.end <= b.end))"""
    # each step reads the one before more than once: a column of its own
    each = lambda names, last: F.expr(f"transform(segs, seg -> named_struct({', '.join(f'{chr(39)}{n}{chr(39)}, seg.{n}' for n in names)}, {last}))")
    some = "size(seg.candidates) > 0"
    return (
        docs.withColumn("segs", F.expr(_segments(f"coalesce({text}, '')")))
        .withColumn("segs", each(("at", "text"), f"'base', {base}, 'candidates', {candidates}"))
        .withColumn("segs", each(("at", "text", "base", "candidates"), f"'hexes', case when {some} then {hexes} end, 'tokens', case when {some} then {tokens} end"))
        .withColumn("segs", each(("at", "text", "base"), f"'spans', case when {some} then sort_array(concat(seg.base, {added})) else seg.base end"))
    )


def with_spans(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with two more columns: ``base_spans`` and ``spans``.

    Both are arrays of (start, rank, end, found) in order of start, then kind
    (rank in ``KINDS``); code points, end exclusive.  ``spans`` adds to the base
    spans the entropy spans that lie in none of them.  Null and empty texts
    have empty arrays; rows and other columns stay as they are.  The time is
    linear in a text's length, whatever its number of matches.
    """
    placed = lambda field: F.expr(f"flatten(transform(segs, seg -> transform(seg.{field}, b -> named_struct('start', b.start + seg.at, 'rank', b.rank, 'end', b.end + seg.at, 'found', b.found))))")
    return _scanned(docs, text).withColumn("base_spans", placed("base")).withColumn("spans", placed("spans")).drop("segs")


def digest_text(spans: str) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = "array(" + ", ".join(f"'{k}'" for k in KINDS) + ")"
    return F.expr(f"array_join(transform({spans}, s -> concat_ws(':', get({names}, s.rank), s.start, s.end)), ',')")


def scan(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_entropy.

    Null and empty texts have no spans (the hash is that of the empty string).
    Null or repeated doc_ids are kept as they come, one row for each input row.
    """
    found = with_spans(docs.select("doc_id", "text")).drop("text")
    count = lambda rank: F.expr(f"cast(size(filter(spans, s -> s.rank = {rank})) as bigint)")
    return found.select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(digest_text("base_spans"), 256).alias("base_sha256"),
        digest_text("spans").alias("spans"),
        count(3).alias("n_entropy"),
    )


def redact(docs: DataFrame, mask: str = "[secret]") -> DataFrame:
    """``docs`` with each secret replaced by ``mask`` and ``n_chars`` made right.

    Overlapping spans are replaced once.  All rows and columns stay; texts
    without secrets, null ones included, are untouched.
    """
    columns = docs.columns
    inner = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"), F.col("text"))
    found = _scanned(inner).withColumn("found", F.expr("exists(segs, seg -> size(seg.spans) > 0)"))
    rebuilt = F.expr(
        f"""array_join(transform(segs, seg -> if(size(seg.spans) = 0, seg.text, aggregate(seg.spans, named_struct('at', 0, 'out', cast('' as string)),
        (s, m) -> if(m.start >= s.at,
          named_struct('at', m.end, 'out', concat(s.out, substring(seg.text, s.at + 1, m.start - s.at), {_quoted(mask)})),
          named_struct('at', greatest(s.at, m.end), 'out', s.out)),
        s -> concat(s.out, substring(seg.text, s.at + 1, length(seg.text) - s.at))))), '')"""
    )
    clean = found.withColumn("masked", F.when(F.col("found"), rebuilt).otherwise(F.col("text")))
    changed = {"text": F.col("masked"), "n_chars": F.when(F.col("found"), F.length("masked").cast("bigint")).otherwise(F.col("row.n_chars"))} if "n_chars" in columns else {"text": F.col("masked")}
    return clean.select(*[changed.get(c, F.col(f"row.`{c}`")).alias(c) for c in columns])
