"""Document fingerprints by Order MinHash, in DataFrame expressions only.

The k-mers are runs of ``K`` words (one run of all words in shorter texts).
Every k-mer carries its occurrence number, so a repeated k-mer counts as often
as it occurs.  The hashes of (k-mer, occurrence) lie on a ring of 64 bits;
slot ``f`` of ``SLOTS`` starts at a fixed point of the ring and takes the
``L`` hashes that come next.  That is a minimum under the order rotated to the
slot's start, so one hash evaluation serves all slots.  The chosen k-mers are
put back in text order and the tuple is hashed: a slot agrees only when the
same k-mers are least *and* stand in the same order, which makes the share of
equal slots sensitive to edit distance rather than to the bag of words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from codequarry.llm.neighbours import ring
from codequarry.scratch import Scratch

K = 2
L = 2
SLOTS = 64
SPACES = r"[\\x20\\x09-\\x0D]+"


def add_fingerprint(df: DataFrame, text: str, out: str) -> DataFrame:
    """``df`` with array<int> column ``out``: ``SLOTS`` hashes, or none for a text
    without words.  Each step is a column of its own that later steps read
    more than once, so Catalyst evaluates it once per row."""
    w, h, s, y = (f"__{out}_{x}" for x in "whsy")
    half = "shiftright(t.lo + t.hi, 1)"
    step = f"""aggregate(sequence(1, length(bin(size({{a}}))) + 1), named_struct('lo', 0, 'hi', {{hi}}),
        (t, u) -> if(t.lo >= t.hi, t, if({{less}}, named_struct('lo', {half} + 1, 'hi', t.hi), named_struct('lo', t.lo, 'hi', {half}))), t -> t.lo)"""
    first = step.format(a=s, hi="j", less=f"get({s}, {half}).x < e.x")
    found = step.format(a=y, hi=f"size({y})", less=f"get({y}, {half}).y < z")
    ring = "array(" + ", ".join(f"{f * (1 << 64) // SLOTS - (1 << 63)}L" if f else "cast(-9223372036854775808 as bigint)" for f in range(SLOTS)) + ")"
    pair = "(p, q) -> if(p.i <= q.i, xxhash64(p.y, q.y), xxhash64(q.y, p.y))"
    return (
        df.withColumn(w, F.expr(f"transform(filter(split(coalesce({text}, ''), '{SPACES}'), v -> v <> ''), v -> xxhash64(v))"))
        .withColumn(h, F.expr(f"case when size({w}) = 0 then cast(array() as array<bigint>) when size({w}) < {K} then {w} else transform(sequence(0, size({w}) - {K}), i -> xxhash64({', '.join(f'get({w}, i + {k})' for k in range(K))})) end"))
        .withColumn(s, F.expr(f"case when size({h}) = size(array_distinct({h})) then cast(null as array<struct<x:bigint,i:int>>) else sort_array(transform({h}, (x, i) -> named_struct('x', x, 'i', i))) end"))
        .withColumn(
            y,
            F.expr(
                f"""sort_array(case when {s} is null then transform({h}, (x, i) -> named_struct('y', xxhash64(x, 0), 'i', i))
                else transform({s}, (e, j) -> named_struct('y', xxhash64(e.x, if(j = 0 or get({s}, j - 1).x <> e.x, 0, j - {first})), 'i', e.i)) end)"""
            ),
        )
        .withColumn(
            out,
            F.expr(
                f"""case when size({y}) = 0 then cast(array() as array<int>)
                else transform(transform({ring}, z -> {found}), f -> cast(shiftright(get(zip_with(
                  array(get({y}, f % size({y}))), array(get({y}, (f + 1) % size({y}))), {pair}), 0), 32) as int)) end"""
            ),
        )
        .drop(w, h, s, y)
    )


def likeness(a: str, b: str) -> Column:
    """Share of equal slots (0 to 1); two texts without words are alike."""
    return F.expr(
        f"""case when size({a}) = 0 and size({b}) = 0 then 1D when size({a}) = 0 or size({b}) = 0 then 0D
        else size(filter(zip_with({a}, {b}, (p, q) -> p = q), e -> e)) / {SLOTS}D end"""
    )


def as_hex(column: str) -> Column:
    """The fingerprint as a string: eight hex digits per slot."""
    return F.expr(f"array_join(transform({column}, v -> lpad(lower(hex(cast(v as bigint) & 4294967295)), 8, '0')), '')")


def edited_likeness(docs: DataFrame, label: str = "fingerprint") -> DataFrame:
    """Fingerprint each document and an edited form of it, and compare.

    Needs ``doc_id`` (bigint, distinct) and ``text``; other columns are not
    read.  The edited text has its last floor(n_chars / 3) code points replaced
    by the first as many (or all) of the next document's, by descending doc_id
    (after the last: the first).  Null texts count as empty.  Rows without a
    doc_id take no part; the longest text (then the last in order) stands for a
    repeated doc_id.  Result:
    doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next.  A single document is its own next.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, label)
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).where("doc_id is not null")
    sizes = scratch.save(docs.groupBy("doc_id").agg(F.max(F.struct(F.length("text").alias("n"), F.xxhash64("text").alias("x"))).alias("t")).select("doc_id", "t.n", "t.x"), "sizes")
    links = scratch.save(ring(sizes.select("doc_id", F.struct("n", "x").alias("size")), scratch, "size"), "links")

    # Written as XORs, which Catalyst does not take for join keys: the texts
    # stay partitioned by doc_id alone and are shuffled once.
    own = docs.join(links, "doc_id").where("(length(text) ^ carry.n) = 0 and (xxhash64(text) ^ carry.x) = 0")
    heads = own.select(F.col("prev_id").alias("doc_id"), F.expr("substring(text, 1, cast(prev_carry.n div 3 as int))").alias("head"))
    edited = own.join(heads, "doc_id").select(
        "doc_id", "next_id", "text", F.length("text").cast("bigint").alias("n_chars"),
        F.expr("concat(substring(text, 1, length(text) - cast(length(text) div 3 as int)), head)").alias("edited"),
    )
    marked = add_fingerprint(add_fingerprint(edited, "text", "own"), "edited", "other")
    kept = scratch.save(marked.select("doc_id", "next_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "own", "other").dropDuplicates(["doc_id"]), "marked")
    after = kept.select(F.col("doc_id").alias("next_id"), F.col("own").alias("following"))
    return kept.join(after, "next_id").select(
        "doc_id", "n_chars", "edited_sha256", as_hex("own").alias("fingerprint"), as_hex("other").alias("edited_fingerprint"),
        likeness("own", "other").alias("near_edited"), likeness("own", "following").alias("near_next"),
    )
