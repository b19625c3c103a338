"""Identifiers.

Ids are 32 hex digits.  The engine's own are md5 over NUL-joined parts, which
runs inside generated code.  ``fnv128`` gives the 128-bit FNV-1a ids, for data
that already carries those, as an Arrow UDF.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, functions as F

FNV_OFFSET = 0x6C62272E07BB014262B821756295C58D
FNV_PRIME = 0x0000000001000000000000000000013B


def stable_id(*parts: Column) -> Column:
    """md5 of the parts joined by NUL; null parts count as empty."""
    return F.md5(F.concat_ws("\u0000", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]))


def content_hash(text: Column) -> Column:
    return F.md5(text)


def fnv1a_128(data: bytes) -> str:
    value = FNV_OFFSET
    for byte in data:
        value = ((value ^ byte) * FNV_PRIME) & ((1 << 128) - 1)
    return f"{value:032x}"


def fnv_id(domain: str, parts: list[str]) -> str:
    """FNV-1a-128 over the domain and the parts, each ended by a NUL byte."""
    return fnv1a_128(b"".join(p.encode() + b"\0" for p in [domain, *parts]))


def fnv128(text: Column, domain: str = "content") -> Column:
    @F.pandas_udf("string")
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else fnv1a_128(domain.encode() + b"\0" + v.encode()))

    return run(text)


def vector_point_id(hex32: Column) -> Column:
    """32 hex digits as UUID text; anything else is null."""
    shaped = F.regexp_replace(hex32, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
    return F.when(hex32.rlike("^[0-9a-fA-F]{32}$"), shaped)


def vector_rowid(point_id: Column) -> Column:
    """The first 16 hex digits as a positive 63-bit integer, at least 1."""
    head = F.substring(F.regexp_replace(point_id, "-", ""), 1, 16)
    value = F.conv(head, 16, 10).cast("decimal(20,0)")
    low = F.pmod(value, F.lit("9223372036854775808").cast("decimal(20,0)"))
    return F.greatest(low.cast("bigint"), F.lit(1).cast("bigint"))


def slug(text: Column) -> Column:
    """Lower-case letters and digits; runs of others become one ``_``."""
    out = F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    return F.when(out == "", "unknown").otherwise(out)


def vector_table_name(repository_id: Column, model: Column, prefix: str = "vectors") -> Column:
    return F.concat_ws("_", F.lit(prefix), slug(repository_id), slug(model))
