"""The approximate tokenizer and overlapping segments of its tokens."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import IntegerType, StringType, StructType

#: A run of white space, up to four ASCII word characters, one other
#: character.  Words are cut every four bytes, other scripts per character.
TOKEN = r"\s+|[A-Za-z0-9_]{1,4}|[^\sA-Za-z0-9_]"
_TOKEN = re.compile(r"\s+|[A-Za-z0-9_]{1,4}|[^\sA-Za-z0-9_]")
_BREAK = re.compile("\n")


def count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(TOKEN)), F.lit(0)).cast("bigint")


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def overlap(budget: int) -> int:
    """Tokens that two segments share."""
    return 0 if budget < 8 else min(budget // 5, 64, budget - 1)


def cuts(text: str, budget: int) -> Iterator[tuple[int, int, int]]:
    """Segments of at most ``budget`` tokens that overlap: (start, end, tokens).

    A segment rather ends after a line break, if one lies in its second half.
    No token or no budget, no segment.  Time is linear in the text.
    """
    ends = list(accumulate(map(len, _TOKEN.findall(text)), initial=0))  # tokens cover the text
    if len(ends) == 1 or budget <= 0:
        return
    count, breaks = len(ends) - 1, [bisect_right(ends, m.start()) for m in _BREAK.finditer(text)]
    first, shared = 0, overlap(budget)
    while True:
        last = min(first + budget, count)
        if last < count:
            at = bisect_right(breaks, last) - 1
            if at >= bisect_left(breaks, first + max(budget // 2, 1)):
                last = breaks[at]
        yield ends[first], ends[last], last - first
        if last == count:
            return
        first = max(last - shared, first + 1)


def segments(text: str, budget: int) -> list[str]:
    """The texts of ``cuts``."""
    return [text[start:end] for start, end, _ in cuts(text, budget)]


def segment_table(df: DataFrame, text: str, budget: int) -> DataFrame:
    """Rows of ``df`` with segment_index, segment and segment_tokens (Arrow
    batches: the step depends on the text).  A null text has no segments."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, index, parts, counts = [], [], [], []
            for row, value in enumerate(batch.column(text).to_pylist()):
                for k, (start, end, n) in enumerate(cuts(value or "", budget)):
                    rows.append(row)
                    index.append(k)
                    parts.append(value[start:end])
                    counts.append(n)
            own = batch.take(pa.array(rows, pa.int64()))
            added = [pa.array(index, pa.int32()), pa.array(parts, pa.string()), pa.array(counts, pa.int32())]
            yield pa.RecordBatch.from_arrays([*own.columns, *added], names=[*batch.schema.names, "segment_index", "segment", "segment_tokens"])

    schema = StructType(list(df.schema.fields)).add("segment_index", IntegerType()).add("segment", StringType()).add("segment_tokens", IntegerType())
    return df.mapInArrow(run, schema)
