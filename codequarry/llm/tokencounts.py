"""Token counts by prefix dynamic programming.

White space never lies inside a token of a word tokenizer, so the count of a
prefix that ends at a word border is the count at the border before plus that
of one word: N[i] = N[i-1] + n(word i).  Inside a word the same is done over its
tokens (``bpeprefix``), once per distinct word.  So the count at every code
point of a text is stored, and truncation and budget questions are answered
from the table: no prefix is encoded again.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from codequarry.llm.bpeprefix import Bpe

CACHE = 400_000
#: Bytes of texts whose words are learned at once.
AT_ONCE = 1 << 20
#: Closing punctuation that stands alone after a letter or digit.
TAIL = b".,;:!?%&#*$"
#: ASCII white space, where texts are cut into words.
SPACE = b" \t\n\r\x0b\x0c"


class Counter:
    """Exact token counts of words, of a ``tokenizers`` file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.bpe = Bpe(path)  # ValueError for a tokenizer of another kind
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        if any(" " in t or not t.startswith("<|") for t in self.special):
            raise ValueError("special strings of a kind that words are not kept apart for")
        self.counts: dict[bytes, int] = {}
        self.prefixes: dict[str, np.ndarray] = {}
        self.held = 0

    def learn(self, words: set[bytes]) -> None:
        """Count words not seen yet; the store is bounded and starts anew when full.

        A letter or digit and closing punctuation never share a token, so a
        word with a tail costs nothing if its stem and tail are known.
        """
        new = words.difference(self.counts)
        if not new:
            return
        if len(self.counts) + 2 * len(new) > CACHE:
            self.counts.clear()
            new = words
        split = {}
        for w in new:
            stem = w.rstrip(TAIL)
            if len(stem) < len(w) and stem and stem[-1:].isalnum():
                split[w] = (stem, w[len(stem) :])
        todo = [w for w in {*new.difference(split), *(x for pair in split.values() for x in pair)} if w not in self.counts]
        for at in range(0, len(todo), 8192):
            part = todo[at : at + 8192]
            for w, e in zip(part, self.library.encode_batch_fast([w.decode("utf-8", "replace") for w in part], add_special_tokens=False), strict=True):
                self.counts[w] = len(e)
        for w, (stem, tail) in split.items():
            self.counts[w] = self.counts[stem] + self.counts[tail]

    def each(self, texts: list[bytes]) -> Iterator[np.ndarray]:
        """For each text the counts of its words, in order.

        New words are learned for many texts at once.  Letter case does not
        matter to the tokenizer but inside special strings and below combining
        marks (U+0300 to U+036F), which may compose with one case only.
        """
        at = 0
        while at < len(texts):
            split, size = [], 0
            while at < len(texts) and (size < AT_ONCE or not split):
                text = texts[at]
                split.append((text if b"<|" in text or b"\xcc" in text or b"\xcd" in text else text.lower()).split())
                size += len(text)
                at += 1
            self.learn(set().union(*split))
            for words in split:
                yield np.fromiter(map(self.counts.__getitem__, words), np.int64, len(words))

    def inside(self, word: str) -> np.ndarray:
        """Counts of the prefixes of 0, 1, ... code points of a word."""
        known = self.prefixes.get(word)
        if known is None:
            if self.held > CACHE * 8:
                self.prefixes.clear()
                self.held = 0
            if self.bpe.plain(word) and not any(t in word for t in self.special):
                known = self.bpe.word(word)
            else:  # normalisation or special strings reach over the cut
                every = self.library.encode_batch_fast([word[:n] for n in range(len(word) + 1)], add_special_tokens=False)
                known = np.array([len(e) for e in every], np.int32)
            self.prefixes[word] = known
            self.held += len(known)
        return known

    def of(self, text: bytes) -> np.ndarray:
        """Counts of one text's words."""
        return next(self.each([text]))


_counters: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    if path not in _counters:
        _counters[path] = Counter(path)
    return _counters[path]


def borders(text: bytes) -> np.ndarray:
    """Byte ends of the words of ``text``."""
    data = np.frombuffer(text, np.uint8)
    space = np.isin(data, np.frombuffer(SPACE, np.uint8))
    after = np.append(space[1:], True)
    return np.flatnonzero(~space & after[: len(data)]) + 1


#: White space where texts are cut into words, as characters.
_WORD = re.compile(f"[^{re.escape(SPACE.decode())}]+")


class PrefixTable:
    """Token counts at every prefix of one text: ``counts[n]`` for n code points."""

    def __init__(self, text: str, tokens: Counter):
        self.counts = np.zeros(len(text) + 1, np.int32)
        before, at = 0, 0
        for m in _WORD.finditer(text):
            self.counts[at : m.start() + 1] = before
            inside = tokens.inside(m[0])
            self.counts[m.start() : m.end() + 1] = before + inside
            before, at = before + int(inside[-1]), m.end()
        self.counts[at:] = before

    def at(self, n_chars: int) -> int:
        """Tokens of the first ``n_chars`` code points."""
        return int(self.counts[min(n_chars, len(self.counts) - 1)])

    def longest(self, budget: int) -> int:
        """Code points of the longest prefix with at most ``budget`` tokens."""
        return int(np.flatnonzero(self.counts <= budget)[-1])


def _texts(column: pa.Array) -> Iterator[bytes]:
    for value in column.cast(pa.large_binary()):
        yield value.as_py() or b""


def prefix_tables(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_bytes, ends, counts, prefix_counts): the tables of every text.

    ``ends`` are the byte ends of the words, ``counts`` the exact number of
    tokens up to there; ``prefix_counts`` has the number of tokens of the first
    0, 1, ... code points.  A null or empty text has no words and [0].  Rows
    with a null or repeated doc_id are kept; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = counter(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                texts = list(_texts(part.column("text")))
                every = [PrefixTable(t.decode(), tokens).counts for t in texts]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"), pa.array([len(t) for t in texts], pa.int64()), pa.array([borders(t) for t in texts], pa.list_(pa.int64())),
                        pa.array([np.cumsum(c) for c in tokens.each(texts)], pa.list_(pa.int64())), pa.array(every, pa.list_(pa.int32())),
                    ],
                    ["doc_id", "n_bytes", "ends", "counts", "prefix_counts"],
                )

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, n_bytes bigint, ends array<bigint>, counts array<bigint>, prefix_counts array<int>")


def truncated(tables: DataFrame, budget: int) -> DataFrame:
    """(doc_id, n_chars): the longest prefix of each text with at most ``budget``
    tokens, read off the rows of ``prefix_tables``."""
    return tables.select("doc_id", F.expr(f"size(prefix_counts) - 1 - coalesce(array_position(transform(reverse(prefix_counts), n -> n <= {int(budget)}), true) - 1, size(prefix_counts) - 1)").cast("bigint").alias("n_chars"))


def count(docs: DataFrame, path: str, limit: int = 2048) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit): the last entry of each table.

    The table is made per text and only its end leaves the worker.  Null and
    empty texts have 0 tokens.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = counter(path)
        for batch in batches:
            totals = []
            texts = list(_texts(batch.column("text")))
            sizes = list(map(len, texts))
            for counts in tokens.each(texts):
                table = np.cumsum(counts)
                totals.append(int(table[-1]) if len(table) else 0)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(totals, pa.int64()), pa.array([n > limit for n in totals], pa.bool_())], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean")
