"""Benchmark decontamination by the q-gram lemma.

Benchmark items are cut into overlapping windows of ``WINDOW`` code points.  If
a document's region is within ``e`` edits of a window of length m, they share
at least m + 1 - (e + 1) * Q q-grams, all within ``e`` diagonals.  So the shared
q-grams are counted in overlapping diagonal bands, regions that reach the bound
are kept, and banded alignment gives their exact edit distance.  The lemma
loses nothing of a window; the alignment lets nothing false through.

A passage need not lie on the windows.  Where they find nothing, the q-grams are
counted per diagonal band against the whole item, and each of its stretches of
``WINDOW`` (``RATE`` edits) and of ``PASSAGE`` code points (``SLIPS`` edits), at
any offset, that reaches the bound is aligned.

Items below ``LEAST`` code points leave no room for edits: they are found where
they stand verbatim as whole words, by one automaton for all of them.

Documents are scanned where they lie: nothing of them is shuffled.  The index of
the benchmark goes out in blocks of about ``BLOCK_CHARS`` code points, of which
the driver holds one at a time; a larger benchmark takes one scan for each block.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from codequarry.llm.textkernel import mix
from codequarry.scratch import Scratch

Q = 10
WINDOW = 100
STRIDE = 50
#: Edits allowed in a window, as a share of its length.
RATE = 0.06
#: Shortest passage from inside a longer item that is a leak, and edits allowed in it.
PASSAGE = 50
SLIPS = 1
#: Shorter items are searched verbatim, as whole words.
LEAST = 30
BLOCK_CHARS = 2_000_000
CHUNK = 1 << 19
MAP = 1 << 21
_P = np.uint64(0x9E3779B97F4A7C15)
_POWERS = np.array([pow(int(_P), k, 1 << 64) for k in range(Q)], dtype=np.uint64)


def code_points(text: str) -> np.ndarray:
    """Code points, A-Z lower-cased."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where((points >= 65) & (points <= 90), points + 32, points).astype(np.uint32)


_LOWER = {c: c + 32 for c in range(65, 91)}


def lowered(text: str) -> str:
    return text.translate(_LOWER)


def grams(points: np.ndarray) -> np.ndarray:
    """Hashes of all q-grams, by start."""
    n = len(points) - Q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    each = mix(points.astype(np.uint64) + np.uint64(1))
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(Q):
            out += each[k : k + n] * _POWERS[k]
    return mix(out)


def budget(length: int) -> int:
    """Edits allowed in a window; never so many that the lemma says nothing."""
    return max(0, min(int(RATE * length), (length + 1) // Q - 2))


@dataclass
class Index:
    windows: list[np.ndarray]
    items: np.ndarray  # item_id of each window
    offsets: np.ndarray  # start of the window in its item
    gram: np.ndarray  # sorted distinct hashes
    first: np.ndarray  # postings of gram k: first[k] .. first[k + 1]
    window: np.ndarray
    place: np.ndarray
    edits: np.ndarray
    need: np.ndarray  # shared q-grams needed
    owner: np.ndarray  # number of the item of each window
    texts: list[np.ndarray]  # whole items, by number
    head: np.ndarray  # places of gram k in whole items: head[k] .. head[k + 1]
    source: np.ndarray
    spot: np.ndarray
    short: dict[str, list[int]]  # items below LEAST, lower-cased

    @classmethod
    def of(cls, items: list[tuple[int, str]]) -> Index | None:
        windows, ids, offsets, owner, whole = [], [], [], [], []
        short: dict[str, list[int]] = {}
        for item, text in items:
            p = code_points(text or "")
            if len(p) < LEAST:
                plain = lowered(text or "").strip()
                if any(map(str.isalnum, plain)):
                    short.setdefault(plain, []).append(item)
                continue
            last = max(len(p) - WINDOW, 0)
            for at in sorted({*range(0, last, STRIDE), last}):
                windows.append(p[at : at + WINDOW])
                ids.append(item)
                offsets.append(at)
                owner.append(len(whole))
            whole.append(p)
        if not windows:
            none = np.zeros(0, np.int64)
            return cls([], none, none, none.astype(np.uint64), np.zeros(1, np.int64), none, none, none, none, none, [], np.zeros(1, np.int64), none, none, short) if short else None
        g = [grams(w) for w in windows]
        gram = np.concatenate(g)
        window = np.repeat(np.arange(len(g)), [len(x) for x in g])
        place = np.concatenate([np.arange(len(x)) for x in g])
        order = np.argsort(gram, kind="stable")
        distinct, first = np.unique(gram[order], return_index=True)
        edits = np.array([budget(len(w)) for w in windows])
        need = np.array([len(w) + 1 - (e + 1) * Q for w, e in zip(windows, edits, strict=True)])
        # windows cover their item, so its grams are the windows' grams
        g = [grams(p) for p in whole]
        at = np.searchsorted(distinct, np.concatenate(g))
        by = np.argsort(at, kind="stable")
        head = np.searchsorted(at[by], np.arange(len(distinct) + 1))
        source = np.repeat(np.arange(len(g)), [len(x) for x in g])[by]
        spot = np.concatenate([np.arange(len(x)) for x in g])[by]
        return cls(windows, np.array(ids, np.int64), np.array(offsets), distinct, np.append(first, len(gram)), window[order], place[order], edits, need, np.array(owner), whole, head, source, spot, short)

    def automaton(self):
        """Finds all short items at once; None without any."""
        if not self.short:
            return None
        import ahocorasick

        found = ahocorasick.Automaton()
        for plain, ids in self.short.items():
            found.add_word(plain, (len(plain), ids))
        found.make_automaton()
        return found

    def bitmap(self) -> np.ndarray:
        have = np.zeros(MAP, bool)
        have[(self.gram & np.uint64(MAP - 1)).astype(np.int64)] = True
        return have


def distance(pattern: np.ndarray, region: np.ndarray, most: int, shift: int) -> tuple[int, int, int] | None:
    """(edits, start, end) of the best place of ``pattern`` in ``region``.

    Alignment by rows over the band of columns that ``shift`` and ``most``
    leave: row i covers columns i - most .. i + shift + most.  None if no place
    has at most ``most`` edits; then the least end, then the latest start wins.
    """
    m, width = len(pattern), shift + 2 * most + 1
    big = m + 1
    cost = np.full(width + 1, big)
    cost[:width] = 0  # a match may start at any column of the band
    cost[: most] = big
    start = np.arange(width + 1) - most
    padded = np.concatenate([np.full(most + 1, -1, np.int64), region.astype(np.int64), np.full(m + width, -2, np.int64)])
    index = np.arange(width)
    for i in range(1, m + 1):
        # column of band place b in row i: j = i + b - most (1-based end)
        chars = padded[i : i + width]
        diagonal = cost[:width] + (chars != pattern[i - 1])
        above = cost[1:] + 1
        new = np.minimum(diagonal, above)
        begin = np.where(diagonal <= above, start[:width], start[1:])
        # insertions run along the row: least of new[k] - k, then + index
        lead = new - index
        least = np.minimum.accumulate(lead)
        from_ = np.maximum.accumulate(np.where(lead == least, index, 0))
        cost[:width], start[:width] = least + index, begin[from_]
        cost[width] = big
    ends = m + index - most
    good = np.flatnonzero((cost[:width] <= most) & (ends <= len(region)) & (ends >= 0))
    if not len(good):
        return None
    best = good[np.argmin(cost[good])]
    return int(cost[best]), int(max(start[best], 0)), int(ends[best])


def verbatim(pattern: np.ndarray, region: np.ndarray) -> tuple[int, int, int] | None:
    """The place of ``pattern`` in ``region`` without any edit: such a region
    needs no alignment."""
    data, at = region.tobytes(), -1
    while (at := data.find(pattern.tobytes(), at + 1)) >= 0:
        if at % 4 == 0:
            return 0, at // 4, at // 4 + len(pattern)
    return None


def verbatim_words(automaton, texts: list[str]) -> Iterator[tuple[int, int, int, int, int]]:
    """(text, item, 0, start, end) of the short items that stand as whole words."""
    for t, text in enumerate(texts):
        plain = lowered(text)
        for last, (size, ids) in automaton.iter(plain):
            start, end = last + 1 - size, last + 1
            glued = start and plain[start].isalnum() and plain[start - 1].isalnum() or end < len(plain) and plain[last].isalnum() and plain[end].isalnum()
            if not glued:
                for item in ids:
                    yield t, item, 0, start, end


class Search:
    """A block's index, made ready once in a task."""

    def __init__(self, index: Index):
        self.index, self.have, self.short = index, index.bitmap(), index.automaton()

    def __call__(self, texts: list[str]) -> Iterator[tuple[int, int, int, int, int]]:
        if self.short is not None:
            yield from verbatim_words(self.short, texts)
        if self.index.windows:
            yield from search(self.index, self.have, texts)


def search(index: Index, have: np.ndarray, texts: list[str]) -> Iterator[tuple[int, int, int, int, int]]:
    """(text, item, edits, start, end) of every window found, then of the
    passages of items of which the text holds no window."""
    parts = [code_points(t) for t in texts]
    points = np.concatenate(parts) if parts else np.zeros(0, np.uint32)
    offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
    hashes = grams(points)
    near = np.flatnonzero(have[(hashes & np.uint64(MAP - 1)).astype(np.int64)])
    if not len(near):
        return
    at = np.searchsorted(index.gram, hashes[near])
    at[at == len(index.gram)] = 0
    hit = index.gram[at] == hashes[near]
    near, at = near[hit], at[hit]
    text = np.searchsorted(offsets, near, side="right") - 1
    inside = near + Q <= offsets[text + 1]
    near, at, text = near[inside], at[inside], text[inside]
    # only places with enough hits around them can hold a window
    span = WINDOW + int(RATE * WINDOW) + 1
    least = min(int(index.need.min()), PASSAGE + 1 - (SLIPS + 1) * Q, WINDOW + 1 - (budget(WINDOW) + 1) * Q)
    ahead = np.searchsorted(near, near + span, side="right")
    rich = np.zeros(len(near) + 1, np.int64)
    first = np.flatnonzero(ahead - np.arange(len(near)) >= least)
    np.add.at(rich, first, 1)
    np.add.at(rich, ahead[first], -1)
    keep = np.cumsum(rich)[:-1] > 0
    near, at, text = near[keep], at[keep], text[keep]
    if not len(near):
        return
    hits = near, at, text
    flat, many = _postings(index.first, at)
    window, place = index.window[flat], index.place[flat]
    where, text = np.repeat(near, many), np.repeat(text, many)
    start = where - place  # the diagonal: where the window would begin
    width = int(index.edits.max()) + 1
    found: dict[tuple[int, int, int], None] = {}
    for half in (0, 1):  # bands of 2 * width, overlapping by one half
        band = (start + half * width + WINDOW) // (2 * width)
        bands = int(band.max()) + 1
        distinct, count = np.unique((text * len(index.windows) + window) * bands + band, return_counts=True)
        for k in distinct[count >= index.need[distinct // bands % len(index.windows)]].tolist():
            t, w, b = k // bands // len(index.windows), k // bands % len(index.windows), k % bands
            found[t, w, b * 2 * width - half * width - WINDOW] = None
    known = set()
    for t, w, low in found:
        e, m = int(index.edits[w]), len(index.windows[w])
        begin = max(low - e, int(offsets[t]))
        region = points[begin : min(low + 2 * width + m + e, int(offsets[t + 1]))]
        best = verbatim(index.windows[w], region) or distance(index.windows[w], region, e, max(len(region) - m, 0))
        if best:
            known.add((t, int(index.owner[w])))
            yield t, int(index.items[w]), best[0], begin - int(offsets[t]) + best[1], begin - int(offsets[t]) + best[2]
    ids = dict(zip(index.owner.tolist(), index.items.tolist(), strict=True))
    for t, i, *rest in _passages(index, points, offsets, *hits, known):
        yield t, ids[i], *rest


def _postings(first: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the postings of the grams ``at``, and how many each has."""
    many = first[at + 1] - first[at]
    return np.repeat(first[at] - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(many.sum()), many


def _passages(index: Index, points: np.ndarray, offsets: np.ndarray, near: np.ndarray, at: np.ndarray, text: np.ndarray, known: set) -> Iterator[tuple[int, int, int, int, int]]:
    """(text, item number, edits, start, end) of passages at any offset of the
    items; pairs in ``known`` are left out.  Passages in one band are one row."""
    kinds = ((PASSAGE, SLIPS), (WINDOW, budget(WINDOW)))
    flat, many = _postings(index.head, at)
    item, spot = index.source[flat], index.spot[flat]
    where, text = np.repeat(near, many), np.repeat(text, many)
    sizes = np.array([len(p) for p in index.texts])
    left = sizes[item] > PASSAGE  # shorter items are a window themselves
    if known:
        left &= ~np.isin(text * len(sizes) + item, [t * len(sizes) + i for t, i in known])
    item, spot, where, text = item[left], spot[left], where[left], text[left]
    width, most = max(e for _, e in kinds) + 1, int(sizes.max())
    done: set = set()
    for half in (0, 1):
        band = (where - spot + half * width + most) // (2 * width)
        bands = int(band.max()) + 1 if len(band) else 1
        group = (text * len(sizes) + item) * bands + band
        order = np.lexsort((spot, group))
        g, s = group[order], spot[order]
        edge = np.append(np.flatnonzero(np.append(True, g[1:] != g[:-1])), len(g)) if len(g) else np.zeros(1, np.int64)
        fewest = min(m + 1 - (e + 1) * Q for m, e in kinds)
        for k in np.flatnonzero(np.diff(edge) >= fewest).tolist():
            here, code = np.unique(s[edge[k] : edge[k + 1]]), int(g[edge[k]])
            t, i, low = code // bands // len(sizes), code // bands % len(sizes), code % bands * 2 * width - half * width - most
            own, a, z = index.texts[i], int(offsets[t]), int(offsets[t + 1])
            for m, e in kinds:
                froms = np.arange(max(len(own) - m + 1, 0))
                shared = np.searchsorted(here, froms + m - Q + 1) - np.searchsorted(here, froms)
                places = []
                for o in froms[shared >= m + 1 - (e + 1) * Q].tolist():
                    begin = max(low + o - e, a)
                    region = points[begin : max(min(low + o + 2 * width + m + e, z), begin)]
                    best = verbatim(own[o : o + m], region) or distance(own[o : o + m], region, e, max(len(region) - m, 0))
                    if best:
                        places.append((best[0], begin - a + best[1], begin - a + best[2]))
                if places:
                    row = (t, i, min(x[0] for x in places), min(x[1] for x in places), max(x[2] for x in places))
                    if row not in done:
                        done.add(row)
                        yield row
                    break


def _scan(index: Index):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look = Search(index)
        for batch in batches:
            ids, texts = batch.column("doc_id").to_pylist(), batch.column("text")
            at = 0
            while at < len(ids):
                own, size, first = [], 0, at
                while at < len(ids) and (size < CHUNK or not own):
                    own.append(texts[at].as_py() or "")
                    size += len(own[-1])
                    at += 1
                rows = [(ids[first + t], i, e, s, z) for t, i, e, s, z in look(own)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], ["doc_id", "item_id", "edits", "start", "end"])

    return run


def _blocks(benchmark: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """Items in blocks of bounded size, fetched one by one to the driver."""
    block, size = [], 0
    for row in benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), "text").where("item_id is not null and text is not null").toLocalIterator():
        if block and size + len(row["text"]) > BLOCK_CHARS:
            yield block
            block, size = [], 0
        block.append((row["item_id"], row["text"]))
        size += len(row["text"])
    if block:
        yield block


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Per window or passage found: doc_id, item_id, edits, start, end (code points).

    A document leaks an item when some region of it is within the edit budget
    (``RATE`` of the length) of the item, if it has at most ``WINDOW`` code
    points, or else of any ``WINDOW`` code points of it, or within ``SLIPS``
    edits of any ``PASSAGE`` code points of it, A-Z lower-cased.  An item below
    ``LEAST`` code points is leaked where it stands verbatim, not glued to other
    letters or digits.
    Null and empty texts leak nothing; items without id, letters or digits are
    not searched.  Repeated rows give repeated results.
    """
    scratch, schema, done, last = Scratch(docs.sparkSession, "decontam"), "doc_id bigint, item_id bigint, edits bigint, start bigint, end bigint", [], None
    for items in _blocks(benchmark):
        if last is not None:  # written, so that no two indexes are in one plan
            done.append(scratch.save(last, f"block{len(done)}"))
        index = Index.of(items)
        last = None if index is None else docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(_scan(index), schema)
    every = done if last is None else [*done, last]
    return reduce(DataFrame.union, every) if every else docs.sparkSession.createDataFrame([], schema)


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row for each leaking document and item: doc_id, item_id, n_windows,
    start, end (least and greatest place), edits (least), contaminated (true)."""
    found = leaks(docs, benchmark).groupBy("doc_id", "item_id")
    return found.agg(F.count("*").alias("n_windows"), F.min("start").alias("start"), F.max("end").alias("end"), F.min("edits").alias("edits"), F.lit(True).alias("contaminated"))


def drop_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that leak nothing, with all their columns.

    The decision is made on each row where it lies: no join, no shuffle.  With
    several blocks each one's rest is written for the next.
    """
    out, scratch, n = docs, Scratch(docs.sparkSession, "decontam"), 0
    for items in _blocks(benchmark):
        if n:
            out = scratch.save(out, f"kept{n}")
        index = Index.of(items)
        if index is None:
            continue
        n += 1

        def run(batches: Iterator[pa.RecordBatch], index: Index = index) -> Iterator[pa.RecordBatch]:
            look = Search(index)
            for batch in batches:
                texts, keep, at = batch.column("text"), np.ones(batch.num_rows, bool), 0
                while at < batch.num_rows:
                    own, size, first = [], 0, at
                    while at < batch.num_rows and (size < CHUNK or not own):
                        own.append(texts[at].as_py() or "")
                        size += len(own[-1])
                        at += 1
                    for t, *_ in look(own):
                        keep[first + t] = False
                yield batch.filter(pa.array(keep))

        out = out.mapInArrow(run, docs.schema)
    return out
