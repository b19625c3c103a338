"""Plain re-computations that the operators are held against."""

import re
from collections import defaultdict

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def shingles(text):
    data = (text or "").encode()
    data = bytes(c + 32 if 65 <= c <= 90 else c for c in data)
    w = WORD.findall(data)
    if not w:
        return frozenset()
    if len(w) < 5:
        return frozenset([tuple(w)])
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4))


def near_classes(rows):
    """doc_id -> (n_shingles, component) by an inverted index over all pairs."""
    sets = {i: shingles(t) for i, t in rows}
    where = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            where[x].append(i)
    common = defaultdict(int)
    for ids in where.values():
        for a in ids:
            for b in ids:
                if a < b:
                    common[a, b] += 1
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (a, b), n in common.items():
        if 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
            p, q = find(a), find(b)
            root[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), find(i)) for i in sets}


ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def base_secrets(text):
    """Sorted (start, rank, end) of the three fixed kinds."""
    text = text or ""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out)


def window_entropy(s, alphabet, least, width=20):
    """(first, last) start of the windows with enough Shannon entropy."""
    from collections import Counter
    from math import log2

    hits = []
    for i in range(len(s) - width + 1):
        c = Counter(s[i : i + width])
        if -sum(n / width * log2(n / width) for n in c.values()) >= least - 1e-12:
            hits.append(i)
    return (hits[0], hits[-1]) if hits else (-1, -1)


def _xx(value, seed):
    """Spark's xxhash64 of one bigint, chained by seed."""
    import xxhash

    return xxhash.xxh64_intdigest(int(value).to_bytes(8, "little", signed=True), seed)


def _signed(x):
    return x - (1 << 64) if x >> 63 else x


def order_minhash(text, k=2, slots=64):
    """The fingerprint by definition: for each slot the two least hashes of
    (k-mer, occurrence) on the ring from the slot's start, in text order."""
    import xxhash

    w = [_signed(xxhash.xxh64_intdigest(x, 42)) for x in WORD.findall((text or "").encode())]
    if not w:
        return ""
    grams = w if len(w) < k else [_signed(_xx(w[i + 1], _xx(w[i], 42))) for i in range(len(w) - 1)]
    seen, ys = defaultdict(int), []
    for i, g in enumerate(grams):
        occ = seen[g]
        seen[g] += 1
        # occurrence numbers are 32-bit integers
        ys.append((_signed(xxhash.xxh64_intdigest(occ.to_bytes(4, "little"), _xx(g, 42))), i))
    out = []
    for f in range(slots):
        start = f * (1 << 64) // slots
        best = sorted(ys, key=lambda y: ((y[0] + (1 << 63)) - start) % (1 << 64))[:2]
        if len(best) < 2:
            best = best * 2
        a, b = sorted(best, key=lambda y: y[1])
        h = _xx(b[0], _xx(a[0], 42))
        out.append(f"{h >> 32:08x}")
    return "".join(out)


def repeats(rows, length=200):
    """doc -> (n_bytes, n_removed, n_spans, sha256 of the rest), by counting all windows."""
    import hashlib
    from collections import Counter

    texts = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(hash(t[p : p + length]) for _, t in texts for p in range(len(t) - length + 1))
    out = []
    for i, t in texts:
        gone = bytearray(len(t))
        for p in range(len(t) - length + 1):
            if seen[hash(t[p : p + length])] > 1:
                gone[p : p + length] = b"\1" * length
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        rest = bytes(c for c, g in zip(t, gone) if not g)
        out.append((i, len(t), sum(gone), spans, hashlib.sha256(rest).hexdigest()))
    return out
