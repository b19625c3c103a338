"""Token counts of all prefixes of a word, by dynamic programming over BPE.

A sequence of tokens is the BPE encoding of its text just when every pair of
neighbours is (merging the text of the two gives them back).  So the last token
of a prefix is the one whose text ends there and that may follow the last token
of what is before it; only one does.  With N[i] the count of the first i
symbols, N[i] = N[i - length of the last token] + 1: one pass over a word gives
all its prefixes, and nothing is encoded again.

The tokenizer marks the last symbol of a word.  A prefix ends in a marked
symbol, what is before its last token does not: the pass keeps unmarked
encodings and reads the marked count of each prefix off them.
"""

from __future__ import annotations

import json
import unicodedata

import numpy as np
import regex

PAIRS = 500_000


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level BPE: the
    byte itself where it prints, else the next free one from U+0100 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in shown]
    return [chr(b) if b in shown else chr(256 + hidden.index(b)) for b in range(256)]


class Bpe:
    """BPE with a mark at word ends, from a ``tokenizers`` file.

    ValueError for files of another kind: the mark, byte-level symbols, NFC and
    lower case, and a split that drops white space are what the pass relies on.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, split = spec["model"], (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        kinds = [n.get("type") for n in (spec.get("normalizer") or {}).get("normalizers", [])]
        known = model.get("type") == "BPE" and model.get("end_of_word_suffix") and not model.get("continuing_subword_prefix") and not model.get("byte_fallback")
        drops = split[0].get("type") == "Split" and split[0].get("invert") and split[0].get("behavior") == "Removed" and split[-1].get("type") == "ByteLevel"
        if not known or not drops or not {"NFC", "Lowercase"} <= set(kinds):
            raise ValueError("not a BPE of lower-case words with marked ends")
        self.pieces = regex.compile(split[0]["pattern"]["Regex"])
        self.mark = model["end_of_word_suffix"]
        self.vocab = model["vocab"]
        self.rank = {tuple(m if isinstance(m, list) else m.split(" ")): k for k, m in enumerate(model["merges"])}
        self.symbols = byte_symbols()
        self.longest = max(len(t.removesuffix(self.mark)) for t in self.vocab)
        self.pairs: dict[tuple[str | None, str], bool] = {}

    def merged(self, parts: list[str]) -> list[str]:
        """Merge the neighbours of least rank until none can be."""
        while len(parts) > 1:
            rank, at = min((self.rank.get(pair, len(self.rank)), k) for k, pair in enumerate(zip(parts, parts[1:])))
            if rank == len(self.rank):
                break
            parts = [*parts[:at], parts[at] + parts[at + 1], *parts[at + 2 :]]
        return parts

    def _split(self, token: str) -> list[str]:
        plain = token.removesuffix(self.mark)
        parts = list(plain)
        if plain != token:
            parts[-1] += self.mark
        return parts

    def may_follow(self, before: str | None, token: str) -> bool:
        """Whether ``token`` stays itself after ``before`` (None: at the start)."""
        known = self.pairs.get((before, token))
        if known is None:
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            head = [] if before is None else [before]
            known = self.merged([*(self._split(before) if before else []), *self._split(token)]) == [*head, token]
            self.pairs[before, token] = known
        return known

    def piece(self, text: str) -> list[int]:
        """Counts of the prefixes of 1, 2, ... code points of one piece."""
        symbols = "".join(self.symbols[b] for b in text.encode())
        ends, place = set(), 0
        for c in text:
            place += len(c.encode())
            ends.add(place)
        last: list[str | None] = [None]
        count, out = [0], []
        for i in range(1, len(symbols) + 1):
            if i in ends:
                out.append(next(count[k] + 1 for k in range(max(0, i - self.longest), i) if (t := symbols[k:i] + self.mark) in self.vocab and self.may_follow(last[k], t)))
            k = next(k for k in range(max(0, i - self.longest), i) if (t := symbols[k:i]) in self.vocab and self.may_follow(last[k], t))
            last.append(symbols[k:i])
            count.append(count[k] + 1)
        return out

    def plain(self, word: str) -> bool:
        """Whether every prefix of ``word`` is normalised to the same prefix."""
        return word.isascii() or (unicodedata.is_normalized("NFC", word) and word == word.lower() and not any(unicodedata.combining(c) or "ᄀ" <= c <= "ᇿ" for c in word))

    def word(self, word: str) -> np.ndarray:
        """Counts of the prefixes of 0, 1, ... code points of a plain word.

        A piece that a prefix cuts is a prefix of the piece, but for a cut
        contraction (``'re`` to ``'r``): a quote and then letters.
        """
        word, out, total = word.lower(), [0], 0
        for m in self.pieces.finditer(word):
            inside = self.piece(m[0])
            if m[0][0] == "'" and m[0][-1].isalpha() and len(m[0]) > 1:
                quote = self.piece("'")[0]
                inside = [quote, *(quote + n for n in self.piece(m[0][1:])[:-1]), inside[-1]]
            out += [total + n for n in inside]
            total += inside[-1]
        return np.array(out, np.int32)
