"""Embedding of texts in batches: a pluggable client behind an iterator UDF.

``hashed`` needs no service: signed feature hashing of the approximate tokens,
scaled to unit length.  ``HttpEmbedder`` talks to a local embedding service,
first in batches, then one by one if the batch endpoint is missing.
"""

from __future__ import annotations

import hashlib
import json
import urllib.error
import urllib.request
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, functions as F

BATCH = 16


@lru_cache(maxsize=1 << 16)
def _hash(token: str) -> int:
    return int.from_bytes(hashlib.blake2b(token.lower().encode(), digest_size=8).digest(), "little")


def hashed(texts: list[str], size: int = 64) -> list[list[float]]:
    from codequarry.functions.tokens import _TOKEN

    out = []
    for text in texts:
        v = [0.0] * size
        for token, n in Counter(_TOKEN.findall(text or "")).items():
            h = _hash(token)
            v[h % size] += n if h >> 63 else -n
        length = sum(x * x for x in v) ** 0.5
        out.append([x / length for x in v] if length else v)
    return out


class HttpEmbedder:
    """Client of an embedding service (POST /api/embed)."""

    def __init__(self, url: str, model: str, timeout: float = 30.0):
        self.url, self.model, self.timeout = url.rstrip("/"), model, timeout

    def _call(self, path: str, body: dict | None = None) -> dict:
        data = None if body is None else json.dumps(body).encode()
        request = urllib.request.Request(self.url + path, data, {"Content-Type": "application/json"})
        with urllib.request.urlopen(request, timeout=self.timeout) as reply:
            return json.load(reply)

    def models(self) -> list[str]:
        return [m["name"] for m in self._call("/api/tags").get("models", [])]

    def available(self) -> bool:
        return any(m in (self.model, f"{self.model}:latest") for m in self.models())

    def __call__(self, texts: list[str]) -> list[list[float]]:
        out: list[list[float]] = []
        for at in range(0, len(texts), BATCH):
            part = texts[at : at + BATCH]
            try:
                got = self._call("/api/embed", {"model": self.model, "input": part})["embeddings"]
            except urllib.error.HTTPError as e:
                if e.code != 404:
                    raise
                got = [self._call("/api/embeddings", {"model": self.model, "prompt": t})["embedding"] for t in part]
            out += got
        if len(out) != len(texts) or len({len(v) for v in out}) > 1 or any(not v for v in out):
            raise ValueError("the service gave vectors of another number or size than asked for")
        return out


def dimension(embed: Callable[[list[str]], list[list[float]]]) -> int:
    return len(embed(["probe"])[0])


def with_embedding(df: DataFrame, text: str, embed: Callable[[list[str]], list[list[float]]] = hashed, out: str = "embedding") -> DataFrame:
    """Add the vectors of a text column, a batch of rows at a time."""
    @F.pandas_udf("array<float>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield pd.Series(embed(part.fillna("").tolist()), index=part.index)

    return df.withColumn(out, run(F.col(text)))
