"""Embedding of texts in batches: by a hash, by an HTTP endpoint, or by one with the other to fall back on."""

from __future__ import annotations

import hashlib
import json
import math
import urllib.request
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass
class HashEmbedder:
    """Reproducible numbers from a SHA-256 of the text, at length one; the same as ``vectors.hash_embedding``."""

    size: int = 768
    name: str = "hash"

    def embed(self, texts: Sequence[str]) -> list[list[float]]:
        out = []
        for t in texts:
            h = hashlib.sha256(t.encode()).digest()
            v = [h[i % 32] / 255 * 2 - 1 for i in range(self.size)]
            n = math.sqrt(sum(x * x for x in v))
            out.append([x / n for x in v] if n else v)
        return out


@dataclass
class HttpEmbedder:
    """An endpoint that takes JSON: ``{"model", "prompt"}`` a text, or with ``batched`` ``{"model", "input": [...]}``."""

    url: str
    model: str
    batched: bool = False
    timeout: float = 30.0
    name: str = "http"

    def _post(self, body: dict) -> dict:
        request = urllib.request.Request(self.url, json.dumps(body).encode(), {"Content-Type": "application/json"})
        with urllib.request.urlopen(request, timeout=self.timeout) as answer:
            return json.load(answer)

    def embed(self, texts: Sequence[str]) -> list[list[float]]:
        if self.batched:
            data = self._post({"model": self.model, "input": list(texts)})["data"]
            return [d["embedding"] for d in sorted(data, key=lambda d: d.get("index", 0))]
        return [self._post({"model": self.model, "prompt": t})["embedding"] for t in texts]

    def available(self) -> bool:
        """Whether it answers."""
        try:
            return bool(self.embed(["x"])[0])
        except Exception:
            return False


@dataclass
class AdaptiveEmbedder:
    """``primary`` until it has failed ``max_errors`` times in a row, ``other`` for what it fails on and after that."""

    primary: object
    other: object
    max_errors: int = 3
    errors: int = field(default=0)

    def embed_named(self, texts: Sequence[str]) -> tuple[list[list[float]], str]:
        if self.errors < self.max_errors:
            try:
                out = self.primary.embed(texts)
                self.errors = 0
                return out, self.primary.name
            except Exception:
                self.errors += 1
        return self.other.embed(texts), self.other.name


def first_available(endpoints: Sequence[HttpEmbedder], other: object) -> object:
    """The first endpoint that answers, else ``other``."""
    return next((e for e in endpoints if e.available()), other)


def embed_texts(docs: DataFrame, key: str, text: str, make: Callable[[], AdaptiveEmbedder], batch: int = 32) -> DataFrame:
    """``key``, vector, backend of every text, ``batch`` at a time; each task makes its own embedder and counts its own failures."""
    rows = docs.where(F.col(text).isNotNull()).select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = dict(rows.dtypes)["key"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        embedder = make()
        for b in batches:
            texts, out, names = b.column("text").to_pylist(), [], []
            for i in range(0, len(texts), batch):
                vectors, name = embedder.embed_named(texts[i : i + batch])
                out += vectors
                names += [name] * len(vectors)
            yield pa.RecordBatch.from_arrays([b.column("key"), pa.array(out, pa.list_(pa.float32())), pa.array(names, pa.string())], names=["key", "vector", "backend"])

    return rows.mapInArrow(run, f"key {kind}, vector array<float>, backend string").withColumnRenamed("key", key)


def backends(embedded: DataFrame) -> DataFrame:
    """Texts by what embedded them."""
    return embedded.groupBy("backend").agg(F.count("*").alias("texts"))
