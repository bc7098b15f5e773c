"""Vector functions: distances as column expressions, and an embedder that needs no model."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..shared import ensure_workers


def squared_distance(a: Column, b: Column) -> Column:
    """Sum of squared differences, in double; null if a length differs or a side is null."""
    terms = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return F.when(F.size(a) == F.size(b), F.aggregate(terms, F.lit(0.0), lambda s, x: s + x))


def literal(vector: list[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in vector])


@dataclass
class HashingEmbedder:
    """Signed counts of hashed words, of length 1 unless normalize is off. No semantics: a stand-in for a model.

    Any object with embed(texts) and the same fields can replace it.
    """

    dimensions: int = 64
    normalize: bool = True
    batch_size: int = 8
    query_prefix: str = ""

    def embed(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dimensions), np.float32)
        for row, text in enumerate(texts):
            for word in (text or "").lower().split():
                h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")
                out[row, h % self.dimensions] += 1 if h >> 63 else -1
        if self.normalize:
            out /= np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)
        return out

    def embed_query(self, text: str) -> list[float]:
        return self.embed([self.query_prefix + text])[0].tolist()

    def config(self) -> dict:
        return asdict(self)


def embedder_udf(embedder: HashingEmbedder):
    """A column function over Arrow batches; the embedder is made once a task and runs over batch_size texts at a time."""

    ensure_workers()

    @F.pandas_udf("array<float>")
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            values = texts.fillna("").tolist()
            made = [row for at in range(0, len(values), embedder.batch_size) for row in embedder.embed(values[at : at + embedder.batch_size]).tolist()]
            yield pd.Series(made, index=texts.index, dtype=object)

    return embed
