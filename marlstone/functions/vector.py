"""Vectors: cosine, and a deterministic embedder for use without a model."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from marlstone.functions.text import terms, truncate_tokens

#: Fixed value: most tokens of a text that are embedded.
EMBED_TOKENS = 8191


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two array columns in double precision; null if one is null, all zero or of another length."""
    a, b = a.cast("array<double>"), b.cast("array<double>")

    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)

    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (size > 0), dot(a, b) / size)


def usable(vector: Column, dim: int | None = None) -> Column:
    """Not null, all numbers finite, not all zero, and of the given length."""
    x = vector.cast("array<double>")
    ok = vector.isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(x, lambda v: v != 0)
    return ok & (F.size(vector) == dim) if dim else ok


def hashing_embedder(dim: int = 64):
    """A column function text -> array<float> of unit length: signed hashed term counts. A stand-in for a model behind
    the same interface; texts over the token cap are cut first, texts without a term give null."""

    @F.arrow_udf("array<float>")
    def embed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        memory: dict[str, int] = {}
        for lists in batches:
            out = []
            for words in lists.to_pylist():
                v = np.zeros(dim)
                for w in words or ():
                    h = memory.get(w)
                    if h is None:
                        if len(memory) > 500_000:
                            memory.clear()
                        h = memory[w] = zlib.crc32(w.encode())
                    v[h % dim] += 1.0 if h & 0x10000 else -1.0
                n = np.linalg.norm(v)
                out.append((v / n).astype(np.float32).tolist() if n else None)
            yield pa.array(out, pa.list_(pa.float32()))

    def of(text: Column) -> Column:
        return embed(terms(truncate_tokens(text, EMBED_TOKENS)))

    return of

#: Dimensions of the models an index may be built with.
MODEL_DIMENSIONS = {"text-embedding-3-small": 1536, "text-embedding-3-large": 3072}


class Embedders:
    """One embedder per tenant, made by ``factory(model, key, dim)`` when it is first asked for and again when its key or model has
    changed. An unknown model is an error."""

    def __init__(self, factory=lambda model, key, dim: hashing_embedder(dim)):
        self.factory = factory
        self._made: dict[str, tuple[str, str, object]] = {}

    def of(self, user_id: str, model: str, key: str):
        if model not in MODEL_DIMENSIONS:
            raise ValueError(f"unknown embedding model: {model}")
        held = self._made.get(user_id)
        if held is None or held[:2] != (model, key):
            held = self._made[user_id] = (model, key, self.factory(model, key, MODEL_DIMENSIONS[model]))
        return held[2]

    def drop(self, user_id: str) -> None:
        self._made.pop(user_id, None)
