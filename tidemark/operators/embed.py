"""Embedding: the seam for models, the feature-hashing fallback, and the backlog job.

A model is anything with `model_id`, `dim` and `embed(texts, kind)`, where kind
is "document" or "query"; it runs in an Arrow UDF, batch by batch.
"""

from __future__ import annotations

import re
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.vectors import quantize
from tidemark.operators.retrieve import unembedded


class Model(Protocol):
    model_id: str
    dim: int

    def embed(self, texts: list[str], kind: str) -> np.ndarray: ...


class HashingModel:
    """Words and neighbouring words counted in 512 hashed places, as a unit vector; a text without words is zero."""

    model_id, dim = "hash-512", 512

    def embed(self, texts: list[str], kind: str) -> np.ndarray:
        out = np.zeros((len(texts), self.dim))
        for row, text in zip(out, texts, strict=True):
            w = [x for x in re.split(r"[\W_]+", text.lower()) if x]
            grams = [x.encode() for x in (*w, *(f"{a}\u001f{b}" for a, b in zip(w, w[1:], strict=False)))]
            if grams:
                np.add.at(row, places(grams), 1)
                row /= np.sqrt((row * row).sum())
        return out


def places(items: list[bytes]) -> np.ndarray:
    """FNV-1a-64 modulo 512 of many strings, in nine-bit steps."""
    size = np.array([len(x) for x in items])
    grid = np.zeros((len(items), size.max()), np.int64)
    for i, x in enumerate(items):
        grid[i, : len(x)] = np.frombuffer(x, np.uint8)
    h = np.full(len(items), 293)
    for k in range(grid.shape[1]):
        h = np.where(size > k, ((h ^ grid[:, k]) * 435) & 511, h)
    return h


def embedded(chunks: DataFrame, model: Model | None = None) -> DataFrame:
    """shard, chunk_id, model_id, dim, scale, embedding (int8) of each chunk."""
    m = model or HashingModel()

    @F.pandas_udf("array<double>")
    def vector(text: pd.Series) -> pd.Series:
        return pd.Series(list(m.embed([t if isinstance(t, str) else "" for t in text], "document")), dtype=object)

    q = quantize(chunks.select("shard", "chunk_id", vector("text").alias("v")), "v", m.dim)
    return q.select("shard", "chunk_id", F.lit(m.model_id).alias("model_id"), F.lit(m.dim).alias("dim"), "scale", F.col("ints").alias("embedding"))


def embed_backlog(chunks: DataFrame, vectors: DataFrame, model: Model | None = None) -> DataFrame:
    """Vectors of the chunks that have none of the model's: one anti join and one pass over all shards."""
    m = model or HashingModel()
    return embedded(unembedded(chunks, vectors, m.model_id), m)


def query_vector(text: str, model: Model | None = None) -> tuple[list[int], float, str]:
    """(ints, scale, model_id) of a query, as retrieval takes it."""
    m = model or HashingModel()
    v = m.embed([text], "query")[0]
    length = np.sqrt((v * v).sum())
    u = v / length if length > 0 else v
    most = np.abs(u).max()
    scale = most / 127 if most > 0 else 1.0
    ints = np.clip(np.sign(u) * np.floor(np.abs(u / scale) + 0.5), -127, 127).astype(int)
    return ints.tolist(), float(np.float32(scale)), m.model_id
