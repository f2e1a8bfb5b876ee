"""Text to vectors.

An embedder is any picklable object with ``dim`` and ``embed(texts) -> array of shape
(len(texts), dim)``; a row it cannot embed is NaN, which becomes a null vector. It runs once per
Arrow batch, inside the partitions of the input.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, StructField, StructType

from reviewmill.fixed import VECTOR_DIM


class Embedder(Protocol):
    dim: int

    def embed(self, texts: list[str]) -> np.ndarray: ...


# The first 8 hex digits of an MD5, and the byte that the ninth begins.
_DIGEST = np.dtype([("head", ">u4"), ("ninth", "u1"), ("rest", "V11")])


class HashingEmbedder:
    """Signed counts of lower-case words in hashed buckets, scaled to unit length.

    The bucket is the first 8 hex digits of the word's MD5 modulo ``dim``; the sign is positive
    if the ninth digit is below 8. Words are split at single spaces, after other whitespace
    became one.
    """

    def __init__(self, dim: int = VECTOR_DIM, normalize: bool = True):
        self.dim = dim
        self.normalize = normalize

    def embed(self, texts: list[str]) -> np.ndarray:
        words = [t.lower().split() for t in texts]
        flat = [w for ws in words for w in ws]
        matrix = np.zeros(len(texts) * self.dim)
        if flat:
            rows = np.repeat(np.arange(len(texts)), [len(ws) for ws in words])
            places = {w: i for i, w in enumerate(dict.fromkeys(flat))}
            slots = np.fromiter(map(places.__getitem__, flat), np.int64, len(flat))
            digests = np.frombuffer(b"".join([hashlib.md5(w.encode()).digest() for w in places]), _DIGEST)
            buckets = digests["head"].astype(np.int64) % self.dim
            signs = np.where(digests["ninth"] < 128, 1.0, -1.0)
            matrix = np.bincount(
                rows * self.dim + buckets[slots], signs[slots], len(texts) * self.dim
            )
        matrix = matrix.reshape(len(texts), self.dim)
        if self.normalize:
            sizes = np.linalg.norm(matrix, axis=1, keepdims=True)
            matrix = np.divide(matrix, sizes, out=matrix, where=sizes > 0)
        return matrix.astype(np.float32)


def vector_array(matrix: np.ndarray) -> pa.Array:
    """A matrix as an Arrow list column; a row with NaN is null."""
    n, dim = matrix.shape
    bad = np.isnan(matrix).any(axis=1)
    values = pa.array(matrix[~bad].reshape(-1), pa.float32())
    ends = np.concatenate([[0], np.cumsum(np.where(bad, 0, dim))]).astype(np.int32)
    starts = pa.array(ends, mask=np.concatenate([bad, [False]]))
    return pa.ListArray.from_arrays(starts, values)


def with_vectors(
    df: DataFrame, embedder: Embedder, text: str = "text", out: str = "vector", batch: int = 512
) -> DataFrame:
    """Append the vector of ``text``. Missing text has no vector."""
    schema = StructType(df.schema.fields + [StructField(out, ArrayType(FloatType()), True)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, batch):
                part = whole.slice(start, batch)
                texts = part.column(text).to_pylist()
                matrix = np.full((len(texts), embedder.dim), np.nan, dtype=np.float32)
                present = [i for i, t in enumerate(texts) if t is not None]
                if present:
                    matrix[present] = embedder.embed([texts[i] for i in present])
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, vector_array(matrix)], [*part.schema.names, out]
                )

    return df.mapInArrow(run, schema)


def embed_batches(df: DataFrame, embedder: Embedder, text: str = "text", batch: int = 64):
    """Vectors by sub-batch; a batch the embedder rejects is retried row by row."""
    return with_vectors(df, RowFallback(embedder), text, batch=batch)


class RowFallback:
    """Wraps an embedder so that a failing row gives a missing vector, not a failed job."""

    def __init__(self, inner: Embedder):
        self.inner = inner
        self.dim = inner.dim

    def embed(self, texts: list[str]) -> np.ndarray:
        try:
            return self.inner.embed(texts)
        except Exception:  # noqa: BLE001 - the rows are tried one by one
            matrix = np.full((len(texts), self.dim), np.nan, dtype=np.float32)
            for i, one in enumerate(texts):
                try:
                    matrix[i] = self.inner.embed([one])[0]
                except Exception as problem:  # noqa: BLE001
                    print(f"no vector for one text: {problem}")
            return matrix


def ingest_counts(df: DataFrame, vector: str = "vector") -> DataFrame:
    """Rows with and without a vector."""
    return df.agg(
        F.count(vector).alias("indexed"), F.count_if(F.col(vector).isNull()).alias("failed")
    )
