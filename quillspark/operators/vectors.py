"""Vector tables: normalising, exact nearest neighbours, upserts and checks.

A vector table is (chunk_id, embedding). Search is an exact scan: the product
is a JVM expression, and each task keeps its own k best.
"""

from __future__ import annotations

import hashlib
import json

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(doubles(v), F.lit(0.0), lambda acc, x: acc + x * x))


def l2_normalize(v: Column) -> Column:
    """Unit length; a zero vector stays."""
    n = norm(v)
    return F.transform(v, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(0.0))


def dot(v: Column, query: list[float]) -> Column:
    return F.aggregate(F.zip_with(doubles(v), F.array(*(F.lit(float(q)) for q in query)), lambda a, b: a * b), F.lit(0.0), lambda acc, x: acc + x)


def top_k(vectors: DataFrame, query: list[float], k: int) -> DataFrame:
    """The k vectors with the greatest product, ties by id."""
    return vectors.withColumn("score", dot(F.col("embedding"), query)).orderBy(F.desc("score"), "chunk_id").limit(k)


def candidates(vectors: DataFrame, chunks: DataFrame, query: list[float], keep: Column, k: int = 400, prefilter: bool = False) -> DataFrame:
    """Nearest chunks of documents that pass ``keep``: filtered after the k nearest are known, or before."""
    k = max(k, 50)
    if prefilter:
        allowed = chunks.where(keep).select("chunk_id", "doc_id")
        return top_k(vectors.join(allowed, "chunk_id"), query, k)
    return top_k(vectors, query, k).join(chunks.where(keep).select("chunk_id", "doc_id"), "chunk_id")


def upsert(vectors: DataFrame, fresh: DataFrame) -> DataFrame:
    return vectors.join(fresh, "chunk_id", "left_anti").unionByName(fresh)


def remove(vectors: DataFrame, ids: DataFrame) -> DataFrame:
    return vectors.join(ids, "chunk_id", "left_anti")


def needs_compaction(total: int, removed: int) -> bool:
    """A quarter of the vectors are gone."""
    return total > 0 and removed / total >= 0.25


def to_literal(v: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(v, lambda x: x.cast("string")), ","), F.lit("]"))


def from_literal(text: Column) -> Column:
    return F.from_json(text, "array<float>")


def compat_hash(payload: dict) -> str:
    """A digest of the settings that vectors depend on."""
    return hashlib.sha256(json.dumps(payload, sort_keys=True, ensure_ascii=False).encode()).hexdigest()[:32]


def check_compatible(stored: dict, *, dimension: int, digest: str) -> None:
    """Refuses a table made under other settings."""
    for name, want in (("dimension", dimension), ("compat_hash", digest)):
        if stored.get(name) not in (None, want):
            raise ValueError(f"vector table has {name} {stored[name]!r}, wanted {want!r}")


def hashing_embedder(dimension: int = 64):
    """A stand-in for an embedding model: signed feature hashing of words, unit length, over Arrow batches."""

    @F.pandas_udf("array<float>")
    def run(text: pd.Series) -> pd.Series:
        out = []
        for t in text.fillna(""):
            v = np.zeros(dimension, np.float32)
            for w in t.lower().split():
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
                v[h % dimension] += 1 if h >> 63 else -1
            out.append(v / (np.linalg.norm(v) or 1))
        return pd.Series(out)

    return run
