"""A stored vector table: additions and removals as changes, exact search, and an approximate one by lists.

The approximate index is an inverted file: vectors belong to the nearest of
some centres, which are the table's partitions. A query reads the ``probes``
lists nearest to it; what it returns is scored exactly.
"""

from __future__ import annotations

from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions.storage import Files
from quillspark.operators import vectors
from quillspark.operators.versions import ChangeTable

VERSION = 1
#: How many more vectors than wanted are asked for, and the share of removed ones from which on a table is rebuilt.
OVERFETCH, REBUILD = 2.5, 0.25
SAMPLE = 20_000  # vectors that centres are made from


class Mismatch(ValueError):
    """A table of another version, dimension or setting; it is never overwritten."""


@dataclass
class Meta:
    version: int
    dimension: int
    model_key: str
    digest: str


class VectorStore:
    """(chunk_id, doc_id, embedding) of one model."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.files = Files(spark, self.path)
        self.table = ChangeTable(spark, f"{self.path}/rows", key="chunk_id", partition="list")
        self.meta: Meta | None = None

    def open(self, dimension: int, model_key: str, digest: str, create: bool = True) -> VectorStore:
        want = Meta(VERSION, dimension, model_key, digest)
        if self.files.exists("meta"):
            have = Meta(**self.files.read("meta"))
            wrong = [k for k, v in asdict(want).items() if getattr(have, k) != v]
            if wrong:
                raise Mismatch(", ".join(f"{k} is {getattr(have, k)!r}, not {getattr(want, k)!r}" for k in wrong))
        elif not create:
            raise FileNotFoundError(self.path)
        else:
            self.files.write("meta", asdict(want))
        self.meta = want
        return self

    def centres(self) -> np.ndarray | None:
        return np.array(self.files.read("centres"), np.float32) if self.files.exists("centres") else None

    def _listed(self, rows: DataFrame) -> DataFrame:
        """Unit vectors with the list that they belong to; vectors of another length are an error of their task."""
        centres, n = self.centres(), self.meta.dimension

        def run(batches):
            for b in batches:
                sizes = b.column("embedding").value_lengths().to_numpy(zero_copy_only=False)
                if len(sizes) and (sizes != n).any():
                    raise ValueError(f"a vector of {int(sizes[sizes != n][0])} numbers in a table of {n}")
                v = b.column("embedding").flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(-1, n)
                size = np.linalg.norm(v, axis=1, keepdims=True)
                v = np.where(size > 0, v / np.where(size > 0, size, 1), 0)
                own = (v @ centres.T).argmax(axis=1) if centres is not None else np.zeros(len(v), np.int64)
                yield pa.RecordBatch.from_arrays(
                    [b.column("chunk_id"), b.column("doc_id"), pa.array(list(v), pa.list_(pa.float32())), pa.array(own.astype(np.int32))],
                    names=["chunk_id", "doc_id", "embedding", "list"],
                )

        rows = rows.where("embedding IS NOT NULL").select(F.col("chunk_id").cast("long"), F.col("doc_id").cast("long"), F.col("embedding").cast("array<float>"))
        return rows.mapInArrow(run, "chunk_id long, doc_id long, embedding array<float>, list int")

    def _next(self) -> int:
        return max(self.table.versions(), default=0) + 1

    def add(self, rows: DataFrame, version: int | None = None) -> None:
        """New vectors, in place of earlier ones of the same chunks."""
        self.table.write(self._listed(rows), rows.select("chunk_id"), version or self._next())

    def remove(self, chunk_ids: DataFrame, version: int | None = None) -> None:
        none = self.spark.createDataFrame([], "chunk_id long, doc_id long, embedding array<float>, list int")
        self.table.write(none, chunk_ids, version or self._next())

    def replace(self, fresh: DataFrame, gone: DataFrame, version: int) -> None:
        """New vectors and the end of the chunks in ``gone``, at once."""
        ended = gone.select("chunk_id").unionByName(fresh.select("chunk_id"))
        self.table.write(self._listed(fresh), ended, version)

    def read(self, upto: int | None = None) -> DataFrame:
        found = self.table.read(upto)
        return found if found is not None else self.spark.createDataFrame([], "chunk_id long, doc_id long, embedding array<float>, list int")

    def count(self) -> int:
        return self.read().count()

    def vector(self, chunk_id: int) -> np.ndarray | None:
        row = self.read().where(F.col("chunk_id") == chunk_id).select("embedding").first()
        return np.array(row.embedding, np.float32) if row else None

    def removed_share(self) -> float:
        """Of all rows that the table holds, those that are removed or replaced."""
        own = self.table.versions()
        total = sum(self.table._rows(v).count() for v in own)
        return 1 - self.count() / total if total else 0.0

    def needs_compaction(self) -> bool:
        return self.removed_share() >= REBUILD

    def compact(self, active: DataFrame | None = None) -> None:
        """Only live vectors (of the chunks in ``active``) stay, in one version."""
        if active is not None:
            self.remove(self.read().join(active.select("chunk_id"), "chunk_id", "left_anti").select("chunk_id"))
        self.table.compact()

    def search(self, query: list[float], k: int) -> DataFrame:
        """The k nearest, exactly: every task keeps its own k best."""
        unit = np.asarray(query, float)
        unit = unit / (np.linalg.norm(unit) or 1.0)
        return vectors.top_k(self.read().select("chunk_id", "doc_id", "embedding"), unit.tolist(), k).select("chunk_id", "doc_id", "score")

    def train(self, lists: int | None = None, steps: int = 12, seed: int = 1) -> int:
        """Makes centres from at most SAMPLE vectors, those with the least hash of their id, and deals all vectors to them."""
        rows = self.read()
        n = rows.count()
        lists = lists or max(1, int(np.sqrt(n)))
        sample = rows.orderBy(F.xxhash64("chunk_id"), "chunk_id").limit(SAMPLE).select("embedding").toArrow()
        v = np.array(sample.column("embedding").to_pylist(), np.float32).reshape(-1, self.meta.dimension)
        if not len(v):
            return 0
        r = np.random.default_rng(seed)
        centres = v[r.choice(len(v), min(lists, len(v)), replace=False)]
        for _ in range(steps):
            own = (v @ centres.T).argmax(axis=1)
            sums = np.zeros_like(centres)
            np.add.at(sums, own, v)
            size = np.linalg.norm(sums, axis=1, keepdims=True)
            centres = np.where(size > 0, sums / np.where(size > 0, size, 1), centres)
        self.files.write("centres", [[round(float(x), 7) for x in c] for c in centres])
        self.table.write(self._listed(rows), rows.select("chunk_id"), self._next())
        self.table.compact()
        return len(centres)

    def nearest(self, query: list[float], k: int, probes: int = 16) -> DataFrame:
        """The k best of the lists nearest to the query; all lists if there are no centres."""
        centres = self.centres()
        if centres is None:
            return self.search(query, k)
        unit = np.asarray(query, np.float32)
        unit = unit / (np.linalg.norm(unit) or 1.0)
        lists = np.argsort(-(centres @ unit), kind="stable")[:probes].tolist()
        some = self.read().where(F.col("list").isin(lists)).select("chunk_id", "doc_id", "embedding")
        found = vectors.top_k(some, unit.astype(float).tolist(), int(np.ceil(OVERFETCH * k)))
        return found.orderBy(F.desc("score"), "chunk_id").limit(k).select("chunk_id", "doc_id", "score")
