"""Embedding providers and how tables are embedded: a model run here, or a service that is asked.

A provider is made on each executor by a factory, so that models and keys are
not part of a plan. Texts are taken in batches within a task; documents are
not gathered for it.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.sources.http import Client, Failed


class Provider(Protocol):
    """What a provider of embeddings has."""

    model_key: str
    dimension: int

    def passages(self, texts: list[str]) -> np.ndarray: ...

    def query(self, text: str) -> np.ndarray: ...


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows of unit length; zero rows stay."""
    n = np.linalg.norm(rows, axis=1, keepdims=True)
    return np.where(n > 0, rows / np.where(n > 0, n, 1), 0.0).astype(np.float32)


def pooled(hidden: np.ndarray, mask: np.ndarray, how: str = "cls") -> np.ndarray:
    """(texts, tokens, width) states to (texts, width): of the first token, or the mean of those that the mask keeps."""
    if how == "cls":
        return hidden[:, 0, :]
    kept = mask[:, :, None].astype(hidden.dtype)
    return (hidden * kept).sum(axis=1) / np.maximum(kept.sum(axis=1), 1e-9)


@dataclass
class Local:
    """A model in this process: ``tokenize`` gives ids and masks of equal lengths, ``run`` the last hidden states (an ONNX session, say)."""

    model_key: str
    dimension: int
    tokenize: Callable[[list[str]], tuple[np.ndarray, np.ndarray]]
    run: Callable[[np.ndarray, np.ndarray], np.ndarray]
    pooling: str = "cls"
    passage_prefix: str = ""
    query_prefix: str = ""
    batch: int = 32
    cancelled: Callable[[], bool] = lambda: False

    def _embedded(self, texts: list[str]) -> np.ndarray:
        out = [np.zeros((0, self.dimension), np.float32)]
        for i in range(0, len(texts), self.batch):
            if self.cancelled():
                raise InterruptedError("embedding was cancelled")
            ids, mask = self.tokenize(texts[i : i + self.batch])
            out.append(unit(pooled(self.run(ids, mask), mask, self.pooling)))
        return np.concatenate(out)

    def passages(self, texts: list[str]) -> np.ndarray:
        return self._embedded([self.passage_prefix + t for t in texts])

    def query(self, text: str) -> np.ndarray:
        return self._embedded([self.query_prefix + text])[0]


def onnx(path: str, **settings) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """The ``run`` of an ONNX model's session, made where it is called."""
    import onnxruntime

    session = onnxruntime.InferenceSession(path, providers=["CPUExecutionProvider"], **settings)
    names = {i.name for i in session.get_inputs()}

    def run(ids: np.ndarray, mask: np.ndarray) -> np.ndarray:
        feed = {"input_ids": ids, "attention_mask": mask, "token_type_ids": np.zeros_like(ids)}
        return session.run(None, {k: v for k, v in feed.items() if k in names})[0]

    return run


@dataclass
class Remote:
    """An embedding service: {"model", "input"} to {"data": [{"embedding", "index"}]}; with ``kinds`` it is told what a text is and adds prefixes itself."""

    client: Client
    model_key: str
    dimension: int
    kinds: bool = False
    send_dimension: bool = False
    passage_prefix: str = ""
    query_prefix: str = ""
    batch: int = 64

    def _asked(self, texts: list[str], kind: str) -> np.ndarray:
        body = {"model": self.model_key, "input": texts}
        body |= {"kind": kind} if self.kinds else {}
        body |= {"dimensions": self.dimension} if self.send_dimension else {}
        answer = self.client.request("POST", "embeddings", body).json()
        rows = answer.get("data") if isinstance(answer, dict) else None
        if not isinstance(rows, list) or len(rows) != len(texts):
            raise Failed("another number of vectors than of texts")
        order = sorted(range(len(rows)), key=lambda i: int(rows[i].get("index", i)))
        try:
            out = np.array([rows[i]["embedding"] for i in order], np.float32)
        except (KeyError, TypeError, ValueError) as e:
            raise Failed("vectors in an unknown form") from e
        if out.ndim != 2 or out.shape[1] != self.dimension:
            raise Failed(f"vectors of {out.shape[1:]} numbers, not {self.dimension}")
        if not np.isfinite(out).all():
            raise Failed("vectors with numbers that are none")
        return unit(out)

    def passages(self, texts: list[str]) -> np.ndarray:
        prefix = "" if self.kinds else self.passage_prefix
        parts = [self._asked([prefix + t for t in texts[i : i + self.batch]], "passage") for i in range(0, len(texts), self.batch)]
        return np.concatenate([np.zeros((0, self.dimension), np.float32), *parts])

    def query(self, text: str) -> np.ndarray:
        return self._asked([("" if self.kinds else self.query_prefix) + text], "query")[0]


@dataclass
class Hashed:
    """A stand-in for a model: signed feature hashing of words. It says nothing about meaning."""

    dimension: int = 64
    model_key: str = "hashed-words"
    seen: dict = field(default_factory=dict, repr=False)

    def passages(self, texts: list[str]) -> np.ndarray:
        import hashlib

        out = np.zeros((len(texts), self.dimension), np.float32)
        for row, text in zip(out, texts, strict=True):
            for w in text.lower().split():
                h = int.from_bytes(hashlib.blake2b(w.encode("utf-8", "replace"), digest_size=8).digest(), "little")
                row[h % self.dimension] += 1 if h >> 63 else -1
        return unit(out)

    def query(self, text: str) -> np.ndarray:
        return self.passages([text])[0]


def context_header(name: Column, path: Column, library: Column, most: int = 240) -> Column:
    """File name and folder, the folder's last parts only where it is long; for embedding beside the text."""
    folder = F.regexp_replace(F.concat_ws("/", F.nullif(library, F.lit("")), F.regexp_replace(path, r"/?[^/]*$", "")), "/+$", "")
    tail = F.regexp_replace(F.substring(folder, -most, most), r"^[^/]*/", "…/")
    shown = F.when(F.length(folder) > most, tail).otherwise(folder)
    return F.concat(F.lit("Plik: "), name, F.when(shown != "", F.concat(F.lit("\nŚcieżka: "), shown)).otherwise(""))


def with_context(text: Column, header: Column) -> Column:
    """A text under its header, as it is embedded; what is searched and shown has no header."""
    return F.concat_ws("\n", F.nullif(header, F.lit("")), text)


def embedded(chunks: DataFrame, provider: Callable[[], Provider], text: str = "text", keep: tuple[str, ...] = ("chunk_id", "doc_id"), batch: int = 128) -> DataFrame:
    """``keep`` and ``embedding`` of rows with a text, in batches that run over documents; null where the provider failed, so that the row can be tried again."""

    def run(batches):
        model = provider()
        for b in batches:
            for i in range(0, b.num_rows, batch):
                part = b.slice(i, batch)
                try:
                    rows = list(model.passages([t or "" for t in part.column(text).to_pylist()]))
                except OSError:
                    rows = [None] * part.num_rows
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in keep), pa.array(rows, pa.list_(pa.float32()))], names=[*keep, "embedding"])

    types = dict(chunks.dtypes)
    return chunks.select(*keep, text).mapInArrow(run, ", ".join(f"{k} {types[k]}" for k in keep) + ", embedding array<float>")
