"""Byte-level BPE encoding and decoding by merge replay over a corpus.

A task takes the distinct pieces of its rows as one corpus of bytes. An
inverted index holds, for every merged token, the positions of the pairs that
make it. Merges are replayed over the whole corpus in rank order; each touches
only the positions that the index names, joins them and enters the two pairs
that arise beside each. A pair may make a token of lower rank than the one
being replayed, since ranks belong to the joined bytes and not to one pair;
such ranks are replayed next, as pair by pair encoding would. Texts are then
looked up piece by piece.

Rows never leave their task and nothing is shuffled. Memory is bounded by one
Arrow batch and a table of pieces that is emptied beyond ``max_pieces``.

Defined cases: a null text is empty and has no tokens; other columns are
ignored; special tokens do not exist, their strings are ordinary text.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Callable, Iterator
from itertools import islice
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from quillspark.functions.storage import spread
from quillspark.functions.tables import table
from quillspark.llm.common import slices, tidy


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from a file of base64 tokens and ranks."""
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(path).read_bytes().splitlines())}


class MergeReplay:
    """Encodes pieces of bytes by the ranks given."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.token = {i: b for b, i in ranks.items()}
        self.byte = np.array([ranks[bytes([i])] for i in range(256)], np.int32)
        self.base = max(ranks.values()) + 1
        pairs = [
            (ranks[b[:i]] * self.base + ranks[b[i:]], r) for b, r in ranks.items() for i in range(1, len(b)) if b[:i] in ranks and b[i:] in ranks
        ]
        pairs.sort()
        self.pair = np.array([k for k, _ in pairs] + [np.iinfo(np.int64).max], np.int64)
        self.made = np.array([r for _, r in pairs] + [-1], np.int64)

    def joined(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank that each pair makes, -1 if none. ``right`` is -1 where there is no neighbour."""
        keys = np.where(right < 0, -2, left.astype(np.int64) * self.base + right)
        at = np.searchsorted(self.pair, keys)
        return np.where(self.pair[at] == keys, self.made[at], -1)

    def replay(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of each piece as little-endian unsigned 32-bit integers."""
        n = np.fromiter(map(len, pieces), np.int64, len(pieces))
        ends = np.cumsum(n)
        token = self.byte[np.frombuffer(b"".join(pieces), np.uint8)]
        size = len(token)
        token = np.append(token, np.int32(-1))  # a sink that stands after the last token of each piece
        after, before = np.arange(1, size + 2, dtype=np.int32), np.arange(-1, size, dtype=np.int32)
        after[ends[n > 0] - 1] = size
        before[(ends - n)[n > 0]] = size
        after[size] = before[size] = size

        made = self.joined(token[:size], token[after[:size]])
        where = np.flatnonzero(made >= 0)
        where = where[np.argsort(made[where], kind="stable")]
        ranks, starts = np.unique(made[where], return_index=True)
        first = dict(zip(ranks.tolist(), np.split(where, starts[1:]), strict=True)) if len(ranks) else {}
        later: dict[int, list[int]] = {}  # positions entered since
        heap = ranks.tolist()
        heapq.heapify(heap)
        while heap:
            rank = heapq.heappop(heap)
            own, more = first.pop(rank, None), later.pop(rank, None)
            if own is None and more is None:
                continue
            at = own if more is None else np.unique(np.array(more) if own is None else np.append(own, more))
            at = at[(token[at] >= 0) & (at < size)]
            at = at[self.joined(token[at], token[after[at]]) == rank]
            if not len(at):
                continue
            if len(at) > 1:  # of pairs that overlap, every other one, from the left
                fresh = np.append(True, at[1:] != after[at[:-1]])
                index = np.arange(len(at))
                at = at[(index - np.maximum.accumulate(np.where(fresh, index, 0))) % 2 == 0]
            gone = after[at]
            beyond = after[gone]
            token[at], token[gone] = rank, -1
            after[at] = beyond
            before[beyond] = at
            before[size] = size
            left = before[at]
            left = left[left < size]
            new = np.concatenate((left, at))
            makes = self.joined(token[new], token[after[new]])
            good = makes >= 0
            for k, p in zip(makes[good].tolist(), new[good].tolist(), strict=True):
                if k in later:
                    later[k].append(p)
                else:
                    later[k] = [p]
                    heapq.heappush(heap, k)
        alive = token[:size] >= 0
        ids, counts = token[:size][alive].astype("<u4").tobytes(), np.append(0, np.cumsum(alive))[ends] * 4 if size else np.zeros(len(n), np.int64)
        bounds = [0, *counts.tolist()]
        return [ids[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]


class Pieces(dict):
    """Pieces by number, in the order of their coming."""

    def __missing__(self, piece: str) -> int:
        n = self[piece] = len(self)
        return n


class Codec:
    """Encodes and decodes texts; keeps the pieces it has seen, until they are over ``max_pieces``."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, max_pieces: int = 250_000):
        import regex

        self.engine, self.max_pieces = MergeReplay(ranks), max_pieces
        self.split = regex.compile(pattern).findall
        self.forget()

    def forget(self) -> None:
        self.pieces, self.coded = Pieces(), []

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """The ids of each text, as little-endian unsigned 32-bit integers."""
        if len(self.pieces) > self.max_pieces:
            self.forget()
        parts = [np.fromiter(map(self.pieces.__getitem__, self.split(t)), np.int32) for t in texts]
        new = [p.encode("utf-8", "surrogatepass") for p in islice(self.pieces, len(self.coded), None)]
        whole = [self.engine.ranks.get(p) for p in new]
        merged = iter(self.engine.replay([p for p, r in zip(new, whole, strict=True) if r is None]))
        self.coded += [next(merged) if r is None else r.to_bytes(4, "little") for r in whole]
        for p in parts:
            yield b"".join(map(self.coded.__getitem__, p.tolist()))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.engine.token.__getitem__, np.frombuffer(ids, "<u4").tolist()))


#: Bytes of text that are encoded at once.
SLICE_BYTES = 16_000_000


_codecs: dict[tuple[str, str], Codec] = {}


def _digest(ranks: dict[bytes, int]) -> str:
    """Of the whole table."""
    h = hashlib.sha256()
    for token, rank in sorted(ranks.items()):
        h.update(len(token).to_bytes(4, "little") + token + rank.to_bytes(8, "little"))
    return h.hexdigest()


def _codec(ranks, digest: str, pattern: str) -> Codec:
    """One codec for each Python process, as building its tables takes a while."""
    from quillspark.llm import bpe  # functions that came by value share the module's codecs, not their own

    kept = bpe._codecs
    if (digest, pattern) not in kept:
        kept.clear()
        kept[digest, pattern] = Codec(ranks.value, pattern)
    return kept[digest, pattern]


def tokenized(
    df: DataFrame, ranks: dict[bytes, int], pattern: str, derive: Callable[[bytes, Codec], tuple], fields: str, text: str = "text"
) -> DataFrame:
    """``df`` with what ``derive(ids, codec)`` gives for each row's text; ``fields`` are the types of that."""
    shared, digest = df.sparkSession.sparkContext.broadcast(ranks), _digest(ranks)  # a vocabulary, bounded by its file
    names = [f.split(":")[0] for f in fields.split(",")]
    schema = T.StructType(list(df.drop(text, *names).schema))
    kept = list(schema.names)

    def run(batches):
        codec = _codec(shared, digest, pattern)
        for b in batches:
            for part in slices(b, text, SLICE_BYTES):
                texts = [t or "" for t in part.column(text).to_pylist()]
                made = [derive(ids, codec) for ids in codec.encode(texts)]
                columns = [pa.array(list(x)) for x in zip(*made, strict=True)] if made else []
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in kept), *columns], names=[*kept, *names])
        codec.forget()

    for f in fields.split(","):
        schema = schema.add(*f.split(":"))
    return df.select(*kept, text).mapInArrow(tidy(run), schema)


def encode(df: DataFrame, ranks: dict[bytes, int], pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """``df`` with ``ids``: the text's tokens as little-endian unsigned 32-bit integers, in place of the text."""
    return tokenized(df, ranks, pattern, lambda x, _: (x,), f"{ids}:binary", text)


def decode(df: DataFrame, ranks: dict[bytes, int], ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``df`` with ``out``: the bytes that the tokens stand for, in place of the tokens (null for null)."""
    shared = df.sparkSession.sparkContext.broadcast(ranks)
    kept = df.drop(ids, out).columns

    def run(batches):
        token = {i: b for b, i in shared.value.items()}
        for b in batches:
            made = [None if x is None else b"".join(map(token.__getitem__, np.frombuffer(x, "<u4").tolist())) for x in b.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in kept), pa.array(made, pa.binary())], names=[*kept, out])

    return df.select(*kept, ids).mapInArrow(tidy(run), T.StructType([*df.select(*kept).schema, T.StructField(out, T.BinaryType())]))


def default_vocabulary() -> tuple[dict[bytes, int], str]:
    import public_tokenizers

    return load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN


def _digests(ids: bytes, codec: Codec) -> tuple:
    return len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(codec.decode(ids)).hexdigest()


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded again, as digests."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return tokenized(docs, *default_vocabulary(), _digests, "n_tokens:long,ids_sha256:string,decoded_sha256:string")
