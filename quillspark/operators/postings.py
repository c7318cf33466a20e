"""A stored inverted index: postings with positions by token bucket, and BM25 over them.

Texts are read once, when the index is built or changed. A query reads the
partitions of its tokens' buckets, in them the row groups of its tokens, and
the lengths' sums; its work follows the postings of its tokens, not the corpus.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions.spans import literal_tokens
from quillspark.functions.storage import spread
from quillspark.functions.text import fold_text
from quillspark.operators.index import Clause, Phrase, bm25, holds, phrases_of
from quillspark.operators.versions import ChangeTable

BUCKETS = 64
SLICE, LEAST_TEXT = 1_000_000, 100  # bytes of text that become postings at once, and what a text counts at least
#: ``part``: folded or norm for postings; chunk for a row per chunk, whose ``n_tokens`` counts. ``bucket`` follows from the token, or the chunk.
ROWS = "bucket int, part string, token string, chunk_id long, doc_id long, tf int, n_tokens long, positions array<int>"
_TOKEN = re.compile("(?:[^\\W_]|[\ue000-\uf8ff])+")


def tokenised(text: str | None) -> list[str]:
    """Index tokens of a text."""
    return _TOKEN.findall(fold_text(text or ""))


def rows_of(chunks: DataFrame, norm: bool = True, heading: str | None = None) -> DataFrame:
    """(chunk_id, doc_id, text) to ROWS without buckets; with ``norm`` the text's dates and numbers are tokens too."""
    columns = ["chunk_id", "doc_id", "text", *([heading] if heading else [])]

    def posted(b: pa.RecordBatch) -> pa.RecordBatch:
        parts, tokens, owners, docs, tfs, sizes, places = [], [], [], [], [], [], []
        headings = b.column(heading).to_pylist() if heading else [None] * b.num_rows
        for chunk, doc, text, above in zip(*(b.column(c).to_pylist() for c in ("chunk_id", "doc_id", "text")), headings, strict=True):
            found = {"folded": tokenised(text)}
            if norm:
                found["norm"] = literal_tokens("\n".join(x for x in (above, text) if x))
            n = sum(map(len, found.values()))
            own = [("chunk", "", [])]
            for part, sequence in found.items():
                at: dict[str, list[int]] = {}
                for i, t in enumerate(sequence):
                    at.setdefault(t, []).append(i)
                own += [(part, t, p) for t, p in at.items()]
            for part, t, p in own:
                parts.append(part)
                tokens.append(t)
                tfs.append(len(p))
                places.append(p)
            owners += [chunk] * len(own)
            docs += [doc] * len(own)
            sizes += [n] * len(own)
        return pa.RecordBatch.from_arrays(
            [pa.array(parts, pa.string()), pa.array(tokens, pa.string()), pa.array(owners, pa.int64()), pa.array(docs, pa.int64()),
             pa.array(tfs, pa.int32()), pa.array(sizes, pa.int64()), pa.array(places, pa.list_(pa.int32()))],
            names=["part", "token", "chunk_id", "doc_id", "tf", "n_tokens", "positions"],
        )

    def run(batches):
        for b in batches:
            yield from map(posted, _slices(b))

    return spread(chunks.select(*columns)).mapInArrow(run, ROWS.partition(", ")[2])


def _slices(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch in parts of some SLICE bytes of text, a longer one alone: postings as Python values take many times what their texts do."""
    start = held = 0
    for i, size in enumerate(pc.fill_null(pc.binary_length(b.column("text")), 0).to_pylist()):
        if held and held + size > SLICE:
            yield b.slice(start, i - start)
            start, held = i, 0
        held += max(size, LEAST_TEXT)
    yield b.slice(start)


def _bucket(part: Column, token: Column, chunk: Column) -> Column:
    return F.pmod(F.when(part == "chunk", F.xxhash64(chunk)).otherwise(F.xxhash64(token)), F.lit(BUCKETS)).cast("int")


def _followed(phrase: int, n: int):
    """Whether the phrase's other tokens stand right after the place of its first."""

    def run(at: Column) -> Column:
        there = (F.coalesce(F.array_contains(F.col(f"_at_{phrase}_{j}"), at + j), F.lit(False)) for j in range(1, n))
        return reduce(lambda a, b: a & b, there)

    return run


def bucket_of(token: str) -> int:
    """The bucket of a token, as _bucket() gives it."""
    h = xxhash.xxh64_intdigest(token.encode(), seed=42)
    return (h - (h >> 63 << 64)) % BUCKETS


class PostingIndex:
    """Postings of chunks in a folder, as changes by document."""

    def __init__(self, spark: SparkSession, path: str, upto: int | None = None):
        self.spark, self.table, self.upto = spark, ChangeTable(spark, path, partition="bucket"), upto
        self._total: tuple[int, int] | None = None

    def write(self, chunks: DataFrame, gone: DataFrame | None = None, version: int = 1, norm: bool = True, heading: str | None = None) -> int:
        """The postings of new chunks; ``gone`` are documents whose earlier postings end. Sorted, so that a token's row groups lie together."""
        rows = rows_of(chunks, norm, heading).withColumn("bucket", _bucket(F.col("part"), F.col("token"), F.col("chunk_id")))
        rows = rows.repartition("bucket").sortWithinPartitions("bucket", "token", "part", "chunk_id")
        self._total = None
        return self.table.write(rows, gone, version)

    def _live(self) -> DataFrame:
        found = self.table.read(self.upto)
        return found if found is not None else self.spark.createDataFrame([], ROWS)

    def totals(self) -> tuple[int, int]:
        """Number of chunks and of all their tokens."""
        if self._total is None:
            row = self._live().where("part = 'chunk'").agg(F.count(F.lit(1)), F.coalesce(F.sum("n_tokens"), F.lit(0))).collect()[0]
            self._total = int(row[0]), int(row[1])
        return self._total

    def lookup(self, phrases: list[Phrase]) -> DataFrame:
        """The postings of the phrases' tokens: partitions are pruned by bucket, row groups by token."""
        wanted = sorted({(p.column, t) for p in phrases for t in p.tokens})
        tokens = sorted({t for _, t in wanted})
        buckets = sorted({bucket_of(t) for t in tokens})
        pairs = F.struct("part", "token").isin([F.struct(F.lit(c), F.lit(t)) for c, t in wanted]) if wanted else F.lit(False)
        return self._live().where(F.col("bucket").isin(buckets) & F.col("token").isin(tokens) & pairs)

    def counted(self, phrases: list[Phrase]) -> DataFrame:
        """(chunk_id, doc_id, n_tokens, tf_<i>): of each chunk with any of the tokens, how often each phrase occurs."""
        rows = self.lookup(phrases)

        def of(column: str, token: str) -> Column:
            return F.when((F.col("part") == column) & (F.col("token") == token), F.col("positions"))

        counts, later = [], {}
        for i, p in enumerate(phrases):
            if len(p.tokens) == 1:
                hit = (F.col("part") == p.column) & (F.col("token") == p.tokens[0])
                counts.append(F.coalesce(F.max(F.when(hit, F.col("tf"))), F.lit(0)).cast("long").alias(f"tf_{i}"))
            else:
                counts += [F.first(of(p.column, t), ignorenulls=True).alias(f"_at_{i}_{j}") for j, t in enumerate(p.tokens)]
                starts = F.filter(f"_at_{i}_0", _followed(i, len(p.tokens)))
                later[f"tf_{i}"] = F.greatest(F.coalesce(F.size(starts), F.lit(0)), F.lit(0)).cast("long")
        grouped = rows.groupBy("chunk_id", "doc_id").agg(F.max("n_tokens").alias("n_tokens"), *counts)
        grouped = grouped.withColumns(later) if later else grouped
        return grouped.select("chunk_id", "doc_id", "n_tokens", *(f"tf_{i}" for i in range(len(phrases))))

    def statistics(self, phrases: list[Phrase]) -> dict[str, float]:
        n, total = self.totals()
        row = self.counted(phrases).agg(*(F.count_if(F.col(f"tf_{i}") > 0).alias(f"df_{i}") for i in range(len(phrases)))).collect()[0].asDict()
        return {"n": n, "mean": total / n if n else 0.0, **{k: v or 0 for k, v in row.items()}}

    def matches(self, clauses: list[Clause], allowed: DataFrame | None = None) -> DataFrame:
        """(chunk_id, doc_id, n_tokens, tf_<i>, score) of chunks that satisfy the clauses; none without clauses. Scores are over all chunks.

        ``allowed`` are the documents (doc_id) that a filter lets pass.
        """
        phrases = phrases_of(clauses)
        if not phrases:
            return self.spark.createDataFrame([], "chunk_id long, doc_id long, n_tokens long, score double")
        stats = self.statistics(phrases)
        found = self.counted(phrases).where(holds(clauses, phrases))
        if allowed is not None:
            found = found.join(allowed.select("doc_id"), "doc_id", "left_semi")
        return found.withColumn("score", bm25(phrases, stats))

    def tokens_found(self, tokens: list[str]) -> DataFrame:
        """(doc_id, n_found): how many of the literal tokens a document has."""
        rows = self.lookup([Phrase("norm", (t,)) for t in tokens])
        return rows.groupBy("doc_id").agg(F.count_distinct("token").alias("n_found"))

    def check(self, chunks: DataFrame, heading: str | None = None, norm: bool = True) -> DataFrame:
        """Postings that the index has and the chunks lack, or the other way round: none if it is sound."""
        keys = ["part", "token", "chunk_id", "tf"]
        have, want = self._live().select(*keys, F.lit(1).alias("n")), rows_of(chunks, norm, heading).select(*keys, F.lit(-1).alias("n"))
        differ = have.unionByName(want).groupBy(*keys).agg(F.sum("n").alias("n")).where("n <> 0")
        finding = F.when(F.col("n") > 0, "surplus").otherwise("missing")
        return differ.select(*keys, F.explode(F.array_repeat(finding, F.abs("n").cast("int"))).alias("finding"))
