"""The three searches over an index, chunks and documents.

``chunks`` are (chunk_id, doc_id, text); ``documents`` have the columns that
filters name. With ``postings`` no search reads a text but those of its page;
without, ``chunks`` are with_tokens() rows, whose token arrays are scanned.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.operators import index, rank, vectors
from quillspark.operators.filters import Filters, predicate
from quillspark.operators.postings import PostingIndex
from quillspark.plans.query import Query, QuerySyntaxError, analyze, clauses


@dataclass
class Settings:
    fts_candidates: int = 400
    semantic_candidates: int = 400
    fts_weight: float = 1.0
    vector_weight: float = 1.0
    rrf_k: int = rank.RRF_K
    exact_boost: float = 0.6
    most_documents: int = 1000
    chunks_per_document: int = 3


@dataclass
class Response:
    hits: DataFrame | None
    total: int = 0
    total_is_exact: bool = True
    mode: str = "exact"
    truncated: bool = False
    notes: list[str] = field(default_factory=list)


class Searcher:
    def __init__(
        self,
        chunks: DataFrame,
        documents: DataFrame,
        embeddings: DataFrame | None = None,
        embed: Callable[[str], list[float]] | None = None,
        settings: Settings | None = None,
        postings: PostingIndex | None = None,
    ):
        self.chunks, self.documents, self.postings = chunks, documents, postings
        self.embeddings, self.embed = embeddings, embed
        self.settings = settings or Settings()

    def search(self, text: str, mode: str = "exact", filters: Filters | None = None, limit: int = 20, offset: int = 0, newest: bool = False) -> Response:
        """Without embeddings all modes are exact; an empty query has no hits; one without any word or literal is an error."""
        q = analyze(text)
        if not q.raw:
            return Response(None, mode=mode)
        if mode == "exact" and not clauses(q):
            raise QuerySyntaxError(f"nothing in {text!r} can be searched for")
        f = (filters or Filters()).with_dates(q.ranges)
        if mode != "exact" and (self.embeddings is None or self.embed is None):
            found = self._exact(q, f, limit, offset, newest)
            found.notes.append("semantic search is not available; the results are exact matches")
            return found
        return {"exact": self._exact, "semantic": self._semantic, "hybrid": self._hybrid}[mode](q, f, limit, offset, newest)

    def _found(self, q: Query, f: Filters, strict: bool) -> DataFrame:
        """Matching chunks of documents that pass the filters; scores are over all chunks."""
        allowed = self.documents.where(predicate(f)).select("doc_id")
        if self.postings is not None:
            return self.postings.matches(clauses(q, strict), allowed)
        return index.matches(self.chunks, clauses(q, strict)).join(allowed, "doc_id", "left_semi")

    def _tokens_found(self, tokens: list[str]) -> DataFrame:
        return self.postings.tokens_found(tokens) if self.postings is not None else rank.tokens_found(self.chunks, tokens)

    def _exact(self, q: Query, f: Filters, limit: int, offset: int, newest: bool) -> Response:
        found = self._found(q, f, strict=True)
        docs = rank.by_document(found)
        if newest:
            docs = docs.join(self.documents.select("doc_id", "modified_at"), "doc_id")
        total = docs.count()
        hits = rank.page(docs, rank.by_modified() if newest else rank.by_relevance(), limit, offset)
        best = rank.best_chunks(found.join(F.broadcast(hits.select("doc_id")), "doc_id", "left_semi"), 3 * self.settings.chunks_per_document)  # of a page
        return Response(self._with_chunks(hits, best), total)

    def _with_chunks(self, hits: DataFrame, best: DataFrame) -> DataFrame:
        """The page with each document's best chunks, without those that repeat a better one."""
        shown = best.select("doc_id", "rank", "chunk_id", "score").join(self.chunks.select("chunk_id", "text"), "chunk_id")
        shown = rank.without_repeats(shown)
        own = shown.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("rank", "chunk_id", "score"))).alias("chunks"))
        own = own.withColumn("chunks", F.slice("chunks", 1, self.settings.chunks_per_document))
        return hits.join(own, "doc_id", "left").orderBy("place")

    def _nearest(self, q: Query, f: Filters) -> DataFrame:
        """Filtered only after the nearest are known."""
        near = vectors.top_k(self.embeddings, self.embed(q.text), max(50, self.settings.semantic_candidates))
        allowed = self.documents.where(predicate(f)).select("doc_id")
        return near.join(self.chunks.select("chunk_id", "doc_id"), "chunk_id").join(allowed, "doc_id").select("chunk_id", "doc_id", "score")

    def _semantic(self, q: Query, f: Filters, limit: int, offset: int, newest: bool) -> Response:
        groups = rank.grouped(self._nearest(q, f), self.settings.chunks_per_document)
        total = groups.count()
        hits = rank.normalized(rank.page(groups, rank.by_relevance(), limit, offset))
        return Response(hits, total, total_is_exact=False, mode="semantic")

    def _hybrid(self, q: Query, f: Filters, limit: int, offset: int, newest: bool) -> Response:
        s = self.settings
        found = self._found(q, f, strict=False)
        total_text = found.select("doc_id").distinct().count()
        lists = {"fts": (rank.ranked(found, s.fts_candidates), s.fts_weight), "vector": (rank.ranked(self._nearest(q, f), s.semantic_candidates), s.vector_weight)}
        groups = rank.grouped(rank.fused(lists, s.rrf_k), s.chunks_per_document)
        if required := q.required_tokens:
            groups = rank.boosted(groups, self._tokens_found(required), len(required), s.exact_boost)
        known = groups.count()
        ordered, truncated = rank.with_spill(groups, rank.by_document(found).limit(0)), False
        if total_text > known:
            extra = rank.by_document(found).orderBy(*rank.by_relevance()).limit(s.most_documents)
            ordered = rank.with_spill(groups, extra)
            truncated = total_text > (known := ordered.count())
        order = [F.asc("tier"), F.desc("own"), F.asc("doc_id")]
        hits = rank.normalized(rank.page(ordered, order, limit, offset))
        return Response(hits, max(total_text, known), bool(required) and not truncated, "hybrid", truncated)

    def count(self, text: str, filters: Filters | None = None) -> int:
        """How many chunks match."""
        q = analyze(text)
        return self._found(q, (filters or Filters()).with_dates(q.ranges), strict=True).count()

    def chunk_counts(self, text: str, doc_ids: list[int]) -> dict[int, int]:
        """Of given documents how many of their chunks match."""
        rows = self._found(analyze(text), Filters(), strict=True).where(F.col("doc_id").isin(doc_ids))
        return {r.doc_id: r.n_chunks for r in rank.by_document(rows).collect()}

    def all_documents(self, text: str, filters: Filters | None = None) -> DataFrame:
        """Every matching document's id, in order, without limit."""
        q = analyze(text)
        return self._found(q, (filters or Filters()).with_dates(q.ranges), strict=True).select("doc_id").distinct().orderBy("doc_id")
