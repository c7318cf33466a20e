"""Grouping by document, pages, fusion, boosts and near-duplicate suppression."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.functions import text as tx

RRF_K = 60
DUPLICATE = 0.82


def by_document(found: DataFrame) -> DataFrame:
    """Matching chunks to (doc_id, score, n_chunks), the best chunk's score."""
    return found.groupBy("doc_id").agg(F.max("score").alias("score"), F.count(F.lit(1)).alias("n_chunks"))


def by_relevance() -> list[Column]:
    return [F.desc("score"), F.asc("doc_id")]


def by_modified() -> list[Column]:
    return [F.desc_nulls_last("modified_at"), F.desc("score"), F.asc("doc_id")]


def page(rows: DataFrame, order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    """A page with the row's place in the whole order, from 1. Only offset + limit rows are ever gathered."""
    top = rows.orderBy(*order).limit(offset + limit)
    place = F.row_number().over(Window.orderBy(*order))
    return top.withColumn("place", place).where(F.col("place") > offset)


def best_chunks(found: DataFrame, per_document: int) -> DataFrame:
    """The best chunks of each document, with their rank."""
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("score"), "chunk_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= per_document)


def ranked(found: DataFrame, limit: int) -> DataFrame:
    """The best chunks overall with their rank; ties by chunk id."""
    order = [F.desc("score"), F.asc("chunk_id")]
    return found.orderBy(*order).limit(limit).withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def fused(lists: dict[str, tuple[DataFrame, float]], k: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion of named (chunk_id, doc_id, rank) lists with weights: score and <name>_rank."""
    rows = None
    for name, (entries, weight) in lists.items():
        one = entries.select("chunk_id", "doc_id", F.lit(name).alias("list"), "rank", (F.lit(weight) / (k + F.col("rank"))).alias("part"))
        rows = one if rows is None else rows.unionByName(one)
    ranks = [F.min(F.when(F.col("list") == n, F.col("rank"))).alias(f"{n}_rank") for n in lists]
    return rows.groupBy("chunk_id").agg(F.min("doc_id").alias("doc_id"), F.sum("part").alias("score"), *ranks)


COMBINERS = {
    "max": lambda most: F.max("score"),
    "sum": lambda most: F.sum("score"),
    "max_plus_tail": lambda most: F.sum(F.when(F.col("rank") <= max(1, most), F.col("score") / F.col("rank")).otherwise(0.0)),
}


def grouped(candidates: DataFrame, most: int = 3, combine: str = "max_plus_tail") -> DataFrame:
    """Candidates to documents: the combined score, and the best 3 * most candidates."""
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("score"), "chunk_id"))
    chunk = F.when(F.col("rank") <= max(1, 3 * most), F.struct("rank", "chunk_id", "score"))
    return (
        candidates.withColumn("rank", rank)
        .groupBy("doc_id")
        .agg(COMBINERS[combine](most).alias("score"), F.array_sort(F.collect_list(chunk)).alias("chunks"))
    )


def normalized(groups: DataFrame) -> DataFrame:
    """Scores of a page relative to its best, 0 where none is positive. For pages: all rows meet in one task."""
    best = F.max("score").over(Window.partitionBy())
    return groups.withColumn("strength", F.when(best > 0, F.least(F.lit(1.0), F.col("score") / best)).otherwise(0.0))


def boosted(groups: DataFrame, found: DataFrame, required: int, boost: float = 0.6) -> DataFrame:
    """Scores raised by the best score * boost * share of the required tokens that (doc_id, n_found) has."""
    best = groups.agg(F.coalesce(F.max("score"), F.lit(1.0)).alias("b")).collect()[0].b or 1.0
    share = F.coalesce("n_found", F.lit(0)) / required
    return groups.join(found, "doc_id", "left").withColumn("score", F.col("score") + best * boost * share).drop("n_found")


def tokens_found(chunks: DataFrame, tokens: list[str]) -> DataFrame:
    """(doc_id, n_found): how many of the tokens a document's chunks have."""
    wanted = F.array(*map(F.lit, tokens))
    each = chunks.select("doc_id", F.explode(F.array_intersect("norm", wanted)).alias("token"))
    return each.groupBy("doc_id").agg(F.count_distinct("token").alias("n_found"))


def with_spill(ordered: DataFrame, extra: DataFrame) -> DataFrame:
    """Fused documents, then full-text documents that fusion lacks, at score 0: (doc_id, score, tier)."""
    rest = extra.join(ordered, "doc_id", "left_anti").select("doc_id", F.lit(0.0).alias("score"), F.lit(1).alias("tier"), F.col("score").alias("own"))
    return ordered.select("doc_id", "score", F.lit(0).alias("tier"), F.col("score").alias("own")).unionByName(rest)


def shingles(text: Column, width: int = 5) -> Column:
    """Distinct windows of words of the folded text, or the whole of a short one."""

    def of(w: Column) -> Column:
        windows = F.transform(F.sequence(F.lit(1), F.size(w) - width + 1), lambda i: F.array_join(F.slice(w, i, width), " "))
        short = F.when(F.size(w) > 0, F.array(F.array_join(w, " "))).otherwise(F.array().cast("array<string>"))
        return F.when(F.size(w) > width, F.array_distinct(windows)).otherwise(short)

    words = F.filter(F.split(tx.fold(text), r"(?U)\s+"), lambda x: x != "")
    # as a lambda's variable, the words are found once and not anew for each window
    return F.get(F.transform(F.array(words), of), F.lit(0))


def overlap(a: Column, b: Column) -> Column:
    """Common shingles over those of the shorter text; 0 if either has none."""
    least = F.least(F.size(a), F.size(b))
    return F.when(least > 0, F.size(F.array_intersect(a, b)) / least).otherwise(0.0)


def without_repeats(chunks: DataFrame, threshold: float = DUPLICATE) -> DataFrame:
    """(doc_id, rank, chunk_id, text, ...): per document the chunks that repeat no better one.

    Groups are pages of a few chunks: which of them stay is folded over an array
    of their distinct shingles, in the order of ranks.
    """
    own = F.struct("rank", "chunk_id", F.xxhash64("chunk_id", "rank").alias("id"), shingles(F.coalesce("text", F.lit(""))).alias("s"))
    ranked = chunks.groupBy("doc_id").agg(F.array_sort(F.collect_list(own)).alias("page"))
    none = F.array().cast(T.ArrayType(T.ArrayType(T.StringType())))

    def step(state: Column, chunk: Column) -> Column:
        repeats = F.exists(state["sets"], lambda o: overlap(o, chunk["s"]) >= threshold)
        return F.struct(
            F.when(repeats, state["sets"]).otherwise(F.concat(state["sets"], F.array(chunk["s"]))).alias("sets"),
            F.when(repeats, state["kept"]).otherwise(F.concat(state["kept"], F.array(chunk["id"]))).alias("kept"),
        )

    start = F.struct(none.alias("sets"), F.array().cast("array<bigint>").alias("kept"))
    kept = ranked.select("doc_id", F.explode(F.aggregate("page", start, step)["kept"]).alias("id"))
    return chunks.withColumn("id", F.xxhash64("chunk_id", "rank")).join(kept, ["doc_id", "id"], "left_semi").drop("id")
