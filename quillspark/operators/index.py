"""The full-text index as DataFrames: token arrays, postings with positions, statistics and BM25.

A chunk has two token columns, ``folded`` (of its text) and ``norm`` (literal
tokens of dates and numbers). A query is a conjunction of clauses; a clause is
satisfied by any of its phrases; a phrase is consecutive tokens in a column.
Everything is per chunk: all clauses must hold in one chunk.

Matching needs no postings and no shuffle: counts of a query's phrases are
computed beside each other from the token arrays in one pass. postings() is
for tables that serve many queries (write_postings() clusters it by token).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions import text as tx

K1, B = 1.2, 0.75
LEAST_IDF = 1e-6
WEIGHTS = {"folded": 1.0, "norm": 0.6}


@dataclass(frozen=True)
class Phrase:
    column: str
    tokens: tuple[str, ...]


Clause = tuple[Phrase, ...]  # alternatives


def word(text: str, column: str = "folded") -> Phrase | None:
    """The phrase that a word or several make under the index's tokeniser."""
    import re
    import unicodedata

    spaced = "".join(c if unicodedata.category(c)[0] in "LN" or unicodedata.category(c) == "Co" else " " for c in tx.fold_text(text))
    found = tuple(re.split(" +", spaced.strip())) if spaced.strip() else ()
    return Phrase(column, found) if found else None


def with_tokens(chunks: DataFrame, text: str = "text", norm: Column | None = None) -> DataFrame:
    """``chunks`` with token arrays ``folded`` and ``norm`` and their common length."""
    none = F.array().cast("array<string>")
    # a generator of one row: the optimiser would else fold the text anew for each phrase that is counted
    found = F.explode(F.array(tx.tokens(tx.fold(F.coalesce(F.col(text), F.lit(""))))))
    out = chunks.drop("folded").select("*", found.alias("folded")).withColumn("norm", norm if norm is not None else none)
    return out.withColumn("n_tokens", (F.size("folded") + F.size("norm")).cast("long"))


def representations(chunks: DataFrame, text: str = "text", heading: str = "heading", norm: Column | None = None) -> DataFrame:
    """``chunks`` with all forms of a chunk: ``display``, what is shown; ``search_text``, cleaned with its heading, in lower case; ``folded`` and ``norm``, what is indexed."""
    whole = F.concat_ws("\n", F.nullif(heading, F.lit("")), F.coalesce(text, F.lit("")))
    out = chunks.withColumn("display", F.coalesce(text, F.lit(""))).withColumn("search_text", tx.cleaned_lower(whole)).withColumn("_whole", whole)
    return with_tokens(out, "_whole", norm).drop("_whole")


def occurrences(p: Phrase) -> Column:
    """How often the phrase occurs in its column."""
    first = F.lit(p.tokens[0])
    if len(p.tokens) == 1:
        return F.size(F.filter(p.column, lambda t: t == first))
    whole = F.array(*map(F.lit, p.tokens))
    starts = F.filter(F.sequence(F.lit(1), F.size(p.column)), lambda i: F.slice(p.column, i, len(p.tokens)) == whole)
    return F.when(F.array_contains(p.column, first), F.size(starts)).otherwise(0)


def phrases_of(clauses: list[Clause]) -> list[Phrase]:
    return list(dict.fromkeys(p for c in clauses for p in c))


def counted(chunks: DataFrame, phrases: list[Phrase]) -> DataFrame:
    """with_tokens() chunks with a count tf_<i> of each phrase."""
    return chunks.withColumns({f"tf_{i}": occurrences(p).cast("long") for i, p in enumerate(phrases)})


def statistics(chunks: DataFrame, phrases: list[Phrase]) -> dict[str, float]:
    """Over all chunks: how many, their mean length, and in how many each phrase occurs. One row reaches the driver."""
    row = (
        counted(chunks, phrases)
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.avg("n_tokens").alias("mean"),
            *(F.sum((F.col(f"tf_{i}") > 0).cast("long")).alias(f"df_{i}") for i in range(len(phrases))),
        )
        .collect()[0]
        .asDict()
    )
    return {k: v or 0 for k, v in row.items()}


def bm25(phrases: list[Phrase], stats: dict[str, float]) -> Column:
    """The score of counted() chunks, greater is better."""
    import math

    total = F.lit(0.0)
    mean = max(stats["mean"], 1e-9)
    for i, p in enumerate(phrases):
        idf = max(LEAST_IDF, math.log((stats["n"] - stats[f"df_{i}"] + 0.5) / (stats[f"df_{i}"] + 0.5)))
        tf = F.col(f"tf_{i}") * WEIGHTS[p.column]
        total = total + idf * (tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("n_tokens") / mean)))
    return total


def holds(clauses: list[Clause], phrases: list[Phrase]) -> Column:
    """All clauses, each by one of its phrases at least."""
    out = F.lit(True)
    for clause in clauses:
        out = out & F.greatest(*(F.col(f"tf_{phrases.index(p)}") for p in clause), F.lit(0)).__gt__(0)
    return out


def matches(chunks: DataFrame, clauses: list[Clause]) -> DataFrame:
    """The with_tokens() chunks that satisfy the clauses, with ``score`` over all chunks; none without clauses."""
    phrases = phrases_of(clauses)
    if not phrases:
        return chunks.where(F.lit(False)).withColumn("score", F.lit(0.0))
    stats = statistics(chunks, phrases)
    found = counted(chunks, phrases).where(holds(clauses, phrases))
    return found.withColumn("score", bm25(phrases, stats)).drop(*(f"tf_{i}" for i in range(len(phrases))))


def postings(chunks: DataFrame, column: str = "folded") -> DataFrame:
    """(token, chunk_id, doc_id, tf, positions) of with_tokens() chunks."""
    each = chunks.select("chunk_id", "doc_id", F.posexplode(column).alias("position", "token"))
    return each.groupBy("token", "chunk_id", "doc_id").agg(
        F.count(F.lit(1)).alias("tf"), F.array_sort(F.collect_list("position")).alias("positions")
    )


def term_frequencies(chunks: DataFrame, column: str = "folded") -> DataFrame:
    """Per token the chunks that have it and its occurrences."""
    per = chunks.select(F.explode(F.array_distinct(column)).alias("token"))
    every = chunks.select(F.explode(column).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("cf"))
    return per.groupBy("token").agg(F.count(F.lit(1)).alias("df")).join(every, "token")


def write_postings(posted: DataFrame, path: str, buckets: int = 64) -> None:
    """Postings clustered by token, so that a query reads few row groups."""
    key = F.pmod(F.xxhash64("token"), F.lit(buckets))
    posted.withColumn("bucket", key).repartition(buckets, "bucket").sortWithinPartitions("bucket", "token", "chunk_id").write.partitionBy("bucket").parquet(path)


def read_postings(spark, path: str, tokens: list[str], buckets: int = 64) -> DataFrame:
    """The postings of some tokens: partitions are pruned by bucket, row groups by token."""
    keys = spark.createDataFrame([(t,) for t in tokens], "token string").select(F.pmod(F.xxhash64("token"), F.lit(buckets))).collect()
    return spark.read.parquet(path).where(F.col("bucket").isin(*{int(k[0]) for k in keys}) & F.col("token").isin(*tokens))
