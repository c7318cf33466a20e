"""A corpus pipeline: each stage's result is written as Parquet and is the next one's documents.

quality -> near duplicates -> secrets -> mixing -> tokens. All stages but the
last return the columns of ``documents``.

What a stage stores on its way is deleted when the next one begins, as that
reads the written result: a stage's result is to be written before then.

Defined cases are those of the operators; a table without rows gives one
without rows, columns besides those of documents are dropped by the first
stage.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.functions.storage import spread
from quillspark.llm import bpe, mixing, neardup, quality, secrets
from quillspark.llm.common import WORD, discard, recorded, scratch, stored

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
_left: list[str] = []


def _stage(f: Stage) -> Stage:
    """A stage that first deletes what the one before has left, but for what its input reads."""

    @wraps(f)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        read = docs.inputFiles()
        old = [p for p in _left if not any(p.rpartition("/")[2] in r for r in read)]
        discard(spark, old)
        with recorded() as made:
            out = f(spark, docs, sf_dir)
        _left[:] = [p for p in _left if p not in old] + made
        return out

    return run


COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@_stage
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and are no outlier of their language and source."""
    rows = stored(quality.keyed(quality.measured(spread(docs.select(COLUMNS)))).where("NOT base_failed"), "quality-stats")
    model = quality.estimates(rows.select("lkey", "skey", "vec"))
    return quality.judged(rows, model).where("kept").select(COLUMNS)


@_stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates, that with the least id; texts without words all stay.

    Where rows share that id and their texts differ, the least text (by its
    digest) stays, and of rows with one id and text the one that is least by
    language and source.
    """
    found = neardup.classes(docs.select("doc_id", "text"))
    least = found.where("worded AND doc_id <=> class_id").groupBy("root", "class_id").agg(F.min("node").alias("node"))
    keepers = least.select(F.col("class_id").alias("doc_id"), "node")
    named = docs.withColumn("node", F.unhex(F.md5("text")))
    same = (named["doc_id"].eqNullSafe(keepers["doc_id"])) & (named["node"] == keepers["node"])
    kept = named.join(keepers, same, "left_semi")
    first = F.row_number().over(Window.partitionBy("doc_id", "node").orderBy("lang", "source"))
    wordless = docs.where(~F.coalesce(F.col("text").rlike(WORD), F.lit(False)))
    return kept.withColumn("first", first).where("first = 1").select(COLUMNS).unionByName(wordless.select(COLUMNS))


@_stage
def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, what looks like a secret replaced by its kind."""
    ledger = secrets.scan(docs.select("text"), scratch(spark, "secret-ledger"))
    clean = secrets.redact(F.col("text"), F.col("findings"))
    found = secrets.findings_of(docs.select(COLUMNS), ledger).withColumn("text", clean)
    return found.withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


@_stage
def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document at least once, those of small sources up to twice, at 95 % of the greatest entropy of sources if that allows."""
    tokens = mixing.n_words(F.col("text"))
    return mixing.draw(docs.select(COLUMNS), tokens, budget="cover", entropy=0.95, max_repeats=2.0).select(COLUMNS)


@_stage
def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as byte-level BPE tokens (little-endian unsigned 32-bit integers)."""
    encoded = bpe.encode(docs.select("doc_id", "source", "text"), *bpe.default_vocabulary(), ids="tokens")
    return encoded.withColumn("n_tokens", (F.octet_length("tokens") / 4).cast("long"))


STAGES = [
    ("quality rules", quality_rules),
    ("near duplicates", near_duplicates),
    ("secret scan", secret_scan),
    ("source mixing", source_mixing),
    ("tokens", tokens),
]

#: SQL can't express minimum covariance determinants, DartMinHash or BPE; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, from the table of documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = scratch(spark, "pipeline-" + name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
