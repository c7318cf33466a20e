"""Incremental maintenance of document and chunk tables as joins and unions.

Tables are replaced as a whole or by partition; MERGE on plain files is a join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NORMALIZATION_VERSION = 1
CHUNKING_VERSION = 1
RETRYABLE = ("download_failed",)


def change_key() -> Column:
    """From etag, else hash, else time and size."""
    return F.coalesce(
        F.concat(F.lit("etag:"), F.nullif("etag", F.lit(""))),
        F.concat(F.lit("hash:"), F.nullif("content_hash", F.lit(""))),
        F.concat(F.lit("mtime:"), F.coalesce(F.col("modified_at").cast("string"), F.lit("")), F.lit(":"), F.coalesce(F.col("size").cast("string"), F.lit(""))),
    )


def register(known: DataFrame, items: DataFrame, scan_id: int) -> DataFrame:
    """Upsert of scanned items by (source_id, external_id): known rows keep status and change key, all seen rows the scan's number."""
    key = ["source_id", "external_id"]
    fresh = items.select(*key, *(F.col(c).alias(f"new_{c}") for c in items.columns if c not in key), F.lit(True).alias("seen"))
    both = known.join(fresh, key, "full_outer")
    kept = {"status": F.coalesce("status", F.lit("pending")), "seen_scan_id": F.when(F.col("seen"), F.lit(scan_id)).otherwise(F.col("seen_scan_id"))}
    columns = []
    for c in known.columns:
        if c in key:
            columns.append(F.col(c))
        elif c in kept:
            columns.append(kept[c].alias(c))
        elif f"new_{c}" in fresh.columns and c != "change_key":
            columns.append(F.when(F.col("seen"), F.col(f"new_{c}")).otherwise(F.col(c)).alias(c))
        else:
            columns.append(F.col(c))
    return both.select(columns)


def needs_processing(new_key: Column, model_key: str | None = None, vectors: bool = False) -> Column:
    """Whether a document is to be processed again."""
    stale = (
        (F.col("status") == "pending")
        | ~F.col("change_key").eqNullSafe(new_key)
        | (F.coalesce("normalization_version", F.lit(0)) != NORMALIZATION_VERSION)
        | (F.coalesce("chunking_version", F.lit(0)) != CHUNKING_VERSION)
        | (~F.coalesce("fts_indexed", F.lit(False)) & (F.col("status") == "indexed"))
    )
    if vectors:
        other = ~F.col("model_key").eqNullSafe(F.lit(model_key))
        stale = stale | (F.col("status").isin("indexed", "partial") & (~F.coalesce("vector_indexed", F.lit(False)) | other))
    return stale


def stale(known: DataFrame, source_id: str, scan_id: int) -> DataFrame:
    """Documents of a source that this scan has not seen; attachments go with their parents."""
    return known.where((F.col("source_id") == source_id) & (F.col("seen_scan_id") < scan_id) & F.col("attachment_of").isNull())


def with_descendants(known: DataFrame, roots: DataFrame, depth: int = 3) -> DataFrame:
    """The ids of documents and of all attachments below them."""
    level = found = roots.select("doc_id")
    links = known.select("doc_id", "attachment_of").where("attachment_of IS NOT NULL")
    for _ in range(depth):
        level = links.join(level.withColumnRenamed("doc_id", "attachment_of"), "attachment_of", "left_semi").select("doc_id")
        found = found.unionByName(level)
    return found.distinct()


def without(rows: DataFrame, ids: DataFrame) -> DataFrame:
    return rows.join(ids, "doc_id", "left_anti")


def replaced(chunks: DataFrame, fresh: DataFrame) -> DataFrame:
    """Chunks with those of the documents in ``fresh`` replaced."""
    return without(chunks, fresh.select("doc_id").distinct()).unionByName(fresh)


def finished_status(n_chunks: Column, vectors_wanted: bool, has_vectors: Column) -> Column:
    """Of a processed document: empty without chunks, partial where wanted vectors are missing."""
    indexed = F.when(~has_vectors, "partial").otherwise("indexed") if vectors_wanted else F.lit("indexed")
    return F.when(n_chunks == 0, "empty").otherwise(indexed)


def failed(known: DataFrame, failures: DataFrame) -> DataFrame:
    """(doc_id, status, error_code, change_key) failures entered; the key is remembered unless a retry may help."""
    f = failures.select("doc_id", F.col("status").alias("f_status"), F.col("error_code").alias("f_code"), F.col("change_key").alias("f_key"))
    hit = F.col("f_status").isNotNull()
    out = known.join(f, "doc_id", "left")
    out = out.withColumn("change_key", F.when(hit & ~F.col("f_status").isin(*RETRYABLE), F.col("f_key")).otherwise(F.col("change_key")))
    out = out.withColumn("status", F.coalesce("f_status", "status")).withColumn("error_code", F.when(hit, F.col("f_code")).otherwise(F.col("error_code")))
    return out.withColumn("attempts", F.coalesce("attempts", F.lit(0)) + hit.cast("int")).drop("f_status", "f_code", "f_key")


def requeued(known: DataFrame, ids: DataFrame) -> DataFrame:
    """The documents named set to pending, errors cleared."""
    hit = known.join(ids.select("doc_id", F.lit(True).alias("hit")).distinct(), "doc_id", "left")
    return hit.withColumn("status", F.when(F.col("hit"), "pending").otherwise(F.col("status"))).withColumn(
        "error_code", F.when(F.col("hit"), F.lit(None)).otherwise(F.col("error_code"))
    ).drop("hit")


def backoff_seconds(attempt: Column) -> Column:
    """0 at first, then 2, 4, 8 up to 60."""
    return F.when(attempt <= 1, 0.0).otherwise(F.least(F.lit(60.0), 2 * F.pow(F.lit(2.0), attempt - 2)))


def attachment_id(parent: Column, name: Column) -> Column:
    return F.concat(parent, F.lit("#att:"), name)


def orphans(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    return chunks.join(documents, "doc_id", "left_anti")
