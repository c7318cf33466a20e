"""Coverage, status, error and consistency reports as aggregates; OCR decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions.text import is_garbage
from quillspark.operators.filters import SEARCHABLE

# All statuses, and the formats that can be rendered for OCR.
STATUSES = ("pending", "indexed", "partial", "skipped", "unsupported", "corrupted", "password_protected", "empty", "download_failed", "error", "deleted")
# How statuses are shown.
STATUS_LABELS = {
    "pending": "Oczekuje na przetworzenie", "indexed": "Zaindeksowany", "partial": "Zaindeksowany częściowo", "skipped": "Pominięty", "unsupported": "Format nieobsługiwany",
    "corrupted": "Plik uszkodzony", "password_protected": "Zabezpieczony hasłem", "empty": "Brak treści do zaindeksowania", "download_failed": "Nie udało się pobrać pliku",
    "error": "Błąd przetwarzania", "deleted": "Usunięty ze źródła",
}
RASTER_TYPES = ("application/pdf", "image/png", "image/jpeg", "image/tiff", "image/bmp", "image/gif", "image/webp")
RASTER_EXTENSIONS = (".pdf", ".png", ".jpg", ".jpeg", ".tif", ".tiff", ".bmp", ".gif", ".webp")
NO_EXTENSION = "(brak)"


def status_label(status: Column) -> Column:
    """How a status is shown; others as they are."""
    labels = F.create_map(*(F.lit(x) for pair in STATUS_LABELS.items() for x in pair))
    return F.coalesce(labels[status], status)


def counts(docs: DataFrame, column: str, empty: str | None = None) -> DataFrame:
    """Rows per value, most first; rows without a value only where ``empty`` names them."""
    value = F.col(column)
    rows = docs.where(value.isNotNull()) if empty is None else docs.withColumn(column, F.coalesce(F.nullif(value, F.lit("")), F.lit(empty)))
    return rows.groupBy(column).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), column)


def requires_ocr(docs: DataFrame, errors: DataFrame) -> DataFrame:
    """``docs`` with needs_ocr: OCR was used, an OCR error is logged, or an empty document could be rendered."""
    logged = errors.where(F.col("stage") == "ocr").select("doc_id", F.lit(True).alias("ocr_error")).distinct()
    blank = (F.lower("status") == "empty") & (F.lower("extension").isin(*RASTER_EXTENSIONS) | F.lower("mime_type").isin(*RASTER_TYPES))
    flag = F.coalesce(F.col("used_ocr"), F.lit(False)) | F.coalesce("ocr_error", F.lit(False)) | F.coalesce(blank, F.lit(False))
    return docs.join(logged, "doc_id", "left").withColumn("needs_ocr", flag).drop("ocr_error")


def coverage(docs: DataFrame, errors: DataFrame) -> DataFrame:
    """One row: documents by status, OCR needed, done and failed, and whether all is searchable."""
    is_ = lambda s: F.count_if(F.col("status") == s)
    ok = F.count_if(F.coalesce("used_ocr", F.lit(False)) & F.col("status").isin(*SEARCHABLE))
    need = F.count_if("needs_ocr")
    row = requires_ocr(docs, errors).agg(
        F.count(F.lit(1)).alias("discovered"),
        *(is_(s).alias(s) for s in STATUSES),
        need.alias("ocr_needed"),
        ok.alias("ocr_succeeded"),
        F.greatest(F.lit(0), need - ok).alias("ocr_failed"),
    )
    rest = F.col("discovered") - F.col("indexed") - F.col("partial")
    done = (F.col("discovered") > 0) & (rest == 0) & (F.col("indexed") > 0)
    return row.withColumn("non_searchable", F.greatest(F.lit(0), rest)).withColumn("is_complete", done)


def non_searchable(docs: DataFrame, pending: bool = True, limit: int = 5000) -> DataFrame:
    rows = docs.where(~F.col("status").isin(*SEARCHABLE))
    rows = rows if pending else rows.where(F.col("status") != "pending")
    return rows.orderBy("status", "name", "doc_id").limit(limit)


def consistency(docs: DataFrame, chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """One row: orphaned chunks, indexed documents without chunks, chunks without and vectors beyond."""
    one = F.count(F.lit(1))
    parts = {
        "orphan_chunks": chunks.join(docs, "doc_id", "left_anti"),
        "indexed_without_chunks": docs.where(F.col("status") == "indexed").join(chunks, "doc_id", "left_anti"),
        "chunks_without_vector": chunks.join(vectors, "chunk_id", "left_anti"),
        "vectors_without_chunk": vectors.join(chunks, "chunk_id", "left_anti"),
    }
    rows = None
    for name, df in parts.items():
        one_row = df.agg(one.alias("n")).select(F.lit(name).alias("finding"), "n")
        rows = one_row if rows is None else rows.unionByName(one_row)
    return rows


def index_statistics(docs: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row: documents, pages read by OCR, chunks and their mean length."""
    d = docs.agg(
        F.count(F.lit(1)).alias("documents"), F.count_if(F.coalesce("used_ocr", F.lit(False))).alias("ocr_documents"),
        F.coalesce(F.sum(F.when(F.col("used_ocr"), F.col("ocr_pages"))), F.lit(0)).alias("ocr_pages"),
    )
    c = chunks.agg(F.count(F.lit(1)).alias("chunks"), F.coalesce(F.bround(F.avg(F.length("text"))), F.lit(0.0)).cast("long").alias("mean_chars"))
    return d.withColumn("k", F.lit(1)).join(c.withColumn("k", F.lit(1)), "k").drop("k")


def ocr_decision(text: Column, mime: Column, pages: Column, failed: Column, asked: Column, enabled: bool = True, per_page: int = 90, least_ratio: float = 0.45) -> Column:
    """Why a document is or isn't read by OCR, the first reason that holds."""
    if not enabled:
        return F.lit("disabled")
    solid = F.length(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s", ""))
    return (
        F.when(~mime.isin(*RASTER_TYPES), F.when(failed | asked, "unsupported").otherwise("not_needed"))
        .when(failed, "extraction_failed")
        .when(F.startswith(mime, F.lit("image/")), "image")
        .when(solid == 0, "no_text")
        .when(solid / F.greatest(F.lit(1), F.coalesce(pages, F.lit(1))) < per_page, "too_few_characters")
        .when(is_garbage(text, least_ratio), "garbled")
        .when(asked, "parser_asked")
        .otherwise("not_needed")
    )


def pages_for_ocr(sections: DataFrame, totals: DataFrame, per_page: int = 90) -> DataFrame:
    """(doc_id, page) of pages with too little text, all pages of documents without page numbers; totals: (doc_id, total_pages)."""
    size = F.sum(F.length(F.regexp_replace("text", r"(?U)\s", "")))
    have = sections.where("page IS NOT NULL").groupBy("doc_id", "page").agg(size.alias("n"))
    pages = totals.where("total_pages > 0").select("doc_id", F.explode(F.sequence(F.lit(1), F.col("total_pages"))).alias("page"))
    return pages.join(have, ["doc_id", "page"], "left").where(F.coalesce("n", F.lit(0)) < per_page).select("doc_id", "page")


def merged_sections(native: DataFrame, ocr: DataFrame) -> DataFrame:
    """Native sections but those of pages read by OCR, and OCR's, in page order, numbered anew."""
    from pyspark.sql import Window

    kept = native.join(ocr.select("doc_id", "page").distinct(), ["doc_id", "page"], "left_anti").withColumn("tier", F.lit(0))
    both = kept.unionByName(ocr.withColumn("tier", F.lit(1)))
    order = Window.partitionBy("doc_id").orderBy(F.coalesce("page", F.lit(0)), "ord", "tier")
    return both.withColumn("ord", F.row_number().over(order) - 1).drop("tier")


