"""Metadata filters as one predicate, and facets."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions.text import fold_text

# Statuses of documents that searches may return.
SEARCHABLE = ("indexed", "partial")


@dataclass
class Filters:
    sources: list[str] = field(default_factory=list)
    libraries: list[str] = field(default_factory=list)
    extensions: list[str] = field(default_factory=list)
    authors: list[str] = field(default_factory=list)
    path_prefix: str | None = None
    modified_from: date | None = None
    modified_to: date | None = None
    used_ocr: bool | None = None

    def is_empty(self) -> bool:
        return self == Filters()

    def with_dates(self, ranges: list[tuple[date, date]]) -> Filters:
        """The first range of a query as bounds of modification, unless there are bounds already."""
        if not ranges or self.modified_from or self.modified_to:
            return self
        return Filters(**{**self.__dict__, "modified_from": ranges[0][0], "modified_to": ranges[0][1]})


def predicate(f: Filters, status: str | None = "status") -> Column:
    """All conditions; days are whole, both ends included. A path prefix is literal."""
    out = F.col(status).isin(*SEARCHABLE) if status else F.lit(True)
    for column, values in (("source_id", f.sources), ("library", f.libraries), ("author", f.authors)):
        if values:
            out = out & F.col(column).isin(*values)
    if f.extensions:
        out = out & F.col("extension").isin(*("." + e.lower().lstrip(".") for e in f.extensions))
    if f.path_prefix:
        out = out & F.startswith("path_folded", F.lit(fold_text(f.path_prefix)))
    if f.modified_from:
        out = out & (F.col("modified_at") >= F.lit(f.modified_from).cast("timestamp"))
    if f.modified_to:
        out = out & (F.col("modified_at") < F.date_add(F.lit(f.modified_to), 1).cast("timestamp"))
    if f.used_ocr is not None:
        out = out & (F.col("used_ocr") == f.used_ocr)
    return out


FACETS = ("library", "extension", "author", "source_id")


def facet(docs: DataFrame, column: str, limit: int = 500) -> DataFrame:
    """Distinct values of a column that are not empty, in order."""
    return docs.select(column).where(F.col(column).isNotNull() & (F.col(column) != "")).distinct().orderBy(column).limit(limit)
