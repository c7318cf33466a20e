"""Directory trees as a table of files, with the filters of a crawl."""

from __future__ import annotations

import fnmatch
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Folders that are never entered.
SYSTEM_FOLDERS = ("$recycle.bin", "system volume information", ".git", "__pycache__", "node_modules")


@dataclass
class Crawl:
    root: str
    source_id: str = "local"
    extensions: list[str] = field(default_factory=list)  # empty: all
    excluded_extensions: list[str] = field(default_factory=list)
    excluded_globs: list[str] = field(default_factory=list)
    hidden: bool = False
    most_bytes: int = 200 * 1024 * 1024


def _excluded(relative: Column, name: Column, globs: list[str]) -> Column:
    out = F.lit(False)
    for g in globs:
        pattern = fnmatch.translate(g).replace(r"\Z", "$").replace(r"\z", "$").replace("(?>", "(?:")
        out = out | relative.rlike(pattern) | name.rlike(pattern)
    return out


def kept(crawl: Crawl) -> Column:
    """Whether a crawl reads a file, by its columns relative, name and extension."""
    folders = F.split(F.lower("relative"), "/")
    keep = ~F.arrays_overlap(folders, F.array(*map(F.lit, SYSTEM_FOLDERS))) & ~_excluded(F.col("relative"), F.col("name"), crawl.excluded_globs)
    if not crawl.hidden:
        keep = keep & ~F.exists(F.split("relative", "/"), lambda p: F.startswith(p, F.lit(".")))
    if crawl.excluded_extensions:
        keep = keep & ~F.col("extension").isin(*("." + e.lower().lstrip(".") for e in crawl.excluded_extensions))
    if crawl.extensions:
        keep = keep & F.col("extension").isin(*("." + e.lower().lstrip(".") for e in crawl.extensions))
    return keep


def etag(size: Column, modified: Column) -> Column:
    """What changes with a file: its size and the second of its last change."""
    return F.concat_ws("-", size, F.unix_timestamp(modified.cast("timestamp")))


def scan(spark: SparkSession, crawl: Crawl, content: bool = True) -> DataFrame:
    """Files below the root: identity, metadata, change key parts and content (null beyond ``most_bytes``).

    Unreadable files are skipped, and files of no bytes, which the reader leaves
    out. Without ``content`` only metadata is read.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("ignoreCorruptFiles", "true").option("ignoreMissingFiles", "true")
    files = raw.load(crawl.root)
    bare = F.regexp_replace("path", "^[a-z]+:/*", "/")
    root = "/" + crawl.root.split(":", 1)[-1].strip("/") + "/" if crawl.root.strip("/") else "/"
    relative = F.substring(bare, len(root) + 1, 1_000_000)
    name = F.element_at(F.split("relative", "/"), -1)
    extension = F.lower(F.regexp_extract("name", r"(\.[^.]+)$", 1))
    out = files.withColumn("relative", relative).withColumn("name", name).withColumn("extension", extension)
    keep = kept(crawl)
    large = F.col("length") > crawl.most_bytes
    body = F.when(~large, F.col("content")) if content else F.lit(None).cast("binary")
    return out.where(keep).select(
        F.lit(crawl.source_id).alias("source_id"),
        F.col("relative").alias("external_id"),
        "name",
        "extension",
        F.col("length").alias("size"),
        F.col("modificationTime").alias("modified_at"),
        etag(F.col("length"), F.col("modificationTime")).alias("etag"),
        large.alias("too_large"),
        *([F.sha2(body, 256).alias("content_hash")] if content else []),
        *([body.alias("content")] if content else [F.lit(None).cast("string").alias("content_hash")]),
        F.col("path").alias("location"),
    )


MOST_PATHS = 20_000


def contents_of(spark: SparkSession, crawl: Crawl, todo: DataFrame) -> DataFrame:
    """scan() rows that were chosen, with ``content`` (null if too large) and ``note`` (why else it is missing).

    Up to MOST_PATHS files are opened by name; for more the folder is read as a
    whole and joined, as after a first crawl nearly all are wanted.
    """
    raw = spark.read.format("binaryFile").option("ignoreMissingFiles", "true")
    wanted = todo.where("NOT too_large")
    paths = [r.location for r in wanted.select("location").limit(MOST_PATHS + 1).collect()]
    if not paths:
        bodies = spark.createDataFrame([], "location string, content binary")
    elif len(paths) <= MOST_PATHS:
        bodies = raw.load(paths).select(F.col("path").alias("location"), "content")
    else:
        bodies = raw.option("recursiveFileLookup", "true").load(crawl.root).select(F.col("path").alias("location"), "content")
        bodies = bodies.join(wanted.select("location"), "location", "left_semi")
    out = todo.join(bodies, "location", "left")
    return out.withColumn("note", F.when(~F.col("too_large") & F.col("content").isNull(), "download_failed: gone"))


def skip_reason() -> Column:
    """Why a listed file isn't read."""
    return F.when(F.col("too_large"), "too_large").when(F.col("size") == 0, "empty")
