"""Recognition of text in images: engines, the cache of what they found, pages to sections.

An engine is a program, a library or a service; it is made on each executor by
a factory. A renderer turns a file into the images of its pages.
"""

from __future__ import annotations

import base64
import csv
import io
import subprocess
import tempfile
from abc import ABC, abstractmethod
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.sources.http import Client, Failed

# Fixed value: the order in which engines are tried.
ENGINES = ("tesseract", "easyocr", "rapidocr")
KEY = ["content_hash", "engine", "engine_version", "dpi"]


def pick_engine(available: set[str], wanted: str = "auto") -> str | None:
    """The engine asked for, or the first that is there."""
    if wanted == "none":
        return None
    order = ENGINES if wanted == "auto" else (wanted,)
    return next((e for e in order if e in available), None)


class Engine(ABC):
    """Recognises the text of one image."""

    name: str
    version = "1"

    @abstractmethod
    def available(self) -> bool: ...

    @abstractmethod
    def read(self, image: bytes) -> tuple[str, float | None]:
        """Text and mean confidence in [0, 1]."""


def text_of_words(table: str) -> tuple[str, float | None]:
    """A program's table of words (tab-separated, a header) to lines and the mean confidence of its words."""
    lines: dict[tuple[str, ...], list[str]] = {}
    scores = []
    for row in csv.DictReader(io.StringIO(table), delimiter="\t", quoting=csv.QUOTE_NONE):
        word, score = (row.get("text") or "").strip(), float(row.get("conf") or -1)
        if word and score >= 0:
            lines.setdefault(tuple(row.get(k) or "" for k in ("block_num", "par_num", "line_num")), []).append(word)
            scores.append(score)
    return "\n".join(" ".join(w) for w in lines.values()), sum(scores) / len(scores) / 100 if scores else None


@dataclass
class Program(Engine):
    """A command that reads an image file and writes a table of words to its output."""

    command: tuple[str, ...] = ("tesseract", "{image}", "stdout", "-l", "pol+eng", "tsv")
    name: str = "tesseract"
    timeout: float = 120.0

    def available(self) -> bool:
        import shutil

        return shutil.which(self.command[0]) is not None

    def read(self, image: bytes) -> tuple[str, float | None]:
        with tempfile.TemporaryDirectory() as folder:  # one image, gone after the call
            path = Path(folder, "page")
            path.write_bytes(image)
            done = subprocess.run([c.replace("{image}", str(path)) for c in self.command], capture_output=True, timeout=self.timeout, check=False)
        if done.returncode:
            raise OSError(f"{self.name} ended with {done.returncode}")
        return text_of_words(done.stdout.decode("utf-8", "replace"))


@dataclass
class Library(Engine):
    """A function of an installed package: image bytes to [(text, confidence)] in reading order."""

    name: str
    module: str
    call: Callable[[bytes], list[tuple[str, float]]]

    def available(self) -> bool:
        import importlib.util

        return importlib.util.find_spec(self.module) is not None

    def read(self, image: bytes) -> tuple[str, float | None]:
        found = [(t.strip(), c) for t, c in self.call(image) if t.strip()]
        return "\n".join(t for t, _ in found), sum(c for _, c in found) / len(found) if found else None


@dataclass
class Service(Engine):
    """A recognition service: {"image": base64, "lang"} to {"text" or "lines": [{"text", "confidence"}], "confidence"}."""

    client: Client
    name: str = "remote"
    language: str = "pol"
    path: str = "ocr"

    def available(self) -> bool:
        try:
            self.client.policy.check(self.client.base, self.client.category)
        except PermissionError:
            return False
        return True

    def read(self, image: bytes) -> tuple[str, float | None]:
        answer = self.client.request("POST", self.path, {"image": base64.b64encode(image).decode(), "lang": self.language}).json()
        if isinstance(lines := answer.get("lines"), list):
            found = [(str(x.get("text", "")).strip(), x.get("confidence")) for x in lines if str(x.get("text", "")).strip()]
            scores = [float(c) for _, c in found if c is not None]
            return "\n".join(t for t, _ in found), sum(scores) / len(scores) if scores else None
        if not isinstance(answer.get("text"), str):
            raise Failed("an answer without text")
        return answer["text"], answer.get("confidence")


PAGES = "page int, text string, confidence double, warning string, truncated boolean"


def run(files: DataFrame, engine: Callable[[], Engine], render: Callable[[bytes, list[int] | None], Iterator[tuple[int, bytes]]], most_pages: int = 200) -> DataFrame:
    """KEY, content and wanted (page numbers, null: all) to KEY and PAGES.

    A page that fails is a row with a warning and no text; pages beyond
    ``most_pages`` of a file are left out, and its rows say so.
    """
    keys = files.select(*KEY).schema

    def each(batches):
        reader = engine()
        for b in batches:
            rows = []
            for *key, data, wanted in b[[*KEY, "content", "wanted"]].itertuples(index=False):
                pages, n, cut = [], 0, False
                try:
                    for number, image in render(data, None if wanted is None else [int(p) for p in wanted]):
                        if n >= most_pages:
                            cut = True
                            break
                        n += 1
                        try:
                            pages.append((number, *reader.read(image), None))
                        except (OSError, ValueError, subprocess.SubprocessError) as e:
                            pages.append((number, None, None, f"page {number}: {type(e).__name__}"))
                except (OSError, ValueError) as e:
                    pages.append((0, None, None, f"not rendered: {type(e).__name__}"))
                rows += [(*key, *p, cut) for p in pages]
            yield pd.DataFrame(rows, columns=[*KEY, *(f.split()[0] for f in PAGES.split(", "))], dtype=object)

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in keys) + ", " + PAGES
    return files.select(*KEY, "content", "wanted").mapInPandas(each, schema)


def image_pages(data: bytes, wanted: list[int] | None) -> Iterator[tuple[int, bytes]]:
    """The renderer of image files: one page, the file itself."""
    if wanted is None or 1 in wanted:
        yield 1, data


def with_cache(files: DataFrame, cache: DataFrame, engine: Callable[[], Engine], render, most_pages: int = 200) -> tuple[DataFrame, DataFrame]:
    """Pages (content_hash, page, text, confidence, warning) of all files, and rows to add to the cache.

    Files of the cache are not recognised again; results that are cut short or
    have failed pages, or are of some pages only, don't enter it.
    """
    known, rest = cached(files, cache)
    found = run(rest, engine, render, most_pages)
    known = known.select("content_hash", "page", "text", F.lit(None).cast("double").alias("confidence"), F.lit(None).cast("string").alias("warning"))
    pages = known.unionByName(found.select("content_hash", "page", "text", "confidence", "warning"))
    whole = rest.where("wanted IS NULL").select(*KEY)
    sound = found.join(found.where("truncated OR warning IS NOT NULL").select(*KEY).distinct(), KEY, "left_anti").join(whole.distinct(), KEY, "left_semi")
    return pages, for_cache(sound)


def cached(files: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Files (with KEY) to pages (content_hash, page, text) that the cache has, and the files it lacks."""
    hits = files.select(*KEY).distinct().join(cache.select(*KEY, "text"), KEY)
    pages = hits.select("content_hash", F.posexplode(F.split("text", "\f")).alias("at", "text")).select("content_hash", (F.col("at") + 1).alias("page"), "text")
    return pages, files.join(cache, KEY, "left_anti")


def recognised(files: DataFrame, engine: Callable[[bytes], list[tuple[str, float | None]]]) -> DataFrame:
    """KEY and content to KEY, page, text, confidence, by a function from bytes to the pages' texts and confidences."""
    keys = files.select(*KEY).schema

    def run(batches):
        for b in batches:
            rows = [(*k, i, t, c) for *k, data in b[[*KEY, "content"]].itertuples(index=False) for i, (t, c) in enumerate(engine(data), 1)]
            yield pd.DataFrame(rows, columns=[*KEY, "page", "text", "confidence"], dtype=object)

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in keys) + ", page int, text string, confidence double"
    return files.select(*KEY, "content").mapInPandas(run, schema)


def for_cache(pages: DataFrame) -> DataFrame:
    """Recognised pages to cache rows: texts joined by form feeds, mean confidence of pages that have one."""
    texts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "text"))), lambda p: F.coalesce(p.text, F.lit(""))), "\f")
    return pages.groupBy(*KEY).agg(F.count(F.lit(1)).alias("pages"), F.avg("confidence").alias("confidence"), texts.alias("text"))


def sections_of(pages: DataFrame, start: int = 0) -> DataFrame:
    """Pages (doc_id, page, text) to page sections, blank ones left out, numbered from ``start``."""
    order = F.row_number().over(Window.partitionBy("doc_id").orderBy("page"))
    full = pages.where(F.trim("text") != "")
    return full.select("doc_id", (order - 1 + start).alias("ord"), "text", F.lit("page").alias("kind"), "page", F.lit("ocr").alias("origin"))


def lines_of(words: DataFrame) -> DataFrame:
    """Recognised words (doc_id, block, par, line, word, text, conf, left, top, width, height) to lines with bounds and confidence in [0, 1]."""
    good = words.where((F.trim("text") != "") & (F.col("conf") >= 0))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("word", "text"))), lambda w: w.text), " ")
    return good.groupBy("doc_id", "block", "par", "line").agg(
        text.alias("text"),
        F.min("left").alias("left"),
        F.min("top").alias("top"),
        F.max(F.col("left") + F.col("width")).alias("right"),
        F.max(F.col("top") + F.col("height")).alias("bottom"),
        (F.avg("conf") / 100).alias("confidence"),
    )
