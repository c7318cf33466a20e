"""An index in a folder: crawls with change detection, searches, reports, maintenance.

A crawl lists its source without contents, decides what is new or changed, and
reads only that. Contents become sections once, sections chunks once; both are
written before anything is made from them. Chunks, postings and vectors are
tables of changes, so that a crawl writes what changed; a manifest publishes
the versions of all tables at once, after all are written.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import text as tx
from quillspark.functions.storage import Files, once
from quillspark.operators import chunking, embedding, incremental, ocr, reports, vectors
from quillspark.operators.embedding import context_header, with_context
from quillspark.operators.filters import SEARCHABLE
from quillspark.operators.postings import PostingIndex
from quillspark.operators.vector_store import VectorStore
from quillspark.operators.versions import ChangeTable, Manifest, VersionedTable
from quillspark.plans.search import Response, Searcher
from quillspark.sources import extract
from quillspark.sources.connectors import Connector, listed
from quillspark.sources.files import Crawl, contents_of, scan

__all__ = ["Recognition", "Workspace", "context_header", "document_id"]

DOCUMENTS = """doc_id long, source_id string, external_id string, name string, extension string, mime_type string, path_folded string, library string, author string, size long,
modified_at timestamp, change_key string, status string, error_code string, parser string, chunk_count long, page_count int, used_ocr boolean, ocr_pages int, ocr_confidence double,
fts_indexed boolean, vector_indexed boolean, model_key string, normalization_version int, chunking_version int, seen_scan_id int, attachment_of long, attempts int"""
CHUNKS = chunking.CHUNK + ", chunk_id long"
ERRORS = "id string, created_at timestamp, stage string, code string, source_id string, doc_id long, file_name string, message string, retryable boolean"
SCHEMA = 2


def document_id(source: Column, external: Column, salt: int = 0) -> Column:
    return F.xxhash64(source, external, F.lit(salt)) if salt else F.xxhash64(source, external)


def identified(files: DataFrame, known: DataFrame) -> DataFrame:
    """``files`` with doc_id: the one that is known, else a hash; of files whose hashes meet each other's or a known one, all but the first take another hash."""
    key = ["source_id", "external_id"]
    old = known.where("attachment_of IS NULL").select(*key, F.col("doc_id").alias("known_id"))
    rows = files.join(old, key, "left").withColumn("doc_id", F.coalesce("known_id", document_id(F.col("source_id"), F.col("external_id"))))
    owner = F.struct(F.col("known_id").isNull(), "source_id", "external_id")
    taken = rows.select("doc_id", owner.alias("owner")).unionByName(known.select("doc_id", F.struct(F.lit(False), "source_id", "external_id").alias("owner")))
    met = taken.groupBy("doc_id").agg(F.min("owner").alias("first"), F.count_distinct("owner").alias("owners")).where("owners > 1").select("doc_id", "first")
    again = rows.join(F.broadcast(met), "doc_id", "left")  # hashes of 64 bits that meet are rare
    own = F.col("first").isNull() | (F.col("first") == owner) | F.col("known_id").isNotNull()
    return again.withColumn("doc_id", F.when(own, F.col("doc_id")).otherwise(document_id(F.col("source_id"), F.col("external_id"), 1))).drop("known_id", "first")


@dataclass
class Recognition:
    """How text is recognised: the engine's factory and name, and what renders pages."""

    engine: Callable[[], ocr.Engine]
    name: str
    version: str = "1"
    dpi: int = 220
    render: Callable = ocr.image_pages
    per_page: int = 90
    most_pages: int = 200


class Workspace:
    def __init__(
        self,
        spark: SparkSession,
        path: str,
        limits: chunking.Limits | None = None,
        provider: Callable[[], embedding.Provider] | None = None,
        recognition: Recognition | None = None,
    ):
        self.spark, self.path, self.limits, self.provider, self.recognition = spark, path.rstrip("/"), limits, provider, recognition
        self.files, self.manifest = Files(spark, self.path), Manifest(spark, self.path)
        self._documents = VersionedTable(spark, f"{self.path}/documents")
        self._chunks = ChangeTable(spark, f"{self.path}/chunks")
        self._errors = ChangeTable(spark, f"{self.path}/errors", key="doc_id")
        self._cache = ChangeTable(spark, f"{self.path}/ocr-cache", key="content_hash")
        self._vectors: VectorStore | None = None
        self.migrate()

    # --- tables

    def migrate(self) -> int:
        """Brings a workspace of an earlier schema to this one; one of a later schema is refused."""
        have = self.manifest.current().get("schema")
        if have is not None and have > SCHEMA:
            raise RuntimeError(f"the workspace has schema {have}, this program knows {SCHEMA}")
        if have is not None and have < SCHEMA:
            version = self._version() + 1
            self._documents.write(self._shaped(self.documents()), version)
            self.manifest.publish(schema=SCHEMA, documents=version)
        return SCHEMA

    def _version(self) -> int:
        now = self.manifest.current()
        return max([int(now.get(k, 0)) for k in ("documents", "chunks", "errors")], default=0)

    def _shaped(self, rows: DataFrame) -> DataFrame:
        """``rows`` with the columns of DOCUMENTS; those that they lack are null."""
        target = self.spark.createDataFrame([], DOCUMENTS).schema
        return rows.select([(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in target])

    def documents(self) -> DataFrame:
        at = self.manifest.current().get("documents")
        found = self._documents.read(at) if at else None
        return found if found is not None else self.spark.createDataFrame([], DOCUMENTS)

    def chunks(self) -> DataFrame:
        at = self.manifest.current().get("chunks")
        found = self._chunks.read(at) if at else None
        return found if found is not None else self.spark.createDataFrame([], CHUNKS)

    def errors(self) -> DataFrame:
        at = self.manifest.current().get("errors")
        found = self._errors.read(at) if at else None
        return found if found is not None else self.spark.createDataFrame([], ERRORS)

    def postings(self) -> PostingIndex:
        return PostingIndex(self.spark, f"{self.path}/postings", self.manifest.current().get("chunks", 0))

    def vectors(self) -> VectorStore | None:
        """The vectors of the provider's model; vectors of another model are refused."""
        if self.provider is None:
            return None
        if self._vectors is None:
            model = self.provider()
            digest = vectors.compat_hash({"model": model.model_key, "dimension": model.dimension, "context": True})
            self._vectors = VectorStore(self.spark, f"{self.path}/vectors").open(model.dimension, model.model_key, digest)
        return self._vectors

    # --- crawls

    def index(self, source: Crawl | Connector, full: bool = False) -> dict[str, int]:
        """Crawls one source; returns documents by status."""
        work = f"{self.path}/work/{uuid.uuid4().hex[:12]}"
        try:
            return self._index(source, full, work)
        finally:
            self.files.delete(work.removeprefix(self.path + "/"))

    def _index(self, source: Crawl | Connector, full: bool, work: str) -> dict[str, int]:
        known = self.documents()
        folder = isinstance(source, Crawl)
        found = scan(self.spark, source, content=False) if folder else _as_scan(listed(self.spark, source, contents=False))
        found = once(identified(found, known).withColumn("new_key", incremental.change_key()), f"{work}/listing")
        scan_id = (known.agg(F.max("seen_scan_id")).first()[0] or 0) + 1
        state = known.select("doc_id", "status", "change_key", "normalization_version", "chunking_version", "fts_indexed", "vector_indexed", "model_key")
        model = self.provider().model_key if self.provider else None
        again = F.lit(True) if full else F.col("status").isNull() | incremental.needs_processing(F.col("new_key"), model, vectors=self.provider is not None)
        todo = found.join(state, "doc_id", "left").where(again).select(*found.columns)
        todo = once(todo, f"{work}/todo")
        read = contents_of(self.spark, source, todo) if folder else _fetched(self.spark, source, todo)
        parts = once(self._sections(read), f"{work}/sections")
        parts, recognised = self._recognised(read, parts, work)
        fresh = chunking.chunked(parts.where("text IS NOT NULL"), self.limits, "extension").withColumn("chunk_id", F.xxhash64("doc_id", "ordinal"))
        fresh = once(fresh.select([f.split()[0] for f in CHUNKS.split(", ")]), f"{work}/chunks")
        docs = once(self._fresh(todo, read, parts, fresh, recognised, scan_id), f"{work}/documents")

        mine = known.where(F.col("source_id") == source.source_id)
        gone = incremental.with_descendants(known, mine.where("attachment_of IS NULL").join(found.select("doc_id").distinct(), "doc_id", "left_anti"))
        redone = incremental.with_descendants(known, todo.select("doc_id").distinct())
        ended = once(gone.unionByName(redone).unionByName(docs.select("doc_id")).distinct(), f"{work}/ended")
        still = F.when(F.col("source_id") == source.source_id, F.lit(scan_id)).otherwise(F.col("seen_scan_id"))
        kept = incremental.without(known, ended).withColumn("seen_scan_id", still)

        version = self._version() + 1
        published = {"schema": SCHEMA, "documents": version, "chunks": version, "errors": version}
        old_chunks = self.chunks().join(ended, "doc_id", "left_semi").select("chunk_id")
        self.postings().write(fresh, ended, version, heading="heading")
        docs = self._with_vectors(fresh, docs, old_chunks, version, published)
        self._chunks.write(fresh, ended, version)
        self._errors.write(self._failures(docs), ended, version)
        self._documents.write(kept.unionByName(docs), version)
        self.manifest.publish(**published)
        return {r.status: r.n for r in reports.counts(self.documents(), "status").collect()}

    def _sections(self, read: DataFrame) -> DataFrame:
        """Sections of files and their attachments with ids, extension and parent."""
        found = extract.sections(read.where("content IS NOT NULL"))
        ids = read.select("source_id", F.col("external_id").alias("top"), F.col("doc_id").alias("top_id"))
        key = F.col("external_id")
        name = F.element_at(F.split(F.element_at(F.split(key, "#att:"), -1), "/"), -1)
        above = F.regexp_replace(key, r"(?s)#att:(?!.*#att:).*$", "")
        rows = found.withColumn("top", F.split_part(key, F.lit("#att:"), F.lit(1))).join(ids, ["source_id", "top"])
        attached = F.contains(key, F.lit("#att:"))
        parent = F.when(attached, F.when(above == F.col("top"), F.col("top_id")).otherwise(document_id(F.col("source_id"), above)))
        own = F.when(attached, document_id(F.col("source_id"), key)).otherwise(F.col("top_id"))
        return rows.select(
            own.alias("doc_id"), *found.columns, name.alias("name"), F.lower(F.regexp_extract(name, r"(\.[^.]+)$", 1)).alias("extension"), parent.alias("attachment_of")
        )

    def _recognised(self, read: DataFrame, parts: DataFrame, work: str) -> tuple[DataFrame, DataFrame]:
        """Sections with those of recognised pages in place, and (doc_id, ocr_pages, ocr_confidence, warning) of the documents that were recognised."""
        none = self.spark.createDataFrame([], "doc_id long, ocr_pages int, ocr_confidence double, warning string")
        r = self.recognition
        if r is None:
            return parts, none
        scanned = parts.where(F.col("extension").isin(*reports.RASTER_EXTENSIONS) & F.col("attachment_of").isNull())
        facts = scanned.groupBy("doc_id", "extension").agg(
            F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda s: F.coalesce(s["text"], F.lit(""))), "\n").alias("all"),
            F.max("pages").alias("pages"), F.max("error").alias("error"),
        )
        mime = F.when(F.col("extension") == ".pdf", "application/pdf").otherwise("image/png")
        why = reports.ocr_decision(F.col("all"), mime, F.col("pages"), F.coalesce(F.startswith("error", F.lit("corrupted")), F.lit(False)), F.lit(False), per_page=r.per_page)
        wanted = facts.withColumn("why", why).where(~F.col("why").isin("not_needed", "unsupported", "disabled", "extraction_failed"))
        some = reports.pages_for_ocr(scanned.where("text IS NOT NULL"), wanted.select("doc_id", F.coalesce("pages", F.lit(0)).alias("total_pages")), r.per_page)
        some = some.groupBy("doc_id").agg(F.array_sort(F.collect_list("page")).alias("wanted"))
        key = {"engine": r.name, "engine_version": r.version}
        files = read.join(wanted.select("doc_id", "pages"), "doc_id").join(some, "doc_id", "left")
        files = files.select(
            "doc_id", F.sha2("content", 256).alias("content_hash"), *(F.lit(v).alias(k) for k, v in key.items()), F.lit(r.dpi).alias("dpi"), "content",
            F.when(F.size("wanted") < F.col("pages"), F.col("wanted")).alias("wanted"),
        )
        files = once(files, f"{work}/to-recognise")
        cache = self._cache.read()
        cache = cache if cache is not None else self.spark.createDataFrame([], "content_hash string, engine string, engine_version string, dpi int, pages long, confidence double, text string")
        pages, fresh = ocr.with_cache(files, cache, r.engine, r.render, r.most_pages)
        pages = once(pages, f"{work}/recognised")
        self._cache.write(fresh, fresh.select("content_hash"), max(self._cache.versions(), default=0) + 1)
        by_doc = files.select("doc_id", "content_hash").join(pages, "content_hash")
        facts = by_doc.groupBy("doc_id").agg(
            F.count_if(F.col("text").isNotNull()).cast("int").alias("ocr_pages"), F.avg("confidence").alias("ocr_confidence"),
            F.array_join(F.array_sort(F.collect_set("warning")), "; ").alias("warning"),
        )
        new = ocr.sections_of(by_doc.where("text IS NOT NULL").select("doc_id", "page", "text"))
        base = parts.where("attachment_of IS NULL").select("doc_id", "source_id", "external_id", "name", "extension", "attachment_of", "parser").dropDuplicates(["doc_id"])
        done = new.select("doc_id").distinct()
        touched = parts.join(done, "doc_id", "left_semi")
        merged = reports.merged_sections(touched.where("text IS NOT NULL").select("doc_id", "page", "ord", "text", "kind", "origin", "heading"), new.withColumn("heading", F.lit(None).cast("string")))
        merged = merged.join(base, "doc_id").withColumns({c: F.lit(None).cast(t) for c, t in (("sheet", "string"), ("row", "int"), ("error", "string"), ("warnings", "string"), ("pages", "int"))})
        both = parts.join(done, "doc_id", "left_anti").unionByName(merged.select(parts.columns))
        return once(both, f"{work}/all-sections"), facts

    def _fresh(self, todo: DataFrame, read: DataFrame, parts: DataFrame, chunks: DataFrame, recognised: DataFrame, scan_id: int) -> DataFrame:
        """Rows of documents for what was read."""
        counts = chunks.groupBy("doc_id").agg(F.count(F.lit(1)).alias("chunk_count"))
        about = parts.groupBy("doc_id", "source_id", "external_id", "name", "extension", "attachment_of").agg(
            F.max("parser").alias("parser"), F.max("error").alias("error"), F.max("pages").alias("page_count")
        )
        unread = read.where("content IS NULL").select(
            "doc_id", "source_id", "external_id", "name", "extension", F.lit(None).cast("long").alias("attachment_of"), F.lit("").alias("parser"),
            F.when(F.col("too_large"), "skipped: too_large").otherwise(F.coalesce("note", F.lit("download_failed"))).alias("error"), F.lit(None).cast("int").alias("page_count"),
        )
        meta = todo.select("doc_id", "size", "modified_at", F.col("new_key").alias("change_key"), *([c for c in ("author", "library") if c in todo.columns]))
        old = self.documents().select("doc_id", F.col("attempts").alias("before"))
        docs = about.unionByName(unread).join(counts, "doc_id", "left").join(meta, "doc_id", "left").join(recognised, "doc_id", "left").join(old, "doc_id", "left")
        kind = F.trim(F.split_part(F.col("error"), F.lit(":"), F.lit(1)))
        n = F.coalesce("chunk_count", F.lit(0))
        failed = F.col("error").isNotNull() & F.col("ocr_pages").isNull()
        status = F.when(failed, kind).otherwise(incremental.finished_status(n, False, F.lit(True)))
        top = F.when(F.contains("external_id", F.lit("/")), F.split_part("external_id", F.lit("/"), F.lit(1)))
        made = {
            "status": status,
            "error_code": F.when(failed, F.col("error")),
            "chunk_count": n.cast("long"),
            "library": F.coalesce("library", top) if "library" in docs.columns else top,
            "path_folded": tx.fold(F.col("external_id")),
            "fts_indexed": n > 0,
            "vector_indexed": F.lit(False),
            "used_ocr": F.coalesce("ocr_pages", F.lit(0)) > 0,
            "normalization_version": F.lit(incremental.NORMALIZATION_VERSION),
            "chunking_version": F.lit(incremental.CHUNKING_VERSION),
            "seen_scan_id": F.lit(scan_id),
            # a failure that may pass leaves no key, so that the next crawl tries again
            "change_key": F.when(~kind.isin(*incremental.RETRYABLE) | F.col("error").isNull(), F.col("change_key")),
            "attempts": F.coalesce("before", F.lit(0)) + failed.cast("int"),
        }
        return self._shaped(docs.withColumns(made))

    def _failures(self, docs: DataFrame) -> DataFrame:
        """What enters the log of errors, messages without secrets."""
        kind = F.trim(F.split_part(F.col("error_code"), F.lit(":"), F.lit(1)))
        stage = F.when(kind == "download_failed", "fetch").otherwise("parse")
        return docs.where("error_code IS NOT NULL").select(
            F.expr("uuid()").alias("id"), F.current_timestamp().alias("created_at"), stage.alias("stage"), kind.alias("code"), "source_id", "doc_id",
            F.col("name").alias("file_name"), tx.redact(F.col("error_code")).alias("message"), kind.isin(*incremental.RETRYABLE).alias("retryable"),
        )

    def _with_vectors(self, fresh: DataFrame, docs: DataFrame, old_chunks: DataFrame, version: int, published: dict) -> DataFrame:
        """Embeds new chunks under their documents' headers; documents that lack a vector are partial."""
        store = self.vectors()
        if store is None:
            return docs
        header = context_header(F.col("name"), F.col("external_id"), F.lit(None).cast("string"))
        named = fresh.join(docs.select("doc_id", header.alias("header")), "doc_id").withColumn("text", with_context(F.col("text"), F.col("header")))
        rows = once(embedding.embedded(named, self.provider), f"{self.path}/work/vectors-{uuid.uuid4().hex[:8]}")
        store.replace(rows, old_chunks, version)
        published["vectors"] = version
        lacking = rows.groupBy("doc_id").agg(F.bool_and(F.col("embedding").isNotNull()).alias("whole"))
        out = docs.join(lacking, "doc_id", "left")
        done = F.coalesce("whole", F.lit(False))
        changes = {
            "vector_indexed": done,
            "model_key": F.when(done, F.lit(store.meta.model_key)),
            "status": F.when((F.col("status") == "indexed") & ~done, "partial").otherwise(F.col("status")),
        }
        return self._shaped(out.withColumns(changes))

    # --- searches and reports

    def searcher(self) -> Searcher:
        store = self.vectors()
        found = store.read(self.manifest.current().get("vectors", 0)).select("chunk_id", "embedding") if store else None
        embed = (lambda text: self.provider().query(text).tolist()) if self.provider else None
        return Searcher(self.chunks(), self.documents(), found, embed, postings=self.postings())

    def search(self, text: str, mode: str = "exact", **options) -> Response:
        return self.searcher().search(text, mode, **options)

    def hits(self, response: Response) -> DataFrame:
        """Hits with names, in order."""
        names = self.documents().select("doc_id", "name", "external_id", "modified_at")
        return response.hits.join(names, "doc_id").orderBy("place")

    def report(self) -> DataFrame:
        return reports.coverage(self.documents(), self.errors())

    def statistics(self) -> dict[str, object]:
        """What the index holds, in numbers."""
        docs, chunks, store = self.documents(), self.chunks(), self.vectors()
        row = reports.index_statistics(docs, chunks).first().asDict()
        count = lambda column, none=None: {r[0]: r.n for r in reports.counts(docs, column, none).collect()}
        now = self.manifest.current()
        scan_ids = docs.agg(F.max("seen_scan_id"), F.max("modified_at")).first()
        return row | {
            "by_status": count("status"), "by_extension": count("extension", reports.NO_EXTENSION), "errors": self.errors().count(),
            "vectors": store.count() if store else 0, "model": store.meta.model_key if store else None, "dimension": store.meta.dimension if store else None,
            "bytes": self.files.bytes_in(), "bytes_of_postings": self.files.bytes_in("postings"), "bytes_of_vectors": self.files.bytes_in("vectors"),
            "schema": now.get("schema"), "normalization_version": incremental.NORMALIZATION_VERSION, "chunking_version": incremental.CHUNKING_VERSION,
            "semantic": store is not None, "last_scan": scan_ids[0], "newest_document": scan_ids[1],
        }

    def check(self) -> DataFrame:
        """Findings and how many there are: tables that disagree, ids that meet, postings that are wrong."""
        store = self.vectors()
        vectors_ = store.read(self.manifest.current().get("vectors", 0)).select("chunk_id") if store else self.chunks().select("chunk_id")
        found = reports.consistency(self.documents(), self.chunks(), vectors_)
        twice = self.chunks().groupBy("chunk_id").count().where("count > 1")
        wrong = self.postings().check(self.chunks(), heading="heading")
        one = lambda df, name: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("finding"), "n")
        return found.unionByName(one(twice, "chunk_ids_used_twice")).unionByName(one(wrong, "postings_that_differ"))

    # --- maintenance

    def _replace_documents(self, rows: DataFrame) -> int:
        version = self._version() + 1
        self._documents.write(self._shaped(rows), version)
        return self.manifest.publish(schema=SCHEMA, documents=version)

    def reindex_all(self, only_vectors: bool = False) -> int:
        """All documents pending, or only without vectors; the next crawl reads them again."""
        searchable = F.col("status").isin(*SEARCHABLE)
        if only_vectors:
            changed = self.documents().withColumn("vector_indexed", F.when(searchable, False).otherwise(F.col("vector_indexed")))
            return self._replace_documents(changed.withColumn("model_key", F.when(searchable, None).otherwise(F.col("model_key"))))
        return self._replace_documents(self.documents().withColumn("status", F.when(searchable, "pending").otherwise(F.col("status"))))

    def requeue(self, ids: DataFrame) -> int:
        """Documents named, to be read again whatever happened to them."""
        return self._replace_documents(incremental.requeued(self.documents(), ids))

    def remove(self, ids: DataFrame) -> None:
        """Documents and what is attached to them."""
        gone = incremental.with_descendants(self.documents(), ids)
        version = self._version() + 1
        old = self.chunks().join(gone, "doc_id", "left_semi").select("chunk_id")
        none = self.spark.createDataFrame([], CHUNKS)
        published = {"schema": SCHEMA, "documents": version, "chunks": version, "errors": version}
        if store := self.vectors():
            store.remove(old, version)
            published["vectors"] = version
        self.postings().write(none, gone, version, heading="heading")
        self._chunks.write(none, gone, version)
        self._errors.write(self.spark.createDataFrame([], ERRORS), gone, version)
        self._documents.write(incremental.without(self.documents(), gone), version)
        self.manifest.publish(**published)

    def compact(self) -> None:
        """Every table as one version of what is live; earlier ones are deleted once the new ones are published."""
        tables = {"chunks": self._chunks, "errors": self._errors, "postings": self.postings().table}
        if store := self.vectors():
            tables["vectors"] = store.table
        made = {name: t.compact(keep=True) for name, t in tables.items()}
        if made["chunks"] != made.pop("postings"):
            raise RuntimeError("postings and chunks have other versions")
        self.manifest.publish(**{k: v for k, v in made.items() if v})
        for name, t in tables.items():
            if version := made.get("chunks" if name == "postings" else name):
                t.drop_before(version)
        self._documents.drop_before(1)
        self.manifest.drop_before(1)

    def rebuild_space(self) -> int:
        """Bytes that writing everything anew may take."""
        return int(1.3 * self.files.bytes_in())

    def ensure_space(self, needed: int | None = None) -> None:
        free = self.files.free_bytes()
        if free < (needed if needed is not None else self.rebuild_space()):
            raise OSError(f"{free} bytes are free, {needed if needed is not None else self.rebuild_space()} are needed")

    def context(self, doc_id: int, ordinal: int, radius: int = 1) -> DataFrame:
        """A chunk and its neighbours."""
        near = F.col("ordinal").between(ordinal - radius, ordinal + radius)
        return self.chunks().where((F.col("doc_id") == doc_id) & near).orderBy("ordinal")

    def pending(self, source_id: str | None = None, limit: int | None = None) -> DataFrame:
        """Documents that wait, in order."""
        rows = self.documents().where("status = 'pending'")
        rows = rows if source_id is None else rows.where(F.col("source_id") == source_id)
        rows = rows.orderBy("doc_id")
        return rows if limit is None else rows.limit(limit)

    def without_vectors(self, after: int | None = None, batch: int = 1000) -> DataFrame:
        """A page of chunks that lack a vector, by id, after the last of the page before."""
        store = self.vectors()
        have = store.read().select("chunk_id") if store else self.spark.createDataFrame([], "chunk_id long")
        rows = self.chunks().join(have, "chunk_id", "left_anti")
        rows = rows if after is None else rows.where(F.col("chunk_id") > after)
        return rows.orderBy("chunk_id").limit(batch)


def _as_scan(items: DataFrame) -> DataFrame:
    """Items of a connector with the columns of scan()."""
    rows = items.where(F.col("skip").isNull() | (F.col("skip") == "too large"))
    return rows.select(
        "source_id", "external_id", "name", "extension", "size", "modified_at", "etag", F.coalesce(F.col("skip") == "too large", F.lit(False)).alias("too_large"), "content_hash", "author", "library"
    )


def _fetched(spark: SparkSession, connector: Connector, todo: DataFrame) -> DataFrame:
    """``todo`` with contents, fetched by the tasks that hold the rows; a failure is a note."""
    from quillspark.sources.connectors import Item

    def run(batches):
        import pandas as pd

        for b in batches:
            rows = []
            for external, name, size, large in zip(b["external_id"], b["name"], b["size"], b["too_large"], strict=True):
                content = note = None
                if not large:
                    try:
                        content = connector.fetch(Item(external, name, external, None if pd.isna(size) else int(size)))
                    except OSError as e:
                        note = f"download_failed: {type(e).__name__}"
                rows.append((content, note))
            yield b.assign(content=[r[0] for r in rows], note=[r[1] for r in rows])

    from pyspark.sql import types as T

    schema = T.StructType([*todo.schema, T.StructField("content", T.BinaryType()), T.StructField("note", T.StringType())])
    return todo.mapInPandas(run, schema)
