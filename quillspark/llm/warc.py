"""WARC archives: writing with deduplication, reading by boundary-chain verification.

Writing makes one record of each page: a response, or a revisit where a page
with the same payload is kept elsewhere. Files are plain WARC/1.1, written by
Spark's text writer, so that any file system that Spark reaches will do.

Reading cuts the files at each occurrence of the version line, in splits of
any size. A task takes every cut for a candidate record and emits its place
and, from its header, its successor's. Candidates of a file meet without
payloads; pointer jumping from the file's start marks those that the chain of
successors reaches in logarithmically many rounds. All others are payload that
happens to hold the version line. Records that were cut by such a line are
put together from their pieces in a second pass over the files, which runs
only where there are any.

Memory: a task holds a batch of records; a file's candidates, some hundred
bytes each, meet in one task, so archives are to be bounded in size as is
usual (the writer starts a new file after ``per_file`` records).

Defined cases: null html is an empty payload; a null url is about:blank;
repeated page ids give a record each; a file that doesn't start with a record
gives none, and a chain that breaks ends there; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions.tables import table
from quillspark.llm.common import joined, scratch, stored

MAGIC = "WARC/1.1\r\n"
END = "\r\n\r\n"
URN = "urn:quillspark:page:"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
LEAST_BYTES = 1000


def records(pages: DataFrame, least: int = LEAST_BYTES) -> DataFrame:
    """(page_id, url, html) pages to ``record``, the text of each WARC record without its end."""
    base = pages.select("page_id", F.coalesce("url", F.lit("about:blank")).alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    base = base.withColumn("digest", F.sha1("html")).withColumn("n", F.octet_length("html"))
    copies = (
        base.where(F.col("n") >= least)
        .groupBy("digest", "n")
        .agg(F.max("page_id").alias("keeper"), F.count(F.lit(1)).alias("copies"))
        .where("copies > 1")
        .select(F.concat_ws(":", "digest", "n").alias("copy"), "keeper", "copies")
    )
    # smaller pages have keys of their own, so that where the pages must be shuffled, those with few contents don't meet in a task
    key = F.when(F.col("n") >= least, F.concat_ws(":", "digest", "n")).otherwise(F.concat_ws("|", F.coalesce(F.col("page_id").cast("string"), F.lit("")), "digest"))
    rows = joined(base.withColumn("copy", key), stored(copies, "warc-copies"), ["copy"], most=200_000, size="copies")
    revisit = F.col("keeper").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("keeper"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), "n", F.lit(END))
    page = F.coalesce(F.col("page_id").cast("string"), F.lit("null"))
    head = F.concat(
        F.lit(MAGIC + "WARC-Type: "),
        F.when(revisit, "revisit").otherwise("response"),
        F.lit(f"\r\nWARC-Record-ID: <{URN}"),
        page,
        F.lit(">\r\nWARC-Target-URI: "),
        F.regexp_replace("url", r"[\x00-\x20\x7F]", "%20"),
        F.lit("\r\nWARC-Date: 2026-01-01T00:00:00Z\r\nWARC-Payload-Digest: sha1:"),
        "digest",
        F.when(revisit, F.concat(F.lit(f"\r\nWARC-Refers-To: <{URN}"), "keeper", F.lit(f">\r\nWARC-Profile: {PROFILE}"))).otherwise(""),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "),
        F.octet_length(http) + F.when(revisit, 0).otherwise(F.col("n")),
        F.lit(END),
    )
    return rows.select(F.concat(head, http, F.when(revisit, "").otherwise(F.col("html"))).alias("record"))


def write(pages: DataFrame, path: str, per_file: int = 100_000) -> None:
    """Archives of ``pages`` in the new folder ``path``."""
    records(pages).write.option("lineSep", END).option("maxRecordsPerFile", per_file).text(path)


FIELDS = "page_id long, record_type string, refers_to long, payload_bytes long, payload_digest string, digest_ok boolean"
PLACE = "file string, split long, nth long"
CANDIDATE = f"{PLACE}, size long, span long, complete boolean, {FIELDS}"


def _page(value: bytes | None) -> int | None:
    text = (value or b"").strip(b"<>").decode("ascii", "replace").removeprefix(URN)
    return int(text) if text.removeprefix("-").isdigit() else None


def parse(piece: bytes) -> tuple[int, bool, tuple]:
    """What follows a version line: bytes from that line to the next record (-1: not a record), whether all are here, FIELDS."""
    none = (None,) * 6
    head, found, block = piece.partition(b"\r\n\r\n")
    if not found:
        return -1, False, none
    fields = {}
    for line in head.split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if not colon:
            return -1, False, none
        fields[name.strip().lower()] = value.strip()
    length = fields.get(b"content-length", b"")
    if not length.isdigit():
        return -1, False, none
    size = int(length)
    span = len(MAGIC) + len(head) + 4 + size + 4
    if len(block) < size:
        return span, False, none
    http, _, payload = block[:size].partition(b"\r\n\r\n")
    kind = fields.get(b"warc-type", b"").decode("ascii", "replace")
    stated = fields.get(b"warc-payload-digest", b"").removeprefix(b"sha1:").decode("ascii", "replace")
    if kind == "revisit":
        sizes = [x.partition(b":")[2].strip() for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")]
        n, digest = int(sizes[0]) if sizes and sizes[0].isdigit() else None, stated
    else:
        n, digest = len(payload), hashlib.sha1(payload).hexdigest()
    return span, True, (_page(fields.get(b"warc-record-id")), kind, _page(fields.get(b"warc-refers-to")), n, digest, digest == stated)


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """(file, split, piece): what lies between version lines, in order within each split."""
    text = spark.read.option("lineSep", MAGIC).text(path)
    return text.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.col("value").cast("binary").alias("piece")
    )


def _numbered(batches):
    """(batch, nth of each row in its split)."""
    at, n = None, 0
    for b in batches:
        nth = []
        for key in zip(b.column("file").to_pylist(), b.column("split").to_pylist(), strict=True):
            n = n + 1 if key == at else 0
            at = key
            nth.append(n)
        yield b, nth


def candidates(spark: SparkSession, path: str) -> DataFrame:
    """CANDIDATE rows: every piece as if it were a record."""

    def run(batches):
        for b, nth in _numbered(batches):
            pieces = b.column("piece").to_pylist()
            rows = [(len(p), *parse(p)) for p in pieces]
            columns = [[r[0] for r in rows], [r[1] for r in rows], [r[2] for r in rows], *(list(c) for c in zip(*(r[3] for r in rows), strict=True))]
            types = [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.bool_()]
            names = [f.split()[0] for f in CANDIDATE.split(", ")]
            arrays = [b.column("file"), b.column("split"), pa.array(nth, pa.int64()), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))]
            if pieces:
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    return _pieces(spark, path).mapInArrow(run, CANDIDATE)


def reached(places: np.ndarray, successors: np.ndarray) -> np.ndarray:
    """Which of the sorted places the chain of successors reaches from place 0, by pointer jumping."""
    n = len(places)
    at = np.searchsorted(places, successors)
    jump = np.where((at < n) & (places[np.minimum(at, n - 1)] == successors), at, n)
    jump = np.append(jump, n)
    mark = np.zeros(n + 1, bool)
    mark[:n] = places == 0
    for _ in range(max(1, n).bit_length()):
        mark[jump[mark]] = True
        jump = jump[jump]
    return mark[:n]


def _chain(rows: pa.Table) -> pa.Table:
    """The candidates of a file that are records, and the pieces of those that were cut; ``owner`` is the record's place."""
    rows = rows.sort_by([("split", "ascending"), ("nth", "ascending")])
    size, span = rows["size"].to_numpy(), rows["span"].to_numpy()
    place = np.cumsum(size + len(MAGIC)) - size - 2 * len(MAGIC)  # of the version line before each piece; the file's first piece has none
    mark = reached(place, np.where(span > 0, place + span, -1))
    last = np.maximum.accumulate(np.where(mark, np.arange(len(mark)), -1))
    inside = (last >= 0) & (place < (place + span)[last])
    cut = inside & ~rows["complete"].to_numpy()[last]
    rows = rows.drop_columns(["size", "span", "complete"])
    for name, column in (("owner", np.where(last >= 0, place[last], -1)), ("record", mark), ("cut", cut)):
        rows = rows.append_column(name, pa.array(column))
    return rows.filter(pa.array(mark | cut))


def _assembled(spark: SparkSession, path: str, cut: DataFrame) -> DataFrame:
    """FIELDS of the records whose pieces ``cut`` (PLACE, owner) names."""

    def number(batches):
        for b, nth in _numbered(batches):
            yield pa.RecordBatch.from_arrays([b.column("file"), b.column("split"), pa.array(nth, pa.int64()), b.column("piece")], names=["file", "split", "nth", "piece"])

    def join(batches):
        for b in batches:
            rows = [parse(MAGIC.encode().join(p))[2] for p in b.column("pieces").to_pylist()]
            names = [f.split()[0] for f in FIELDS.split(", ")]
            types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.bool_()]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    pieces = _pieces(spark, path).mapInArrow(number, f"{PLACE}, piece binary").join(cut, ["file", "split", "nth"])
    whole = pieces.groupBy("file", "owner").agg(F.array_sort(F.collect_list(F.struct("split", "nth", "piece"))).alias("p"))
    return whole.select(F.col("p.piece").alias("pieces")).mapInArrow(join, FIELDS)


def read(spark: SparkSession, path: str) -> DataFrame:
    """FIELDS of every record of the archives in ``path``."""
    chain = candidates(spark, path).groupBy("file").applyInArrow(_chain, f"{PLACE}, {FIELDS}, owner long, record boolean, cut boolean")
    names = [f.split()[0] for f in FIELDS.split(", ")]
    kept = scratch(spark, "warc-chain")
    chain.write.parquet(kept)
    chain = spark.read.schema(chain.schema).parquet(kept)
    found = chain.where("record AND NOT cut").select(names)
    cut = chain.where("cut").select("file", "split", "nth", "owner")
    return found.unionByName(_assembled(spark, path, cut)) if cut.take(1) else found


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to archives, and read from them again."""
    path = scratch(spark, "warc")
    write(table(spark, sf_dir, "pages"), path)
    return read(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "digest_ok")


OP7_SQL = f"""
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
k AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS keeper FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= {LEAST_BYTES} AND keeper <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= {LEAST_BYTES} AND keeper <> page_id THEN keeper END AS refers_to,
       TRUE AS digest_ok
FROM k
"""
