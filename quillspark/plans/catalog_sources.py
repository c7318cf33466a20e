"""Queries of sources, types, encodings and readers, with oracle SQL.

The tables hold no office files: files of every format are made of the rows of
customers, and what is read from them must be what was put in.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions.storage import dealt
from quillspark.functions.tables import table
from quillspark.operators import incremental
from quillspark.sources import detect, extract, images, samples
from quillspark.sources.connectors import Choice, Item
from quillspark.sources.files import Crawl, etag, kept, skip_reason

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def _customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers for work in Python, on all cores."""
    return dealt(table(spark, sf_dir, "customer"), "c_custkey")


# --- listings: paths that follow from page ids

_PATHS = ("docs/{}.txt", ".hidden/{}.txt", "node_modules/{}.js", "docs/~tmp{}.txt", "a/b/{}.PDF", "{}.docx", "a/.git/{}.txt", "a/secret/{}.csv", "{}.exe")
_PATH_SQL = "CASE page_id % 9 " + " ".join(f"WHEN {i} THEN replace('{p}', '{{}}', page_id::VARCHAR)" for i, p in enumerate(_PATHS)) + " END"
_FILES_SQL = f"""f AS (SELECT page_id, {_PATH_SQL} AS path, octet_length(encode(coalesce(html, '')))::BIGINT AS size, make_timestamp(1700000000000000 + page_id * 1000000) AS modified, html FROM pages)"""


def _listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.coalesce(*(F.when(F.col("page_id") % 9 == i, F.replace(F.lit(p), F.lit("{}"), F.col("page_id").cast("string"))) for i, p in enumerate(_PATHS)))
    rows = table(spark, sf_dir, "pages").select("page_id", path.alias("relative"), F.coalesce("html", F.lit("")).alias("html"))
    name = F.element_at(F.split("relative", "/"), -1)
    return rows.select(
        "page_id", "relative", name.alias("name"), F.lower(F.regexp_extract(name, r"(\.[^.]+)$", 1)).alias("extension"),
        F.octet_length("html").cast("long").alias("size"), F.timestamp_seconds(F.lit(1_700_000_000) + F.col("page_id")).alias("modified_at"), "html",
    )


@query(f"""WITH {_FILES_SQL} SELECT page_id, path FROM f WHERE NOT regexp_matches(path, '(^|/)\\.') AND NOT contains(path, 'node_modules/') AND NOT contains(path, '~') AND NOT starts_with(path, 'a/secret/')
AND lower(path) NOT LIKE '%.exe'""")
def crawl_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hidden and system folders, patterns on paths and names, extensions that are excluded."""
    crawl = Crawl("/", excluded_globs=["*~*", "a/secret/*"], excluded_extensions=["exe"])
    return _listing(spark, sf_dir).where(kept(crawl)).select("page_id", F.col("relative").alias("path"))


@query(f"WITH {_FILES_SQL} SELECT page_id, path FROM f WHERE lower(path) LIKE '%.txt' OR lower(path) LIKE '%.pdf'")
def crawl_extensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only some extensions, hidden files too; system folders never."""
    return _listing(spark, sf_dir).where(kept(Crawl("/", extensions=["txt", ".PDF"], hidden=True)) | F.contains("relative", F.lit(".git"))).select("page_id", F.col("relative").alias("path"))


@query(f"""WITH {_FILES_SQL} SELECT page_id, size || '-' || epoch(modified)::BIGINT AS etag, 'etag:' || size || '-' || epoch(modified)::BIGINT AS change_key, size > 4000 AS too_large,
CASE WHEN size > 4000 THEN 'too_large' WHEN size = 0 THEN 'empty' END AS skip FROM f""")
def item_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _listing(spark, sf_dir).withColumn("etag", etag(F.col("size"), F.col("modified_at"))).withColumn("too_large", F.col("size") > 4000).withColumn("content_hash", F.lit(None).cast("string"))
    return rows.select("page_id", "etag", incremental.change_key().alias("change_key"), "too_large", skip_reason().alias("skip"))


@query(f"""WITH {_FILES_SQL} SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'etag:e' || page_id WHEN 1 THEN 'hash:' || sha256(coalesce(html, '')) ELSE 'mtime:' || strftime(modified, '%Y-%m-%d %H:%M:%S') || ':' || size END AS change_key FROM f""")
def change_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By etag, else by hash, else by time and size."""
    kind = F.col("page_id") % 3
    rows = _listing(spark, sf_dir).withColumn("etag", F.when(kind == 0, F.concat(F.lit("e"), "page_id")).otherwise("")).withColumn("content_hash", F.when(kind == 1, F.sha2("html", 256)))
    return rows.select("page_id", incremental.change_key().alias("change_key"))


@query("SELECT page_id, sha256(coalesce(html, '')) AS content_hash FROM pages")
def content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _listing(spark, sf_dir).select("page_id", F.sha2(F.col("html").cast("binary"), 256).alias("content_hash"))


@query(f"""WITH {_FILES_SQL} SELECT page_id, CASE WHEN lower(path) LIKE '%.exe' THEN 'excluded extension' WHEN lower(path) NOT LIKE '%.txt' AND lower(path) NOT LIKE '%.pdf' THEN 'extension not included'
WHEN contains(path, 'tmp') THEN 'excluded by pattern' WHEN size > 3000 THEN 'too large' END AS reason FROM f""")
def skip_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why a remote drive's items are left out."""
    choice = Choice(extensions=("txt", ".pdf"), excluded=("exe",), patterns=("*tmp*",), most_bytes=3000)

    @F.pandas_udf("string")
    def reason(name: pd.Series, path: pd.Series, size: pd.Series) -> pd.Series:
        return pd.Series([choice.reason(Item(p, n, p, int(s)), lower=True) for n, p, s in zip(name, path, size, strict=True)])

    return _listing(spark, sf_dir).select("page_id", reason("name", "relative", "size").alias("reason"))


# --- types and encodings

_HEADS = [
    (b"%PDF-1.4", "x", "application/pdf"), (b"\x89PNG\r\n\x1a\n", "a.pdf", "image/png"), (b"\xff\xd8\xff\xe0", "x.bin", "image/jpeg"), (b"GIF89a", "x", "image/gif"),
    (b"{\\rtf1", "a.txt", "application/rtf"), (b"\x1f\x8b\x08", "a", "application/gzip"), (b"7z\xbc\xaf\x27\x1c", "a", "application/x-7z-compressed"), (b"II*\x00", "a", "image/tiff"),
    (b"plain", "a.CSV", "text/csv"), (b"plain", "noext", "text/plain"), (b"a\x00b", "noext", "application/octet-stream"), (b"", "a.msg", "application/vnd.ms-outlook"),
    (samples.docx("x"), "a.zip", "application/vnd.openxmlformats-officedocument.wordprocessingml.document"), (samples.zipped({"a": "b"}), "a.docx", "application/zip"),
    (samples.compound({"Workbook": b"x"}), "a.doc", "application/vnd.ms-excel"), (samples.compound({"x": b"x"}), "a.ppt", "application/vnd.ms-powerpoint"),
]


@query("SELECT c_custkey, CASE c_custkey % 16 " + " ".join(f"WHEN {i} THEN '{t}'" for i, (_, _, t) in enumerate(_HEADS)) + " END AS mime_type, false AS encrypted FROM customer")
def detect_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By signature, then by what a container holds, extension, and how the bytes look."""
    heads = spark.createDataFrame([(i, h, n) for i, (h, n, _) in enumerate(_HEADS)], "i long, content binary, name string")
    rows = _customers(spark, sf_dir).select("c_custkey", (F.col("c_custkey") % len(_HEADS)).alias("i")).join(F.broadcast(heads), "i")
    return rows.select("c_custkey", detect.file_type_udf()(F.col("content"), F.col("name")).alias("t")).select("c_custkey", "t.mime_type", "t.encrypted")


_ENCODINGS = ("utf-8", "utf-8-sig", "utf-16-le", "utf-16-be", "utf-32-le", "cp1250", "iso-8859-2")
_MARKED = {"utf-16-le": b"\xff\xfe", "utf-16-be": b"\xfe\xff", "utf-32-le": b"\xff\xfe\x00\x00"}


@query("SELECT c_custkey, 'Zażółć gęślą jaźń: ' || c_name || ' ŁÓDŹ' AS text, ['" + "', '".join(_ENCODINGS) + "'][(c_custkey % 7)::INT + 1] AS encoding FROM customer")
def decode_encodings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes with and without marks, in code pages that are told from each other by how their text reads."""

    def run(batches):
        for b in batches:
            rows = []
            for key, text in zip(b["c_custkey"], b["text"], strict=True):
                name = _ENCODINGS[key % len(_ENCODINGS)]
                rows.append((key, *detect.decode(_MARKED.get(name, b"") + text.encode(name))))
            yield pd.DataFrame(rows, columns=["c_custkey", "text", "encoding"])

    rows = _customers(spark, sf_dir).select("c_custkey", F.concat(F.lit("Zażółć gęślą jaźń: "), "c_name", F.lit(" ŁÓDŹ")).alias("text"))
    return rows.mapInPandas(run, "c_custkey long, text string, encoding string")


_COUNT = "len(regexp_extract_all(t, '[{}]'))"
_SCORE_SQL = " + ".join([
    f"3.0 * {_COUNT.format(detect.POLISH)}", f"0.2 * {_COUNT.format(' \\t\\n\\r\\f\\v')}", f"-3.0 * {_COUNT.format(detect.CHARACTERS['odd'])}",
    f"1.0 * len(regexp_extract_all(regexp_replace(t, '[{detect.POLISH}{detect.CHARACTERS['odd']}]', '', 'g'), '[\\p{{L}}\\p{{N}}]'))",
    f"-0.2 * len(regexp_extract_all(regexp_replace(t, '[{detect.CHARACTERS['odd']}\\s]', '', 'g'), '[^\\p{{L}}\\p{{N}}]'))",
])


@query(f"SELECT doc_id, round(CASE WHEN t = '' THEN 0.0 ELSE ({_SCORE_SQL}) / length(t) END, 6) AS score FROM (SELECT doc_id, left(coalesce(text, ''), 20000) AS t FROM documents)")
def text_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well each text reads as an office text."""

    @F.pandas_udf("double")
    def score(text: pd.Series) -> pd.Series:
        return text.fillna("").map(detect.text_score)

    return table(spark, sf_dir, "documents").select("doc_id", F.round(score("text"), 6).alias("score"))


# --- readers: a file of each format from a customer's name, segment and balance


def _files(spark: SparkSession, sf_dir: str, name: str, build: Callable[[str, str, float], bytes]) -> DataFrame:
    """Rows of files as a crawl gives them."""

    @F.pandas_udf("binary")
    def make(who: pd.Series, segment: pd.Series, balance: pd.Series) -> pd.Series:
        return pd.Series([build(w, s, float(b)) for w, s, b in zip(who, segment, balance, strict=True)])

    rows = _customers(spark, sf_dir)
    return rows.select(F.lit("made").alias("source_id"), F.col("c_custkey").cast("string").alias("external_id"), F.lit(name).alias("name"), make("c_name", "c_mktsegment", "c_acctbal").alias("content"))


def _texts(files: DataFrame) -> DataFrame:
    """What the readers find in each file, attachments as files of their own."""
    rows = extract.sections(files)
    own = F.array_sort(F.collect_list(F.struct("ord", "text")))
    texts = F.array_join(F.transform(own, lambda s: F.coalesce(s["text"], F.lit(""))), "|")
    return rows.groupBy("external_id").agg(F.max("parser").alias("parser"), F.max("error").alias("error"), texts.alias("texts"))


def _reads(key: str, name: str, build: Callable[[str, str, float], bytes], sql: str, parser: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _texts(_files(spark, sf_dir, name, build))

    run.__name__ = key
    run.__doc__ = f"Files {name} written and read."
    query(f"SELECT c_custkey::VARCHAR AS external_id, '{parser}' AS parser, NULL::VARCHAR AS error, {sql} AS texts FROM customer")(run)


_BALANCE = "printf('%.2f', c_acctbal)"
_NUMBER = "CASE WHEN c_acctbal = round(c_acctbal) THEN c_acctbal::BIGINT::VARCHAR ELSE c_acctbal::VARCHAR END"
_MAIL = "'Od: biuro@firma.example' || chr(10) || 'Do: klient@firma.example' || chr(10) || 'Temat: ' || c_name"

_reads("read_text", "a.txt", lambda w, s, b: f"{w}\r\n \r\n  {s}  \n\n\n".encode(), "c_name || '|' || c_mktsegment", "text")
_reads("read_csv", "a.csv", lambda w, s, b: f"nazwa;segment;saldo;uwagi\n{w};{s};{b:.2f};\n;;;\n{w};;1;x\n".encode("cp1250"),
       f"'nazwa | segment | saldo | uwagi|nazwa: ' || c_name || ' | segment: ' || c_mktsegment || ' | saldo: ' || {_BALANCE} || '|nazwa: ' || c_name || ' | saldo: 1 | uwagi: x'", "csv")
_reads("read_tsv_without_header", "a.tsv", lambda w, s, b: f"1\t{b:.2f}\n2\t3\n".encode(), f"'1 | ' || {_BALANCE} || '|2 | 3'", "csv")
_reads("read_html", "a.html", lambda w, s, b: f"<html><head><title>t</title><style>x</style></head><body><h1>{w}</h1><p>{s} &amp; co<script>y</script></p><table><tr><td>a<td>b</table></body></html>".encode(),
       "c_name || '|' || c_mktsegment || ' & co|a b'", "html")
_reads("read_rtf", "a.rtf", lambda w, s, b: rb"{\rtf1\ansi\ansicpg1250{\fonttbl{\f0 Arial;}}" + w.encode() + rb"\par \b Za\'bf\'f3\'b3\u263? " + s.encode() + rb"\b0}", "c_name || '|Zażółć ' || c_mktsegment", "rtf")
_reads("read_mail", "a.eml", lambda w, s, b: samples.eml(w, f"{s}\n\nkoniec\n"), f"{_MAIL} || '|' || c_mktsegment || '|koniec'", "eml")
_reads("read_docx", "a.docx", lambda w, s, b: samples.docx(w, "", s), "c_name || '|' || c_mktsegment", "docx")
_reads("read_xlsx", "a.xlsx", lambda w, s, b: samples.xlsx("Dane", [["nazwa", "saldo"], [w, b], [s, 2.0]]), f"'Arkusz: Dane|nazwa | saldo|nazwa: ' || c_name || ' | saldo: ' || {_NUMBER} || '|nazwa: ' || c_mktsegment || ' | saldo: 2'", "xlsx")
_reads("read_pptx", "a.pptx", lambda w, s, b: samples.pptx([w], [s, "x"]), "c_name || '|' || c_mktsegment || '|x'", "pptx")
_reads("read_pdf", "a.pdf", lambda w, s, b: samples.pdf_file([f"BT /F1 12 Tf 72 700 Td ({w}) Tj 0 -14 Td [({s[:3]}) -20 ({s[3:]})] TJ ET".encode(), b"", b"BT /F1 9 Tf (end) Tj ET"], objstm=True),
       "c_name || chr(10) || c_mktsegment || '|end'", "pdf")
_reads("read_doc", "a.doc", lambda w, s, b: samples.word(f"{w}\rx\x13 FIELD \x14{s}\x15\r", "ŁÓDŹ\r"), "c_name || '|x' || c_mktsegment || '|ŁÓDŹ'", "doc")
_reads("read_xls", "a.xls", lambda w, s, b: samples.sheet("Dane", [["nazwa", "saldo"], [w, b], [s, 2.0]]), f"'Arkusz: Dane|nazwa | saldo|nazwa: ' || c_name || ' | saldo: ' || {_NUMBER} || '|nazwa: ' || c_mktsegment || ' | saldo: 2'", "xls")
_reads("read_ppt", "a.ppt", lambda w, s, b: samples.slides([w, s]), "c_name || '|' || c_mktsegment", "ppt")
_reads("read_msg", "a.msg", lambda w, s, b: samples.compound(samples.mail(body=f"{w}\r\n\r\n{s}")),
       "'Od: Ala <ala@example.org>' || chr(10) || 'Do: Ola' || chr(10) || 'Data: 2015-07-24T10:00:00+00:00' || chr(10) || 'Temat: Temat listu|' || c_name || '|' || c_mktsegment", "msg")


@query(f"""WITH c AS (SELECT c_custkey::VARCHAR AS k, c_name, c_mktsegment FROM customer)
SELECT k AS external_id, 'zip' AS parser, NULL::VARCHAR AS error, 'list.eml' || chr(10) || 'x/' || c_mktsegment || '.txt' AS texts FROM c UNION ALL
SELECT k || '#att:list.eml', 'eml', NULL, {_MAIL} || '|tekst|Załącznik: in.txt' FROM c UNION ALL
SELECT k || '#att:list.eml#att:in.txt', 'text', NULL, c_mktsegment FROM c UNION ALL SELECT k || '#att:x/' || c_mktsegment || '.txt', 'text', NULL, c_name FROM c""")
def read_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives with mail with attachments: members and what is attached are documents of their own; hidden files are left out."""
    build = lambda w, s, b: samples.zipped({"list.eml": samples.eml(w, "tekst\n", ("in.txt", s.encode())), f"x/{s}.txt": w, ".hidden": "no", "__MACOSX/x": "no"})
    rows = _texts(_files(spark, sf_dir, "a.zip", build))
    hidden = F.replace(F.col("texts"), F.lit("\n.hidden\n__MACOSX/x"), F.lit(""))
    return rows.select("external_id", "parser", "error", hidden.alias("texts"))


@query("SELECT c_custkey::VARCHAR AS external_id, '' AS parser, CASE c_custkey % 4 WHEN 0 THEN 'password_protected' WHEN 1 THEN 'corrupted: BadZipFile' WHEN 2 THEN 'unsupported' ELSE 'password_protected' END AS error, '' AS texts FROM customer")
def read_defects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that can't be read are rows with a reason, never a failure of the task."""
    bad = [(samples.workbook(protect=True), "a.xls"), (b"PK\x03\x04junk", "a.docx"), (b"\x00\x01\x02", "a.bin"), (samples.pdf_file([b""], trailer=b"/Encrypt 9 0 R "), "a.pdf")]
    rows = spark.createDataFrame([(i, d, n) for i, (d, n) in enumerate(bad)], "i long, content binary, name string")
    files = _customers(spark, sf_dir).select(F.lit("made").alias("source_id"), F.col("c_custkey").cast("string").alias("external_id"), (F.col("c_custkey") % 4).alias("i"))
    return _texts(files.join(F.broadcast(rows), "i").select("source_id", "external_id", "name", "content"))


@query("SELECT c_custkey, 1 + c_custkey % 40 AS width, 1 + c_custkey % 7 AS height FROM customer")
def image_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    def run(batches):
        for b in batches:
            found = [images.facts(samples.png(int(1 + k % 40), int(1 + k % 7))) for k in b["c_custkey"]]
            yield pd.DataFrame({"c_custkey": b["c_custkey"], "width": [int(f["width"]) for f in found], "height": [int(f["height"]) for f in found]})

    return _customers(spark, sf_dir).select("c_custkey").mapInPandas(run, "c_custkey long, width long, height long")
