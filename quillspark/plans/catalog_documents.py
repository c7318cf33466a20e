"""Queries of dates, numbers, chunking, extraction, reports and incremental maintenance over the driver's tables, with oracle SQL.

The tables hold no written dates or accounts, so that strings are derived from
the columns of orders, line items and customers, alike in both languages.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import spans
from quillspark.functions.storage import dealt
from quillspark.functions.tables import table
from quillspark.operators import chunking, incremental, reports
from quillspark.plans.query import analyze

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


# --- dates

_ORDERS = "orders"


def _orders(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    return dealt(table(spark, sf_dir, _ORDERS), "o_orderkey").select("o_orderkey", "o_orderdate", F.expr(text).alias("text"))


def _joined(found: Column) -> Column:
    return F.array_join(found, " ")


@query("""SELECT o_orderkey, strftime(o_orderdate, 'dat%Y%m%d mon%Y%m yea%Y') AS tokens FROM orders""")
def date_tokens_dmy(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _orders(spark, sf_dir, "concat('dnia ', date_format(o_orderdate, 'dd.MM.yyyy'), ' r.')")
    return rows.select("o_orderkey", _joined(spans.tokens_udf(spans.date_tokens)(F.col("text"))).alias("tokens"))


@query("""SELECT l_orderkey, l_linenumber, strftime(l_shipdate, 'dat%Y%m%d mon%Y%m yea%Y') AS tokens FROM lineitem""")
def date_tokens_iso(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = dealt(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber").select("l_orderkey", "l_linenumber", F.date_format("l_shipdate", "'wysyłka 'yyyy-MM-dd").alias("text"))
    return rows.select("l_orderkey", "l_linenumber", _joined(spans.tokens_udf(spans.date_tokens)(F.col("text"))).alias("tokens"))


@query("""SELECT o_orderkey, CASE WHEN y % 100 < 40 THEN 2000 + y % 100 ELSE 1900 + y % 100 END AS year, month(o_orderdate) AS month FROM (SELECT *, year(o_orderdate) - 40 + (o_orderkey % 60)::INT AS y FROM orders)""")
def two_digit_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    y = "(year(o_orderdate) - 40 + cast(o_orderkey % 60 as int)) % 100"
    rows = _orders(spark, sf_dir, f"concat(least(dayofmonth(o_orderdate), 28), date_format(o_orderdate, '/MM/'), lpad(cast({y} as string), 2, '0'))")
    when = F.to_date(F.get(spans.spans_udf(spans.dates)(F.col("text")), 0)["value"])
    return rows.select("o_orderkey", F.year(when).cast("long").alias("year"), F.month(when).cast("long").alias("month"))


@query("SELECT o_orderkey, (o_orderkey % 28 + 1 <= 28 AND o_orderkey % 20 BETWEEN 1 AND 12)::INT AS n FROM orders")
def invalid_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _orders(spark, sf_dir, "concat(lpad(cast(o_orderkey % 28 + 1 as string), 2, '0'), '.', lpad(cast(o_orderkey % 20 as string), 2, '0'), '.1995')")
    return rows.select("o_orderkey", F.size(spans.spans_udf(spans.dates)(F.col("text"))).alias("n"))


_GENITIVE_SQL = "[" + ", ".join(f"'{m}'" for m in spans.GENITIVES) + "]"


@query(f"""SELECT o_orderkey, strftime(o_orderdate, '%d.%m.%Y') || '|' || day(o_orderdate) || '.' || month(o_orderdate) || '.' || year(o_orderdate) || '|' || strftime(o_orderdate, '%Y-%m-%d') || '|' || strftime(o_orderdate, '%d-%m-%Y') || '|'
|| strftime(o_orderdate, '%d/%m/%Y') || '|' || day(o_orderdate) || ' ' || ({_GENITIVE_SQL})[month(o_orderdate)] || ' ' || year(o_orderdate) AS variants FROM orders""")
def date_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, _ORDERS).select("o_orderkey", F.array_join(spans.date_variants(F.col("o_orderdate")), "|").alias("variants"))


@query(f"SELECT o_orderkey, strftime(o_orderdate, 'dat%Y%m%d mon%Y%m yea%Y') || CASE WHEN month(o_orderdate) = 1 THEN '' ELSE strftime(o_orderdate, ' mon%Y01') END AS tokens FROM orders")
def date_tokens_textual(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = ", ".join(f"'{m}'" for m in spans.GENITIVES)
    rows = _orders(spark, sf_dir, f"concat(day(o_orderdate), ' ', element_at(array({words}), month(o_orderdate)), ' ', year(o_orderdate), ' r. oraz styczeń ', year(o_orderdate))")
    return rows.select("o_orderkey", _joined(spans.tokens_udf(spans.date_tokens)(F.col("text"))).alias("tokens"))


# --- numbers


@query("SELECT o_orderkey, 'kwo' || (round(o_totalprice * 100))::BIGINT AS token, (round(o_totalprice * 100))::BIGINT AS minor FROM orders")
def amount_minor_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _orders(spark, sf_dir, "concat('razem ', replace(format_number(o_totalprice, 2), ',', ' '), ' zł')").withColumn("text", F.regexp_replace("text", r"\.(\d\d) zł", ",$1 zł"))
    first = F.get(spans.spans_udf(spans.amounts)(F.col("text")), 0)
    return rows.select("o_orderkey", first["token"].alias("token"), F.substring(first["token"], 4, 30).cast("long").alias("minor"))


@query("SELECT o_orderkey, 'num' || (10000000 + o_orderkey) AS token, 'digits' AS kind, 2::INT AS start FROM orders")
def digit_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight digits in fours, joined by blanks or dashes or not at all."""
    n = "cast(10000000 + o_orderkey as string)"
    gap = "element_at(array(' ', '-', ''), cast(o_orderkey % 3 + 1 as int))"
    rows = _orders(spark, sf_dir, f"concat('# ', substr({n}, 1, 4), {gap}, substr({n}, 5, 4), ' ok')")
    s = F.get(spans.spans_udf(spans.digit_runs)(F.col("text")), 0)
    return rows.select("o_orderkey", s["token"].alias("token"), s["kind"].alias("kind"), s["start"].alias("start"))


@query("SELECT c_custkey, 'nip' || (1000000000 + c_custkey) AS token FROM customer")
def nip_like(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("Nip: "), F.regexp_replace((F.lit(1000000000) + F.col("c_custkey")).cast("string"), r"(\d{3})(\d{3})(\d{2})(\d{2})", "$1-$2-$3-$4"))
    return dealt(table(spark, sf_dir, "customer"), "c_custkey").select("c_custkey", F.get(spans.spans_udf(spans.official_numbers)(text), 0)["token"].alias("token"))


@query("SELECT c_custkey, 'accpl61' || lpad(c_custkey::VARCHAR, 24, '7') AS token FROM customer")
def iban_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("konto PL61 "), F.regexp_replace(F.lpad(F.col("c_custkey").cast("string"), 24, "7"), r"(\d{4})(?=\d)", "$1 "), F.lit("."))
    return dealt(table(spark, sf_dir, "customer"), "c_custkey").select("c_custkey", F.get(spans.spans_udf(spans.ibans)(text), 0)["token"].alias("token"))


@query("SELECT o_orderkey, 'idffv' || year(o_orderdate) || '07' || (100 + o_orderkey % 900) || ' kwo' || (o_orderkey % 5000 + 1) || '00' AS tokens FROM orders")
def number_token_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _orders(spark, sf_dir, "concat('FV/', year(o_orderdate), '/07/', 100 + o_orderkey % 900, ' na ', o_orderkey % 5000 + 1, ' PLN')")
    pick = F.filter(spans.spans_udf(spans.numbers)(F.col("text")), lambda s: s.kind.isin("identifier", "amount"))
    return rows.select("o_orderkey", F.array_join(F.transform(pick, lambda s: s.token), " ").alias("tokens"))


# --- chunking

_SQL_TRIM = "regexp_replace({}, '^\\s+|\\s+$', '', 'g')"


@query(f"""SELECT page_id, unnest(range(0, len(p)))::INT AS pos, unnest(p) AS par FROM (SELECT page_id, list_filter(list_transform(string_split_regex(replace(html, '><', '>' || chr(10) || chr(10) || '<'), '\\n\\s*\\n'), lambda x: {_SQL_TRIM.format("x")}), lambda x: x <> '') AS p FROM pages)""")
def split_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    html = F.replace(F.col("html"), F.lit("><"), F.lit(">\n\n<"))
    return table(spark, sf_dir, "pages").select("page_id", F.posexplode(chunking.paragraphs(html)).alias("pos", "par"))


_SQL_MARK = "regexp_replace(coalesce(text, ''), '([.!?;])\\s+([A-ZĄĆĘŁŃÓŚŹŻ0-9])', '\\1' || chr(1) || '\\2', 'g')"


@query(f"""SELECT doc_id, len(s)::BIGINT AS n, md5(array_to_string(s, '|')) AS sentences FROM (SELECT doc_id, list_filter(list_transform(string_split({_SQL_MARK}, chr(1)), lambda x: {_SQL_TRIM.format("x")}), lambda x: x <> '') AS s FROM documents)""")
def split_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = chunking.sentences(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(s).cast("long").alias("n"), F.md5(F.array_join(s, "|")).alias("sentences"))



# --- reports: documents with a status that follows from labels and ids

_STATUS = "CASE WHEN doc_id % 11 = 0 THEN 'error' WHEN doc_id % 7 = 0 THEN 'empty' WHEN quality = 0 THEN 'partial' WHEN quality = 1 THEN 'indexed' ELSE 'pending' END"
_STATUS_SQL = f"""s AS (SELECT doc_id, source AS source_id, {_STATUS} AS status, doc_id % 5 = 0 AS used_ocr, CASE WHEN doc_id % 3 = 0 THEN '.pdf' WHEN doc_id % 3 = 1 THEN '.txt' ELSE '' END AS extension,
CASE WHEN doc_id % 3 = 0 THEN 'application/pdf' ELSE 'text/plain' END AS mime_type, CASE WHEN doc_id % 11 = 0 THEN 'FD-' || doc_id % 4 END AS error_code, 'n' || doc_id AS name, text FROM documents LEFT JOIN labels USING (doc_id))"""


def _statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    docs = table(spark, sf_dir, "documents").join(labels, "doc_id", "left")
    return docs.select(
        "doc_id", F.col("source").alias("source_id"), F.expr(_STATUS).alias("status"), (F.col("doc_id") % 5 == 0).alias("used_ocr"),
        F.when(F.col("doc_id") % 3 == 0, ".pdf").when(F.col("doc_id") % 3 == 1, ".txt").otherwise("").alias("extension"),
        F.when(F.col("doc_id") % 3 == 0, "application/pdf").otherwise("text/plain").alias("mime_type"),
        F.when(F.col("doc_id") % 11 == 0, F.concat(F.lit("FD-"), F.col("doc_id") % 4)).alias("error_code"), F.concat(F.lit("n"), "doc_id").alias("name"), "text",
    )


def _errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log of errors: of labelled documents that are toxic, by the parity of their ids."""
    rows = table(spark, sf_dir, "labels").where("toxic = 1")
    return rows.select("doc_id", F.when(F.col("doc_id") % 2 == 0, "ocr").otherwise("parse").alias("stage"))


@query(f"WITH {_STATUS_SQL} SELECT status, count(*) AS n FROM s GROUP BY status")
def status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.counts(_statuses(spark, sf_dir), "status")


@query(f"WITH {_STATUS_SQL} SELECT CASE WHEN extension = '' THEN '(brak)' ELSE extension END AS extension, count(*) AS n FROM s GROUP BY 1")
def extension_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.counts(_statuses(spark, sf_dir), "extension", reports.NO_EXTENSION)


@query(f"WITH {_STATUS_SQL} SELECT error_code, count(*) AS n FROM s WHERE error_code IS NOT NULL GROUP BY 1")
def error_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.counts(_statuses(spark, sf_dir), "error_code")


_COUNTS = ", ".join(f"count(*) FILTER (status = '{s}') AS {s}" for s in reports.STATUSES)


@query(f"""WITH {_STATUS_SQL}, o AS (SELECT *, used_ocr OR (doc_id % 2 = 0 AND doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)) OR (status = 'empty' AND extension = '.pdf') AS need FROM s),
c AS (SELECT count(*) AS discovered, {_COUNTS}, count(*) FILTER (need) AS ocr_needed, count(*) FILTER (used_ocr AND status IN ('indexed', 'partial')) AS ocr_succeeded FROM o)
SELECT *, greatest(0, ocr_needed - ocr_succeeded) AS ocr_failed, greatest(0, discovered - indexed - partial) AS non_searchable, discovered > 0 AND discovered = indexed + partial AND indexed > 0 AS is_complete FROM c""")
def coverage_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.coverage(_statuses(spark, sf_dir), _errors(spark, sf_dir))


@query(f"WITH {_STATUS_SQL} SELECT doc_id, status, name FROM s WHERE status NOT IN ('indexed', 'partial', 'pending') ORDER BY status, name, doc_id LIMIT 5000")
def non_searchable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report of 5000 rows at most."""
    return reports.non_searchable(_statuses(spark, sf_dir), pending=False).select("doc_id", "status", "name")


@query(f"""WITH {_STATUS_SQL}, x AS (SELECT *, length(regexp_replace(coalesce(text, ''), '\\s', '', 'g')) AS solid, length(regexp_replace(text, '[^\\p{{L}}\\p{{N}}]', '', 'g')) AS useful, 1 + doc_id % 20 AS pages FROM s)
SELECT doc_id, CASE WHEN mime_type <> 'application/pdf' THEN CASE WHEN doc_id % 17 = 0 OR doc_id % 19 = 0 THEN 'unsupported' ELSE 'not_needed' END WHEN doc_id % 17 = 0 THEN 'extraction_failed'
WHEN solid = 0 THEN 'no_text' WHEN solid / pages < 90 THEN 'too_few_characters' WHEN useful < 0.45 * solid THEN 'garbled' WHEN doc_id % 19 = 0 THEN 'parser_asked' ELSE 'not_needed' END AS reason FROM x""")
def ocr_need_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    reason = reports.ocr_decision(F.col("text"), F.col("mime_type"), 1 + d % 20, d % 17 == 0, d % 19 == 0)
    return _statuses(spark, sf_dir).select("doc_id", reason.alias("reason"))


@query("""WITH t AS (SELECT conv_id AS doc_id, turn + 1 AS page, length(regexp_replace(text, '\\s', '', 'g')) AS n FROM conversations),
p AS (SELECT DISTINCT conv_id AS doc_id, unnest(range(1, 7)) AS page FROM conversations) SELECT p.doc_id, p.page::INT AS page FROM p LEFT JOIN t USING (doc_id, page) WHERE coalesce(n, 0) < 90""")
def pages_for_ocr(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), (F.col("turn") + 1).cast("int").alias("page"), "text")
    return reports.pages_for_ocr(turns, turns.select("doc_id", F.lit(6).alias("total_pages")).distinct())


@query("SELECT count(*) AS chunks, round(avg(length(text)))::BIGINT AS mean_chars, (SELECT count(*) FROM labels) AS documents, (SELECT count(*) FROM labels WHERE toxic = 1) AS ocr_documents, (SELECT coalesce(sum(quality), 0)::BIGINT FROM labels WHERE toxic = 1) AS ocr_pages FROM documents")
def avg_chunk_chars(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "labels").select("doc_id", (F.col("toxic") == 1).alias("used_ocr"), F.col("quality").cast("long").alias("ocr_pages"))
    return reports.index_statistics(docs, table(spark, sf_dir, "documents").select("text"))


@query("""SELECT 'orphan_chunks' AS finding, count(*) AS n FROM documents ANTI JOIN labels USING (doc_id) UNION ALL
SELECT 'indexed_without_chunks', 0 UNION ALL SELECT 'chunks_without_vector', count(*) FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings) UNION ALL
SELECT 'vectors_without_chunk', count(*) FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM documents)""")
def consistency_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as chunks, labels as documents, embeddings as vectors."""
    docs = table(spark, sf_dir, "labels").select("doc_id", F.lit("indexed").alias("status"))
    chunks = table(spark, sf_dir, "documents").select("doc_id", F.col("doc_id").alias("chunk_id"))
    return reports.consistency(docs, chunks, table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id")))


@query("SELECT doc_id FROM documents ANTI JOIN labels USING (doc_id)")
def orphan_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incremental.orphans(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels"))


# --- incremental: known are the documents that have labels, a scan sees all but French ones


def _known(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left_semi")
    return docs.select(
        "doc_id", "lang", F.col("source").alias("source_id"), F.col("doc_id").cast("string").alias("external_id"),
        F.when(F.col("doc_id") % 9 == 0, "pending").otherwise("indexed").alias("status"),
        F.concat(F.lit("hash:"), F.md5("text")).alias("change_key"), F.col("n_chars").alias("size"), F.lit(1).alias("seen_scan_id"), F.lit(1).alias("normalization_version"),
        F.when(F.col("doc_id") % 10 == 0, 0).otherwise(1).alias("chunking_version"), (F.col("doc_id") % 21 != 0).alias("fts_indexed"),
        F.when(F.col("doc_id") % 6 == 1, F.col("doc_id") - 1).alias("attachment_of"),
    )


_KNOWN_SQL = "k AS (SELECT * FROM documents SEMI JOIN labels USING (doc_id)), i AS (SELECT * FROM documents WHERE lang <> 'fr')"


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").where("lang <> 'fr'")
    return docs.select("doc_id", F.col("source").alias("source_id"), F.col("doc_id").cast("string").alias("external_id"), (F.col("n_chars") + 1).alias("size"))


@query(f"""WITH {_KNOWN_SQL} SELECT coalesce(k.source, i.source) AS source_id, coalesce(k.doc_id, i.doc_id)::VARCHAR AS external_id,
CASE WHEN k.doc_id IS NULL OR k.doc_id % 9 = 0 THEN 'pending' ELSE 'indexed' END AS status, coalesce(i.n_chars + 1, k.n_chars) AS size,
CASE WHEN i.doc_id IS NOT NULL THEN 2 ELSE 1 END AS seen_scan_id FROM k FULL JOIN i ON k.doc_id = i.doc_id""")
def upsert_register(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = incremental.register(_known(spark, sf_dir), _items(spark, sf_dir), 2)
    return out.select("source_id", "external_id", "status", "size", "seen_scan_id")


@query(f"WITH {_KNOWN_SQL} SELECT doc_id, doc_id % 9 = 0 OR doc_id % 8 = 1 OR doc_id % 10 = 0 OR doc_id % 21 = 0 AS again FROM k")
def needs_processing(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = F.when(F.col("doc_id") % 8 == 1, "hash:new").otherwise(F.col("change_key"))
    return _known(spark, sf_dir).select("doc_id", incremental.needs_processing(new).alias("again"))


@query(f"WITH {_KNOWN_SQL} SELECT doc_id FROM k WHERE lang = 'fr' AND doc_id % 6 <> 1 AND source = 'src0'")
def stale_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    after = incremental.register(_known(spark, sf_dir), _items(spark, sf_dir).drop("doc_id"), 2)
    return incremental.stale(after, "src0", 2).select("doc_id")


@query("SELECT doc_id, CASE WHEN doc_id IN (SELECT doc_id FROM labels) THEN 'new' ELSE md5(text) END AS text FROM documents")
def replace_doc_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = table(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("text"))
    fresh = table(spark, sf_dir, "labels").select("doc_id", F.lit("new").alias("text"))
    return incremental.replaced(chunks, fresh)


@query(f"""WITH {_KNOWN_SQL}, u AS (SELECT doc_id, CASE WHEN doc_id % 6 = 1 THEN doc_id - 1 END AS up, doc_id % 9 = 0 AS gone FROM k)
SELECT doc_id FROM u WHERE NOT gone AND (up IS NULL OR up NOT IN (SELECT doc_id FROM u WHERE gone))""")
def cascade_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pending documents go, with their attachments."""
    known = _known(spark, sf_dir)
    gone = incremental.with_descendants(known, known.where("status = 'pending'"))
    return incremental.without(known, gone).select("doc_id")


@query(f"""WITH {_KNOWN_SQL} SELECT doc_id, CASE WHEN lang = 'fr' THEN CASE WHEN doc_id % 2 = 0 THEN 'corrupted' ELSE 'download_failed' END WHEN doc_id % 9 = 0 THEN 'pending' ELSE 'indexed' END AS status,
CASE WHEN lang = 'fr' AND doc_id % 2 = 0 THEN 'k2' ELSE 'hash:' || md5(text) END AS change_key, (lang = 'fr')::INT AS attempts FROM k""")
def mark_failed(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = _known(spark, sf_dir).withColumn("error_code", F.lit(None).cast("string")).withColumn("attempts", F.lit(0))
    bad = known.where("lang = 'fr'").select(
        "doc_id", F.when(F.col("doc_id") % 2 == 0, "corrupted").otherwise("download_failed").alias("status"), F.lit("FD").alias("error_code"), F.lit("k2").alias("change_key")
    )
    return incremental.failed(known, bad).select("doc_id", "status", "change_key", "attempts")
