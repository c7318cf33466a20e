from concurrent.futures import ThreadPoolExecutor

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from quillspark import registry
from quillspark.operators import incremental, reports, sinks
from quillspark.streaming.ingest import ChunkTable, ingest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    return round(v, 7) if isinstance(v, float) else tuple(map(plain, v)) if isinstance(v, list | tuple) else v


@pytest.fixture(scope="module")
def results(spark):
    """Columns and rows of every query with an oracle, or what it raised; several run at a time, as each is small."""

    def run(name):
        try:
            df = registry.queries()[name](spark, SF)
            return df.columns, [tuple(r) for r in df.collect()]
        except Exception as e:
            return e

    names = sorted(registry.oracle_sql())
    with ThreadPoolExecutor(6) as pool:
        return dict(zip(names, pool.map(run, names), strict=True))


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_against_oracle(results, oracle, name):
    if isinstance(results[name], Exception):
        raise results[name]
    columns, rows = results[name]
    want = oracle.execute(registry.oracle_sql()[name])
    wanted = [c[0] for c in want.description]
    assert sorted(wanted) == sorted(columns)
    order = [columns.index(c) for c in wanted]
    got = sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)
    assert got == sorted((tuple(plain(x) for x in r) for r in want.fetchall()), key=repr)


def test_entry(spark):
    assert __spark_entry__.entry(spark).columns
    assert set(registry.queries()) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_requeue_and_backoff(spark):
    known = spark.createDataFrame([(1, "error", "E"), (2, "indexed", None)], "doc_id long, status string, error_code string")
    got = {r.doc_id: (r.status, r.error_code) for r in incremental.requeued(known, known.where("doc_id = 1")).collect()}
    assert got == {1: ("pending", None), 2: ("indexed", None)}
    waits = spark.range(1, 9).select(incremental.backoff_seconds(F.col("id")).alias("w")).collect()
    assert [r.w for r in waits] == [0, 2, 4, 8, 16, 32, 60, 60]


def test_merged_sections(spark):
    schema = "doc_id long, page int, ord int, text string"
    native = spark.createDataFrame([(1, 1, 0, "n1"), (1, 2, 1, "n2"), (1, None, 2, "n0")], schema)
    ocr = spark.createDataFrame([(1, 2, 0, "o2"), (1, 3, 1, "o3")], schema)
    rows = reports.merged_sections(native, ocr).orderBy("ord").collect()
    assert [(r.ord, r.text) for r in rows] == [(0, "n0"), (1, "n1"), (2, "o2"), (3, "o3")]


def test_exports(spark, tmp_path):
    docs = spark.createDataFrame([(1, "error", ".pdf", "application/pdf", False, "a;b")], "doc_id long, status string, extension string, mime_type string, used_ocr boolean, name string")
    errors = spark.createDataFrame([(1, 1, "ocr", "password=hunter22")], "id long, doc_id long, stage string, message string").withColumn("created_at", F.current_timestamp())
    report = reports.coverage(docs, errors)
    assert '"ocr_needed": 1' in sinks.report_json(report)
    data = sinks.coverage_csv(report, reports.non_searchable(docs))
    assert data.startswith(b"\xef\xbb\xbfmetric;value\r\n") and b'error;"a;b"\r\n' in data
    assert sinks.recent_errors(errors).first().message == "password=[usunieto]"
    assert sinks.bundle({"a.csv": data})[:2] == b"PK"
    sinks.snapshot(spark, {"docs": docs}, f"{tmp_path}/s")
    assert sinks.restore(spark, f"{tmp_path}/s")["docs"].count() == 1


def test_stream_of_documents(spark, tmp_path):
    schema = "doc_id long, text string, modified_at timestamp"
    table = ChunkTable(spark, f"{tmp_path}/chunks")

    def arrive(n, rows):
        spark.createDataFrame(rows, "doc_id long, text string").withColumn("modified_at", F.expr(f"timestamp_seconds({n})")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        ingest(stream, table, f"{tmp_path}/checkpoint").awaitTermination()

    arrive(1, [(1, "one"), (2, "two")])
    arrive(2, [(2, "two again"), (3, "three")])
    assert {(r.doc_id, r.text) for r in table.read().collect()} == {(1, "one"), (2, "two again"), (3, "three")}
    table.apply(spark.createDataFrame([(3, "x")], "doc_id long, text string").withColumn("modified_at", F.current_timestamp()), 1)  # a batch run again
    assert {(r.doc_id, r.text) for r in table.read().collect()} == {(1, "one"), (2, "two"), (3, "x")}
