from pyspark.sql import functions as F

from quillspark.functions import spans
from quillspark.operators import ocr


def test_cache_round_trip(spark):
    files = spark.createDataFrame([("h1", "e", "1", 220, b"a|b"), ("h2", "e", "1", 220, b"c")], "content_hash string, engine string, engine_version string, dpi int, content binary")
    none = spark.createDataFrame([], "content_hash string, engine string, engine_version string, dpi int, text string")
    pages, todo = ocr.cached(files, none)
    assert pages.count() == 0 and todo.count() == 2
    read = ocr.recognised(todo, lambda data: [(t, 0.5) for t in bytes(data).decode().split("|")])
    cache = ocr.for_cache(read)
    assert {(r.content_hash, r.pages, r.confidence, r.text) for r in cache.collect()} == {("h1", 2, 0.5, "a\fb"), ("h2", 1, 0.5, "c")}
    pages, todo = ocr.cached(files, cache)
    assert {tuple(r) for r in pages.collect()} == {("h1", 1, "a"), ("h1", 2, "b"), ("h2", 1, "c")} and todo.count() == 0
    assert ocr.pick_engine({"rapidocr"}) == "rapidocr" and ocr.pick_engine(set()) is None and ocr.pick_engine({"tesseract"}, "none") is None


def test_lines_and_sections(spark):
    words = spark.createDataFrame(
        [(1, 1, 1, 1, 2, "kota", 80.0, 50, 10, 40, 12), (1, 1, 1, 1, 1, "Ala", 90.0, 10, 11, 30, 10), (1, 1, 1, 1, 3, " ", 95.0, 0, 0, 1, 1), (1, 1, 1, 2, 1, "x", -1.0, 0, 0, 1, 1)],
        "doc_id long, block int, par int, line int, word int, text string, conf double, left int, top int, width int, height int",
    )
    (r,) = ocr.lines_of(words).collect()
    assert (r.text, r.left, r.top, r.right, r.bottom, round(r.confidence, 3)) == ("Ala kota", 10, 10, 90, 22, 0.85)
    pages = spark.createDataFrame([(1, 2, "b"), (1, 1, " "), (1, 3, "c")], "doc_id long, page int, text string")
    assert [(s.ord, s.page) for s in ocr.sections_of(pages, 5).orderBy("ord").collect()] == [(5, 2), (6, 3)]


def test_times(spark):
    df = spark.createDataFrame([("D:20150724103000+02'00'", "2015-07-24T10:30:00.1234567Z"), ("D:2015", "x"), ("nope", None)], "p string, i string")
    got = df.select(spans.pdf_date(F.col("p")).cast("string").alias("p"), spans.iso_time(F.col("i")).cast("string").alias("i")).collect()
    assert [tuple(r) for r in got] == [("2015-07-24 08:30:00", "2015-07-24 10:30:00.123456"), ("2015-01-01 00:00:00", None), (None, None)]
