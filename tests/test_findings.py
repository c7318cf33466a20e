"""Cases of a review's findings, each of which failed before."""

import subprocess
import sys
from datetime import date

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import functions as F

from quillspark.functions import spans as sp
from quillspark.functions import storage
from quillspark.functions import text as tx
from quillspark.operators import chunking, highlight, postings, rank
from quillspark.plans import catalog_documents, catalog_records, catalog_search, catalog_sources
from quillspark.sources import extract, samples


def column(spark, expression, rows, kind="string"):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"i int, t {kind}")
    return [r.v for r in df.select("i", expression(F.col("t")).alias("v")).orderBy("i").collect()]


def customers(spark, tmp_path, keys):
    rows = spark.createDataFrame([(k, f"Customer#{k}", "AUTOMOBILE", k + 0.5) for k in keys], "c_custkey long, c_name string, c_mktsegment string, c_acctbal double")
    rows.write.parquet(str(tmp_path / "customer.parquet"))
    return str(tmp_path)


def test_sizes_are_rounded_as_doubles_and_have_the_wanted_units(spark, tmp_path):
    rows = [1023, 1024, 1280, 1331, 1433, 2**30 - 1, 2**40, 2**40 + 2**36, 123_456_789_012_345, 5 * 10**18]
    want = [next((f"{n / 1024**p:.1f} {u}".replace(".", ",") for p, u in ((3, "GB"), (2, "MB"), (1, "KB")) if n >= 1024**p), f"{n} B") for n in rows]
    assert column(spark, lambda c: tx.human_size(c, ("KB", "MB", "GB")), rows, "long") == want
    assert column(spark, tx.human_size, [2**40, 2**52], "long") == ["1,0 TB", "4,0 PB"]
    shown = catalog_search.human_sizes(spark, customers(spark, tmp_path, [5413, 10_000])).orderBy("c_custkey")
    assert [r.shown for r in shown.collect()] == ["1034,0 GB", "6519,3 GB"]


def test_keys_longer_than_a_spelling_keep_their_first_digits(spark, tmp_path):
    rows = catalog_records.digit_spellings(spark, customers(spark, tmp_path, [123_456, 4, 7])).orderBy("c_custkey").collect()
    assert [r.spellings.split("|")[0] for r in rows] == ["77774", "7" * 26, "12345"]


def test_terms_across_blanks_are_found_only_if_wanted(spark, tmp_path):
    docs = [(0, "but he is an idiot", "en", "s", 0), (1, "The id-iot", "en", "s", 0), (2, "an ÍDIOT, they say", "en", "s", 0), (3, None, "en", "s", 0)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    assert [r.doc_id for r in catalog_search.contains_all(spark, str(tmp_path)).collect()] == [2]
    assert column(spark, lambda c: highlight.contains_all(c, ["the", "idiot"]), [d[1] for d in docs]) == [True, True, True, None]


def test_texts_of_any_letters_are_folded(spark):
    codes = [k for r in (range(1, 0xD800), range(0xE000, 0x110000)) for k in r]
    rows = ["".join(map(chr, codes[i : i + 257])) for i in range(0, len(codes), 257)] + ["¼ kg ŉ ǆ", "Ｉｄｉｏｔ ﬁn ế 한글", "I\u0307 ΣΑΣ", None]
    assert column(spark, tx.fold, rows) == [None if t is None else tx.fold_text(t) for t in rows]


def test_terms_are_found_in_texts_of_any_letters(spark):
    rows = ["Ｔｈｅ ｉｄｉｏｔ", "the ịdiöt"]
    assert column(spark, lambda c: highlight.contains_all(c, ["The", "idiot"]), rows) == [True, True]


def test_references_without_a_semicolon(spark, tmp_path):
    page = "<h1>a &quot</h1><p>b &quot; &amp c &amp; &copy; &lt x</p>"
    spark.createDataFrame([(0, page), (1, None)], "page_id long, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got = catalog_records.html_to_text(spark, str(tmp_path)).orderBy("page_id").collect()
    assert [r.text for r in got] == ['a &quot\nb " & c & © &lt x', ""]
    assert extract.html_to_text(page) == 'a "\nb " & c & © < x'


def test_few_row_groups_do_not_hold_readers_back(spark, tmp_path):
    folder = customers(spark, tmp_path, range(40))
    one = spark.read.parquet(folder + "/customer.parquet").coalesce(1)
    one.write.parquet(folder + "/one/customer.parquet")
    files = catalog_sources._files(spark, folder + "/one", "a.txt", lambda w, s, b: w.encode())
    tasks = files.select(F.spark_partition_id().alias("task")).distinct().count()
    assert tasks == spark.sparkContext.defaultParallelism


def test_sections_are_handed_on_in_parts(spark, monkeypatch):
    monkeypatch.setattr(extract, "MOST_ROWS", 3)
    files = spark.createDataFrame([("s", str(i), "a.txt", b"a\n\nb") for i in range(20)], "source_id string, external_id string, name string, content binary")
    rows = extract.sections(files.coalesce(1)).collect()
    assert sorted((int(r.external_id), r.ord, r.text) for r in rows) == [(i, k, t) for i in range(20) for k, t in enumerate("ab")]


def test_fields_of_mails_are_parsed_once(monkeypatch):
    parsed = []
    plain = extract.policy.EmailPolicy.header_fetch_parse
    monkeypatch.setattr(extract.policy.EmailPolicy, "header_fetch_parse", lambda self, name, value: parsed.append(name) or plain(self, name, value))
    extract._FIELD.clear()
    out = extract.extract(samples.eml("Temat", "tekst\n", ("in.txt", b"x")), "a.eml")[0]
    assert [s["text"] for s in out.sections] == ["Od: biuro@firma.example\nDo: klient@firma.example\nTemat: Temat", "tekst", "Załącznik: in.txt"]
    assert parsed.count("From") == parsed.count("Subject") == 1


def test_postings_are_made_of_few_texts_at_once(spark, monkeypatch, tmp_path):
    rows = [(i, i, "the " * (300 if i % 7 == 0 else i)) for i in range(50)] + [(50, 50, None), (51, 51, "x y x")]
    batch = pa.RecordBatch.from_pylist([{"chunk_id": c, "doc_id": d, "text": t} for c, d, t in rows])
    monkeypatch.setattr(postings, "SLICE", 1000)
    parts = list(postings._slices(batch))
    assert pa.Table.from_batches(parts).to_pylist() == batch.to_pylist()
    assert all(sum(len(t or "") for t in p.column("text").to_pylist()) <= 1200 for p in parts) and len(parts) > 8
    chunks = spark.createDataFrame(rows, "chunk_id long, doc_id long, text string")
    made = postings.rows_of(chunks, norm=False)
    assert made.where("part = 'chunk'").count() == 52 and made.where("token = 'x'").first().positions == [0, 2]


def test_a_check_of_postings_groups_them_once(spark, tmp_path):
    chunks = spark.createDataFrame([(1, 1, "a b a"), (2, 2, "b c")], "chunk_id long, doc_id long, text string")
    made = postings.PostingIndex(spark, str(tmp_path / "index"))
    made.write(chunks, norm=False)
    assert made.check(chunks, norm=False).count() == 0
    other = spark.createDataFrame([(1, 1, "a b"), (2, 2, "b c"), (3, 3, "a"), (3, 3, "a")], "chunk_id long, doc_id long, text string")
    found = made.check(other, norm=False)
    assert sorted((r.part, r.token, r.chunk_id, r.tf, r.finding) for r in found.collect()) == sorted([
        ("folded", "a", 1, 2, "surplus"), ("folded", "a", 1, 1, "missing"), *[("folded", "a", 3, 1, "missing"), ("chunk", "", 3, 0, "missing")] * 2
    ])
    assert found._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1


def test_windows_of_words_take_time_in_proportion_to_the_text(spark):
    plan = spark.range(1).select(rank.shingles(F.col("id").cast("string")).alias("s"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 1  # and not within the function of each window
    long = " ".join(map(str, range(5000)))
    assert column(spark, lambda c: F.size(rank.shingles(c)), [long, "a b", " "]) == [4996, 1, 0]


def test_records_of_one_row_group_are_dealt_to_all_cores(spark, tmp_path):
    rows = spark.range(64).select(F.col("id").alias("o_orderkey"), F.lit(date(1995, 2, 3)).alias("o_orderdate"), F.lit(1.5).alias("o_totalprice"))
    rows.coalesce(1).write.parquet(str(tmp_path / "orders.parquet"))
    folder, cores = customers(spark, tmp_path, range(64)), spark.sparkContext.defaultParallelism
    made = [catalog_documents._orders(spark, folder, "'x'"), catalog_records._order_text(spark, folder, "'x'"), catalog_records._chunks_of(spark, folder), catalog_records.snippet_window(spark, folder)]
    for df in made:
        assert df.select(F.spark_partition_id()).distinct().count() == cores
    chunks = catalog_records.chunk_text(spark, folder)
    assert chunks._jdf.queryExecution().optimizedPlan().toString().count("Repartition") == 1  # and the texts are not dealt again
    assert chunks.count() == 64 * 4


def test_large_tables_are_dealt_to_more_tasks(spark, monkeypatch):
    monkeypatch.setattr(storage, "SHARE", 100)
    rows, cores = spark.range(1000), spark.sparkContext.defaultParallelism
    n = storage.dealt(rows, "id").select(F.spark_partition_id()).distinct().count()
    assert n == cores * 20  # 8,000 bytes


def test_sections_become_lists_column_by_column():
    kind = pa.list_(pa.struct([(n, chunking._ARROW[t]) for n, t in chunking._FIELDS]))
    section = {"ord": 1, "text": "a", "kind": "text", "page": None, "sheet": None, "row": 2, "heading": "h", "origin": None}
    docs = [[section, {**section, "ord": 2}], [], None, [{**section, "text": None}]]
    nested = pa.array([[], *docs], kind).slice(1)
    assert list(chunking._section_lists(nested)) == [d or [] for d in docs]


def test_detectors_ask_for_a_text_once():
    sp._IDENTIFIERS.clear()
    for _ in range(3):
        assert [s.token for s in sp.identifiers("umowa FV/12/X")] == ["idffv12x"]
    assert list(sp._IDENTIFIERS) == ["umowa", "FV/12/X"]


def test_workers_need_no_copy_of_the_package():
    for f in (sp.literal_tokens, extract.read_mail, extract.html_to_text, postings.tokenised, chunking.document_chunks, highlight.snippet):
        read = "import sys, pickle; sys.modules['quillspark'] = None; pickle.loads(sys.stdin.buffer.read())"
        done = subprocess.run([sys.executable, "-c", read], input=cloudpickle.dumps(f), capture_output=True, check=False)
        assert done.returncode == 0, done.stderr.decode()
