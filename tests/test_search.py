import random
import sqlite3
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from quillspark.functions import spans as sp
from quillspark.operators import chunking, highlight, index, rank, vectors
from quillspark.operators.filters import Filters
from quillspark.plans.query import analyze, clauses
from quillspark.plans.search import Searcher

TEXTS = {
    1: "Umowa z dnia 24.07.2015, rachunek 12 3456 7890 oraz łódź.",
    2: "Umowa najmu. Rachunek 12-3456-7890.",
    3: "Lodz i umowa umowa umowa.",
    4: "karta łódzka zażółć",
    5: "łódzka karta",
    6: "inne słowa bez znaczenia " * 20,
}


@pytest.fixture(scope="module")
def chunks(spark):
    rows = [(i, i % 4, t, sp.literal_tokens(t)) for i, t in TEXTS.items()]
    df = spark.createDataFrame(rows, "chunk_id long, doc_id long, text string, lit array<string>")
    return index.with_tokens(df, norm=F.col("lit")).cache()


@pytest.fixture(scope="module")
def documents(spark):
    rows = [(i, "indexed" if i else "error", f"s{i % 2}", "lib", f".{e}", f"lib/d{i}", datetime(2020, 1, 1 + i), i == 1) for i, e in enumerate(["pdf", "pdf", "txt", "csv"])]
    return spark.createDataFrame(rows, "doc_id long, status string, source_id string, library string, extension string, path_folded string, modified_at timestamp, used_ocr boolean")


def test_scores_equal_those_of_a_full_text_engine(chunks):
    db = sqlite3.connect(":memory:")
    db.execute("CREATE VIRTUAL TABLE f USING fts5(folded, norm, tokenize = \"unicode61 remove_diacritics 2 categories 'L* N* Co'\")")
    for r in chunks.collect():
        db.execute("INSERT INTO f(rowid, folded, norm) VALUES (?, ?, ?)", (r.chunk_id, " ".join(r.folded), " ".join(r.norm)))
    for text, match in (("umowa", 'folded: "umowa"'), ("umowa lodz", 'folded: "umowa" AND folded: "lodz"'), ('"karta łódzka"', 'folded: "karta lodzka"'), ("1234567890", '(norm: "num1234567890" OR folded: "1234567890")')):
        want = dict(db.execute("SELECT rowid, -bm25(f, 1.0, 0.6) FROM f WHERE f MATCH ?", (match,)).fetchall())
        got = {r.chunk_id: r.score for r in index.matches(chunks, clauses(analyze(text))).collect()}
        assert got.keys() == want.keys() and want, text
        assert all(abs(got[k] - want[k]) < 1e-6 for k in want), text


def test_exact_search(chunks, documents):
    s = Searcher(chunks, documents)
    r = s.search("umowa")
    assert r.total == 3 and [h.doc_id for h in r.hits.collect()] == [3, 2, 1] and r.total_is_exact
    assert s.search("umowa", limit=1, offset=1).hits.collect()[0].place == 2
    assert s.search("umowa", limit=5, offset=9).hits.count() == 0
    assert [h.doc_id for h in s.search("umowa", newest=True).hits.collect()] == [3, 2, 1]
    assert [d.doc_id for d in s.all_documents("12 3456 7890").collect()] == [1, 2]
    assert s.search("umowa", filters=Filters(extensions=["pdf"])).total == 1
    assert s.search("  ").hits is None and s.search("umowa", "hybrid").notes


def test_semantic_and_hybrid_search(spark, chunks, documents):
    vecs = chunks.select("chunk_id", vectors.hashing_embedder(16)(F.col("text")).alias("embedding"))
    one = spark.createDataFrame([("umowa najmu",)], "t string").select(vectors.hashing_embedder(16)(F.col("t")).alias("v")).first().v
    s = Searcher(chunks, documents, vecs, lambda t: list(one))
    r = s.search("umowa", "semantic")
    hits = r.hits.collect()
    assert not r.total_is_exact and {h.doc_id for h in hits} == {1, 2, 3} and max(h.strength for h in hits) == 1.0
    r = s.search("umowa 1234567890", "hybrid")
    hits = r.hits.collect()
    assert r.total_is_exact and {hits[0].doc_id, hits[1].doc_id} == {1, 2}


def test_fusion(spark):
    make = lambda ids: spark.createDataFrame([(c, c * 10, i) for i, c in enumerate(ids, 1)], "chunk_id long, doc_id long, rank int")
    f = {r.chunk_id: r for r in rank.fused({"fts": (make([1, 2, 3]), 1.0), "vector": (make([2, 4, 5]), 1.0)}).collect()}
    assert max(f, key=lambda k: f[k].score) == 2 and abs(f[2].score - (1 / 62 + 1 / 61)) < 1e-12 and f[4].fts_rank is None
    c = spark.createDataFrame([(i, 1, s) for i, s in enumerate([9.0, 6.0, 3.0, 1.0])], "chunk_id long, doc_id long, score double")
    assert [rank.grouped(c, 3, k).first().score for k in ("max", "sum", "max_plus_tail")] == [9.0, 19.0, 13.0]


def test_repeats_are_left_out(spark):
    base = "one two three four five six seven eight nine ten"
    rows = [(1, 1, 1, base), (1, 2, 2, base.upper() + " eleven"), (1, 3, 3, "something else altogether here now ok"), (1, 4, 4, ""), (1, 5, 5, "")]
    df = spark.createDataFrame(rows, "doc_id long, rank int, chunk_id long, text string")
    assert sorted(r.chunk_id for r in rank.without_repeats(df).collect()) == [1, 3, 4, 5]


def test_highlighting():
    assert highlight.marked("Łódź i lodz", highlight.find("Łódź i lodz", ["łódź"])) == "[[hl]]Łódź[[/hl]] i [[hl]]lodz[[/hl]]"
    assert highlight.find("nr 12 34-56 x", ["123456"]) == [(3, 11)] and highlight.find("karta, łódzka", ["karta lodzka"]) == [(0, 13)]
    assert highlight.find("aa bb cc, dd ee", ["aa bb", "bb cc", "ee"]) == [(0, 8), (13, 15)]
    assert highlight.find("12-34 56 i 123456 i 1234567", ["123456"]) == [(0, 8), (11, 17)]
    long = "słowo " * 100 + "cel " + "inne " * 100
    s = highlight.snippet(long, ["cel"])
    assert s.startswith("...") and s.endswith("...") and "[[hl]]cel[[/hl]]" in s and len(s) < 350
    assert highlight.snippet("x" * 400, ["y"]) == "x" * 320 + "..." and highlight.snippet("", ["y"]) == ""


def sections(spark, *rows):
    full = [(r.get("doc", 1), i, r["text"], r.get("kind", "text"), r.get("page"), r.get("sheet"), r.get("row"), r.get("heading"), "native") for i, r in enumerate(rows)]
    return spark.createDataFrame(full, chunking.SECTION)


def test_text_chunks(spark):
    body = "\n\n".join(f"Akapit {i}. " + "słowa " * 30 for i in range(40))
    got = chunking.chunked(sections(spark, {"text": body})).orderBy("ordinal").collect()
    assert len(got) > 5 and all(len(c.text) <= 1100 + 180 for c in got)
    assert all(f"Akapit {i}." in " ".join(c.text for c in got) for i in range(40))
    for a, b in zip(got, got[1:], strict=False):
        head = b.text.split("\n")[0]
        assert a.text.endswith(head) and len(head) <= 180
    one = chunking.chunked(sections(spark, {"text": "x" * 5000 + " y"})).collect()
    assert "".join(c.text for c in one).count("x") >= 5000
    split = chunking.chunked(sections(spark, {"text": "a " * 80, "page": 1}, {"text": "b " * 80, "page": 2}, {"text": "c", "page": 3})).orderBy("ordinal").collect()
    assert [c.page for c in split] == [1, 3] or [c.page for c in split] == [1, 2, 3]


def test_table_chunks(spark):
    rows = [{"text": "Arkusz: A", "kind": "sheet", "sheet": "A"}, {"text": "k | w", "kind": "table_header"}]
    rows += [{"text": f"k: {i} | w: {i}", "kind": "table_row", "row": i, "heading": "k | w"} for i in range(30)] + [{"text": "z" * 800, "kind": "table_row", "row": 99, "heading": "k | w"}]
    got = chunking.chunked(sections(spark, *rows)).orderBy("ordinal").collect()
    assert [(c.row_start, c.row_end) for c in got] == [(0, 11), (12, 23), (24, 29), (99, 99)]
    assert all(c.text.startswith("Arkusz: A\nk | w\n") for c in got)
    mixed = chunking.chunked(sections(spark, {"text": "Wstęp " * 30}, {"text": "Dalej"}, {"text": "a: 1", "kind": "table_row", "row": 1})).orderBy("ordinal").collect()
    assert [c.kind for c in mixed] == ["text", "table_row"]


def test_vectors(spark):
    df = spark.createDataFrame([(1, [3.0, 4.0]), (2, [0.0, 0.0]), (3, [1.0, 0.0])], "chunk_id long, embedding array<float>")
    unit = {r.chunk_id: list(r.u) for r in df.select("chunk_id", vectors.l2_normalize(F.col("embedding")).alias("u")).collect()}
    assert unit == {1: [0.6, 0.8], 2: [0.0, 0.0], 3: [1.0, 0.0]}
    assert [r.chunk_id for r in vectors.top_k(df, [1.0, 0.0], 2).collect()] == [1, 3]
    assert vectors.upsert(df, df.where("chunk_id = 1")).count() == 3 and vectors.remove(df, df.where("chunk_id = 1")).count() == 2
    assert df.select(vectors.from_literal(vectors.to_literal(F.col("embedding"))).alias("v")).first().v == [3.0, 4.0]
    assert vectors.needs_compaction(8, 2) and not vectors.needs_compaction(9, 2)
    with pytest.raises(ValueError):
        vectors.check_compatible({"dimension": 3}, dimension=4, digest="x")


def test_stored_postings(spark, chunks, tmp_path):
    posted = index.postings(chunks)
    index.write_postings(posted, f"{tmp_path}/p", 8)
    got = index.read_postings(spark, f"{tmp_path}/p", ["umowa", "lodz"], 8)
    assert {(r.token, r.chunk_id, r.tf) for r in got.collect()} == {("umowa", 1, 1), ("umowa", 2, 1), ("umowa", 3, 3), ("lodz", 1, 1), ("lodz", 3, 1)}


def test_buckets_here_and_in_the_jvm(spark):
    from quillspark.operators import postings

    tokens = ["", "a", "the", "zażółć", "x" * 100, "\U0001f600", "123"]
    df = spark.createDataFrame([("folded", t, 1) for t in tokens], "part string, token string, chunk_id long")
    got = df.select("token", postings._bucket(F.col("part"), F.col("token"), F.col("chunk_id")).alias("b")).collect()
    assert {r.token: r.b for r in got} == {t: postings.bucket_of(t) for t in tokens}


def test_stored_index_against_scans(spark, tmp_path):
    """Words, phrases, literals and alternatives: the stored index finds and scores what a scan of token arrays does, after changes too."""
    from quillspark.operators.postings import PostingIndex

    r = random.Random(11)
    words = ["ala", "ma", "kota", "psa", "łódź", "12", "01.02.2015", "314 zł", "x_y", "FV/2015/12"]
    texts = {i: " ".join(r.choices(words, k=r.randint(0, 25))) for i in range(300)}
    rows = lambda ids: spark.createDataFrame([(i, i // 3, texts[i]) for i in ids], "chunk_id long, doc_id long, text string")
    stored = PostingIndex(spark, f"{tmp_path}/p")
    stored.write(rows(range(300)), version=1)
    for i in range(0, 60):
        texts[i] = " ".join(r.choices(words, k=8))
    stored.write(rows(range(60)), rows(range(60)).select("doc_id"), version=2)
    scanned = index.with_tokens(rows(range(300)), norm=sp.tokens_udf()(F.col("text"))).cache()
    for text, strict in [("ala kota", True), ('"ala ma"', True), ('"ma ma ma"', True), ("ala psa nic", False), ("01.02.2015 łódź", True), ("314 zł", True), ("x_y", True), ("brak", True), ("FV/2015/12 ala", False)]:
        c = clauses(analyze(text), strict)
        want = {r.chunk_id: round(r.score, 9) for r in index.matches(scanned, c).collect()}
        assert {r.chunk_id: round(r.score, 9) for r in stored.matches(c).collect()} == want, text
    assert stored.check(rows(range(300))).count() == 0 and stored.check(rows(range(299))).count() > 0
    plan = stored.lookup([index.Phrase("folded", ("ala",))])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "PushedFilters: [" in plan
