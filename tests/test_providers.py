import base64
import json
import sys

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from quillspark.operators import embedding as em
from quillspark.operators import ocr
from quillspark.operators.vector_store import Mismatch, VectorStore
from quillspark.sources.egress import Policy
from quillspark.sources.http import SERVICE, Answer, Client, Failed

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def test_pooling_and_local_model():
    hidden = np.arange(24, dtype=np.float32).reshape(2, 3, 4)
    mask = np.array([[1, 1, 0], [1, 0, 0]])
    assert (em.pooled(hidden, mask) == hidden[:, 0]).all()
    assert np.allclose(em.pooled(hidden, mask, "mean"), [hidden[0, :2].mean(axis=0), hidden[1, 0]])
    assert np.allclose(np.linalg.norm(em.unit(np.array([[3.0, 4], [0, 0]])), axis=1), [1, 0])
    seen = []

    def tokenize(texts):
        seen.append(texts)
        ids = np.array([[len(t), t.count("a"), 1] for t in texts])
        return ids, np.ones_like(ids)

    model = em.Local("m", 2, tokenize, lambda ids, mask: np.stack([ids[:, :1], ids[:, 1:2]], axis=2).repeat(3, axis=1).astype(np.float32), "mean", "p: ", "q: ", batch=2)
    out = model.passages(["a", "bb", "aaa"])
    assert out.shape == (3, 2) and np.allclose(np.linalg.norm(out, axis=1), 1) and seen == [["p: a", "p: bb"], ["p: aaa"]]
    assert model.query("a").shape == (2,) and seen[-1] == ["q: a"] and model.passages([]).shape == (0, 2)
    model.cancelled = lambda: True
    with pytest.raises(InterruptedError):
        model.passages(["x"])


def service(answers, asked):
    def send(method, url, headers, body, timeout):
        asked.append((url, json.loads(body)))
        a = answers.pop(0)
        return a if isinstance(a, Answer) else Answer(200, {}, json.dumps(a).encode())

    return Client("https://localhost/v1", "internal_api", Policy(), SERVICE, send=send, sleep=lambda s: None)


def test_remote_model():
    asked = []
    rows = lambda *v: {"data": [{"embedding": x, "index": i} for i, x in v]}
    m = em.Remote(service([Answer(425, {}, b""), rows((1, [0, 2]), (0, [3, 0])), rows((0, [1, 1]))], asked), "m", 2, passage_prefix="p ", batch=2)
    assert np.allclose(m.passages(["a", "b", "c"]), [[1, 0], [0, 1], [0.5**0.5] * 2])
    assert asked[-2] == ("https://localhost/v1/embeddings", {"model": "m", "input": ["p a", "p b"]}) and len(asked) == 3
    m = em.Remote(service([rows((0, [1, 0]))], asked), "m", 2, kinds=True, send_dimension=True, query_prefix="q ")
    assert m.query("x").tolist() == [1, 0] and asked[-1][1] == {"model": "m", "input": ["x"], "kind": "query", "dimensions": 2}
    for bad in ({"data": []}, {"no": 1}, rows((0, [1, 2, 3])), {"data": [{"vector": [1, 2]}]}, {"data": [{"embedding": [1, float("nan")]}]}, Answer(401, {}, b"")):
        with pytest.raises(Failed):
            em.Remote(service([bad], []), "m", 2).query("x")


class Failing:
    model_key, dimension = "f", 4

    def passages(self, texts):
        if any("bad" in t for t in texts):
            raise OSError
        return np.ones((len(texts), 4), np.float32)


def test_embedding_of_tables(spark):
    df = spark.createDataFrame([(i, i // 2, "bad" if i == 7 else None if i == 3 else f"t{i}") for i in range(12)], "chunk_id long, doc_id long, text string").coalesce(1)
    got = {r.chunk_id: r.embedding for r in em.embedded(df, Failing, batch=4).collect()}
    assert [i for i, e in got.items() if e is None] == [4, 5, 6, 7] and got[3] == [1.0] * 4
    header = spark.createDataFrame([("a", "Plik: x"), ("b", "")], "t string, h string").select(em.with_context(F.col("t"), F.col("h")).alias("x")).collect()
    assert [r.x for r in header] == ["Plik: x\na", "b"]


def test_vector_store(spark, tmp_path):
    r = np.random.default_rng(5)
    centres = r.normal(size=(12, 16))
    v = (centres[np.arange(1200) % 12] + 0.6 * r.normal(size=(1200, 16))).astype(np.float32)
    rows = spark.createDataFrame([(i, i // 10, x.tolist()) for i, x in enumerate(v)], "chunk_id long, doc_id long, embedding array<float>")
    s = VectorStore(spark, f"{tmp_path}/v").open(16, "m", "d")
    s.add(rows)
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    truth = lambda q, k, keep=None: [int(i) for i in np.argsort(-(unit @ q), kind="stable") if keep is None or keep[i]][:k]
    q = unit[7]
    assert [x.chunk_id for x in s.search(q.tolist(), 10).orderBy(F.desc("score"), "chunk_id").collect()] == truth(q, 10)
    assert s.count() == 1200 and np.allclose(s.vector(7), unit[7]) and s.vector(5000) is None
    s.remove(spark.createDataFrame([(i,) for i in range(400)], "chunk_id long"))
    s.add(spark.createDataFrame([(500, 50, (2 * unit[7]).tolist())], "chunk_id long, doc_id long, embedding array<float>"))
    assert s.count() == 800 and s.search(q.tolist(), 1).first().chunk_id == 500 and s.needs_compaction()
    unit[500] = unit[7]
    s.compact(active=s.read().where("chunk_id < 1100"))
    assert s.count() == 700 and not s.needs_compaction() and len(s.table.versions()) == 1
    keep = (np.arange(1200) >= 400) & (np.arange(1200) < 1100)
    assert s.train(24) == 24 and s.count() == 700
    found = []
    for i in range(400, 1100, 35):
        got = {x.chunk_id for x in s.nearest(unit[i].tolist(), 10, probes=8).collect()}
        found.append(len(got & set(truth(unit[i], 10, keep))) / 10)
    assert np.mean(found) >= 0.9
    assert "PartitionFilters: [" in s.read().where("list = 1")._jdf.queryExecution().executedPlan().toString()
    for dimension, model, digest in ((8, "m", "d"), (16, "n", "d"), (16, "m", "e")):
        with pytest.raises(Mismatch):
            VectorStore(spark, f"{tmp_path}/v").open(dimension, model, digest)
    with pytest.raises(FileNotFoundError):
        VectorStore(spark, f"{tmp_path}/none").open(16, "m", "d", create=False)
    with pytest.raises(Exception, match="3 numbers"):
        s.add(spark.createDataFrame([(1, 1, [1.0, 2.0, 3.0])], "chunk_id long, doc_id long, embedding array<float>"))


WORDS = "level\tblock_num\tpar_num\tline_num\tword_num\tconf\ttext\n5\t1\t1\t1\t1\t90\tAla\n5\t1\t1\t1\t2\t70\tma\n5\t1\t1\t2\t1\t-1\t \n5\t1\t1\t2\t1\t80\tkota\n5\t1\t1\t2\t2\t-1\tx\n"


def test_engines():
    assert ocr.text_of_words(WORDS) == ("Ala ma\nkota", pytest.approx(0.8)) and ocr.text_of_words("") == ("", None)
    echo = ocr.Program(("cat", "{image}"), "echo")
    assert echo.available() and echo.read(WORDS.encode())[0] == "Ala ma\nkota"
    assert not ocr.Program(("no-such-program",)).available()
    with pytest.raises(OSError):
        ocr.Program(("false",)).read(b"")
    lib = ocr.Library("json", "json", lambda image: [("a ", 0.5), (" ", 0.1), ("b", 0.7)])
    assert lib.available() and lib.read(b"") == ("a\nb", pytest.approx(0.6)) and not ocr.Library("x", "no_such_module", lib.call).available()
    asked = []
    s = ocr.Service(service([{"lines": [{"text": "a", "confidence": 0.5}, {"text": " "}, {"text": "b"}]}, {"text": "t", "confidence": 0.9}, {"x": 1}], asked))
    assert s.available() and s.read(b"img") == ("a\nb", 0.5) and s.read(b"img") == ("t", 0.9)
    assert asked[0] == ("https://localhost/v1/ocr", {"image": base64.b64encode(b"img").decode(), "lang": "pol"})
    with pytest.raises(Failed):
        s.read(b"img")
    assert not ocr.Service(Client("https://far.example", "ocr_api", Policy())).available()


class Reader(ocr.Engine):
    name = "fake"

    def available(self):
        return True

    def read(self, image):
        if b"!" in image:
            raise ValueError
        return image.decode(), 0.5


def paged(data, wanted):
    for i, page in enumerate(data.split(b"|"), 1):
        if wanted is None or i in wanted:
            yield i, page


def test_recognition_with_cache(spark):
    key = lambda h: (h, "fake", "1", 220)
    schema = "content_hash string, engine string, engine_version string, dpi int, content binary, wanted array<int>"
    rows = [(*key("a"), b"one|two", None), (*key("b"), b"x|!|z", None), (*key("c"), b"p|q|r", [2]), (*key("d"), b"1|2|3|4", None), (*key("k"), b"unseen", None)]
    files = spark.createDataFrame(rows, schema)
    cache = spark.createDataFrame([(*key("k"), 2, 0.5, "known\fpages")], "content_hash string, engine string, engine_version string, dpi int, pages long, confidence double, text string")
    pages, fresh = ocr.with_cache(files, cache, Reader, paged, most_pages=3)
    got = {}
    for r in pages.collect():
        got.setdefault(r.content_hash, {})[r.page] = r.text or r.warning
    assert got == {"a": {1: "one", 2: "two"}, "b": {1: "x", 2: "page 2: ValueError", 3: "z"}, "c": {2: "q"}, "d": {1: "1", 2: "2", 3: "3"}, "k": {1: "known", 2: "pages"}}
    assert [(r.content_hash, r.pages, r.text) for r in fresh.collect()] == [("a", 2, "one\ftwo")]  # whole and without warnings
