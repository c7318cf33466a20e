import json
import sys
import threading
import time
import zipfile
from io import BytesIO

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from quillspark.__main__ import main
from quillspark.functions.storage import Files
from quillspark.functions.text import redacted
from quillspark.operators import embedding as em
from quillspark.operators import ocr, sinks
from quillspark.operators.versions import ChangeTable
from quillspark.plans import jobs
from quillspark.plans.query import QuerySyntaxError
from quillspark.plans.workspace import Recognition, Workspace, identified
from quillspark.sources.connectors import Choice, Folder
from quillspark.sources.files import Crawl


cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors can't import tests


def test_change_table(spark, tmp_path):
    t = ChangeTable(spark, f"{tmp_path}/t")
    rows = lambda *x: spark.createDataFrame(list(x), "doc_id long, text string")
    read = lambda **k: {(r.doc_id, r.text) for r in t.read(**k).collect()}
    assert t.read() is None and t.compact() is None
    t.write(rows((1, "a"), (2, "b"), (3, "c")), None, 1)
    t.write(rows((2, "B"), (2, "BB")), rows((2, "")), 2)
    t.write(rows(), rows((3, "")), 3)
    assert read() == {(1, "a"), (2, "B"), (2, "BB")} and read(upto=2) == {(1, "a"), (2, "B"), (2, "BB"), (3, "c")} and read(upto=1) == {(1, "a"), (2, "b"), (3, "c")}
    t.write(rows((2, "again")), rows((2, "")), 2)  # a version written anew
    assert read() == {(1, "a"), (2, "again")}
    assert t.compact(keep=True) == 4 and read() == {(1, "a"), (2, "again")} == read(upto=3)
    t.drop_before(4)
    assert t.versions() == [4] and read() == {(1, "a"), (2, "again")}
    t.write(rows((1, "z")), rows((1, "")), 5)
    assert read() == {(1, "z"), (2, "again")}


def test_ids_that_meet(spark, monkeypatch):
    """Two files and a known one whose hashes are equal: each has an id of its own, the known one keeps its."""
    from quillspark.plans import workspace

    monkeypatch.setattr(workspace, "document_id", lambda s, e, salt=0: F.when(F.lit(salt) == 0, F.lit(7).cast("long")).otherwise(F.xxhash64(s, e, F.lit(salt))))
    files = spark.createDataFrame([("s", "a"), ("s", "b"), ("s", "k")], "source_id string, external_id string")
    known = spark.createDataFrame([(7, "s", "k", None)], "doc_id long, source_id string, external_id string, attachment_of long")
    got = {r.external_id: r.doc_id for r in identified(files, known).collect()}
    assert got["k"] == 7 and len(set(got.values())) == 3


class Fake(ocr.Engine):
    name = "fake"

    def available(self):
        return True

    def read(self, image):
        return "umowa rozpoznana " + image[-3:].decode("latin-1"), 0.75


PNG = b"\x89PNG\r\n\x1a\n\x00\x00\x00\rIHDR\x00\x00\x00\x01\x00\x00\x00\x01\x08\x02\x00\x00\x00....abc"


@pytest.fixture(scope="module")
def filled(spark, tmp_path_factory):
    top = tmp_path_factory.mktemp("jobs")
    (top / "files").mkdir()
    for i in range(6):
        (top / "files" / f"d{i}.txt").write_text(f"dokument numer {i} o kotach i psach")
    (top / "files" / "scan.png").write_bytes(PNG)
    w = Workspace(spark, f"{top}/ws", provider=lambda: em.Hashed(16), recognition=Recognition(Fake, "fake"))
    w.counts = w.index(Crawl(f"{top}/files"))
    return top, w


def test_recognition_and_vectors_in_a_crawl(spark, filled):
    top, w = filled
    assert w.counts == {"indexed": 7}
    scan = w.documents().where("name = 'scan.png'").first()
    assert (scan.used_ocr, scan.ocr_pages, scan.ocr_confidence, scan.vector_indexed, scan.model_key) == (True, 1, 0.75, True, "hashed-words")
    assert [h.name for h in w.hits(w.search("rozpoznana")).collect()] == ["scan.png"]
    assert w.chunks().where("origin = 'ocr'").count() == 1 and w.report().first().ocr_succeeded == 1
    found = w.search("psach numer 3", mode="hybrid")
    assert found.total >= 6 and found.mode == "hybrid" and w.search("kotach", mode="semantic").total > 0
    facts = w.statistics()
    assert (facts["vectors"], facts["ocr_documents"], facts["semantic"], facts["by_extension"][".txt"]) == (w.chunks().count(), 1, True, 6)
    assert not any(r.n for r in w.check().collect())
    assert w.without_vectors().count() == 0 and Workspace(spark, w.path).without_vectors(batch=3).count() == 3
    first = [r.chunk_id for r in Workspace(spark, w.path).without_vectors(batch=3).collect()]
    after = [r.chunk_id for r in Workspace(spark, w.path).without_vectors(after=first[-1], batch=99).collect()]
    assert len(after) == 4 and min(after) > max(first)


def test_a_rescan_reads_no_content(spark, filled, monkeypatch):
    from quillspark.plans import workspace

    top, w = filled
    seen = []
    plain = workspace.contents_of
    monkeypatch.setattr(workspace, "contents_of", lambda s, c, todo: seen.append(todo.count()) or plain(s, c, todo))
    assert w.index(Crawl(f"{top}/files")) == {"indexed": 7} and seen == [0]
    (top / "files" / "d0.txt").write_text("zmieniony dokument")
    (top / "files" / "d1.txt").unlink()
    assert w.index(Crawl(f"{top}/files")) == {"indexed": 6} and seen == [0, 1]
    assert w.search("zmieniony").total == 1 and w.vectors().count() == 6


def test_a_crawl_that_ends_early_changes_nothing(spark, filled, monkeypatch):
    top, w = filled
    before = sorted((r.doc_id, r.status) for r in w.documents().collect())
    (top / "files" / "new.txt").write_text("nowy")
    monkeypatch.setattr(w._documents, "write", lambda *a: (_ for _ in ()).throw(OSError("disk")))
    with pytest.raises(OSError):
        w.index(Crawl(f"{top}/files"))
    assert sorted((r.doc_id, r.status) for r in w.documents().collect()) == before and w.search("nowy").total == 0
    assert not any(r.n for r in w.check().collect())
    monkeypatch.undo()
    w.index(Crawl(f"{top}/files"))
    assert w.search("nowy").total == 1 and not any(r.n for r in w.check().collect())


def test_maintenance(spark, filled):
    top, w = filled
    count = w.documents().count()
    w.compact()
    assert w.documents().count() == count and w.search("kotach").total > 0 and w.vectors().count() == w.chunks().count() and not any(r.n for r in w.check().collect())
    w.reindex_all(only_vectors=True)
    assert w.documents().where("vector_indexed").count() == 0
    w.index(Crawl(f"{top}/files"))
    assert w.documents().where("vector_indexed").count() == count
    w.requeue(w.documents().limit(2).select("doc_id"))
    assert w.pending().count() == 2 and w.pending("other").count() == 0 and w.pending(limit=1).count() == 1
    w.ensure_space()
    with pytest.raises(OSError):
        w.ensure_space(1 << 62)
    with pytest.raises(QuerySyntaxError):
        w.search("?!")
    w.manifest.publish(schema=99)
    with pytest.raises(RuntimeError):
        Workspace(spark, w.path)
    w.manifest.publish(schema=1)
    assert Workspace(spark, w.path).manifest.current()["schema"] == 2
    w.index(Crawl(f"{top}/files"))


def test_connector_failures_are_tried_again(spark, tmp_path):
    (tmp_path / "f").mkdir()
    (tmp_path / "f" / "a.txt").write_text("alfa")
    (tmp_path / "f" / "b.txt").write_text("token=sekret12345 beta")
    (tmp_path / "f" / "big.txt").write_text("z" * 500)
    source = Folder(str(tmp_path / "f"), "disk", Choice(most_bytes=100))

    class Broken(Folder):
        def fetch(self, item):
            if item.name == "b.txt":
                raise ConnectionError("token=sekret12345")
            return super().fetch(item)

    w = Workspace(spark, f"{tmp_path}/ws")
    assert w.index(Broken(source.root, "disk", source.choice)) == {"indexed": 1, "download_failed": 1, "skipped": 1}
    rows = {r.file_name: r for r in w.errors().collect()}
    assert (rows["b.txt"].stage, rows["b.txt"].retryable, rows["big.txt"].code) == ("fetch", True, "skipped")
    assert w.documents().where("name = 'b.txt'").first().attempts == 1
    assert w.index(source) == {"indexed": 2, "skipped": 1}
    assert {r.file_name for r in w.errors().collect()} == {"big.txt"}
    data = sinks.diagnostics(w.report(), w.documents().limit(0), w.errors(), {"api_key": "x", "n": [1] * 50}, "a\npassword=abcdefgh\n")
    with zipfile.ZipFile(BytesIO(data)) as z:
        assert set(z.namelist()) == {"coverage.json", "coverage.csv", "errors.csv", "environment.json", "log.txt"}
        assert z.read("log.txt").decode() == "a\npassword=[usunieto]" and json.loads(z.read("environment.json")) == {"api_key": "[usunieto]", "n": [1] * 20}


def test_jobs(spark, tmp_path):
    r = jobs.Runner(spark, f"{tmp_path}/ws")
    held, seen = threading.Event(), []

    def slow(job, control):
        for i in range(3):
            control.step()
            seen.append(i)
            held.set()
            time.sleep(0.2)
        return {"n": 3}

    first = r.submit("slow", slow, password="x")
    second = r.submit("fails", lambda job, control: 1 / 0)
    third = r.submit("never", slow)
    r.cancel(third)
    held.wait()
    r.pause(first)
    assert first.state == "paused" and {j.id for j in r.records.resumable()} >= {first.id, second.id}
    r.resume(first)
    r.wait()
    assert (first.state, first.result, second.state, third.state) == ("done", {"n": 3}, "failed", "cancelled") and second.error.startswith("ZeroDivisionError")
    assert [j.kind for j in r.records.recent(2)] == ["never", "fails"] and r.records.recent(states=("failed",))[0].id == second.id and not r.records.resumable()
    assert [j for j in r.records.all() if j.id == first.id][0].settings == {"password": "[usunieto]"}
    r.close()
    assert jobs.environment(spark)["spark"] == spark.version


def test_indexing_goes_on_after_an_interruption(spark, tmp_path):
    for s in "ab":
        (tmp_path / s).mkdir()
        (tmp_path / s / "x.txt").write_text(f"plik {s}")
    w = Workspace(spark, f"{tmp_path}/ws")
    made = []
    sources = [{"source_id": s, "make": lambda s=s: made.append(s) or Crawl(str(tmp_path / s), s)} for s in "ab"] + [{"source_id": "c", "enabled": False}]
    records = jobs.Records(spark, w.path)
    records.save_checkpoint("a", "j", finished=True, result={"indexed": 1})
    got = jobs.indexing(w, sources)(jobs.Job("j", "index"), jobs.Control())
    assert made == ["b"] and got == {"a": {"indexed": 1}, "b": {"indexed": 1}} and records.checkpoint("a", "j") is None
    control = jobs.Control()
    control.cancel()
    with pytest.raises(jobs.Cancelled):
        jobs.indexing(w, sources)(jobs.Job("k", "index"), control)


def test_small_files(spark, tmp_path):
    f = Files(spark, str(tmp_path / "x"))
    f.write("a/b", {"ż": [1]})
    f.write("a/b", {"ż": [2]})
    assert f.read("a/b") == {"ż": [2]} and f.names("a") == ["b"] and f.exists("a/b") and f.bytes_in() > 0 and f.free_bytes() > 0
    f.delete("a")
    assert not f.exists("a")


def test_redaction_at_any_depth():
    value = {"Cookie": "a", "inner": {"set-cookie": 1, "text": "abc", "x": ["password=abcdefgh", {"vector": [1, 2]}]}, "n": None, "deep": {"a": {"b": {"c": {"d": {"e": {"f": 1}}}}}}, "body": 5}
    got = redacted("", value)
    assert got["Cookie"] == "[usunieto]" == got["inner"]["set-cookie"] == got["inner"]["x"][1]["vector"] == got["body"] and got["inner"]["text"] == "<3 znaków>"
    assert got["inner"]["x"][0] == "password=[usunieto]" and got["n"] is None and "[usunieto]" in json.dumps(got["deep"])


def test_commands(spark, tmp_path, capsys):
    ws = str(tmp_path / "ws")
    said = lambda: json.loads(capsys.readouterr().out.strip().splitlines()[-1])
    main([ws, "init"])
    assert said()["schema"] == 2
    main([ws, "demo", str(tmp_path / "files")])
    assert said()["files"] == 24
    main([ws, "sources", "add-local", "--id", "demo", "--root", str(tmp_path / "files")])
    main([ws, "sources", "add-local", "--id", "off", "--root", str(tmp_path / "none"), "--disabled"])
    main([ws, "sources", "test"])
    assert said() == {"demo": True, "off": False}
    main([ws, "index"])
    assert said()["demo"]["indexed"] == 20
    main([ws, "search", "procedura", "--text"])
    assert "1 documents" in capsys.readouterr().out
    assert main([ws, "search", "!?"]) == 2
    main([ws, "report", "--fast"])
    assert said()["indexed"] == 20
    main([ws, "doctor", "--bundle", str(tmp_path / "b.zip")])
    assert said()["statistics"]["documents"] == 24 and zipfile.is_zipfile(tmp_path / "b.zip")
    main([ws, "maintenance", "errors"])
    main([ws, "maintenance", "compact"])
    main([ws, "maintenance", "check"])
    assert not any(said().values())
    main([ws, "maintenance", "snapshot", "--to", str(tmp_path / "snaps" / "one")])
    assert sinks.snapshots(spark, str(tmp_path / "snaps")) == ["one"] and sinks.restore(spark, str(tmp_path / "snaps" / "one"))["documents"].count() == 24
    for command in ("model", "ocr"):
        main([ws, command])
        said()
    main([ws, "sources", "remove", "--id", "off"])
    main([ws, "sources", "list"])
    assert [s["source_id"] for s in said()] == ["demo"]
