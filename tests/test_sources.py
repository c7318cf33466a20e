import hashlib
import json
import os
import sys
from datetime import UTC, datetime

import pytest
from pyspark import cloudpickle

from quillspark.sources import connectors as cn
from quillspark.sources.egress import EgressError, Policy
from quillspark.sources.http import Answer, Client, Failed, Patience


cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors can't import tests


def test_policy():
    p = Policy({"internal_api"}, {"internal_api": ("*.corp.example",)})
    assert p.check("https://a.corp.example/x", "internal_api") == "a.corp.example" and p.check("https://localhost:8/x", "ocr_api") == "localhost"
    for url, category in [
        ("https://a.corp.example", "ocr_api"), ("http://a.corp.example", "internal_api"), ("https://corp.example.evil", "internal_api"), ("http://localhost", "internal_api"),
        ("https:///x", "internal_api"), ("https://graph.microsoft.com", "microsoft_graph"),
    ]:
        with pytest.raises(EgressError):
            p.check(url, category)
    assert Policy(plain_local=True).check("http://127.0.0.1:9", "ocr_api") == "127.0.0.1"
    assert Policy({"microsoft_graph"}).allows_host("x.sharepoint.com", "microsoft_graph")


def test_patience():
    p = Patience()
    assert [p.wait(i) for i in range(1, 9)] == [1.0, 2.25, 4.5, 8.75, 16.0, 32.25, 60.0, 60.0]
    now = datetime(2026, 1, 1, tzinfo=UTC)
    assert [p.asked(x, now) for x in (None, " ", "7", "9999", "-3", "junk", "Thu, 01 Jan 2026 00:00:30 GMT")] == [None, None, 7.0, 300.0, 0.0, None, 30.0]


class Server:
    """Answers by a list, and what was asked."""

    def __init__(self, *answers):
        self.answers, self.asked, self.waits = list(answers), [], []

    def __call__(self, method, url, headers, body, timeout):
        self.asked.append((method, url, headers, body))
        a = self.answers.pop(0)
        if isinstance(a, Exception):
            raise a
        return a if isinstance(a, Answer) else Answer(200, {}, a if isinstance(a, bytes) else json.dumps(a).encode())

    def client(self, **more):
        return Client("https://localhost/v1", "microsoft_graph", Policy(), send=self, sleep=self.waits.append, **more)


def test_retries_and_tokens():
    s = Server(Answer(429, {"retry-after": "3"}, b""), Answer(503, {}, b""), OSError(), {"ok": 1})
    assert s.client().request("GET", "x").json() == {"ok": 1} and s.waits == [3.0, 2.25, 4.5]
    tokens = []
    s = Server(Answer(401, {}, b""), {"ok": 2})
    assert s.client(token=lambda fresh: tokens.append(fresh) or f"t{fresh}").request("GET", "x").json() == {"ok": 2}
    assert tokens == [False, True] and s.asked[1][2]["Authorization"] == "Bearer tTrue"
    for answers in ([Answer(404, {}, b"")], [Answer(401, {}, b""), Answer(401, {}, b"")], [Answer(500, {}, b"")] * 5):
        with pytest.raises(Failed):
            Server(*answers).client(token=lambda fresh: "t").request("GET", "x")
    with pytest.raises(EgressError):
        Client("https://elsewhere.example", "microsoft_graph", Policy(), send=s).request("GET", "x")


def test_pages_changes_and_downloads():
    s = Server({"value": [1, 2], "@odata.nextLink": "https://localhost/v1/p2"}, {"value": [3], "@odata.nextLink": "https://localhost/v1/p2"})
    assert list(s.client().paged("p1")) == [1, 2, 3]
    s = Server({"value": [1], "@odata.nextLink": "https://localhost/n"}, {"value": [2], "@odata.deltaLink": "https://localhost/d"})
    assert s.client().changes("x") == ([1, 2], "https://localhost/d")
    s = Server(b"abc", b"abc")
    assert s.client().download("f", 3) == (b"abc", hashlib.sha256(b"abc").hexdigest())
    with pytest.raises(Failed):
        s.client().download("f", 4)


@pytest.fixture
def folder(tmp_path):
    for name in ("b.txt", "a/z.txt", "a/deep/y.csv", "a.txt", "c/x.docx", ".hidden/h.txt", "node_modules/n.txt", "c/~tmp.txt", "big.txt"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("z" * 99 if name == "big.txt" else name)
    os.symlink(tmp_path / "b.txt", tmp_path / "link.txt")
    return str(tmp_path)


def test_folder_in_order_and_from_a_cursor(folder):
    c = cn.Folder(folder, choice=cn.Choice(patterns=("*~*",), most_bytes=50))
    c.test()
    paths = [i.path for i in c.items()]
    assert paths == ["a/deep/y.csv", "a/z.txt", "a.txt", "b.txt", "big.txt", "c/x.docx"]
    assert [i.skip for i in c.items()] == [None] * 4 + ["too large", None]
    assert [i.path for i in c.items(cursor=cn.Cursor("a.txt"))] == ["b.txt", "big.txt", "c/x.docx"]
    assert [i.path for i in c.items(cursor=cn.Cursor.loads(cn.Cursor("a/deep/y.csv").dumps()))] == paths[1:]
    assert sorted(i.path for s in c.shares() for i in c.items(s)) == sorted(paths)
    assert c.estimate() == 5 and c.estimate(0, iter(range(100)).__next__) is None
    item = next(c.items())
    assert (item.extension, item.library, item.etag.split("-")[0]) == (".csv", "a", "12") and c.fetch(item) == b"a/deep/y.csv"
    with pytest.raises(PermissionError):
        c.fetch(cn.Item("x", "x", "../../etc/hostname"))
    only = cn.Folder(folder, choice=cn.Choice(extensions=("TXT",), excluded=(".docx",), hidden=True))
    assert {i.path for i in only.items()} == {"a/z.txt", "a.txt", "b.txt", "big.txt", ".hidden/h.txt", "c/~tmp.txt"}
    with pytest.raises(FileNotFoundError):
        cn.Folder(folder + "/none").test()
    assert [i.skip for i in cn.Folder(folder + "/none").items()] == ["not listed: FileNotFoundError"]


def test_folder_as_a_data_source(spark, folder):
    rows = {r.path: r for r in cn.listed(spark, cn.Folder(folder, "disk", cn.Choice(most_bytes=50))).collect()}
    assert rows["a.txt"].content == b"a.txt" and rows["a.txt"].content_hash == hashlib.sha256(b"a.txt").hexdigest()
    assert rows["big.txt"].content is None and rows["big.txt"].skip == "too large" and rows["a.txt"].source_id == "disk"
    bare = cn.listed(spark, cn.Folder(folder, "disk"), contents=False)
    assert bare.where("content IS NOT NULL").count() == 0 and bare.rdd.getNumPartitions() == 3


TREE = {
    "root": [{"id": "f1", "name": "Docs", "folder": {}}, {"id": "1", "name": "a.txt", "size": 3, "file": {"hashes": {"sha1Hash": "s", "crc32Hash": "c"}}, "eTag": "e1",
             "createdBy": {"user": {"displayName": "Ala"}}, "lastModifiedDateTime": "2024-05-01T10:00:00.1234567Z"}, {"id": "h", "name": ".x", "folder": {}}],
    "f1": [{"id": "2", "name": "b.PDF", "size": 5, "file": {}, "cTag": "c2"}, {"id": "f2", "name": "Sub", "folder": {}}, {"id": "3", "name": "TMP.txt", "size": 1, "file": {}}],
    "f2": [{"id": "4", "name": "c.txt", "size": 4, "file": {}}],
}


def graph(method, url, headers, body, timeout):
    if url.endswith("/children"):
        entries = TREE[url.split("/")[-2]]
        return Answer(200, {}, json.dumps({"value": entries}).encode())
    if url.endswith("/content"):
        return Answer(200, {}, b"x" * {"1": 3, "2": 5, "3": 1, "4": 9}[url.split("/")[-2]])
    if url.endswith("/delta"):
        value = [{"id": "1", "name": "old.txt", "file": {}}, {"id": "9", "deleted": {}}, {"id": "1", "name": "new.txt", "file": {}, "parentReference": {"path": "/drives/d/root:/Docs"}}]
        return Answer(200, {}, json.dumps({"value": value, "@odata.deltaLink": "https://localhost/next"}).encode())
    return Answer(200, {}, b"{}")


def drive(**choice):
    client = lambda: Client("https://localhost/v1", "microsoft_graph", Policy(), send=graph)
    return cn.Drive(client, "d", "cloud", "Library", choice=cn.Choice(**choice))


def test_drive(spark):
    d = drive(patterns=("*tmp*",), most_bytes=4)
    d.test()
    found = {i.path: i for i in d.items()}
    assert set(found) == {"a.txt", "Docs/b.PDF", "Docs/TMP.txt", "Docs/Sub/c.txt"}
    assert (found["a.txt"].author, found["a.txt"].etag, found["a.txt"].content_hash) == ("Ala", "e1", "sha1Hash:s")
    assert found["a.txt"].modified_at == datetime(2024, 5, 1, 10, 0, 0, 123456, UTC) and found["Docs/b.PDF"].etag == "c2"
    assert [found[p].skip for p in ("Docs/b.PDF", "Docs/TMP.txt", "Docs/Sub/c.txt")] == ["too large", "excluded by pattern", None]
    rows = {r.path: r for r in cn.listed(spark, drive()).collect()}
    assert set(rows) == set(found) and rows["a.txt"].content == b"xxx" and rows["a.txt"].library == "Library"
    assert rows["Docs/Sub/c.txt"].note.startswith("download_failed") and rows["Docs/Sub/c.txt"].content is None
    items, gone, cursor = d.changed(cn.Cursor())
    assert [(i.external_id, i.path) for i in items] == [("1", "Docs/new.txt")] and gone == ["9"] and cursor.token == "https://localhost/next"
    with pytest.raises(Failed):
        cn.Drive(d.client, " ").test()


def test_selected():
    sources = [{"source_id": "a"}, {"source_id": "b", "enabled": False}, {"source_id": "c"}]
    assert [s["source_id"] for s in cn.selected(sources)] == ["a", "c"] and cn.selected(sources, ["b", "c"]) == sources[2:]
    assert [cn.graph_time(x) for x in (None, "", "no", "2024-01-01T00:00:00+02:00")][:3] == [None] * 3
