import hashlib

import numpy as np

from quillspark.llm import warc

BIG = "x" * 1200
FAKE = f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <{warc.URN}99>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"


def test_pointer_jumping_against_walk():
    r = np.random.default_rng(1)
    for _ in range(200):
        n = int(r.integers(1, 60))
        places = np.sort(r.choice(300, n, replace=False))
        places[0] = r.integers(0, places[0] + 1)
        successors = places + r.integers(1, 20, n)
        walked, at = set(), 0
        while at in places.tolist():
            walked.add(at)
            at = int(successors[places.tolist().index(at)])
        assert set(places[warc.reached(places, successors)].tolist()) == walked


def run(spark, tmp_path, rows, split=None):
    spark.createDataFrame(rows, "page_id long, url string, html string, digest int").repartition(2).write.parquet(f"{tmp_path}/pages.parquet")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split or old)
    try:
        return {r.page_id: r for r in warc.op7_warc(spark, str(tmp_path)).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_magic_inside_payloads_and_copies(spark, tmp_path):
    pages = {
        1: BIG, 2: BIG, 3: BIG, 4: "small", 5: "small", 6: None, 7: FAKE, 8: FAKE * 30 + "end", 9: "WARC/1.1\r\n", 10: "\r\n\r\n", 11: "é" * 600,
        12: "WARC/1.1\r\n" * 200, 13: "y" * 999, 14: "y" * 999, 15: " " * 400 + FAKE,
    }
    for split in (None, "400b"):
        folder = tmp_path / str(split)
        got = run(spark, folder, [(k, None if k == 4 else f"http://h/ {k}\r\n", v, 0) for k, v in pages.items()], split)
        assert sorted(got) == sorted(pages)
        for k, v in pages.items():
            raw = (v or "").encode()
            assert (got[k].payload_bytes, got[k].payload_digest) == (len(raw), hashlib.sha1(raw).hexdigest()), k
            assert (got[k].record_type, got[k].refers_to) == (("revisit", 3) if k in (1, 2) else ("response", None))


def test_empty_table_and_broken_files(spark, tmp_path):
    assert run(spark, tmp_path, []) == {}
    for i, text in enumerate(["junk" + FAKE, FAKE + "junk" + FAKE, FAKE[:-20]]):
        (tmp_path / f"a{i}").mkdir()
        (tmp_path / f"a{i}" / "x.warc").write_bytes(text.encode())
    assert [warc.read(spark, f"{tmp_path}/a{i}").count() for i in range(3)] == [0, 1, 1]
