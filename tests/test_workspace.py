import json

from pyspark.sql import functions as F

from quillspark.__main__ import main
from quillspark.plans.workspace import Workspace, context_header
from quillspark.sources.files import Crawl


def test_incremental_index(spark, tmp_path):
    root = tmp_path / "files"
    (root / "sub").mkdir(parents=True)
    (root / "alfa.txt").write_text("alfa umowa z dnia 24.07.2015")
    (root / "sub" / "beta.csv").write_text("rachunek;kwota\n12 3456 7890;314 zł\n")
    (root / "bad.docx").write_bytes(b"PK\x03\x04junk")
    w = Workspace(spark, str(tmp_path / "ws"))
    assert w.index(Crawl(str(root))) == {"corrupted": 1, "indexed": 2}
    assert w.search("umowa").total == 1 and w.search("2015-07-24").total == 1
    assert [h.name for h in w.hits(w.search("1234567890")).collect()] == ["beta.csv"]
    before = {r.doc_id: r.seen_scan_id for r in w.documents().collect()}
    (root / "alfa.txt").write_text("gamma zamiast tego")
    (root / "sub" / "beta.csv").unlink()
    assert w.index(Crawl(str(root))) == {"corrupted": 1, "indexed": 1}
    assert w.search("umowa").total == 0 and w.search("gamma").total == 1 and w.search("1234567890").total == 0
    assert {r.doc_id: r.seen_scan_id for r in w.documents().collect()}.keys() < before.keys()
    found = {r.finding: r.n for r in w.check().collect()}
    assert set(found) == {"orphan_chunks", "indexed_without_chunks", "chunks_without_vector", "vectors_without_chunk", "chunk_ids_used_twice", "postings_that_differ"} and not any(found.values())
    w.reindex_all()
    assert w.report().first().pending == 1
    assert w.index(Crawl(str(root)))["indexed"] == 1
    w.remove(w.documents().where("name = 'alfa.txt'").select("doc_id"))
    w.compact()
    assert w.chunks().count() == 0 and w.documents().count() == 1


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "f").mkdir()
    (tmp_path / "f" / "a.txt").write_text("jedno słowo")
    ws = str(tmp_path / "ws")
    assert main([ws, "index", str(tmp_path / "f")]) == 0
    main([ws, "search", "słowo"])
    main([ws, "report", "--csv-out", str(tmp_path / "r.csv")])
    lines = capsys.readouterr().out.strip()
    assert '"total": 1' in lines and '"indexed": 1' in lines and (tmp_path / "r.csv").read_bytes().startswith(b"\xef\xbb\xbf")
    assert json.loads(lines.split("\n")[0]) == {"indexed": 1}


def test_context_header(spark):
    df = spark.createDataFrame([("a.txt", "x/y/a.txt", "lib"), ("b", "b", ""), ("c", "p" * 200 + "/" + "q" * 100 + "/c", "l")], "n string, p string, l string")
    got = [r.h for r in df.select(context_header(F.col("n"), F.col("p"), F.col("l")).alias("h")).collect()]
    assert got == ["Plik: a.txt\nŚcieżka: lib/x/y", "Plik: b", "Plik: c\nŚcieżka: …/" + "q" * 100]
