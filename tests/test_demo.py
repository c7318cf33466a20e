import pytest

from quillspark.plans.workspace import Workspace
from quillspark.sources import demo
from quillspark.sources.files import Crawl


@pytest.fixture(scope="module")
def workspace(spark, tmp_path_factory):
    top = tmp_path_factory.mktemp("demo")
    demo.write(f"{top}/files")
    w = Workspace(spark, f"{top}/ws")
    w.found = w.index(Crawl(f"{top}/files"))
    return w


def test_counts(workspace):
    assert len(demo.files()) == demo.EXPECTED["files"]
    assert workspace.found == {"indexed": 20, "empty": 2, "corrupted": 2}


@pytest.mark.parametrize("how", list(demo.SPELLINGS))
def test_account_in_every_spelling(workspace, how):
    first = workspace.search(demo.SPELLINGS[how], limit=10)
    second = workspace.search(demo.SPELLINGS[how], limit=10, offset=10)
    ids = {r.doc_id for r in first.hits.collect()} | {r.doc_id for r in second.hits.collect()}
    assert first.total == demo.EXPECTED["account"] == len(ids)


@pytest.mark.parametrize("spelling", demo.DATE)
def test_date_in_every_spelling(workspace, spelling):
    assert workspace.search(spelling).total == demo.EXPECTED["date"]


def test_words_with_and_without_marks(workspace):
    assert workspace.search("ogólna").total == workspace.search("OGOLNA").total == 3
    assert workspace.search("nieobecne").total == 0
