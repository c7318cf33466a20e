import os

import pytest
from pyspark.sql import functions as F

from quillspark.llm import common


@pytest.mark.parametrize("most, size, weight", [(20_000, None, None), (2, None, None), (2, "n", None), (20_000, None, 1e9)])
def test_joined_whatever_the_side(spark, monkeypatch, most, size, weight):
    """Broadcast, counted, with known sizes, and a side of few but wide rows: the same rows each time, hot keys salted."""
    rows = spark.createDataFrame([(f"g{i % 5 if i % 2 else 0}", i) for i in range(4000)], "grp string, i int").repartition(3)
    sizes = {f"g{k}": sum((i % 5 if i % 2 else 0) == k for i in range(4000)) for k in range(5)}
    side = spark.createDataFrame([(f"g{k}", k, sizes[f"g{k}"]) for k in range(4)], "grp string, m int, n int")
    for how in ("left", "inner"):
        got = common.joined(rows, side, ["grp"], how, most=most, size=size, weight=None if weight is None else F.lit(weight)).collect()
        want = {(i, k if k < 4 else None) for i in range(4000) for k in [i % 5 if i % 2 else 0] if how == "left" or k < 4}
        assert len(got) == len(want) and {(r.i, r.m) for r in got} == want


def test_scratch_is_shared_or_local_and_can_be_cleaned(spark, monkeypatch):
    df = common.stored(spark.range(3), "kept")
    top = f"{spark.conf.get('spark.checkpoint.dir')}/quillspark-{spark.sparkContext.applicationId}"
    assert df.count() == 3 and os.path.isdir(top)
    common.cleanup(spark)
    assert not os.path.exists(top)

    class Far:
        class conf:
            get = staticmethod(lambda *_: None)

        class sparkContext:
            master = "spark://host:7077"

    with pytest.raises(RuntimeError):
        common.scratch(Far, "x")
