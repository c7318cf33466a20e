import random
import re
from collections import Counter
from itertools import combinations

import numpy as np

from quillspark.llm import quality
from quillspark.llm.common import WORD


def brute(text):
    words = re.findall(WORD, text or "")
    lines = [x for x in (text or "").split("\n") if re.search(WORD, x)]
    windows = Counter(zip(words, words[1:], words[2:], strict=False))
    covered = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    dup = sum(x in lines[:i] for i, x in enumerate(lines))
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(covered)


def sample(seed, n=120):
    r = random.Random(seed)
    return "\n".join(" ".join("".join(r.choices("abcdeiou", k=r.randint(2, 8))) for _ in range(12)).capitalize() + "." for _ in range(n // 12))


TEXTS = [None, "", "\x1c \xa0", "a b c a b c", "x\n x\nx\n\n\n \n \nx", "é|<># \x85", "la " * 4000, "a b c d a b c", sample(1), sample(2) + "\n" + sample(2), "w" * 200_000]


def test_statistics_against_brute_force(spark):
    df = spark.createDataFrame([(i, t, 0) for i, t in enumerate(TEXTS)], "doc_id long, text string, vec int")
    for r in quality.measured(df).collect():
        want = brute(TEXTS[r.doc_id])
        assert tuple(r[c] for c in quality.STATS) == want, TEXTS[r.doc_id]
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0]) == (r.vec is None)


def test_many_distinct_words():
    words = [str(i) for i in range(2_100_000)]
    assert quality.n_repeat_words([*words, "0", "1", "2"]) == 6


def rows_of(spark, groups):
    rows = [(g, *v.tolist()) for g, vs in groups.items() for v in vs]
    return spark.createDataFrame(rows, "grp string, " + ", ".join(f"{x} double" for x in quality.X)).repartition(3)


def exhaustive(v):
    """The subset of SHARE of the rows whose scatter has the least determinant, by trying all."""
    h = round(quality.SHARE * len(v))
    best = min(combinations(range(len(v)), h), key=lambda s: np.linalg.slogdet(quality.lifted(np.cov(v[list(s)].T, bias=True)))[1])
    return v[list(best)]


def test_least_determinant_against_all_subsets(spark):
    """Groups of 16 rows: the steps end in the subset that is best of all 1,820, for outliers all around or along one direction.

    (Of so few rows in six dimensions, a tight cluster of outliers has the least determinant itself.)
    """
    r = np.random.default_rng(8)
    groups = {}
    for k in range(6):
        good = r.normal(0, 1, (12, 6)) * [0.5, 1, 2, 1, 1, 3]
        bad = r.normal(0, 1, (4, 6)) * [15, 40, 90][k % 3] if k < 3 else np.outer([20, -35, 50, 80], r.normal(0, 1, 6)) + r.normal(0, 1, (4, 6))
        groups[f"g{k}"] = np.concatenate((good, bad))[r.permutation(16)]
    found = {x.grp: x for x in quality.concentrated(rows_of(spark, groups)).collect()}
    for g, v in groups.items():
        best = exhaustive(v)
        least = np.linalg.slogdet(quality.lifted(np.cov(best.T, bias=True)))[1]
        assert found[g].logdet <= least + 1e-6, g
        assert np.allclose(found[g].mu, best.mean(axis=0), atol=1e-6), g


def test_steps_never_raise_the_determinant_and_end(spark):
    r = np.random.default_rng(3)
    cov = np.diag([0.5, 1, 2, 1, 1, 3.0]) + 0.3
    good, bad = r.multivariate_normal(np.arange(6), cov, 3000), r.multivariate_normal(np.full(6, 30.0), np.eye(6), 700)
    rows = rows_of(spark, {"a": np.concatenate((good, bad)), "one": good[:1], "same": np.repeat(good[:1], 9, axis=0)})
    got = {x.grp: x for x in quality.concentrated(rows).collect()}
    assert np.abs(np.array(got["a"].mu) - np.arange(6)).max() < 0.15
    scatter = quality.CONSISTENCY * np.array(got["a"].cov).reshape(6, 6)
    assert (np.abs(scatter - cov) / np.sqrt(np.outer(np.diag(cov), np.diag(cov)))).max() < 0.3  # of the good ones more than SHARE are kept
    assert np.allclose(got["one"].mu, good[0]) and np.allclose(got["same"].mu, good[0])
    model = quality._starts(rows).where("grp = 'a'")
    logdet = [min(x.logdet for x in model.collect())]
    for _ in range(5):
        model = quality._step(rows.where("grp = 'a'"), model)
        logdet.append(min(x.logdet for x in model.collect()))
    assert all(b <= a + 1e-3 for a, b in zip(logdet[1:], logdet[2:], strict=False)) and abs(logdet[-1] - got["a"].logdet) < 0.01


def test_small_groups_lean_on_their_language(spark):
    r = np.random.default_rng(4)
    many, few = r.normal(0, 1, (2000, 6)), r.normal(3, 1, (5, 6))
    rows = [("va", "vbig", v.tolist()) for v in many] + [("va", "vfew", v.tolist()) for v in few] + [("n", "n", few[0].tolist())]
    model = {x.lkey + x.skey: x for x in quality.estimates(spark.createDataFrame(rows, "lkey string, skey string, vec array<double>")).collect()}
    assert len(model) == 3
    big, small = np.array(model["vavbig"].mu), np.array(model["vavfew"].mu)
    assert np.abs(big).max() < 0.15 and (small > 0.1).all() and (small < 0.6).all()


def test_query_rejects_junk_and_keeps_clean(spark, tmp_path):
    rows = [(i, sample(i), "en" if i % 2 else None, "s", 0) for i in range(300)]
    junk = {1000 + i: sample(5000 + i).replace(" ", "### ") for i in range(10)}
    rows += [(k, t, "en", "s", 0) for k, t in junk.items()] + [(2000, None, None, None, 0), (2001, sample(77), "new", None, 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, kept int").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in quality.op5_quality(spark, str(tmp_path)).collect()}
    assert len(got) == len(rows)
    assert [k for k, r in got.items() if not r.kept] and {k for k, r in got.items() if not r.kept} == {*junk, 2000}
    spark.createDataFrame([], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/none/documents.parquet")
    assert quality.op5_quality(spark, f"{tmp_path}/none").count() == 0
