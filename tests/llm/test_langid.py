import zlib

import numpy as np

from quillspark.llm import langid

LETTERS = langid._letters()
WORDS = {"aa": "banana mango papaya kiwi", "bb": "tzork grmpf wxyz qrst", "cc": "ñandú añejo señal caña"}


def brute_grams(text):
    words = "".join(c if c.isalpha() else " " for c in text.lower()).split()
    return sorted(f" {w} "[i : i + n] for w in words for n in langid.SIZES for i in range(len(w) + 3 - n))


def test_grams_against_brute_force():
    texts = ["One  two, thrée!", None, "", "1 2", "x", "a\U0001f600bc\n\nde", "İ ß"]
    g, owner, has = langid.grams(texts, LETTERS)
    known = {}
    for i, t in enumerate(texts):
        want = brute_grams(t or "")
        assert (owner == i).sum() == len(want)
        for h, w in zip(sorted(g[owner == i].tolist()), sorted(langid.grams([w.strip(" ") and t or ""], LETTERS)[0].tolist() for w in want[:1]), strict=False):
            known[h] = w
        assert has[i] == any(c.isalpha() for c in t or "")
    same = langid.grams(["mango", "mango mango"], LETTERS)
    assert sorted(same[0][same[1] == 0].tolist() * 2) == sorted(same[0][same[1] == 1].tolist())


def test_bit_slices_return_all_languages_and_correct_counts():
    sets = [np.array(x, np.uint64) * np.uint64(0x9E3779B97F4A7C15) for x in (range(1, 500), range(250, 900), range(2000, 2100))]
    m = langid.Model.build(["a", "b", "c"], sets, 1 << 14, 3)
    masks = m.masks(np.concatenate(sets))[:, 0]
    for i, s in enumerate(sets):
        assert ((m.masks(s)[:, 0] >> np.uint64(i)) & np.uint64(1)).all()
    assert masks.max() <= 7
    counts, totals = m.counts(sets[0], np.zeros(len(sets[0]), np.int32), 1)
    assert totals[0] == 499 and abs(counts[0, 0] - 499) < 1 and abs(counts[0, 1] - 250) < 15 and counts[0, 2] < 15
    many = langid.Model.build([str(i) for i in range(70)], [sets[0][i : i + 3] for i in range(70)], 1 << 12, 3)
    assert many.rows.shape[1] == 2 and many.counts(sets[0][69:72], np.zeros(3, np.int32), 1)[0].argmax() == 69


def test_query(spark, tmp_path):
    rows = [(i, f"{WORDS[k]} {WORDS[k].split()[i % 4]}.", k, 1) for i in range(300) for k in [list(WORDS)[i % 3]]]
    rows += [(1000, None, "aa", 1), (1001, "", None, 1), (1002, "12 !", "bb", 1), (1003, WORDS["bb"] * 20000, None, 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, score int").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in langid.op6_langid(spark, str(tmp_path)).collect()}
    assert len(got) == len(rows)
    for i, text, k, _ in rows[:300]:
        assert got[i].lang_pred == k and 0.5 < got[i].score <= 1
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1)
    assert [got[i].lang_pred for i in range(1000, 1004)] == ["und", "und", "und", "bb"]


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    truth = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    held = langid.op6_langid(spark, sf).where("held_out").join(truth, "doc_id")
    assert held.where("lang = lang_pred").count() >= 0.97 * held.count()


def test_nothing_to_learn_from(spark):
    df = spark.createDataFrame([("x", None)], "text string, lang string")
    assert langid.identify(df, langid.fit(df)).collect()[0].lang_pred == "und"
    assert langid.identify(df.limit(0), langid.fit(df)).count() == 0
