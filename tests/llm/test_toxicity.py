import math
import random
import zlib

import pytest

from quillspark.llm import toxicity


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        out = [i]
        for j, y in enumerate(b, 1):
            out.append(min(row[j] + 1, out[-1] + 1, row[j - 1] + (x != y)))
        row = out
    return row[-1]


def test_automaton_against_edit_distance():
    r = random.Random(5)
    terms = sorted({"".join(r.choices("abc", k=r.randint(3, 11))) for _ in range(25)} | {"idiot", "disgusting"})
    automaton = toxicity.Automaton(terms, max_states=300)
    for _ in range(1500):
        base = r.choice(terms)
        token = "".join(c for c in base if r.random() > 0.1)
        token = "".join(c + (r.choice("abcz") if r.random() < 0.1 else "") for c in token)
        near = [(distance(token, t), i) for i, t in enumerate(terms) if distance(token, t) <= toxicity.allowed_edits(t)]
        assert automaton.match(token) == (min(near) if near else None), token
    assert toxicity.Automaton([]).match("x") is None
    assert automaton.match("idi0t")[0] == 1 and automaton.match("dizgustinng")[0] == 2


def test_quotation_counts_less_than_abuse():
    model = toxicity.Model(["idiot"], [4.0])
    scorer = toxicity.Scorer(model)
    plain, quoted = scorer.hits("you are an idiot here"), scorer.hits('he said "you idiot" and left')
    assert [h["quoted"] for h in plain + quoted] == [False, True]
    assert plain[0]["context"] > 3 * quoted[0]["context"]
    assert scorer.hits("you are an 1diot")[0]["edits"] == 1
    assert scorer.hits(None) == scorer.hits("") == []
    text = "İİ you are an İdiot? no: an idiot"
    assert [text[h["start"] : h["end"]] for h in scorer.hits(text)][-1] == "idiot"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    r, path = random.Random(2), tmp_path_factory.mktemp("toxic")
    words = ["".join(r.choices("aeioulmnrst", k=r.randint(2, 7))) for _ in range(300)]
    bad = ["blorgface", "snarkwit", "grumpfoo"]
    rows, labels = [], []
    for i in range(900):
        text = r.choices(words, k=40)
        if i % 6 == 0:
            for _ in range(3):
                w = r.choice(bad)
                text.insert(r.randrange(40), w if i < 700 else w[:4] + "x" + w[5:])
        rows.append((i, " ".join(text), 1))
        labels += [(i, int(i % 6 == 0), 1)] * (1 + i % 2)
    copied = " ".join(r.choices([w + "q" for w in words], k=30))
    rows += [(2000 + i, copied, 1) for i in range(60)] + [(3000, None, 1), (3001, "", 1), (None, "snarkwit", 1), (3002, "snarkwit " * 50_000, 1)]
    labels += [(2000 + i, 1, 1) for i in range(60)] + [(None, 1, 1), (3001, None, 1)]
    spark.createDataFrame(rows, "doc_id long, text string, score int").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int, text int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def test_query(spark, folder):
    got = {r.doc_id: r for r in toxicity.op3_toxicity(spark, folder).collect()}
    assert len(got) == 964
    for i in range(900):
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0)
    wrong = [i for i in range(900) if got[i].predicted != (i % 6 == 0)]
    assert len(wrong) <= 9  # misspelled ones (from 700) are found too
    assert got[3000].score == got[3001].score < 0.5 and got[3000].predicted == 0
    assert got[3002].predicted == got[None].predicted == 1


def test_copies_teach_nothing(spark, folder):
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(docs, labels)
    assert {"blorgface", "grumpfoo", "snarkwit"} <= set(model.terms)
    assert not any(t.endswith("q") for t in model.terms)


def test_copies_remove_nothing(spark, folder):
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    want = toxicity.fit(docs, labels)
    text = "a blorgface b snarkwit c grumpfoo d"
    once, often = (docs.select("doc_id", "text").unionByName(spark.createDataFrame([(5000 + i, text) for i in range(n)], docs.select("doc_id", "text").schema)) for n in (1, 400))
    labels = labels.select("doc_id", "toxic").unionByName(spark.createDataFrame([(5000 + i, 1) for i in range(400)], "doc_id long, toxic int"))
    got = toxicity.fit(often, labels)
    assert set(want.terms) <= set(got.terms) and got == toxicity.fit(once, labels)


def test_no_labels_or_one_class(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    for labels, want in (([], 0), ([(1, 1)], 1), ([(1, 0)], 0)):
        model = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
        assert {r.predicted for r in toxicity.scored(docs, model).collect()} == {want}
    assert toxicity.scored(docs.limit(0), toxicity.Model([], [])).count() == 0


def test_query_against_brute_force(spark, folder):
    """Every score again, each token compared with every term by edit distance, windows and quotes found by splitting."""
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(docs, labels.where(toxicity.crc_mod("doc_id", 5) != 0))
    near: dict[str, tuple[int, int] | None] = {}

    def nearest(token):
        if token not in near:
            found = [(distance(token, t), i) for i, t in enumerate(model.terms) if abs(len(t) - len(token)) <= 2]
            near[token] = min(((e, i) for e, i in found if e <= toxicity.allowed_edits(model.terms[i])), default=None)
        return near[token]

    def score(text):
        tokens = (text or "").lower().split()
        hits = []
        for i, t in enumerate(tokens):
            if found := nearest(t):
                window = set(tokens[max(0, i - toxicity.WINDOW) : i + toxicity.WINDOW + 1])
                context = model.odds[found[1]] * 0.6 ** found[0] * (0.6 if window & toxicity.REPORT else 1) * (1.3 if window & toxicity.ADDRESS else 1)
                hits.append((context, found[0], found[1]))
        x = [0.0] * toxicity.FEATURES
        if hits:
            x = [max(c for c, _, _ in hits), math.log1p(sum(c for c, _, _ in hits)), float(any(e == 0 for _, e, _ in hits)),
                 math.log1p(sum(e > 0 for _, e, _ in hits)), math.log1p(len({t for _, _, t in hits})), 0.0]
        z = model.weights[0] + sum(w * v for w, v in zip(model.weights[1:], x, strict=True))
        return 1 / (1 + math.exp(-max(-30, min(30, z))))

    texts = {r.doc_id: r.text for r in docs.collect()}
    got = toxicity.op3_toxicity(spark, folder).collect()
    assert len(got) == len(texts)
    for r in got:
        want = score(texts[r.doc_id])
        assert abs(r.score - want) < 1e-9 and r.predicted == (want >= 0.5), r.doc_id


def test_held_out_on_generated_documents(spark):
    sf = "/root/testdata/sf0.1"
    truth = spark.read.parquet(f"{sf}/labels.parquet")
    rows = toxicity.op3_toxicity(spark, sf).where("held_out").join(truth, "doc_id").select("toxic", "predicted").collect()
    assert sum(r.toxic == r.predicted for r in rows) / len(rows) > 0.97
    toxic = [r.predicted for r in rows if r.toxic]
    assert sum(toxic) / len(toxic) > 0.88
    clean = [r.predicted for r in rows if not r.toxic]
    assert sum(clean) / len(clean) < 0.01
