import random

import numpy as np
import pytest

from quillspark.llm import neardup as nd


def jaccard(a, b):
    (ea, ca), (eb, cb) = a, b
    _, i, j = np.intersect1d(ea, eb, return_indices=True)
    least = np.minimum(ca[i], cb[j]).sum()
    return least / (ca.sum() + cb.sum() - least)


@pytest.mark.parametrize("whole", [True, False])
def test_signatures_agree_as_similarity_says(whole):
    r = np.random.default_rng(4)
    for size in (3, 60, 3000):
        agree, want = [], []
        for _ in range(12 if size > 100 else 60):
            e = np.sort(r.integers(0, 2**63, size, dtype=np.uint64))
            w = [r.integers(1, 4, size) if whole else r.uniform(0.1, 3, size) for _ in range(2)]
            a, b = (nd.dart_minhash(e, x) for x in w)
            agree.append((a == b).mean())
            want.append(np.minimum(*w).sum() / np.maximum(*w).sum())
        assert abs(np.mean(agree) - np.mean(want)) < 0.04


def test_shingles():
    h = nd.WordHashes()
    e, c = nd.shingles("a b c d e f a b c d e", h)
    assert len(e) == 6 and sorted(c) == [1, 1, 1, 1, 1, 2]
    assert len(nd.shingles("a b", h)[0]) == len(nd.shingles("a b c d e", h)[0]) == 1
    assert nd.shingles("a b", h)[0][0] != nd.shingles("a b b", h)[0][0]
    assert len(nd.shingles(None, h)[0]) == len(nd.shingles(" \n", h)[0]) == 0


def brute(texts):
    h, parent = nd.WordHashes(), {i: i for i in texts}
    sets = {i: nd.shingles(t, h) for i, t in texts.items()}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    inverse = {}
    for i, (e, _) in sets.items():
        for x in e.tolist():
            inverse.setdefault(x, []).append(i)
    for i, j in {(x[0], y) for x in inverse.values() for y in x[1:]} | {(x[k], y) for x in inverse.values() if len(x) < 200 for k in range(len(x)) for y in x[k + 1 :]}:
        if jaccard(sets[i], sets[j]) >= nd.THRESHOLD:
            a, b = root(i), root(j)
            parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in texts}


def edited(words, n, r):
    out = list(words)
    for i in r.sample(range(len(out)), n):
        out[i] = f"w{r.random()}"
    return " ".join(out)


def test_classes_against_brute_force(spark, tmp_path):
    r, texts, n = random.Random(9), {}, 0
    vocabulary = [f"v{i}" for i in range(500)]
    for group in range(60):
        base = r.choices(vocabulary, k=r.choice([30, 120, 400]))
        for _ in range(r.choice([1, 2, 3, 12])):
            texts[n] = edited(base, r.choice([0, 0, 1, len(base) // 60, len(base) // 25]), r)
            n += 1
    passage = " ".join(r.choices(vocabulary, k=60))
    for _ in range(50):
        texts[n] = passage + " " + " ".join(r.choices(vocabulary, k=70))
        n += 1
    for t in ("one two", "one two", "one  two", "three", " \n", "", None, "x " * 20_000, "x " * 20_000 + "y"):
        texts[n] = t
        n += 1
    rows = [(i, t, 0) for i, t in texts.items()] + [(None, "three", 0), (0, texts[0], 0)]
    r.shuffle(rows)
    spark.createDataFrame(rows, "doc_id long, text string, node int").write.parquet(f"{tmp_path}/documents.parquet")
    got = nd.op2_neardup(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    want = brute(texts)
    assert {x.doc_id: x.class_id for x in got if x.doc_id is not None} == want
    assert next(x.class_id for x in got if x.doc_id is None) == next(i for i, t in texts.items() if t == "three")


def test_large_group_of_near_copies(spark, monkeypatch):
    monkeypatch.setattr(nd, "LARGE", 40)
    monkeypatch.setattr(nd, "CARRY", 8)
    r = random.Random(3)
    base = [f"v{i}" for i in range(200)]
    texts = {i: edited(base, r.choice([0, 1, 2]) if i else 0, r) for i in range(300)}
    texts |= {1000 + i: edited([f"z{j}" for j in range(50)], 0, r) + f" {i}" for i in range(100)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {x.doc_id: x.class_id for x in nd.classes(df).collect()} == {i: 0 if i < 1000 else 1000 for i in texts}


def star(n, seed):
    """A text and n variants, each of a similarity of 126 / 156 to it and mostly under 0.7 to each other."""
    r = random.Random(seed)
    base, texts = [f"v{i}" for i in range(145)], {}
    for i in range(n + 1):
        out = list(base)
        for p in r.sample(range(5, 140, 5), 3) if i else ():
            out[p] = f"w{i}.{p}"
        texts[i] = " ".join(out)
    return texts


def test_a_false_edge_does_not_replace_a_true_one(spark):
    texts = star(1000, 1)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {x.class_id for x in nd.classes(df).collect()} == {0}


def test_links_near_the_threshold_in_buckets_over_large(spark, monkeypatch):
    monkeypatch.setattr(nd, "LARGE", 40)
    monkeypatch.setattr(nd, "CARRY", 8)
    df = spark.createDataFrame(list(star(400, 2).items()), "doc_id long, text string")
    assert {x.class_id for x in nd.classes(df).collect()} == {0}


def test_components_of_long_chains(spark):
    ids = list(range(200))
    random.Random(1).shuffle(ids)
    b = lambda i: i.to_bytes(4, "big")
    edges = [(b(min(x)), b(max(x))) for x in zip(ids, ids[1:])] + [(b(1000), b(1001)), (b(1001), b(1002))]
    got = {r.node: r.root for r in nd.components(spark.createDataFrame(edges, "a binary, b binary").repartition(7)).collect()}
    assert got == {b(i): b(0) for i in range(1, 200)} | {b(1001): b(1000), b(1002): b(1000)}


def test_empty_table(spark):
    assert nd.classes(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def links_of(texts):
    """Every pair with the similarity, by an inverted index over shingles."""
    h = nd.WordHashes()
    sets = {i: nd.shingles(t, h) for i, t in texts.items()}
    inverse, pairs = {}, set()
    for i, (e, _) in sets.items():
        for x in e.tolist():
            inverse.setdefault(x, []).append(i)
    for own in inverse.values():
        pairs.update((i, j) for k, i in enumerate(own) for j in own[k + 1 :])
    return {(i, j) for i, j in pairs if jaccard(sets[i], sets[j]) >= nd.THRESHOLD}


def test_recall_of_links_on_generated_documents(spark):
    """Of all true links between different texts, those inside one class; and no class has a pair that no link connects."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    first, same = {}, {}
    for r in docs.orderBy("doc_id").collect():
        first.setdefault(r.text, r.doc_id)
        same[r.doc_id] = first[r.text]
    texts = {i: t for t, i in first.items()}
    links = links_of(texts)
    got = {r.doc_id: r.class_id for r in nd.op2_neardup(spark, "/root/testdata/sf0.01").collect()}
    assert len(links) >= 4 and sum(got[i] == got[j] for i, j in links) == len(links)
    assert all(got[i] == got[j] for i, j in same.items() if texts[j] and texts[j].strip())
    assert {i: got[i] for i in texts} == {i: min(k for k in same if same[k] == c) for i, c in ((i, c) for i, c in brute(texts).items())}


@pytest.mark.parametrize("nodes", [0, 10**9])
def test_units_by_filter_or_by_join(spark, monkeypatch, nodes):
    monkeypatch.setattr(nd, "FILTER_NODES", nodes)
    docs = nd.nodes_of(spark.createDataFrame([(i, f"t{i} b c d e f") for i in range(50)] * 2 + [(99, None)], "doc_id long, text string"))
    wanted = docs.where("doc_id < 10").select("node").distinct()
    got = {bytes(r.node): len(r.units) for r in nd.expanded(docs.select("node", "text"), wanted).collect()}
    need = {bytes(r.node) for r in wanted.collect()}
    assert need <= set(got) and set(got.values()) == {2} and (nodes or set(got) == need)


def test_hot_keys_beyond_the_broadcast(spark, monkeypatch):
    """All joins salted instead of broadcast: the same classes."""
    from quillspark.llm import common

    plain = common.joined
    monkeypatch.setattr(nd, "joined", lambda *a, **k: plain(*a, **k, most=0))
    r, base = random.Random(6), [f"v{i}" for i in range(120)]
    rows = [(i, edited(base, i % 3 % 2, r)) for i in range(1500)] + [(5000 + i, f"one of a kind {i} x{i} y{i}") for i in range(300)] + [(9000, None), (9001, None)]
    got = {x.doc_id: x.class_id for x in nd.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: 0 if i < 5000 else i for i, _ in rows}
