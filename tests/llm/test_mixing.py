import math
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from quillspark.llm import mixing


def exponents(shares, goal):
    def h(a):
        x = [p**a for p in shares]
        return -sum(v / sum(x) * math.log(v / sum(x)) for v in x)

    lo, hi = 0.0, 1.0
    for _ in range(50):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if h(mid) >= goal else (lo, mid)
    return lo


def test_weights_meet_entropy(spark):
    tokens = [7000, 1000, 900, 100]
    src = spark.createDataFrame([(f"v{i}", t) for i, t in enumerate(tokens)], "skey string, tokens long")
    rows = mixing.weights(src, "total", 0.9, 100.0).collect()
    a = exponents([t / 9000 for t in tokens], 0.9 * math.log(4))
    for r in rows:
        assert abs(r.exponent - a) < 1e-9
        assert abs(r.weight - r.tokens**a / sum(t**a for t in tokens)) < 1e-9
        assert r.epochs * r.tokens + r.rest == r.budget
    limited = mixing.weights(src, "total", 0.9, 2.0).collect()
    assert max(r.budget / r.tokens for r in limited) <= 2.0 + 1e-6 and limited[0].exponent > a
    cover = mixing.weights(src, "cover", 0.9, 3.0).collect()
    assert min(r.epochs for r in cover) == 1 and max(r.budget / r.tokens for r in cover) <= 3.0 + 1e-6


def test_draws_keep_to_the_budget(spark):
    rows = [(i, "big" if i % 3 else None if i % 2 else "small", "w " * (1 + i % 7), "x") for i in range(600)]
    rows += [(1000, "mute", None, "x"), (1000, "mute", "", "x"), (None, "big", "a b", "x"), (5, "big", "same id", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string, mix_slot string")
    got = mixing.draw(docs, mixing.n_words(F.col("text")), n_blocks=8, budget="total", entropy=0.999, max_repeats=4.0).collect()
    per = defaultdict(Counter)
    for r in got:
        per[r.source][r.mix_epoch] += r.mix_tokens
    whole = Counter()
    for _, s, t, _ in rows:
        whole[s] += len((t or "").split())
    sums = spark.createDataFrame([(s or "none", t) for s, t in whole.items()], "skey string, tokens long")
    plan = {r.skey: r for r in mixing.weights(sums, "total", 0.999, 4.0).collect()}
    for s in ("big", "small", None):
        p = plan[s or "none"]
        assert all(per[s][e] == whole[s] for e in range(p.epochs))
        assert p.rest - 8 <= per[s][p.epochs] <= p.rest
    assert sum(r.source == "mute" for r in got) == 2
    assert mixing.draw(docs.limit(0), mixing.n_words(F.col("text"))).count() == 0
