"""Quality rules with robust multivariate outliers.

Each text gives statistics (words, symbols, repeated lines and phrases) and a
vector of six transformed shares. Per language and source, the location and
scatter of the vectors are estimated by minimum covariance determinant: from
four deterministic starts, concentration steps keep the ``SHARE`` of rows with
least Mahalanobis distance and estimate again; after ``TRIALS`` steps the start
of least determinant goes on until its determinant settles. Rows whose distance
lies beyond a quantile of the chi-squared distribution are rejected, besides
those that fail the base rules.

All rows of a group enter its estimate, however small it is. Languages and the
whole table are groups too: a source's estimate is a mixture of its own with
``PRIOR`` rows like its language's, a language's with as many like all's, so
that estimates of few rows lean on others by degrees.

A step is one aggregate with map-side combining: rows fall into bins by the
logarithm of their distance, and counts, sums and products of each bin tell
both where SHARE is reached and the moments up to there. So a source with a
third of all rows costs no task more than its own splits. Estimates are one row
per group, kept as a table, and broadcast while they are few.

Defined cases: a null text has no words and fails the base rules, as does an
empty one; null languages and sources are values of their own; repeated rows
count as often as they come; where no row passes the base rules nothing is
estimated and nothing kept; columns named like the results are replaced.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.functions.storage import spread
from quillspark.functions.tables import table
from quillspark.llm.common import WORD, joined, null_safe_key, slices, stored, tidy

SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\v\f\r"
#: Least standard deviation of each element of the vector: shares that are zero in most texts would else have none.
FLOORS = (0.15, 0.15, 0.12, 0.12, 0.2, 0.2)
P = len(FLOORS)
SHARE = 0.75
TRIALS = 2  # steps of every start before the one of least determinant goes on
STEPS, TOLERANCE = 20, 1e-4  # steps at most, and the least decrease of the determinant's logarithm for another one
PRIOR = 50.0  # rows of the language that count beside those of a source, and rows of all beside those of a language
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def chi2_cdf(x: float, even: int) -> float:
    """Of the chi-squared distribution with an even number of degrees of freedom."""
    return 1 - math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(even // 2))


def chi2_quantile(q: float, even: int) -> float:
    lo, hi = 0.0, 1000.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi2_cdf(mid, even) < q else (lo, mid)
    return lo


#: Makes the covariance of the nearest SHARE of normal rows that of all.
CONSISTENCY = SHARE / chi2_cdf(chi2_quantile(SHARE, P), P + 2)


def n_repeat_words(words: list[str]) -> int:
    """Words inside three-word windows that occur twice or more."""
    if len(words) < 4:
        return 0
    ids: dict[str, int] = {}
    a = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words))
    size = len(ids)
    pair = a[:-2] * size + a[1:-1]
    if size > 2_000_000:  # else the key of three fits 63 bits
        pair = np.unique(pair, return_inverse=True)[1]
    key = pair * size + a[2:]
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    if not same.any():
        return 0
    twice = np.zeros(len(key), bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    covered = np.zeros(len(words), bool)
    covered[:-2] |= twice
    covered[1:-1] |= twice
    covered[2:] |= twice
    return int(covered.sum())


def n_dup_lines(lines: list[str]) -> int:
    """Lines with a word that equal an earlier line."""
    if len(set(lines)) == len(lines):
        return 0
    full = [x for x in lines if x.strip(BLANKS)]
    return len(full) - len(set(full))


def _case_tables() -> bytes:
    """Of every code point, a bit for letters and a bit for upper case, packed."""
    chars = [chr(c) for c in range(0x110000)]
    return np.packbits(np.array([[c.isalpha() for c in chars], [c.isupper() for c in chars]])).tobytes()


def _counted(flag: np.ndarray, raw: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Of each text how many of its characters have the flag."""
    out = np.zeros(len(sizes), np.int64)
    if len(raw):
        starts = (np.cumsum(sizes) - sizes)[sizes > 0]
        out[sizes > 0] = np.add.reduceat(flag[raw].view(np.uint8), starts, dtype=np.int64)
    return out


def measured(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with STATS, base_failed and ``vec``, the vector of transformed shares (null if base_failed)."""
    tables = df.sparkSession.sparkContext.broadcast(_case_tables())
    made = [*STATS, "base_failed", "vec"]
    kept = df.drop(*(c for c in made if c != text)).columns
    find = re.compile(WORD).findall

    def run(batches):
        alpha, upper = np.unpackbits(np.frombuffer(tables.value, np.uint8)).astype(bool).reshape(2, -1)
        for whole in batches:
            for b in slices(whole, text, 1_000_000):
                texts = [t or "" for t in b.column(text).to_pylist()]
                raw = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
                sizes = np.fromiter(map(len, texts), np.int64, len(texts))
                letters, uppers = (_counted(x, raw, sizes) for x in (alpha, upper))
                rows, lines = [], []
                for t in texts:
                    words, split = find(t), t.split("\n")
                    rows.append((len(words), sum(map(len, words)), sum(map(t.count, SYMBOLS)), n_dup_lines(split), n_repeat_words(words)))
                    lines.append(len(split))
                n, chars, symbols, dup, rep = np.array(rows, np.int64).reshape(-1, 5).T
                failed = (n < 50) | (100 * rep > 50 * n)
                some = np.maximum(1, n)
                vec = np.stack(
                    [
                        np.log(chars / some + 0.1),
                        np.log(symbols / some + 0.1),
                        dup / np.maximum(1, lines),
                        rep / some,
                        np.log(uppers / np.maximum(1, letters) + 0.05),
                        np.log(np.maximum(0, chars - letters) / np.maximum(1, chars) + 0.05),
                    ],
                    axis=1,
                )
                vecs = [None if f else v for f, v in zip(failed.tolist(), vec.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [*(b.column(k) for k in kept), *map(pa.array, (n, chars, symbols, dup, rep, failed)), pa.array(vecs, pa.list_(pa.float64()))],
                    names=[*kept, *made],
                )

    types = [T.LongType()] * 5 + [T.BooleanType(), T.ArrayType(T.DoubleType())]
    fields = [*df.select(*kept).schema, *(T.StructField(n, t) for n, t in zip(made, types, strict=True))]
    return df.select(*kept).mapInArrow(tidy(run), T.StructType(fields))


X = [f"x{i}" for i in range(P)]
_PAIRS = [(i, j) for i in range(P) for j in range(i, P)]
#: Aggregated in each bin besides the number of rows: deviations from the location so far, and their products.
_MOMENTS = [*(f"s{i}" for i in range(P)), *(f"p{i}{j}" for i, j in _PAIRS)]
BINS_PER_OCTAVE = 8
_REAL, _REALS, _LIST = T.DoubleType(), T.ArrayType(T.DoubleType()), pa.list_(pa.float64())
#: (mu, cov, prec, logdet, n): location, scatter, inverse and determinant of the scatter with floors, rows of the group.
_STATE = T.StructType([T.StructField(c, t) for c, t in (("mu", _REALS), ("cov", _REALS), ("prec", _REALS), ("logdet", _REAL), ("n", _REAL))])


def distance(vec: Column, mu: Column, prec: Column) -> Column:
    """Squared Mahalanobis distance."""
    return _distance([vec[i] - mu[i] for i in range(P)], prec)


def _distance(off: list[Column], prec: Column) -> Column:
    parts = []
    for i in range(P):
        row = sum((prec[i * P + j] * off[j] for j in range(P)), F.lit(0.0))
        parts.append(off[i] * row)
    return sum(parts, F.lit(0.0))


def _moments(values: list[Column], prefix: str = "") -> list[Column]:
    """Sums and products of the values, as columns of an aggregate."""
    sums = [F.sum(v).alias(f"{prefix}s{i}") for i, v in enumerate(values)]
    return [*sums, *(F.sum(values[i] * values[j]).alias(f"{prefix}p{i}{j}") for i, j in _PAIRS)]


def _bin(d: Column) -> Column:
    """Distances in steps of an eighth of an octave."""
    return F.floor(F.log2(F.greatest(d, F.lit(1e-9))) * BINS_PER_OCTAVE).cast("int")


def _square(products: np.ndarray) -> np.ndarray:
    out = np.zeros((P, P))
    for (i, j), v in zip(_PAIRS, products, strict=True):
        out[i, j] = out[j, i] = v
    return out


def lifted(cov: np.ndarray) -> np.ndarray:
    """The scatter with no variance under its floor, and correlations a thousandth nearer to zero, so that few rows have an inverse too."""
    size = np.diag(cov)
    return cov * (1 - 1e-3) + np.diag(np.maximum(1e-3 * size, np.square(FLOORS) - (1 - 1e-3) * size))


def _state(mu: np.ndarray, cov: np.ndarray, n: float) -> dict:
    full = lifted(cov)
    return {"mu": mu.tolist(), "cov": cov.ravel().tolist(), "prec": np.linalg.inv(full).ravel().tolist(), "logdet": float(np.linalg.slogdet(full)[1]), "n": n}


def nearest(bins: np.ndarray, n: np.ndarray, moments: np.ndarray, share: float, mu: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Location and scatter (maximum likelihood) of the ``share`` of rows in the lowest bins.

    The bin at the border counts with the part of its rows that is wanted.
    """
    order = np.argsort(bins)
    n, moments = n[order], moments[order]
    weight = np.clip((share * n.sum() - (np.cumsum(n) - n)) / n, 0.0, 1.0)
    kept = weight @ moments / (weight @ n)
    off = kept[:P]
    return mu + off, _square(kept[P:]) - np.outer(off, off)


def _columns(rows: pa.Table, names: list[str]) -> np.ndarray:
    return np.stack([rows[c].to_numpy() for c in names], axis=1)


def _grouped(binned: DataFrame, keys: list[str], make) -> DataFrame:
    """What ``make`` of a group's bins gives, a list of (start, state); a group has as many rows as its distances span bins."""

    def run(rows: pa.Table) -> pa.Table:
        made = make(rows)
        own = {"grp": [rows["grp"][0].as_py()] * len(made), "start": [i for i, _ in made]}
        return pa.table(own | {f.name: [x[f.name] for _, x in made] for f in _STATE}, schema=shape)

    shape = pa.schema([("grp", pa.string()), ("start", pa.int32()), ("mu", _LIST), ("cov", _LIST), ("prec", _LIST), ("logdet", pa.float64()), ("n", pa.float64())])
    return binned.groupBy(*keys).applyInArrow(run, T.StructType([T.StructField("grp", T.StringType()), T.StructField("start", T.IntegerType()), *_STATE]))


def _starts(rows: DataFrame) -> DataFrame:
    """(grp, start, mu, cov, prec, logdet, n): four deterministic starts for each group.

    From medians and median absolute deviations: the nearest half and the
    nearest SHARE by them, the correlations of tanh of standardised values, and
    those of their spatial signs.
    """
    middle = stored(rows.groupBy("grp").agg(F.array(*(F.percentile_approx(x, 0.5, 10_000) for x in X)).alias("mid")), "quality-middle")
    off = joined(rows, middle, ["grp"], "inner")
    spread = [F.percentile_approx(F.abs(F.col(x) - F.col("mid")[i]), 0.5, 10_000) for i, x in enumerate(X)]
    scale = F.array(*(F.greatest(1.4826 * v, F.lit(f)) for v, f in zip(spread, FLOORS, strict=True)))
    wide = stored(off.groupBy("grp").agg(F.first("mid").alias("mid"), scale.alias("scale")), "quality-scale")
    z = joined(rows, wide, ["grp"], "inner")
    x = [F.col(c) - F.col("mid")[i] for i, c in enumerate(X)]
    z = z.select("grp", *(v.alias(f"s{i}") for i, v in enumerate(x)), *((v / F.col("scale")[i]).alias(f"z{i}") for i, v in enumerate(x)))
    squares = sum((F.col(f"z{i}") ** 2 for i in range(P)), F.lit(0.0))
    z = z.withColumn("d", squares)
    norm = F.sqrt(F.greatest("d", F.lit(1e-12)))
    flat = [F.tanh(f"z{i}") for i in range(P)], [F.col(f"z{i}") / norm for i in range(P)]
    binned = z.groupBy("grp", _bin(F.col("d")).alias("bin")).agg(
        F.count(F.lit(1)).cast("double").alias("n"), *_moments([F.col(f"s{i}") for i in range(P)]), *_moments(flat[0], "t"), *_moments(flat[1], "u")
    )
    def begin(rows: pa.Table) -> list[tuple[int, dict]]:
        mid, scale = (np.array(rows[c][0].as_py()) for c in ("mid", "scale"))
        bins, n = rows["bin"].to_numpy(), rows["n"].to_numpy()
        found = [nearest(bins, n, _columns(rows, _MOMENTS), share, mid) for share in (0.5, SHARE)]
        for k in "tu":
            total = _columns(rows, [k + c for c in _MOMENTS]).sum(axis=0) / n.sum()
            own = _square(total[P:]) - np.outer(total[:P], total[:P])
            size = np.sqrt(np.maximum(np.diag(own), 1e-12))
            found.append((mid, own / np.outer(size, size) * np.outer(scale, scale)))
        return [(i, _state(mu, cov, n.sum())) for i, (mu, cov) in enumerate(found)]

    return stored(_grouped(binned.join(F.broadcast(wide) if wide.count() <= 20_000 else wide, "grp"), ["grp"], begin), "quality-start")


def _step(rows: DataFrame, model: DataFrame) -> DataFrame:
    """A concentration step of every (grp, start): one aggregate with map-side combining over all rows."""
    off = [F.col(c) - F.col("mu")[i] for i, c in enumerate(X)]
    far = joined(rows, model.select("grp", "start", "mu", "prec"), ["grp"], "inner")
    far = far.select("grp", "start", "prec", *(v.alias(f"s{i}") for i, v in enumerate(off)))
    off = [F.col(f"s{i}") for i in range(P)]
    binned = far.groupBy("grp", "start", _bin(_distance(off, F.col("prec"))).alias("bin")).agg(F.count(F.lit(1)).cast("double").alias("n"), *_moments(off))
    old = model.select("grp", "start", "mu")
    binned = binned.join(F.broadcast(old) if old.count() <= 20_000 else old, ["grp", "start"])

    def again(rows: pa.Table) -> list[tuple[int, dict]]:
        n = rows["n"].to_numpy()
        mu, cov = nearest(rows["bin"].to_numpy(), n, _columns(rows, _MOMENTS), SHARE, np.array(rows["mu"][0].as_py()))
        return [(rows["start"][0].as_py(), _state(mu, cov, n.sum()))]

    made = _grouped(binned, ["grp", "start"], again)
    was = model.select("grp", "start", F.col("logdet").alias("was"))
    return stored(made.join(was, ["grp", "start"]), "quality-step")


def _least(model: DataFrame) -> DataFrame:
    """Of each group the start with the least determinant."""
    best = F.row_number().over(Window.partitionBy("grp").orderBy("logdet", "start"))
    return stored(model.withColumn("best", best).where("best = 1").drop("best"), "quality-best")


def concentrated(rows: DataFrame) -> DataFrame:
    """(grp, x0, ...) rows to (grp, mu, cov, prec, logdet, n): minimum covariance determinant of each group."""
    model = _starts(rows)
    for _ in range(TRIALS):
        model = _step(rows, model)
    open_, done = _least(model), []
    for _ in range(STEPS):
        open_ = _step(rows, open_)
        moving = F.col("was") - F.col("logdet") > TOLERANCE
        done.append(open_.where(~moving).drop("was"))
        open_ = open_.where(moving).drop("was")
        if open_.isEmpty():
            break
    done.append(open_)
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.drop("start")


def blended(own: tuple, prior: tuple) -> tuple[np.ndarray, np.ndarray]:
    """Location and scatter of a mixture of a group's (mu, cov, n) with PRIOR rows like ``prior``'s (mu, cov)."""
    (mu, cov, n), (mu0, cov0) = own, prior
    w = n / (n + PRIOR)
    return w * mu + (1 - w) * mu0, w * cov + (1 - w) * cov0 + w * (1 - w) * np.outer(mu - mu0, mu - mu0)


def estimates(vectors: DataFrame) -> DataFrame:
    """(lkey, skey, vec) rows to (lkey, skey, mu, prec), by minimum covariance determinant."""
    names = F.array(F.concat(F.lit("s|"), F.length("lkey"), F.lit("|"), "lkey", "skey"), F.concat(F.lit("l|"), "lkey"), F.lit("all"))
    parts = [F.col("vec")[i].alias(x) for i, x in enumerate(X)]
    rows = vectors.select(F.explode(names).alias("grp"), *parts)
    model = stored(concentrated(rows), "quality-mcd").select("grp", "mu", "cov", "n")
    groups = vectors.select("lkey", "skey", names.alias("g")).distinct()
    for i, level in enumerate("sla"):
        m = model.select(F.col("grp").alias("own"), F.struct("mu", "cov", "n").alias(level))
        groups = groups.withColumn("own", F.col("g")[i]).join(m, "own").drop("own")

    @F.pandas_udf("struct<mu:array<double>,prec:array<double>>")
    def shrunk(s: pd.DataFrame, l: pd.DataFrame, a: pd.DataFrame) -> pd.DataFrame:  # noqa: E741
        out = []
        for rows in zip(*(zip(x["mu"], x["cov"], x["n"], strict=True) for x in (s, l, a)), strict=True):
            own, lang, every = ((np.array(mu), CONSISTENCY * np.array(cov).reshape(P, P), n) for mu, cov, n in rows)
            mu, cov = blended(own, blended(lang, every[:2]))
            out.append((mu.tolist(), np.linalg.inv(lifted(cov)).ravel().tolist()))
        return pd.DataFrame(out, columns=["mu", "prec"])

    return stored(groups.select("lkey", "skey", shrunk("s", "l", "a").alias("m")).select("lkey", "skey", "m.mu", "m.prec"), "quality-model")


def keyed(df: DataFrame, lang: str = "lang", source: str = "source") -> DataFrame:
    return df.withColumn("lkey", null_safe_key(lang)).withColumn("skey", null_safe_key(source))


def judged(rows: DataFrame, model: DataFrame, tail: float = 1e-6) -> DataFrame:
    """measured() and keyed() rows with ``distance`` and ``kept``; a group without an estimate keeps what passes the base rules."""
    far = distance(F.col("vec"), F.col("mu"), F.col("prec"))
    rows = joined(rows, model, ["lkey", "skey"]).withColumn("distance", far)
    kept = ~F.col("base_failed") & (F.coalesce("distance", F.lit(0.0)) <= chi2_quantile(1 - tail, P))
    return rows.withColumn("kept", kept).drop("lkey", "skey", "mu", "prec", "vec")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics and verdict of every document."""
    docs = table(spark, sf_dir, "documents")
    rows = measured(spread(docs.select("doc_id", "lang", "source", "text")))
    rows = stored(keyed(rows).select("doc_id", "lkey", "skey", *STATS, "base_failed", "vec"), "quality-stats")
    model = estimates(rows.where("vec IS NOT NULL").select("lkey", "skey", "vec"))
    return judged(rows, model).select("doc_id", *STATS, "base_failed", "kept", "distance")


def quality_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The statistics and base rules of every document, without a verdict."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return measured(docs).select("doc_id", *STATS, "base_failed")


QUALITY_BASE_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, doc_id, t, regexp_extract_all(t, '{WORD}') AS w FROM d),
p AS (SELECT r, unnest(range(1, len(w) - 1)) AS i, w FROM w WHERE len(w) > 2),
k AS (SELECT r, i, count(*) OVER (PARTITION BY r, w[i], w[i + 1], w[i + 2]) AS n FROM p),
c AS (SELECT r, count(DISTINCT j) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS j FROM k WHERE n > 1) GROUP BY r),
l AS (SELECT r, unnest(string_split(t, chr(10))) AS line FROM d),
x AS (SELECT r, count(*) - count(DISTINCT line) AS n FROM l WHERE regexp_matches(line, '{WORD}') GROUP BY r),
s AS (SELECT w.r, doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda v: length(v))), 0)::BIGINT AS word_chars,
             length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(x.n, 0) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words
      FROM w LEFT JOIN x USING (r) LEFT JOIN c USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM s
"""
