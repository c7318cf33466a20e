"""Language identification by a bit-sliced Bloom filter over character n-grams.

One row of bits per position of the filter, one column per language: the row
of a position is a mask of the languages that have set it. The rows at an
n-gram's k positions, and-ed, are the mask of all languages that (seem to)
contain it. Over a text, the popcount of each language's column is corrected
for false positives, of which the column's share of set bits to the power k is
the rate; the language with most n-grams left decides.

Fitting takes at most ``max_rows`` rows of each language, those with the least
hash of their text, so that copies and order do not matter; all their n-grams
that occur in ``min_rows`` texts and a share ``min_share`` of them enter the
filter, whose size follows from their number. Scoring covers whole texts in
Arrow batches with numpy; the filter is broadcast (a power of two of rows, one
word per 64 languages each).

Defined cases: a text that is null or has no letter is ``und`` with score 0;
a text without any known n-gram takes the first language in order, with score
1 / languages; ties take the first in order; rows with a null language teach
nothing; without training rows all are ``und``; other columns are kept.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.functions.storage import spread
from quillspark.functions.tables import table
from quillspark.llm.common import crc_mod, slices, stored, tidy

UND = "und"
SIZES = (3, 4)


def _letters() -> np.ndarray:
    """Of every code point, whether it is a letter."""
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def grams(texts: list[str | None], letters: np.ndarray):
    """Hashes of the n-grams of all texts, the text that each belongs to, and whether each text has a letter.

    Texts are lower-cased; runs of other characters than letters count as one
    blank, as do both ends. An n-gram has no blank but at its ends.
    """
    lower = [f" {t.lower()} " if t else "  " for t in texts]
    sizes = np.fromiter(map(len, lower), np.int64, len(lower))
    raw = np.frombuffer("".join(lower).encode("utf-32-le", "surrogatepass"), np.uint32)
    owner = np.repeat(np.arange(len(lower), dtype=np.int32), sizes)
    is_letter = letters[raw]
    keep = is_letter.copy()
    keep[1:] |= is_letter[:-1]  # the first blank after a letter
    first = np.cumsum(sizes) - sizes
    keep[first] = True
    code, owner, is_letter = np.where(is_letter, raw, 32)[keep].astype(np.uint64), owner[keep], is_letter[keep]
    has = np.bincount(owner[is_letter], minlength=len(lower)) > 0
    hashes, owners = [], []
    for n in SIZES:
        if len(code) < n:
            continue
        end = len(code) - n + 1
        fits = owner[:end] == owner[n - 1 :]
        for inner in range(1, n - 1):
            fits &= is_letter[inner : inner + end]
        h = np.zeros(end, np.uint64)
        for i in range(n):
            h = (h << np.uint64(21)) ^ (h >> np.uint64(43)) ^ code[i : i + end]
        hashes.append(_mix(h[fits] + np.uint64(n)))
        owners.append(owner[:end][fits])
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(0, np.int32), has
    return np.concatenate(hashes), np.concatenate(owners), has


@dataclass
class Model:
    languages: list[str]
    rows: np.ndarray  # bits x words of 64 languages
    rates: np.ndarray  # of false positives, per language
    hashes: int

    @classmethod
    def build(cls, languages: list[str], grams_of: list[np.ndarray], bits: int, hashes: int) -> Model:
        rows = np.zeros((bits, max(1, -(-len(languages) // 64))), np.uint64)
        rates = np.zeros(len(languages))
        for i, g in enumerate(grams_of):
            at = np.unique(cls.positions(g, bits, hashes).ravel())
            rows[at, i // 64] |= np.uint64(1) << np.uint64(i % 64)
            rates[i] = (len(at) / bits) ** hashes
        return cls(languages, rows, rates, hashes)

    @staticmethod
    def positions(grams: np.ndarray, bits: int, hashes: int) -> np.ndarray:
        low, high = grams & np.uint64(0xFFFFFFFF), grams >> np.uint64(32) | np.uint64(1)
        return np.stack([((low + np.uint64(i) * high) & np.uint64(bits - 1)).astype(np.int64) for i in range(hashes)])

    def masks(self, grams: np.ndarray) -> np.ndarray:
        at = self.positions(grams, len(self.rows), self.hashes)
        out = self.rows[at[0]]
        for p in at[1:]:
            out &= self.rows[p]
        return out

    def counts(self, grams: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Corrected counts per text and language, and n-grams per text."""
        totals = np.bincount(owner, minlength=n).astype(float)
        masks, out = self.masks(grams), np.zeros((n, len(self.languages)))
        for i in range(len(self.languages)):
            hit = (masks[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1)
            out[:, i] = np.bincount(owner, weights=hit, minlength=n)
        expected = totals[:, None] * self.rates
        return np.maximum(0, out - expected) / np.maximum(1e-9, 1 - self.rates), totals


def fit(
    train: DataFrame, text: str = "text", lang: str = "lang", max_rows: int = 2000, min_rows: int = 2, min_share: float = 0.02, bits_per_gram: int = 12, hashes: int = 3
) -> Model:
    """A model of the languages in ``train``, from about ``max_rows`` rows of each.

    An n-gram belongs to a language if ``min_rows`` and ``min_share`` of the
    distinct texts that were taken of it have it; the filter has as many bits as
    the language with the most n-grams needs.
    """
    rows = train.select(F.col(lang).alias("lang"), F.col(text).alias("text")).where("lang IS NOT NULL AND text IS NOT NULL")
    sizes = {r.lang: r["count"] for r in rows.groupBy("lang").count().collect()}  # a row per language
    if not sizes:
        return Model([], np.zeros((1, 1), np.uint64), np.zeros(0), hashes)
    # the texts with the least hash: those below the share that max_rows are of all
    share = F.create_map(*(F.lit(x) for k, n in sizes.items() for x in (k, float(min(1.0, max_rows / n)))))
    low = (F.xxhash64("text") / F.lit(2.0**64) + 0.5) <= share[F.col("lang")]
    letters = _letters()

    def count(batches):
        for b in (part for whole in batches for part in slices(whole, "text", 500_000)):
            langs = b.column("lang").to_pylist()
            g, owner, _ = grams(b.column("text").to_pylist(), letters)
            order = np.lexsort((g, owner))
            g, owner = g[order], owner[order]
            first = np.append(True, (g[1:] != g[:-1]) | (owner[1:] != owner[:-1])) if len(g) else np.zeros(0, bool)
            frame = pd.DataFrame({"lang": np.array(langs, object)[owner[first]], "gram": g[first].view(np.int64)})
            yield pa.RecordBatch.from_pandas(frame.groupby(["lang", "gram"]).size().reset_index(name="n"), preserve_index=False)

    few = stored(rows.where(low).dropDuplicates(["lang", "text"]), "langid-sample")
    texts = {r.lang: r["count"] for r in few.groupBy("lang").count().collect()}
    seen = few.mapInArrow(tidy(count), "lang string, gram long, n long")
    least = F.create_map(*(F.lit(x) for k in sizes for x in (k, max(float(min_rows), min_share * texts.get(k, 0)))))
    seen = seen.groupBy("lang", "gram").agg(F.sum("n").alias("n")).where(F.col("n") >= least[F.col("lang")])
    table_ = seen.select("lang", "gram").toArrow()  # n-grams of the sample
    of, grams_ = np.array(table_["lang"].to_pylist(), object), table_["gram"].to_numpy().view(np.uint64)
    languages = sorted(sizes)
    sets = [np.sort(grams_[of == k]) for k in languages]
    bits = 1 << max(10, int(bits_per_gram * max(map(len, sets))).bit_length())
    return Model.build(languages, sets, bits, hashes)


def identify(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``df`` with lang_pred and score, in place of the text."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    letters = df.sparkSession.sparkContext.broadcast(np.packbits(_letters()))
    kept = df.drop(text, "lang_pred", "score").columns

    def run(batches):
        m, is_letter = shared.value, np.unpackbits(letters.value)[:0x110000].astype(bool)
        for whole in batches:
            for b in slices(whole, text, 500_000):
                g, owner, has = grams(b.column(text).to_pylist(), is_letter)
                names, scores = [UND] * b.num_rows, np.zeros(b.num_rows)
                if m.languages:
                    counts, totals = m.counts(g, owner, b.num_rows)
                    best = counts.argmax(axis=1)
                    share = counts / np.maximum(1, totals)[:, None]
                    odds = np.exp(20 * (share - share.max(axis=1, keepdims=True)))
                    top = 1 / odds.sum(axis=1)
                    names = [m.languages[i] if ok else UND for i, ok in zip(best.tolist(), has.tolist(), strict=True)]
                    scores = np.where(has, top, 0.0)
                yield pa.RecordBatch.from_arrays([*(b.column(k) for k in kept), pa.array(names), pa.array(scores)], names=[*kept, "lang_pred", "score"])

    fields = [*df.select(*kept).schema, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
    return df.select(*kept, text).mapInArrow(tidy(run), T.StructType(fields))


def op6_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document; a third of the ids is held out from fitting."""
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.where(crc_mod("doc_id", 3) != 1).select("text", "lang"))
    rows = spread(docs.select("doc_id", (crc_mod("doc_id", 3) == 1).alias("held_out"), "text"))
    return identify(rows, model)
