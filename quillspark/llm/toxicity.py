"""Toxicity by a fuzzy lexicon and the context of each hit.

A lexicon is learned from labelled texts: words whose document counts differ
between the classes beyond chance (a likelihood ratio, corrected for the number
of words) and that occur in many contexts, so that copies of one text teach
nothing. Its terms form a trie, which is intersected with Levenshtein automata
of the edits that each term's length allows. The product is determinised as
tokens drive it, so that a token costs a table look-up per character until no
term can follow.

Each hit is scored from its context window: inside quotation marks, or beside
words of reporting, it counts less, beside words of address more. A logistic
regression over the hits of a text gives the score.

Fitting takes at most ``max_rows`` labelled rows, those with the least hash of
their id; their ids and labels are broadcast, and their distinct texts, by hash,
are the training rows. No other text is shuffled. Scoring covers whole texts in
Arrow batches.

Defined cases: a null or empty text has no hits; repeated labels of an id or of
equal texts count once, as toxic if any is; null labels teach nothing; with one class or none the
score is that class's (0 without labels); other columns are kept.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.functions.storage import spread
from quillspark.functions.tables import table
from quillspark.llm.common import crc_mod, slices, stored, tidy

TOKEN = r"\w+"
QUOTED = "\"[^\"\n]*\"|“[^”\n]*”|«[^»\n]*»|„[^“”\n]*[“”]|‘[^’\n]*’"
#: Words that report speech, and words of address; fixed values in the four languages at hand.
REPORT = frozenset("said says say wrote writes quoted quote called calls reported word term dit écrit cité appelé mot sagte schrieb zitierte nannte wort dijo escribió citó llamó palabra".split())
ADDRESS = frozenset("you your you're u ur tu toi vous votre du dich dir dein sie ihr tú usted ustedes vosotros eres".split())
WINDOW = 6
FEATURES = 6


def allowed_edits(term: str) -> int:
    return 0 if len(term) < 5 else 1 if len(term) < 9 else 2


class Automaton:
    """The intersection of a lexicon's trie with Levenshtein automata, determinised lazily."""

    def __init__(self, terms: list[str], max_states: int = 100_000):
        self.terms, self.max_states = terms, max_states
        self.children: list[dict[str, int]] = [{}]
        self.term_at: list[int] = [-1]
        self.most: list[int] = [0]  # edits that some term below a node allows
        for i, term in enumerate(terms):
            node, edits = 0, allowed_edits(term)
            self.most[0] = max(self.most[0], edits)
            for c in term:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.term_at.append(-1)
                    self.most.append(0)
                node = self.children[node][c]
                self.most[node] = max(self.most[node], edits)
            self.term_at[node] = i
        self._clear()

    def _clear(self) -> None:
        self.ids: dict[tuple, int] = {}
        self.states: list[dict[int, int]] = []
        self.next: list[dict[str, int]] = []
        self.accepts: list[tuple[int, int] | None] = []
        self.start = self._state({0: 0})

    def _state(self, nodes: dict[int, int]) -> int:
        """The id of a set of nodes with the fewest edits that lead there, missing characters followed; -1 if empty."""
        todo = list(nodes)
        while todo:
            node = todo.pop()
            e = nodes[node] + 1
            for child in self.children[node].values():
                if e <= self.most[child] and e < nodes.get(child, 9):
                    nodes[child] = e
                    todo.append(child)
        if not nodes:
            return -1
        key = tuple(sorted(nodes.items()))
        if key not in self.ids:
            self.ids[key] = len(self.states)
            self.states.append(nodes)
            self.next.append({})
            ends = [(e, self.term_at[n]) for n, e in nodes.items() if self.term_at[n] >= 0 and e <= allowed_edits(self.terms[self.term_at[n]])]
            self.accepts.append(min(ends) if ends else None)
        return self.ids[key]

    def _step(self, state: int, c: str) -> int:
        out: dict[int, int] = {}

        def enter(node: int, e: int) -> None:
            if e <= self.most[node] and e < out.get(node, 9):
                out[node] = e

        for node, e in self.states[state].items():
            enter(node, e + 1)  # a character too many
            for x, child in self.children[node].items():
                enter(child, e + (x != c))
        return self._state(out)

    def match(self, token: str) -> tuple[int, int] | None:
        """(edits, term) of the nearest term within its edits, if any."""
        if len(self.states) > self.max_states:
            self._clear()
        s = self.start
        for c in token:
            table = self.next[s]
            t = table.get(c)
            if t is None:
                t = table[c] = self._step(s, c)
            if t < 0:
                return None
            s = t
        return self.accepts[s]


@dataclass
class Model:
    terms: list[str]
    odds: list[float]
    weights: list[float] = field(default_factory=lambda: [0.0] * (FEATURES + 1))

    def probability(self, features: np.ndarray) -> np.ndarray:
        z = features @ np.array(self.weights[1:]) + self.weights[0]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def lowered(text: str) -> tuple[str, list[int] | None]:
    """The text in lower case, and where each character comes from if some became several."""
    lower = text.lower()
    if len(lower) == len(text):
        return lower, None
    parts = [c.lower() for c in text]
    return "".join(parts), [i for i, p in enumerate(parts) for _ in p]


class Scorer:
    """Finds hits and their features; keeps what tokens match while they fit ``max_tokens``."""

    def __init__(self, model: Model, max_tokens: int = 500_000):
        self.model, self.max_tokens = model, max_tokens
        self.automaton = Automaton(model.terms)
        self.find = re.compile(TOKEN).findall
        self.seen: dict[str, tuple[int, int] | None] = {}
        self.known: dict[str, tuple[int, int]] = {}

    def tokens(self, text: str) -> set[str]:
        found = set(self.find(text))
        for t in found.difference(self.seen):
            self.seen[t] = hit = self.automaton.match(t)
            if hit:
                self.known[t] = hit
        return found

    def hits(self, text: str | None) -> list[dict]:
        """start, end, term, edits, quoted and context score of each hit, in code points of ``text``."""
        lower, origin = lowered(text or "")
        if len(self.seen) > self.max_tokens:
            self.seen.clear()
            self.known.clear()
        if not self.known.keys() & self.tokens(lower):
            return []
        found = list(re.finditer(TOKEN, lower))
        quotes = [m.span() for m in re.finditer(QUOTED, lower)]
        starts = np.array([s for s, _ in quotes])
        out = []
        for i, m in enumerate(found):
            hit = self.known.get(m.group())
            if hit is None:
                continue
            q = int(np.searchsorted(starts, m.start())) - 1
            quoted = q >= 0 and quotes[q][1] >= m.end()
            near = {x.group() for x in found[max(0, i - WINDOW) : i + WINDOW + 1]}
            context = self.model.odds[hit[1]] * 0.6 ** hit[0] * (0.3 if quoted else 1.0)
            context *= (0.6 if near & REPORT else 1.0) * (1.3 if near & ADDRESS else 1.0)
            start, end = (m.start(), m.end()) if origin is None else (origin[m.start()], origin[m.end() - 1] + 1)
            out.append({"start": start, "end": end, "term": self.model.terms[hit[1]], "edits": hit[0], "quoted": quoted, "context": context})
        return out

    @staticmethod
    def features(hits: list[dict]) -> list[float]:
        plain = [h for h in hits if not h["quoted"]]
        return [
            max((h["context"] for h in hits), default=0.0),
            math.log1p(sum(h["context"] for h in hits)),
            float(any(h["edits"] == 0 for h in plain)),
            math.log1p(sum(h["edits"] > 0 for h in plain)),
            math.log1p(len({h["term"] for h in plain})),
            float(bool(hits) and not plain),
        ]


def _significant(toxic: int, clean: int, n_toxic: int, n_clean: int, words: int) -> float:
    """Log odds of a word if its counts differ beyond chance in favour of the toxic class, else 0."""
    n, base = toxic + clean, n_toxic / (n_toxic + n_clean)
    if toxic <= n * base:
        return 0.0
    g = 2 * sum(k * math.log(k / (n * p)) for k, p in ((toxic, base), (clean, 1 - base)) if k)
    odds = math.log((toxic + 0.5) / (n_toxic + 1)) - math.log((clean + 0.5) / (n_clean + 1))
    return odds if g > 2 * math.log(max(2, words) / 0.5) and odds > math.log(8) else 0.0


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = 40_000, least_contexts: int = 3) -> Model:
    """A model from (doc_id, text) and (doc_id, toxic)."""
    one = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    few = one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    few = few.sparkSession.createDataFrame(few.collect() or [], few.schema)  # at most max_rows ids and labels
    train = docs.select("doc_id", "text").join(F.broadcast(few), "doc_id").groupBy(F.md5("text").alias("node"))
    train = stored(train.agg(F.first("text").alias("text"), F.max("toxic").alias("toxic")).select("text", "toxic"), "toxicity-train")

    def count(batches):
        for b in batches:
            words: dict[int, Counter] = {0: Counter(), 1: Counter()}
            for text, toxic in zip(b.column("text").to_pylist(), b.column("toxic").to_pylist(), strict=True):
                words[int(toxic > 0)].update({*re.findall(TOKEN, (text or "").lower()), ""})
            every = list({*words[0], *words[1]})
            yield pa.RecordBatch.from_pydict({"word": every, "toxic": [words[1][w] for w in every], "clean": [words[0][w] for w in every]})

    seen = train.mapInArrow(count, "word string, toxic long, clean long").groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    seen = seen.where((F.col("toxic") + F.col("clean") > 1) | (F.col("word") == ""))
    top = seen.where((F.col("toxic") >= least_contexts) | (F.col("word") == "")).withColumn("words", F.lit(1))
    totals = {r.word: r for r in top.where("word = ''").collect()}
    if "" not in totals or not totals[""].toxic or not totals[""].clean:
        only = totals[""].toxic > 0 if "" in totals else False
        return Model([], [], [30.0 if only else -30.0, *[0.0] * FEATURES])
    n_toxic, n_clean = totals[""].toxic, totals[""].clean
    words = seen.count()
    # more than eight times the odds; near copies are still among them
    ratio = (F.col("toxic") + 0.5) / (F.col("clean") + 0.5) * ((n_clean + 1) / (n_toxic + 1))
    rows = top.where((ratio > 8) & (F.col("word") != "")).collect()  # words of at most max_rows texts
    odds = {r.word: o for r in rows if (o := _significant(r.toxic, r.clean, n_toxic, n_clean, words))}
    toxic_rows = {r.word: r.toxic for r in rows}

    def contexts(batches):
        for b in batches:
            found = set()
            for text, toxic in zip(b.column("text").to_pylist(), b.column("toxic").to_pylist(), strict=True):
                w = ["", *re.findall(TOKEN, (text or "").lower()), ""] if toxic > 0 else []
                found.update((w[i], f"{w[i - 1]} {w[i + 1]}") for i in range(1, len(w) - 1) if w[i] in odds)
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.string()), pa.array([y for _, y in found], pa.string())], names=["word", "context"])

    varied = train.mapInArrow(contexts, "word string, context string").distinct().groupBy("word").count().collect()
    varied = {r.word: r["count"] for r in varied}
    terms = sorted(w for w in odds if varied.get(w, 0) >= max(least_contexts, 0.5 * toxic_rows[w]))
    model = Model(terms, [odds[w] for w in terms])
    pairs = _features(train, model).toPandas()  # FEATURES numbers for each of at most max_rows texts
    x = np.array(pairs["x"].tolist(), float).reshape(-1, FEATURES)
    y = (pairs["toxic"] > 0).to_numpy(float)
    rest = [n_toxic - y.sum(), n_clean - (len(y) - y.sum())]  # texts without hits have no features
    blank = np.zeros((2, FEATURES))
    x, y = np.vstack([x, blank]), np.append(y, [1.0, 0.0])
    model.weights = _weighted(x, y, np.append(np.ones(len(pairs)), np.maximum(0, rest)))
    return model


def _features(train: DataFrame, model: Model) -> DataFrame:
    """(text, toxic) to (toxic, x) of the texts with hits."""
    shared = train.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        scorer = Scorer(shared.value)
        for b in batches:
            hits = [scorer.hits(t) for t in b.column("text").to_pylist()]
            some = [i for i, h in enumerate(hits) if h]
            toxic = b.column("toxic").cast(pa.int64()).take(pa.array(some, pa.int64()))
            yield pa.RecordBatch.from_arrays([toxic, pa.array([scorer.features(hits[i]) for i in some], pa.list_(pa.float64()))], names=["toxic", "x"])

    return train.select("text", "toxic").mapInArrow(tidy(run), "toxic long, x array<double>")


def _weighted(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-2) -> list[float]:
    """Intercept and weights of a logistic regression over weighted rows, by Newton's method."""
    x = np.hstack([np.ones((len(x), 1)), x])
    w = np.zeros(x.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (weight * (y - p)) - ridge * w
        hessian = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.clip(np.linalg.solve(hessian, gradient), -3, 3)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w.tolist()


HITS = "array<struct<start:long,end:long,term:string,edits:int,quoted:boolean,context:double>>"


def scored(df: DataFrame, model: Model, text: str = "text", hits: str | None = None) -> DataFrame:
    """``df`` with score and predicted, and on demand all hits, in place of the text."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    made = ["score", "predicted", *([hits] if hits else [])]
    kept = df.drop(text, *made).columns
    struct = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("term", pa.string()), ("edits", pa.int32()), ("quoted", pa.bool_()), ("context", pa.float64())])

    def run(batches):
        scorer = Scorer(shared.value)
        for whole in batches:
            for b in slices(whole, text, 8_000_000):
                found = [scorer.hits(t) for t in b.column(text).to_pylist()]
                score = shared.value.probability(np.array([scorer.features(h) for h in found]).reshape(-1, FEATURES))
                columns = [pa.array(score), pa.array((score >= 0.5).astype(np.int32)), *([pa.array(found, pa.list_(struct))] if hits else [])]
                yield pa.RecordBatch.from_arrays([*(b.column(k) for k in kept), *columns], names=[*kept, *made])

    schema = T.StructType([*df.select(*kept).schema, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    if hits:
        schema = T.StructType([*schema, T.StructField(hits, T._parse_datatype_string(HITS))])
    return df.select(*kept, text).mapInArrow(tidy(run), schema)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document scored; a fifth of the ids is held out from fitting."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    labels = table(spark, sf_dir, "labels").where(crc_mod("doc_id", 5) != 0)
    model = fit(docs, labels)
    return scored(docs.select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "text"), model)
