"""Secret scans over an incremental blob ledger.

Every version of every path is addressed by the SHA-256 of its content. The
ledger is a table of the blobs that were scanned, with the rule versions that
scanned them and what they found. A scan takes the distinct blobs of the
versions at hand, leaves out the (blob, rule version) pairs that the ledger
has, scans the rest, appends it, and joins all findings back to every path
that holds the blob. Copies and unchanged versions are thus never read twice,
and a new version of one rule scans old blobs for that rule alone.

Plan: contents meet by address behind a map-side aggregate, so that a group of
copies sends one row per task. Findings of the few blobs that have any are
joined to (path, address) rows, broadcast while they are few, else salted for
addresses with many paths; texts take no part in that join.

Defined cases: a null text is empty; repeated rows are paths of their own; an
empty table gives no rows; other columns of the input are ignored. Spans are
code points with exclusive ends.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions.tables import table
from quillspark.llm.common import crc_mod, joined, scratch, stored, tidy


def _either_case(word: str) -> str:
    return "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in word)


_NAMES = "|".join(_either_case(w) for w in ("password", "passwd", "secret", "token")) + "|" + _either_case("api") + "_?" + _either_case("key")


#: Patterns of a run of one class, maybe after a prefix that the class holds too. A match of theirs that starts anywhere in a
#: longer run ends with it, so that such rules can state their least length in the pattern.
_RUNS = {"AKIA[A-Z0-9]+": "AKIA[A-Z0-9]", "[0-9a-f]+": "[0-9a-f]"}


@dataclass(frozen=True)
class Rule:
    """A kind of secret: a pattern, and the least length of one of its groups (0: the whole match)."""

    kind: str
    pattern: str
    group: int
    least: int

    @property
    def version(self) -> str:
        """Changes with whatever changes the rule's findings."""
        return self.kind + "@" + hashlib.sha256(repr((self.pattern, self.group, self.least, self.short)).encode()).hexdigest()[:12]

    @property
    def short(self) -> str:
        """The pattern that is run: the stated one, or one with the same findings."""
        run = _RUNS.get(self.pattern)
        return f"{run}{{{self.least - len(run.partition('[')[0])},}}" if run else self.pattern


BASE_RULES = (
    Rule("assign", f"({_NAMES})[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 12),
    Rule("access", "AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", "[0-9a-f]+", 0, 16),
)
RULES = (*BASE_RULES, Rule("pem", "-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 0), Rule("forge", "gh[pousr]_[A-Za-z0-9]+", 0, 40))

FINDING = "array<struct<kind:string,start:long,end:long>>"
LEDGER = f"blob binary, rules array<string>, findings {FINDING}"
def find(text: str, rule: Rule, compiled: re.Pattern) -> Iterator[tuple[str, int, int]]:
    """Leftmost non-overlapping matches of one rule, those too short left out."""
    for m in compiled.finditer(text):
        if m.end(rule.group) - m.start(rule.group) >= rule.least:
            yield rule.kind, m.start(), m.end()


def _scan(rules: tuple[Rule, ...]):
    def run(batches):
        own = [(r, r.version, re.compile(r.short)) for r in rules]
        kind = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
        for b in batches:
            found = []
            for text, todo in zip(b.column("text"), b.column("todo"), strict=True):
                t, versions = text.as_py() or "", set(todo.as_py())
                found.append([{"kind": k, "start": s, "end": e} for r, v, c in own if v in versions for k, s, e in find(t, r, c)])
            yield pa.RecordBatch.from_arrays(
                [b.column("blob"), b.column("todo"), pa.array(found, pa.list_(kind))], names=["blob", "rules", "findings"]
            )

    return run


def addressed(versions: DataFrame, text: str = "text") -> DataFrame:
    """``versions`` with ``blob``, the SHA-256 of the content."""
    return versions.withColumn("blob", F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")), 256)))


def read_ledger(spark: SparkSession, path: str | None) -> DataFrame:
    """The ledger at ``path``, or an empty one where there is none yet."""
    if path:
        fs_path = spark._jvm.org.apache.hadoop.fs.Path(path)
        if fs_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(fs_path):
            return spark.read.schema(LEDGER).parquet(path)
    return spark.createDataFrame([], LEDGER)


def unseen(versions: DataFrame, ledger: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(blob, text, todo) for each distinct blob and the rule versions that have not scanned it."""
    blobs = addressed(versions).groupBy("blob").agg(F.first("text").alias("text"))
    seen = ledger.select("blob", F.explode("rules").alias("rule")).groupBy("blob").agg(F.collect_set("rule").alias("done"))
    wanted = F.array(*(F.lit(r.version) for r in rules))
    todo = F.array_except(wanted, F.coalesce("done", F.array().cast("array<string>")))
    return blobs.join(seen, "blob", "left").select("blob", "text", todo.alias("todo")).where(F.size("todo") > 0)


def scan(versions: DataFrame, ledger_path: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Scan what the ledger at ``ledger_path`` has not seen, append it, and return the ledger."""
    spark = versions.sparkSession
    fresh = unseen(versions, read_ledger(spark, ledger_path), rules).mapInArrow(tidy(_scan(rules)), LEDGER)
    fresh.write.mode("append").parquet(ledger_path)
    return read_ledger(spark, ledger_path)


def findings_of(versions: DataFrame, ledger: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``versions`` with ``findings``: those of its blob by the current rule versions, by start, then rule."""
    order = F.create_map(*(x for i, r in enumerate(rules) for x in (F.lit(r.kind), F.lit(i))))
    kinds = F.array(*(F.lit(r.kind) for r in rules))
    current = F.array(*(F.lit(r.version) for r in rules))
    hits = (
        ledger.where(F.size("findings") > 0)
        .where(F.arrays_overlap("rules", current))
        .select("blob", F.explode("findings").alias("f"), "rules")
        .where(F.array_contains(kinds, F.col("f.kind")))
        .where(F.exists("rules", lambda v: F.array_contains(current, v) & (F.substring_index(v, "@", 1) == F.col("f.kind"))))
        .groupBy("blob")
        .agg(F.array_sort(F.collect_set(F.struct("f.start", order[F.col("f.kind")].alias("rank"), "f.kind", "f.end"))).alias("sorted"))
        .select("blob", F.transform("sorted", lambda f: F.struct(f.kind.alias("kind"), f.start.alias("start"), f.end.alias("end"))).alias("findings"))
    )
    none = F.array().cast(FINDING)
    hits = stored(hits, "secret-hits")
    return joined(addressed(versions), hits, ["blob"], most=50_000, weight=F.size("findings") * 48).withColumn("findings", F.coalesce("findings", none)).drop("blob")


def as_text(findings: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(findings, lambda f: F.concat_ws(":", f.kind, f.start, f.end)), ",")


def redact(text: Column, findings: Column) -> Column:
    """``text`` with every span replaced by its kind in brackets; of overlapping spans the first counts and swallows the rest."""
    step = F.aggregate(
        findings,
        F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at")),
        lambda acc, f: F.when(f.end <= acc["at"], acc).otherwise(
            F.struct(
                F.concat(
                    acc["out"],
                    F.when(
                        f.start >= acc["at"],
                        F.concat(F.substring(text, acc["at"] + 1, f.start - acc["at"]), F.lit("[secret:"), f.kind, F.lit("]")),
                    ).otherwise(""),
                ).alias("out"),
                f.end.alias("at"),
            )
        ),
    )
    return F.when(F.size(findings) == 0, text).otherwise(
        F.concat(step["out"], F.substring(text, step["at"] + 1, F.length(text)))
    )


def op1_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of every document, by a ledger of two scans: a first crawl of some paths, then all."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    path = scratch(spark, "secret-ledger")
    scan(docs.where(crc_mod("doc_id", 16) == 0), path)
    ledger = scan(docs, path)
    found = findings_of(docs, ledger)
    base = F.filter("findings", lambda f: f.kind.isin(*(r.kind for r in BASE_RULES)))
    count = lambda k: F.size(F.filter("findings", lambda f: f.kind == k)).cast("long")
    return found.select(
        "doc_id",
        *(count(r.kind).alias(f"n_{r.kind}") for r in BASE_RULES),
        F.sha2(as_text(base), 256).alias("base_sha256"),
        as_text(F.col("findings")).alias("spans"),
    )


def _sql_spans(rule: Rule, rank: int) -> str:
    pattern = rule.pattern.replace("'", "''")
    length = f"length(regexp_extract(m, '{pattern}', {rule.group}))"
    return f"""
  SELECT doc_id, {rank} AS rank, '{rule.kind}' AS kind, unnest(list_transform(ms, lambda m, i:
    {{'s': list_sum(list_transform(ps[1:i], lambda x: length(x)))::BIGINT + coalesce(list_sum(list_transform(ms[1:i-1], lambda x: length(x))), 0)::BIGINT,
      'n': length(m), 'ok': {length} >= {rule.least}}})) AS f
  FROM (SELECT doc_id, regexp_extract_all(t, '{pattern}') AS ms, regexp_split_to_array(t, '{pattern}') AS ps FROM d)"""


OP1_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
a AS ({' UNION ALL '.join(_sql_spans(r, i) for i, r in enumerate(RULES))}),
s AS (SELECT doc_id, rank, kind, f.s AS s, kind || ':' || f.s || ':' || (f.s + f.n) AS span FROM a WHERE f.ok),
g AS (
  SELECT doc_id,
         count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
         coalesce(string_agg(span, ',' ORDER BY s, rank) FILTER (rank < {len(BASE_RULES)}), '') AS base,
         string_agg(span, ',' ORDER BY s, rank) AS spans
  FROM s GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g USING (doc_id)
"""
