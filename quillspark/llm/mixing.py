"""Mixing of sources to target weights by temperature.

Token shares p of the sources are raised to an exponent a in [0, 1] and
normalised: a = 1 keeps the shares, a = 0 makes them equal. The exponent is
found by bisection: the largest whose weights reach a share of the greatest
possible entropy, unless some source would then be repeated more often than
``max_repeats``; then the smallest exponent that keeps to that limit (1 where
none does).

The weights are realised as block permutations under a token budget. Documents
fall into ``n_blocks`` blocks per source by a hash of their id. Each epoch of a
source is a permutation of its blocks. A source is drawn for as many whole
epochs as its budget holds; of the next epoch, leading blocks are taken until
one would pass the budget; that block gives documents, in an order of its own,
as far as the budget goes. ``slot`` (0 to 2^31) places each drawn block in the
mixture in proportion, so that ordering by (slot, source, doc_key) interleaves
all sources.

All of it is DataFrame functions. Shuffled are (source, block) sums and, per
document, its id, key and tokens; a source's blocks meet in one window of at
most ``n_blocks`` rows per epoch, only the block that ends a budget is ordered
by document, and no join has a source as its key on the documents' side.

Defined cases: a null source is a source of its own; a null text has no
tokens; a null id hashes as empty text and repeated rows are drawn alike;
sources without tokens cost nothing and are drawn once; an empty table gives
no rows; other columns are kept by draw() and take no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.functions.tables import table
from quillspark.llm.common import WORD, null_safe_key, stored

STEPS = 50
SLOTS = 2**31


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _hash32(text: Column) -> Column:
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def _id_text(doc_id: str) -> Column:
    return F.coalesce(F.col(doc_id).cast("string"), F.lit(""))


def weights(tokens: DataFrame, budget: int | str = "total", entropy: float = 0.95, max_repeats: float = 4.0) -> DataFrame:
    """(skey, tokens) per source to (skey, tokens, weight, budget, epochs, rest).

    Sources with equally many tokens are one entry of the row that is solved, so
    that it has no more entries than the root of twice the number of all tokens,
    whatever the number of sources.

    ``budget``: a number of tokens; "total", as many as there are; or "cover",
    the least for which every source is drawn at least once as a whole.
    """
    sums = tokens.where("tokens > 0").groupBy(F.col("tokens").cast("double").alias("t")).agg(F.count(F.lit(1)).cast("double").alias("m"))
    one = sums.agg(F.array_sort(F.collect_list(F.struct("t", "m"))).alias("s")).where(F.size("s") > 0)
    one = one.withColumn("t", F.col("s.t")).withColumn("m", F.col("s.m"))

    def total(x: Column) -> Column:
        """Over all sources, ``m`` of which have each value."""
        return F.aggregate(F.zip_with(x, "m", lambda v, m: v * m), F.lit(0.0), lambda acc, v: acc + v)

    one = one.withColumn("sum", total(F.col("t")))
    one = one.withColumn("p", F.transform("t", lambda t: t / F.col("sum")))

    def powered(a: Column) -> Column:
        return F.transform("p", lambda p: F.pow(p, a))

    def spread(a: Column) -> Column:  # entropy of x / sum(x) is log(sum) - sum(x log x) / sum
        x = powered(a)
        return F.log(total(x)) - total(F.transform(x, lambda v: v * F.log(v))) / total(x)

    def repeats(a: Column) -> Column:
        x = powered(a)
        over = F.zip_with(x, "t", lambda v, t: v / t)
        if budget == "cover":
            return F.array_max(over) / F.array_min(over)
        return F.array_max(over) / total(x) * (F.col("sum") if budget == "total" else F.lit(float(budget)))

    def bisect(low_moves) -> Column:
        """Bounds (lo, hi) of [0, 1] after STEPS halvings; lo moves up where the condition holds at the middle."""
        return F.aggregate(
            F.sequence(F.lit(1), F.lit(STEPS)),
            F.struct(F.lit(0.0).alias("lo"), F.lit(1.0).alias("hi")),
            lambda acc, _: F.when(
                low_moves((acc.lo + acc.hi) / 2), F.struct(((acc.lo + acc.hi) / 2).alias("lo"), acc.hi.alias("hi"))
            ).otherwise(F.struct(acc.lo.alias("lo"), ((acc.lo + acc.hi) / 2).alias("hi"))),
        )

    goal = F.lit(entropy) * F.log(F.aggregate("m", F.lit(0.0), lambda acc, m: acc + m))
    one = one.withColumn("by_entropy", F.when(spread(F.lit(1.0)) >= goal, 1.0).otherwise(bisect(lambda a: spread(a) >= goal).lo))
    one = one.withColumn(
        "by_repeats", F.when(repeats(F.lit(0.0)) <= max_repeats, 0.0).otherwise(bisect(lambda a: repeats(a) > max_repeats).hi)
    )
    one = one.withColumn("exponent", F.greatest("by_entropy", "by_repeats")).withColumn("x", powered(F.col("exponent")))
    one = one.withColumn("w", F.transform("x", lambda v: v / total(F.col("x"))))
    if budget == "cover":
        whole = F.array_max(F.zip_with("t", "w", lambda t, w: t / w))
    else:
        whole = F.col("sum") if budget == "total" else F.lit(float(budget))
    own = one.select("exponent", whole.alias("whole"), F.inline(F.zip_with("t", "w", lambda t, w: F.struct(t.alias("t"), w.alias("weight")))))
    # within a billionth of a whole epoch, an epoch is whole
    rows = tokens.withColumn("t", F.col("tokens").cast("double")).join(own, "t")
    drawn = F.floor(F.col("weight") * F.col("whole") * (1 + 1e-9)).cast("long")
    some = rows.select("skey", F.col("t").cast("long").alias("tokens"), "weight", "exponent", drawn.alias("budget"))
    return some.select(
        "*",
        F.floor(F.col("budget") / F.col("tokens")).cast("int").alias("epochs"),
        (F.col("budget") % F.col("tokens")).alias("rest"),
    )


def schedule(blocks: DataFrame, sources: DataFrame) -> DataFrame:
    """(skey, block, tokens) sums and weights() to the drawn (skey, block, epoch, slot, left).

    ``left`` is null for a block that is drawn whole, else the tokens that its
    documents may take.
    """
    plan = blocks.join(
        sources.select("skey", "budget", "epochs", "rest"), "skey", "left"
    ).select(  # a source without tokens is not in the weights: one epoch
        "skey", "block", "tokens", F.coalesce("budget", F.lit(0)).alias("budget"), F.coalesce("epochs", F.lit(1)).alias("epochs"),
        F.coalesce("rest", F.lit(0)).alias("rest"),
    )
    each = plan.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("epochs"))))
    key = _hash32(F.concat_ws("|", F.lit("block"), "skey", "epoch", "block"))
    order = Window.partitionBy("skey", "epoch").orderBy("key", "block")
    ahead = F.coalesce(F.sum("tokens").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = each.withColumn("key", key).withColumn("ahead", ahead)
    whole = (F.col("epoch") < F.col("epochs")) | (F.col("ahead") + F.col("tokens") <= F.col("rest"))
    source_tokens = F.when(F.col("epochs") > 0, (F.col("budget") - F.col("rest")) / F.col("epochs")).otherwise(0)
    slot = F.floor((F.col("epoch") * source_tokens + F.col("ahead")) * SLOTS / F.greatest("budget", F.lit(1)))
    return (
        placed.where((F.col("epoch") < F.col("epochs")) | (F.col("ahead") < F.col("rest")))
        .select("skey", "block", "epoch", slot.cast("long").alias("slot"), F.when(~whole, F.col("rest") - F.col("ahead")).alias("left"))
    )


def draw(docs: DataFrame, tokens: Column, doc_id: str = "doc_id", source: str = "source", n_blocks: int = 1024, **target) -> DataFrame:
    """The mixture: ``docs`` with columns mix_tokens, mix_epoch, mix_block, mix_slot and mix_key, a row for each draw."""
    made = [f"mix_{c}" for c in ("skey", "tokens", "block", "key", "epoch", "slot", "left", "ahead", "last")]
    keyed = docs.drop(*made).select(
        "*",
        null_safe_key(source).alias("mix_skey"),
        tokens.alias("mix_tokens"),
        (_hash32(_id_text(doc_id)) % n_blocks).cast("int").alias("mix_block"),
    )
    slim = stored(keyed.select("mix_skey", "mix_block", "mix_tokens", doc_id), "mixing-tokens")  # so that texts are counted twice, not once for each use
    blocks = slim.groupBy(F.col("mix_skey").alias("skey"), F.col("mix_block").alias("block")).agg(F.sum("mix_tokens").alias("tokens"))
    drawn = schedule(blocks, weights(blocks.groupBy("skey").agg(F.sum("tokens").alias("tokens")), **target))
    drawn = drawn.select(*(F.col(c).alias(f"mix_{c}") for c in ("skey", "block", "epoch", "slot", "left")))
    key = _hash32(F.concat_ws("|", F.lit("doc"), "mix_epoch", _id_text(doc_id)))
    last = F.struct("mix_key", F.col(doc_id).alias("id"))
    # where a budget ends inside a block: the last of its documents, by key and id, that the budget holds
    order = Window.partitionBy("mix_skey", "mix_block", "mix_epoch").orderBy("mix_key", doc_id)
    ends = (
        slim.join(drawn.where("mix_left IS NOT NULL"), ["mix_skey", "mix_block"])
        .withColumn("mix_key", key)
        .withColumn("mix_ahead", F.sum("mix_tokens").over(order.rangeBetween(Window.unboundedPreceding, 0)))
        .where(F.col("mix_ahead") <= F.col("mix_left"))
        .groupBy("mix_skey", "mix_block", "mix_epoch")
        .agg(F.max(last).alias("mix_last"))
    )
    drawn = drawn.join(ends, ["mix_skey", "mix_block", "mix_epoch"], "left")
    rows = keyed.join(drawn, ["mix_skey", "mix_block"]).withColumn("mix_key", key)
    return rows.where(F.col("mix_left").isNull() | (last <= F.col("mix_last"))).drop("mix_skey", "mix_left", "mix_last")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A mixture of as many tokens as the corpus has, at 95 % of the greatest entropy and four repeats at most."""
    docs = stored(table(spark, sf_dir, "documents").select("doc_id", "source", n_words(F.col("text")).alias("n")), "mixing-counts")
    return draw(docs, F.col("n"), budget="total", entropy=0.95, max_repeats=4.0).select(
        "doc_id",
        "source",
        F.col("mix_tokens").alias("tokens"),
        F.col("mix_epoch").alias("epoch"),
        F.col("mix_block").alias("block"),
        F.col("mix_slot").alias("slot"),
        F.col("mix_key").alias("doc_key"),
    )


_SQL_HASH = "('0x' || substr(md5({}), 1, 8))::BIGINT"


def _sql_bisect(name: str, condition: str) -> str:
    return f"""
{name}(i, lo, hi) AS (
  SELECT 0, 0.0::DOUBLE, 1.0::DOUBLE
  UNION ALL
  SELECT i + 1, CASE WHEN c THEN (lo + hi) / 2 ELSE lo END, CASE WHEN c THEN hi ELSE (lo + hi) / 2 END
  FROM (SELECT i, lo, hi, (SELECT {condition} FROM (SELECT t, pow(p, (lo + hi) / 2) AS x FROM p)) AS c FROM {name} WHERE i < {STEPS}))"""


_ENTROPY = "ln(sum(x)) - sum(x * ln(x)) / sum(x) >= 0.95 * ln(count(*))"
_REPEATS = "max(x / t) / sum(x) * sum(t) > 4.0"

OP4_SQL = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, CASE WHEN source IS NULL THEN 'n' ELSE 'v' || source END AS skey,
         coalesce(len(regexp_extract_all(text, '{WORD}')), 0)::BIGINT AS tokens,
         {_SQL_HASH.format("coalesce(doc_id::VARCHAR, '')")} % 1024 AS block
  FROM documents),
b AS (SELECT skey, block, sum(tokens)::BIGINT AS tokens FROM d GROUP BY ALL),
s AS (SELECT skey, sum(tokens)::DOUBLE AS t FROM b GROUP BY skey HAVING sum(tokens) > 0),
p AS (SELECT skey, t, t / sum(t) OVER () AS p FROM s),
{_sql_bisect('be', _ENTROPY)},
{_sql_bisect('br', _REPEATS)},
a AS (SELECT greatest(
  (SELECT CASE WHEN {_ENTROPY} THEN 1.0 ELSE (SELECT lo FROM be WHERE i = {STEPS}) END FROM (SELECT p AS x FROM p)),
  (SELECT CASE WHEN NOT ({_REPEATS}) THEN 0.0 ELSE (SELECT hi FROM br WHERE i = {STEPS}) END FROM (SELECT 1.0::DOUBLE AS x, t FROM p))) AS e),
w AS (SELECT skey, t::BIGINT AS t, floor(pow(p, e) / sum(pow(p, e)) OVER () * sum(t) OVER () * (1 + 1e-9))::BIGINT AS budget FROM p, a),
q AS (SELECT b.*, coalesce(budget, 0) AS budget, coalesce(budget // t, 1) AS epochs, coalesce(budget % t, 0) AS rest, coalesce(t, 0) AS t FROM b LEFT JOIN w USING (skey)),
e AS (SELECT *, unnest(range(0, epochs + 1)) AS epoch FROM q),
o AS (SELECT *, coalesce(sum(tokens) OVER (PARTITION BY skey, epoch ORDER BY {_SQL_HASH.format("'block|' || skey || '|' || epoch || '|' || block")}, block
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead FROM e),
k AS (SELECT skey, block, epoch, floor((CASE WHEN epochs > 0 THEN epoch * t ELSE 0 END + ahead)::DOUBLE * {SLOTS} / greatest(budget, 1))::BIGINT AS slot,
        CASE WHEN epoch < epochs OR ahead + tokens <= rest THEN NULL ELSE rest - ahead END AS room
      FROM o WHERE epoch < epochs OR ahead < rest),
r AS (SELECT d.*, k.epoch, k.slot, k.room, {_SQL_HASH.format("'doc|' || epoch || '|' || coalesce(doc_id::VARCHAR, '')")} AS doc_key FROM d JOIN k USING (skey, block))
SELECT doc_id, source, tokens, epoch::INT AS epoch, block::INT AS block, slot, doc_key
FROM (SELECT *, sum(tokens) OVER (PARTITION BY skey, block, epoch, room ORDER BY doc_key, doc_id RANGE UNBOUNDED PRECEDING) AS taken FROM r)
WHERE room IS NULL OR taken <= room
"""
