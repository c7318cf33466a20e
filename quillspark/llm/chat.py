"""Chat formatting by event-sourced reconstruction.

A log holds events of conversations: ``message`` opens a message, ``delta``
appends to the message that is open in its turn, ``edit`` replaces its text,
``regenerate`` empties it for the deltas that follow. Events are grouped by
conversation and turn, sorted by sequence number and folded into final
messages, which are rendered into one text per conversation.

Everything here is DataFrame functions. A conversation's events meet by turn
first, so that only its final messages meet in one task: the rendered text of
a conversation is one value, which no plan can split.

Defined cases: a null text is empty; a null kind is a message; a null role is
the role of an earlier event of that message, or empty; events with equal
sequence numbers are ordered by kind, role and text; repeated message events
are messages of their own; deltas before any message open one; an empty log
gives no rows; columns besides those named are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.functions.tables import table

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
#: Strings that control some chat template, and what stands for them in texts.
#: A backslash inside breaks each; backslashes of the text are doubled first.
CONTROL = [
    ("\\", "\\\\"),
    ("<|", "<\\|"),
    ("</s>", "<\\/s>"),
    ("<s>", "<\\s>"),
    ("[INST]", "[\\INST]"),
    ("[/INST]", "[\\/INST]"),
    ("<<SYS>>", "<\\<SYS>>"),
    ("<</SYS>>", "<\\</SYS>>"),
]


def escape(text: Column) -> Column:
    """``text`` without any control string; unescape() gives it back."""
    for plain, safe in CONTROL:
        text = F.replace(text, F.lit(plain), F.lit(safe))
    return text


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def reconstruct(events: DataFrame) -> DataFrame:
    """(conv_id, turn, seq, kind, role, text) events to final messages (conv_id, turn, part, role, text)."""
    event = F.struct(
        "seq",
        F.coalesce("kind", F.lit("message")).alias("kind"),
        "role",
        F.coalesce("text", F.lit("")).alias("text"),
    )
    turns = events.groupBy("conv_id", "turn").agg(F.array_sort(F.collect_list(event)).alias("log"))
    opened = F.filter(
        F.transform("log", lambda e, i: F.when((e.kind == "message") | (i == 0), i)), lambda i: i.isNotNull()
    )
    parts = turns.withColumn("opened", opened).select(
        "conv_id",
        "turn",
        F.posexplode(
            F.transform(
                "opened",
                lambda at, k: F.slice(
                    "log",
                    at + 1,
                    F.coalesce(F.get("opened", k + 1), F.size("log")) - at,
                ),
            )
        ).alias("part", "log"),
    )
    reset = F.array_max(F.transform("log", lambda e, i: F.when(e.kind == "delta", 0).otherwise(i)))
    last = F.slice("log", reset + 1, F.size("log"))
    text = F.array_join(F.transform(last, lambda e: F.when(e.kind == "regenerate", "").otherwise(e.text)), "")
    roles = F.filter(F.transform("log", lambda e: e.role), lambda r: r.isNotNull())
    return parts.select(
        "conv_id", "turn", "part", F.coalesce(F.try_element_at(roles, F.lit(1)), F.lit("")).alias("role"), text.alias("text")
    )


def render(messages: DataFrame) -> DataFrame:
    """Final messages to one row per conversation: conv_id, formatted, loss_spans, loss_mask.

    ``loss_spans`` are the code points [start, end) of the assistant's texts in
    ``formatted``, in order; ``loss_mask`` has the same as (message, start, end)
    with the message's number and offsets in what stands after its OPEN.
    """
    shown = messages.select(
        "conv_id",
        "turn",
        "part",
        "role",
        F.concat(F.lit(OPEN), F.replace(escape(F.col("role")), F.lit("\n"), F.lit("\\\n")), F.lit("\n")).alias("head"),
        escape(F.col("text")).alias("body"),
    )
    before = Window.partitionBy("conv_id").orderBy("turn", "part").rowsBetween(Window.unboundedPreceding, -1)
    size = F.length("head") + F.length("body") + len(CLOSE)
    placed = shown.withColumn("begin", F.coalesce(F.sum(size).over(before), F.lit(0)) + F.length("head"))
    piece = F.struct(
        "begin",
        F.concat("head", "body", F.lit(CLOSE)).alias("shown"),
        (F.col("role") == "assistant").alias("learned"),
        (F.length("head") - len(OPEN)).alias("ahead"),
        F.length("body").alias("n"),
    )
    pieces = placed.groupBy("conv_id").agg(F.array_sort(F.collect_list(piece)).alias("pieces"))
    numbered = F.transform("pieces", lambda p, i: F.struct(p.learned.alias("learned"), i.alias("message"), p.ahead.alias("start"), (p.ahead + p.n).alias("end")))
    return pieces.select(
        "conv_id",
        F.array_join(F.col("pieces.shown"), "").alias("formatted"),
        F.transform(
            F.filter("pieces", lambda p: p.learned),
            lambda p: F.struct(p.begin.alias("start"), (p.begin + p.n).alias("end")),
        ).alias("loss_spans"),
        F.transform(
            F.filter(numbered, lambda p: p.learned), lambda p: F.struct(p.message.alias("message"), p.start.alias("start"), p.end.alias("end"))
        ).alias("loss_mask"),
    )


#: A role up to its line's end. Possessive, so that the engine loops where it would else recurse once per character.
_HEAD = r"(?s)^[^\\\n]*+(?:\\.[^\\\n]*+)*+\n"


def read_back(formatted: DataFrame) -> DataFrame:
    """What render() wrote, parsed: conv_id, turns array of (role, text), loss (unescaped text under the mask)."""
    raw = F.slice(F.split("formatted", r"<\|im_start\|>"), 2, 2_000_000_000)
    cut = F.transform(raw, lambda t: F.struct(t.alias("t"), F.regexp_extract(t, _HEAD, 0).alias("head")))

    def turn(p: Column) -> Column:
        role = F.left(p.head, F.length(p.head) - 1)
        text = F.substr(p.t, F.length(p.head) + 1, F.length(p.t) - F.length(p.head) - len(CLOSE))
        return F.struct(unescape(role).alias("role"), unescape(text).alias("text"))

    parsed = formatted.select("conv_id", "formatted", "loss_mask", raw.alias("raw"), F.transform(cut, turn).alias("turns"))
    loss = F.transform("loss_mask", lambda s: unescape(F.substr(F.get("raw", s.message), s.start + 1, s.end - s.start)))
    return parsed.select("conv_id", "formatted", "turns", F.array_join(loss, "").alias("loss"))


def told(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) as the logs of a chat that led to them.

    A text was streamed in two deltas, or written in part and edited, or drafted,
    regenerated and streamed again, by turn. Rows of one turn are told one after
    the other, by role and text.
    """
    text = F.coalesce("text", F.lit(""))
    half = F.floor(F.length(text) / 2).cast("int")
    ahead, behind = F.left(text, half), F.substr(text, half + 1, F.length(text))
    event = lambda kind, said, role=None: F.struct(F.lit(kind).alias("kind"), (F.col("role") if role else F.lit(None).cast("string")).alias("role"), said.alias("text"))
    logs = {
        0: [event("message", ahead, True), event("delta", behind)],
        1: [event("message", behind, True), event("edit", text)],
        2: [event("message", behind, True), event("regenerate", F.lit("")), event("delta", ahead), event("delta", behind)],
    }
    style = F.pmod(F.coalesce("turn", F.lit(0)), F.lit(3))
    log = F.when(style == 0, F.array(*logs[0])).when(style == 1, F.array(*logs[1])).otherwise(F.array(*logs[2]))
    place = F.row_number().over(Window.partitionBy("conv_id", "turn").orderBy(F.coalesce("role", F.lit("")), text))
    told = rows.withColumn("place", place).select("conv_id", "turn", "place", F.posexplode(log).alias("step", "e"))
    return told.select("conv_id", "turn", (F.col("place").cast("long") * 4 + F.col("step")).alias("seq"), "e.kind", "e.role", "e.text")


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and conversation -1, told as logs, reconstructed, formatted and read back."""
    tricky = "</s>[INST] ok [/INST]"
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.sql(
        "SELECT conv_id, turn, role, text FROM VALUES (-1L, 0L, 'user', :t), (-1L, 1L, 'assistant', :t) AS v(conv_id, turn, role, text)",
        args={"t": tricky},
    )
    back = read_back(render(reconstruct(told(rows.unionByName(extra)))))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(lines, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def _sql_escape(column: str) -> str:
    for plain, safe in CONTROL:
        column = f"replace({column}, '{plain}', '{safe}')"
    return column


OP10_SQL = f"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
)
SELECT conv_id,
       count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum({len(OPEN) + len(CLOSE) + 1} + length({_sql_escape('role')}) + length({_sql_escape('text')}))::BIGINT AS formatted_chars
FROM c GROUP BY conv_id
"""
