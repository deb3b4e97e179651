"""Chat formatting by prefix-target expansion, in DataFrame operations only.

Every assistant turn becomes an example of its own: all turns before it are context, only its reply
is trainable. Turns after the last assistant turn (or all, if there is none) make one more example
without a target, so that the output holds every turn.

Template of a turn: ``### <role>:\\n<text>\\n</turn>\\n``. In texts and roles ``\\`` becomes ``\\\\``,
``###`` becomes ``\\###`` and ``</turn>`` becomes ``\\</turn>``; line ends in roles become ``\\n``.
An escaped text never holds a line end followed by ``</turn>``, so a turn's end is found by a plain
split and the escapes are undone by one pass.

Defined results: a null role or text is an empty one; a null conversation id is one conversation; rows
with equal turns (a null turn first) go by role, then text; repeated rows are kept; an empty table gives
no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmatch.llm._common import table

END = "\n</turn>\n"
ASSISTANT = "assistant"


def escape(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("###"), F.lit("\\###")), F.lit("</turn>"), F.lit("\\</turn>"))


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"\\(\\|###|</turn>)", "$1")


def escape_role(c: Column) -> Column:
    return F.replace(escape(c), F.lit("\n"), F.lit("\\n"))


def unescape_role(c: Column) -> Column:
    part = lambda p: F.replace(F.replace(F.replace(p, F.lit("\\n"), F.lit("\n")), F.lit("\\###"), F.lit("###")), F.lit("\\</turn>"), F.lit("</turn>"))
    return F.array_join(F.transform(F.split(c, r"\\\\", -1), part), "\\")


def format_conversations(turns: DataFrame) -> DataFrame:
    """``(conv_id, turn, role, text)`` rows -> one example a row.

    Returns ``conv_id, example (from 0), target_turn (index of the trainable turn, null if none),
    n_turns, text, loss_start, loss_end``: characters ``[loss_start, loss_end)`` of text, in code
    points, are the trainable reply; both are 0 where there is no target.
    """
    rows = turns.select(
        "conv_id",
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    rows = rows.select(
        "conv_id",
        F.struct("turn", "role", "text").alias("at"),
        F.concat(F.lit("### "), escape_role(F.col("role")), F.lit(":\n")).alias("head"),
        escape(F.col("text")).alias("body"),
    )
    whole = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("at", "head", "body"))).alias("t"))
    last = F.size("t") - 1
    targets = F.filter(F.sequence(F.lit(0), last), lambda i: (F.get("t", i)["at"]["role"] == ASSISTANT) | (i == last))
    out = whole.select("conv_id", "t", F.posexplode(targets).alias("example", "i"))
    before = F.array_join(F.transform(F.slice("t", F.lit(1), F.col("i")), lambda x: F.concat(x["head"], x["body"], F.lit(END))), "")
    now = F.get("t", F.col("i"))
    out = out.select("conv_id", F.col("example").cast("long").alias("example"), "i", before.alias("context"), now["at"]["role"].alias("role"), now["head"].alias("head"), now["body"].alias("body"))
    trains = F.col("role") == ASSISTANT
    start = F.length("context") + F.length("head")
    return out.select(
        "conv_id",
        "example",
        F.when(trains, F.col("i").cast("long")).alias("target_turn"),
        (F.col("i") + 1).cast("long").alias("n_turns"),
        F.concat("context", "head", "body", F.lit(END)).alias("text"),
        F.when(trains, start).otherwise(0).cast("long").alias("loss_start"),
        F.when(trains, start + F.length("body")).otherwise(0).cast("long").alias("loss_end"),
    )


def parse(text: Column) -> Column:
    """A formatted text -> array of (role, text)."""
    parts = F.split(text, END, -1)
    parts = F.slice(parts, F.lit(1), F.size(parts) - 1)
    return F.transform(
        parts,
        lambda p: F.struct(
            unescape_role(F.regexp_extract(p, r"(?s)\A### ([^\n]*):\n", 1)).alias("role"),
            unescape(F.regexp_replace(p, r"(?s)\A### [^\n]*:\n", "")).alias("text"),
        ),
    )


def probe(spark: SparkSession) -> DataFrame:
    """Conversation -7: its texts look like the template's own marks."""
    said = "\\### Assistant: </turn> ok"
    return spark.createDataFrame([(-7, 0, "user", said), (-7, 1, ASSISTANT, said)], "conv_id long, turn long, role string, text string")


def op10_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a conversation, read back from the examples."""
    names = ["conv_id", "turn", "role", "text"]
    examples = format_conversations(table(spark, sf_dir, "conversations").select(*names).unionByName(probe(spark)))
    reply = unescape(F.expr("substring(text, int(loss_start) + 1, int(loss_end - loss_start))"))
    by = examples.groupBy("conv_id").agg(
        F.max_by("text", "example").alias("whole"),
        F.count(F.lit(1)).alias("n_examples"),
        F.sort_array(F.collect_list(F.when(F.col("target_turn").isNotNull(), F.struct("example", reply.alias("reply"))))).alias("replies"),
    )
    by = by.select("conv_id", "n_examples", "whole", parse(F.col("whole")).alias("turns"), F.array_join(F.transform("replies", lambda x: x["reply"]), "").alias("loss"))
    said = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return by.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("whole").cast("long").alias("formatted_chars"),
        "n_examples",
    )


OP10_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (
  SELECT *, 4 + length(replace(replace(replace(replace(role, '\', '\\'), '###', '\###'), '</turn>', '\</turn>'), chr(10), '\n')) + 2
    + length(replace(replace(replace(text, '\', '\\'), '###', '\###'), '</turn>', '\</turn>')) + 9 AS chars FROM t)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(chars)::BIGINT AS formatted_chars,
  (count(*) FILTER (role = 'assistant') + CASE WHEN arg_max(role, (coalesce(turn, -1e18::BIGINT), role, text)) = 'assistant' THEN 0 ELSE 1 END)::BIGINT AS n_examples
FROM e GROUP BY conv_id
"""
