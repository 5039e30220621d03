"""Chat formatting with prefix-target expansion, in DataFrame operations only.

A conversation becomes one text, a turn ``[INST]role[/INST]text</s>`` after the other. Every assistant turn is an
example of its own: the context is all that stands before its text, the target is that text alone. As
a context is always a beginning of the conversation's text, examples are kept as spans of it (in code points) and
contexts are cut out when examples are expanded: a long conversation is stored once, not once per turn.

Control strings inside texts get a backslash behind their first character, one more where there are some already,
so no text can end a turn, and taking one backslash away gives the text back.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldtrust.llm.common import materialised, table

OPEN, MIDDLE, END = "[INST]", "[/INST]", "</s>"
TRAINED_ROLE = "assistant"
_CONTROL = r"/s>|INST\]|/INST\]"
#: A conversation whose texts are made of control strings.
CONTROL_TEXT = f"{END}{OPEN} ok {MIDDLE}"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])(\\*)({_CONTROL})", r"$1\\$2$3")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])\\(\\*)({_CONTROL})", "$1$2$3")


def formatted(turns: DataFrame) -> DataFrame:
    """conv_id, text and examples of each conversation of ``turns`` (conv_id, turn, role, text).

    Turns are in the order of their number, then role and text; null numbers come first, null roles and texts
    are empty, rows with a null conv_id are one conversation, repeated rows are repeated turns. Extra columns are
    ignored. examples: start and end of each assistant text within the conversation's text.
    A conversation is one row, so its turns meet in one task; nothing larger does.
    """
    rows = turns.select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    rows = (
        rows.withColumn("_text", escaped(F.col("text")))
        .withColumn("_whole", F.concat(F.lit(OPEN), escaped(F.col("role")), F.lit(MIDDLE), "_text", F.lit(END)))
        .withColumn("_number", F.row_number().over(order))
        .withColumn("_end", F.sum(F.length("_whole")).over(order.rowsBetween(Window.unboundedPreceding, 0)) - len(END))
    )
    turn = F.struct(F.col("_number"), "_whole", (F.col("role") == TRAINED_ROLE).alias("trained"), (F.col("_end") - F.length("_text")).alias("start"), F.col("_end").alias("end"))
    gathered = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("_turns"))
    return gathered.select(
        "conv_id",
        F.array_join(F.transform("_turns", lambda t: t["_whole"]), "").alias("text"),
        F.transform(F.filter("_turns", lambda t: t["trained"]), lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end"))).alias("examples"),
    )


def expanded(conversations: DataFrame) -> DataFrame:
    """An example per assistant turn: conv_id, example (from 0), context, target and length of the context.

    ``conversations`` is what ``formatted`` gives. context is the text before the target and takes no part
    in the loss; target is still escaped. Conversations without assistant turns have no example.
    """
    rows = conversations.select("conv_id", "text", F.posexplode("examples").alias("example", "_span"))
    start, end = F.col("_span.start").cast("int"), F.col("_span.end").cast("int")
    return rows.select(
        "conv_id", "example",
        F.substring("text", F.lit(1), start).alias("context"),
        F.substring("text", start + 1, end - start).alias("target"),
    )


def turns_of(text: Column) -> Column:
    """Array of (role, text) read back from a conversation's text."""
    pieces = F.split(text, END)
    whole = F.slice(pieces, F.lit(1), F.size(pieces) - 1)

    def parsed(piece: Column) -> Column:
        role = F.substring_index(piece, MIDDLE, 1)
        rest = F.substring(piece, F.length(role) + len(MIDDLE) + 1, F.length(piece))
        name = F.substring(role, F.lit(len(OPEN) + 1), F.length(role))
        return F.struct(unescaped(name).alias("role"), unescaped(rest).alias("text"))

    return F.transform(whole, parsed)


def sha256(text: Column) -> Column:
    return F.sha2(F.encode(text, "UTF-8"), 256)


def digests(conversations: DataFrame) -> DataFrame:
    """Counts and digests of what the formatted conversations and their expanded examples hold."""
    examples = expanded(conversations).select("conv_id", "example", unescaped(F.col("target")).alias("target"), F.length("context").alias("_context"))
    losses = examples.groupBy("conv_id").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("example", "target"))), lambda e: e["target"]), "").alias("_loss"),
        F.count("*").alias("_n"), F.sum("_context").alias("_chars"),
    ).withColumnRenamed("conv_id", "_id")
    turns = F.transform(F.col("turns"), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    whole = conversations.withColumn("turns", turns_of(F.col("text"))).select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), sha256(F.array_join(turns, "")).alias("turns_sha256"), F.length("text").cast("long").alias("formatted_chars")
    )
    loss = F.coalesce("_loss", F.lit(""))
    return whole.join(losses, F.col("conv_id").eqNullSafe(F.col("_id")), "left").select(
        "conv_id", "n_turns", "turns_sha256", F.length(loss).cast("long").alias("loss_chars"), sha256(loss).alias("loss_sha256"), "formatted_chars",
        F.coalesce("_n", F.lit(0)).alias("n_examples"), F.coalesce("_chars", F.lit(0)).alias("context_chars"),
    )


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    control = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise(TRAINED_ROLE).alias("role"), F.lit(CONTROL_TEXT).alias("text"),
    )
    return digests(materialised(formatted(turns.unionByName(control)), "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op5_chat_format": op5_chat_format}

ORACLES = {
    "op5_chat_format": r"""
WITH control AS (
    SELECT (-1)::BIGINT AS conv_id, 0::BIGINT AS turn, 'user' AS role, '</s>[INST] ok [/INST]' AS text
    UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), turns AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT * FROM control
), sized AS (
    SELECT *, length(regexp_replace(text, '([<\[])(\\*)(/s>|INST\]|/INST\])', '\1\\\2\3', 'g')) AS text_chars,
           17 + length(regexp_replace(role, '([<\[])(\\*)(/s>|INST\]|/INST\])', '\1\\\2\3', 'g')) AS mark_chars
    FROM turns
), placed AS (
    SELECT *, sum(text_chars + mark_chars) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text ROWS UNBOUNDED PRECEDING) - text_chars - 4 AS start
    FROM sized
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(text_chars + mark_chars)::BIGINT AS formatted_chars,
       count(*) FILTER (role = 'assistant')::BIGINT AS n_examples,
       coalesce(sum(start) FILTER (role = 'assistant'), 0)::BIGINT AS context_chars
FROM placed GROUP BY conv_id
"""
}
