"""Message histories. Long tables ``(conv, turn, role, text)``; only what asks for one cell gathers a history into one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stagewise.functions import json_text as J
from stagewise.functions.columns import Keys, join_on, names, ordered_values, ref

# Roles, marks of failed answers, and the turn limit.
SYSTEM = "system"
ASSISTANT = "assistant"
FATAL_MARK = "[FATAL]"
RETRYABLE = "429|500|502|503|504|timeout"
TURN_LIMIT = 10


def assemble_history(
    df: DataFrame, conv: Keys, turn: str = "turn", role: str = "role", text: str = "text", system: str | None = None
) -> DataFrame:
    """``(conv, turn, role, text)`` with the system text put once before each conversation, at turn -1."""
    cols = names(conv)
    messages = df.select(
        *cols, ref(turn).cast("bigint").alias("turn"), ref(role).alias("role"), ref(text).alias("text")
    )
    if not system:
        return messages
    first = df.select(*cols).distinct()
    opening = first.select(
        *cols, F.lit(-1).cast("bigint").alias("turn"), F.lit(SYSTEM).alias("role"), F.lit(system).alias("text")
    )
    return opening.unionByName(messages)


def history_lists(messages: DataFrame, conv: Keys) -> DataFrame:
    """``(conv, messages)``: each history as one ordered JSON message list, for clients that take whole calls."""
    cols = names(conv)
    packed = F.to_json(F.struct("role", "text"))
    rows = messages.select(*cols, "turn", packed.alias("m"))
    grouped = rows.groupBy(*cols).agg(ordered_values(F.col("m"), F.col("turn")).alias("_m"))
    return grouped.select(*cols, J.list_text(F.col("_m")).alias("messages"))


def last_message(df: DataFrame, conv: Keys, turn: str = "turn", text: str = "text") -> DataFrame:
    """``(conv, text)``: what an empty prompt without schema returns."""
    return df.groupBy(*names(conv)).agg(F.max_by(text, turn).alias("text"))


def join_parts(df: DataFrame, keys: Keys, pos: str, text: str, sep: str = "") -> DataFrame:
    """``(keys, text)``: part texts joined in the order of ``pos``, for texts that fit a cell."""
    cols = names(keys)
    rows = df.select(*cols, ref(pos).alias("_pos"), ref(text).alias("_text"))
    grouped = rows.groupBy(*cols).agg(ordered_values(F.col("_text"), F.col("_pos")).alias("_texts"))
    return grouped.select(*cols, F.array_join("_texts", sep).alias("text"))


def tool_calls(df: DataFrame, kind: str, col: str = "role") -> DataFrame:
    """Messages of one type."""
    return df.filter(ref(col) == kind)


def has_tool_calls(df: DataFrame, conv: Keys, kind: str, col: str = "role") -> DataFrame:
    """``(conv, has_calls)``: whether a conversation holds any message of that type."""
    return df.groupBy(*names(conv)).agg(F.bool_or(ref(col) == kind).alias("has_calls"))


def loop_guard(df: DataFrame, conv: Keys, limit: int = TURN_LIMIT, role: str = "role") -> DataFrame:
    """``(conv, model_turns, looping)``: flags conversations whose model-turn counter reaches the limit."""
    turns = F.count_if(ref(role) == ASSISTANT)
    return df.groupBy(*names(conv)).agg(turns.alias("model_turns"), (turns >= limit).alias("looping"))


def attach_once(df: DataFrame, conv: Keys, turn: str = "turn", out: str = "with_documents") -> DataFrame:
    """Add a flag that is true on the first message of each conversation only.

    The first turn is a pre-aggregated minimum, joined back on (conv, turn), so a long conversation stays spread out.
    """
    cols = names(conv)
    first = df.groupBy(*cols).agg(F.min(turn).alias(turn)).withColumn("_first", F.lit(True))
    return join_on(df, first, [*cols, turn], "left").withColumn(out, F.coalesce("_first", F.lit(False))).drop("_first")


def answer_class(answer: Column, error: Column) -> Column:
    """ok, fatal (the answer says so) or retryable (the error is of the passing kind); other errors are fatal."""
    return (
        F.when(answer.contains(FATAL_MARK), "fatal")
        .when(error.rlike(RETRYABLE), "retryable")
        .when(error.isNotNull(), "fatal")
        .otherwise("ok")
    )


def classify_answers(df: DataFrame, stage: str, answer: str, error: str) -> DataFrame:
    """``(stage, class, n)``: answers counted per stage and class."""
    tagged = df.select(ref(stage).alias("stage"), answer_class(ref(answer), ref(error)).alias("class"))
    return tagged.groupBy("stage", "class").agg(F.count(F.lit(1)).alias("n"))
