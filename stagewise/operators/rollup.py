"""Roll-ups: run status, raw answers, variables from resources."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stagewise.functions import json_text as J
from stagewise.functions.columns import Keys, names, ordered_values, ref

# Stage statuses.
QUEUED = "queued"
COMMITTED = "committed"
RUNNING = "running"
FINISHED = "finished"
FAILED = "failed"
NOOP = "noop"


def run_status(df: DataFrame, run: Keys, stage: str = "stage", status: str = "status") -> DataFrame:
    """``(run, complete, failed)``: complete when nothing is queued, and the names of failed stages.

    The list is a set of stage names, so its size is that of the plan and not of the table.
    """
    return df.groupBy(*names(run)).agg(
        F.bool_and(ref(status) != QUEUED).alias("complete"),
        F.array_sort(F.collect_set(F.when(ref(status) == FAILED, ref(stage)))).alias("failed"),
    )


def collect_text(df: DataFrame, keys: Keys, stage: str, pos: str, text: str) -> DataFrame:
    """``(keys, field, value)``: raw answers of a stage, in the order of ``pos``, as one JSON list under the stage's name.

    For answers that fit a cell together; the rows themselves, ordered by ``pos``, are the same list at any size.
    """
    cols = names(keys)
    rows = df.select(
        *cols,
        ref(stage).alias("field"),
        ref(pos).alias("_pos"),
        J.quote(ref(text)).alias("_text"),
    )
    grouped = rows.groupBy(*cols, "field").agg(ordered_values(F.col("_text"), F.col("_pos")).alias("_texts"))
    return grouped.select(*cols, "field", J.list_text(F.col("_texts")).alias("value"))


def resources_to_vars(
    df: DataFrame,
    keys: Keys,
    seq: str,
    identifier: str = "identifier",
    var: str = "var",
    structured: str = "structured",
    content: str = "content",
) -> DataFrame:
    """``(keys, name, value)``: resources as variables, named by ``var`` or the cleaned identifier; the last one wins."""
    name = F.coalesce(ref(var), F.regexp_replace(ref(identifier), "[^a-zA-Z0-9_]", "_"))
    value = F.coalesce(ref(structured), ref(content).cast("string"))
    return df.groupBy(*names(keys), name.alias("name")).agg(F.max_by(value, ref(seq)).alias("value"))
