"""Plan-driven function calls: ordered, over every row, each seeing the results of those before it."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stagewise.functions.columns import Keys, names, ref
from stagewise.functions.json_text import printed_json
from stagewise.functions.registry import FunctionRegistry, Registered
from stagewise.functions.templates import compile_template
from stagewise.operators.prompts import CallOutput
from stagewise.operators.reshape import Rule, run_rule
from stagewise.sources.sinks import publish_table

# Destinations of call results.
TO_PROMPT = "ai"
TO_VARS = "vars"
TO_CONTEXT = "context"
TO_TABLE = "db"


@dataclass(frozen=True)
class Call:
    """One call. ``args`` values: ``$(sql)`` keeps its type, other strings are templates, the rest are constants."""

    name: str
    var: str
    args: dict[str, Any] = field(default_factory=dict)
    into: str = TO_PROMPT
    description: str = ""


def expression_argument(text: str) -> str | None:
    """SQL inside ``$( … )`` when the opening parenthesis closes exactly at the end; a backslash skips a character."""
    if len(text) < 3 or not text.startswith("$(") or not text.endswith(")"):
        return None
    body = text[2:-1]
    depth, at = 1, 0
    while at < len(body):
        if body[at] == "\\":
            at += 1
        elif body[at] == "(":
            depth += 1
        elif body[at] == ")":
            depth -= 1
            if depth == 0:
                return None
        at += 1
    return body if depth == 1 else None


def resolve_argument(value: Any, df: DataFrame) -> Column:
    """Column of one argument value over the scope of the rows."""
    if isinstance(value, str):
        sql = expression_argument(value)
        return F.expr(sql) if sql is not None else compile_template(value, df.schema)
    return F.lit(value)


def put(df: DataFrame, holder: str, name: str, value: Column) -> DataFrame:
    """Set a field of a struct column, creating the struct if needed."""
    if holder not in df.columns:
        return df.withColumn(holder, F.struct(value.alias(name)))
    return df.withColumn(holder, ref(holder).withField(f"`{name}`", value))


def _with_args(df: DataFrame, call: Call, rules: Sequence[Rule]) -> DataFrame:
    values = [resolve_argument(value, df).alias(name) for name, value in call.args.items()]
    df = df.withColumn("args", F.struct(*values) if values else F.struct(F.lit(None).cast("string").alias("_none")))
    for rule in rules:
        if rule.on_input == call.name:
            df = run_rule(df, rule)
    if not isinstance(df.schema["args"].dataType, T.StructType):
        raise ValueError(f"arguments of {call.name} must stay an object")
    return df


def _argument(df: DataFrame, name: str) -> Column:
    kind = df.schema["args"].dataType
    assert isinstance(kind, T.StructType)
    return F.col("args")[name] if name in kind.names else F.lit(None)


def _evaluate(df: DataFrame, entry: Registered) -> DataFrame:
    if entry.table is not None:
        wanted = [F.col(name).alias(f"_k{i}") for i, name in enumerate(entry.inputs)]
        found = entry.table.select(*wanted, F.col(entry.output).alias("_result"))
        if not entry.inputs:
            raise ValueError("a function from a table needs inputs to be looked up by")
        condition = F.lit(True)
        for i, name in enumerate(entry.inputs):
            condition = condition & (_argument(df, name) == F.col(f"_k{i}"))
        return df.join(found, condition, "left").drop(*[f"_k{i}" for i in range(len(entry.inputs))])
    assert entry.apply is not None
    return df.withColumn("_result", entry.apply(*[_argument(df, name) for name in entry.inputs]))


def call_functions(
    df: DataFrame, calls: Sequence[Call], functions: FunctionRegistry, rules: Sequence[Rule] = (), keys: Keys = ()
) -> tuple[DataFrame, list[CallOutput]]:
    """Run the calls over the rows.

    Results for variables and context become fields of ``vars`` and ``context``; those for a table are published under
    the call's ``var`` beside the ``keys`` of their rows; those for the prompt are returned as outputs backed by columns ``_call_<var>``.
    """
    outputs: list[CallOutput] = []
    row_key = [ref(name) for name in names(keys)]
    passing: list[str] = []
    for call in calls:
        entry = functions.get(call.name)
        df = _evaluate(_with_args(df, call, rules), entry).drop("args")
        for rule in rules:
            if rule.on_output == call.name:
                df = run_rule(df.withColumnRenamed("_result", "args"), rule).withColumnRenamed("args", "_result")
        kind = df.schema["_result"].dataType
        df = put(df, TO_VARS, call.var, F.col("_result"))
        if call.into == TO_CONTEXT:
            df = put(df, TO_CONTEXT, call.var, F.col("_result"))
        elif call.into == TO_TABLE:
            publish_table(call.var, df.select(*row_key, F.col("_result").alias("value")))
        elif call.into == TO_PROMPT:
            column = f"_call_{call.var}"
            df = df.withColumn(column, F.coalesce(printed_json(F.col("_result"), kind), F.lit("")))
            outputs.append(CallOutput(call.name, ref(column), call.description))
        elif call.into != TO_VARS:
            raise ValueError(f"unknown destination: {call.into}")
        if call.into != TO_VARS:
            passing.append(call.var)
        df = df.drop("_result")
    kept = [name for name in (df.schema[TO_VARS].dataType.names if TO_VARS in df.columns else []) if name not in passing]
    if passing:
        df = df.withColumn(TO_VARS, ref(TO_VARS).dropFields(*passing)) if kept else df.drop(TO_VARS)
    return df, outputs
