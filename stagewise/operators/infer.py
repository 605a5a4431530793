"""Schema inference over a column of JSON text.

One scan flattens every row to (path, kind) nodes of any depth, a pre-aggregated count per (path, kind) is the only
shuffle, and the schema is built from that summary, whose size depends on the schema and not on the rows.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stagewise.functions import json_text as J
from stagewise.functions.columns import if_present, ref
from stagewise.plans.schema import Schema

ROOT = "$"


def _kind(value: Any) -> str:
    """Kind of a parsed value; whole numbers are integers however they are written."""
    if value is None:
        return "null"
    if isinstance(value, bool):
        return "boolean"
    if isinstance(value, int | float):
        return "integer" if value == value // 1 else "number"
    return {str: "string", dict: "object", list: "array"}[type(value)]


def count_nodes(text: str, counts: Counter) -> None:
    """Count the (path, kind) nodes of one JSON text, each node once."""
    open_nodes = [(ROOT, json.loads(text))]
    while open_nodes:
        path, value = open_nodes.pop()
        counts[path, _kind(value)] += 1
        if isinstance(value, dict):
            open_nodes += [(f"{path}.{json.dumps(name, ensure_ascii=False)}", inner) for name, inner in value.items()]
        elif isinstance(value, list):
            inside = path + "[]"
            open_nodes += [(inside, inner) for inner in value]


def _count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        counts: Counter = Counter()
        for text in frame["text"]:
            count_nodes(text, counts)
        yield pd.DataFrame([(*key, n) for key, n in counts.items()], columns=["path", "kind", "n"])


def schema_paths(df: DataFrame, col: str) -> DataFrame:
    """``(path, kind, n)`` over all rows. Member names in paths are JSON strings, list items are ``[]``.

    Spark parses and checks the texts; the walk over the checked ones is linear in their size and counts within each batch before
    the shuffle.
    """
    checked = df.select(F.to_json(J.parse_strict(ref(col))).alias("text"))
    texts = checked.select(F.explode(if_present(F.col("text"))).alias("text"))
    nodes = texts.mapInPandas(_count, "path string, kind string, n long")
    return nodes.groupBy("path", "kind").agg(F.sum("n").alias("n"))


def _steps(path: str) -> list[str]:
    """Path text to its steps; names keep their quotes so that they never equal the item step."""
    steps: list[str] = []
    rest = path[len(ROOT) :]
    while rest:
        if rest.startswith("[]"):
            steps.append("[]")
            rest = rest[2:]
            continue
        end = 2
        while rest[end] != '"':
            end += 2 if rest[end] == "\\" else 1
        steps.append(rest[1 : end + 1])
        rest = rest[end + 1 :]
    return steps


def build_schema(summary: Iterable[tuple[str, str, int]]) -> Schema:
    """Schema from (path, kind, count) rows: type unions, nullable folding, and required members."""
    tree: dict[str, Any] = {"kinds": {}, "below": {}}
    for path, kind, n in summary:
        node = tree
        for step in _steps(path):
            node = node["below"].setdefault(step, {"kinds": {}, "below": {}})
        node["kinds"][kind] = node["kinds"].get(kind, 0) + n

    def branch(kind: str, node: dict[str, Any]) -> Schema:
        if kind == "object":
            fields = {json.loads(step): child for step, child in node["below"].items() if step != "[]"}
            out: Schema = {"type": "object", "properties": {name: fold(fields[name]) for name in sorted(fields)}}
            objects = node["kinds"]["object"]
            always = [name for name in sorted(fields) if sum(fields[name]["kinds"].values()) == objects]
            if objects > 1 and always:
                out["required"] = always
            return out
        if kind == "array":
            inside = node["below"].get("[]")
            return {"type": "array", "items": fold(inside)} if inside else {"type": "array"}
        return {"nullable": True} if kind == "null" else {"type": kind}

    def fold(node: dict[str, Any]) -> Schema:
        kinds = sorted(node["kinds"])
        if len(kinds) == 1:
            return branch(kinds[0], node)
        if len(kinds) == 2 and "null" in kinds:
            other = next(kind for kind in kinds if kind != "null")
            return {**branch(other, node), "nullable": True}
        return {"oneOf": [branch(kind, node) for kind in kinds]}

    return fold(tree) if tree["kinds"] else {}


def infer_schema(df: DataFrame, col: str) -> DataFrame:
    """``(schema)``: one row with the JSON schema of the values of a column.

    The schema is one text, so its distinct paths meet in one task; that is as many rows as the schema has nodes, whatever the size of the
    table. Where member names are themselves data, ``schema_paths`` gives the same as a table.
    """
    columns = ["path", "kind", "n"]

    def build(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = [row for frame in frames for row in frame[columns].itertuples(index=False)]
        yield pd.DataFrame({"schema": [json.dumps(build_schema(rows), ensure_ascii=False)]})

    # A shuffle of the summary, so that the counting before it keeps its own tasks.
    return schema_paths(df, col).select(*columns).repartition(1).mapInPandas(build, "schema string")
