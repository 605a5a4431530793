"""Placeholder templates (``{{ .a.b }}``) compiled to string expressions.

A constant template becomes one ``concat`` on the driver. Templates that come from data, and placeholders that appear
only after a first rendering, are filled from a map of declared paths.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stagewise.functions.columns import let, ref
from stagewise.functions.json_text import printed_json

# Text printed for an absent value, and the number of rendering rounds.
NO_VALUE = "<no value>"
ROUNDS = 3

_PLACEHOLDER = re.compile(r"\{\{\s*(.*?)\s*\}\}", re.S)
_PATH = re.compile(r"^\.([A-Za-z0-9_]+(?:\.[A-Za-z0-9_]+)*)$")
_INDEXED = re.compile(r"^\(?\s*index\s+\.([A-Za-z0-9_.]+)((?:\s+(?:\d+|\"[^\"]*\"))+)\s*\)?((?:\.[A-Za-z0-9_]+)*)$")
_DATA_PLACEHOLDER = r"\{\{\s*\.([A-Za-z0-9_.]+)\s*\}\}"


def _step(column: Column, kind: T.DataType, name: str | int) -> tuple[Column, T.DataType] | None:
    if isinstance(kind, T.StructType):
        if name in kind.names:
            return column[name], kind[name].dataType
    elif isinstance(kind, T.MapType):
        return F.try_element_at(column, F.lit(name)), kind.valueType
    elif isinstance(kind, T.ArrayType) and isinstance(name, int):
        return F.get(column, F.lit(name)), kind.elementType
    return None


def resolve(schema: T.StructType, steps: list[str | int]) -> tuple[Column, T.DataType] | None:
    """Column and type behind a path of names and list indexes, or None when the schema has no such path."""
    if not steps or steps[0] not in schema.names:
        return None
    found: tuple[Column, T.DataType] | None = (ref(str(steps[0])), schema[str(steps[0])].dataType)
    for name in steps[1:]:
        if found is None:
            return None
        found = _step(*found, name)
    return found


def printed(column: Column, kind: T.DataType) -> Column:
    """Text of a value inside a template; null prints the absent mark."""
    if isinstance(kind, T.ArrayType) and not isinstance(kind.elementType, (T.StructType, T.MapType, T.ArrayType)):
        items = F.transform(column, lambda item: F.coalesce(item.cast("string"), F.lit(NO_VALUE)))
        column = F.concat(F.lit("["), F.array_join(items, " "), F.lit("]"))
    elif isinstance(kind, (T.StructType, T.MapType, T.ArrayType)):
        raise ValueError("objects and nested lists need the json filter inside a template")
    return F.coalesce(column.cast("string"), F.lit(NO_VALUE))


def _steps_of(action: str) -> list[str | int]:
    plain = _PATH.match(action)
    if plain:
        return list(plain.group(1).split("."))
    indexed = _INDEXED.match(action)
    if indexed:
        picks = re.findall(r"\d+|\"[^\"]*\"", indexed.group(2))
        chosen = [pick[1:-1] if pick.startswith('"') else int(pick) for pick in picks]
        rest = [part for part in indexed.group(3).split(".") if part]
        return [*indexed.group(1).split("."), *chosen, *rest]
    raise ValueError(f"unsupported template action: {action}")


def _action(action: str, schema: T.StructType) -> Column:
    as_json = False
    if action.startswith("json "):
        as_json, action = True, action[5:].strip()
    elif re.search(r"\|\s*json$", action):
        as_json, action = True, re.sub(r"\s*\|\s*json$", "", action)
    found = resolve(schema, _steps_of(action))
    if found is None:
        return F.lit("" if as_json else NO_VALUE)
    column, kind = found
    if not as_json:
        return printed(column, kind)
    return F.coalesce(printed_json(column, kind, " "), F.lit(""))


def placeholders(template: str) -> list[str]:
    """Dotted paths a template mentions, each once, in order."""
    paths = (_PATH.match(action) for action in _PLACEHOLDER.findall(template))
    return list(dict.fromkeys(match.group(1) for match in paths if match))


def _printed_sql(sql: str, kind: T.DataType) -> str:
    """``printed`` of a plain value or a list of them, as SQL text."""
    if isinstance(kind, T.ArrayType):
        sql = f"concat('[', array_join(transform({sql}, item -> coalesce(cast(item AS string), '{NO_VALUE}')), ' '), ']')"
    return f"coalesce(cast({sql} AS string), '{NO_VALUE}')"


def scope_map(schema: T.StructType, paths: list[str]) -> Column:
    """``MAP<STRING, STRING>`` from declared path to printed value.

    Paths of names are put together as one SQL text, which the session parses at once.
    """
    entries: list[Column | str] = []
    for path in dict.fromkeys(paths):
        kind: T.DataType | None = schema
        for name in path.split("."):
            kind = kind[name].dataType if isinstance(kind, T.StructType) and name in kind.names else None
        plain = kind.elementType if isinstance(kind, T.ArrayType) else kind
        if plain is None or isinstance(plain, T.StructType | T.MapType | T.ArrayType) or not re.fullmatch(r"[\w.]+", path):
            found = resolve(schema, list(path.split(".")))
            entries += [F.lit(path), F.lit(NO_VALUE) if found is None else printed(*found)]
        else:
            entries += [f"'{path}'", _printed_sql(".".join(f"`{name}`" for name in path.split(".")), kind)]
    if not entries:
        return F.lit(None).cast("map<string,string>")
    if all(isinstance(entry, str) for entry in entries):
        return F.expr(f"map({', '.join(map(str, entries))})")
    return F.create_map(*[F.expr(entry) if isinstance(entry, str) else entry for entry in entries])


def fill(text: Column, scope: Column) -> Column:
    """One round over a text column: every placeholder is replaced at the same time from the scope map."""
    between = F.split(text, _DATA_PLACEHOLDER, -1)
    wanted = F.regexp_extract_all(text, F.lit(_DATA_PLACEHOLDER), 1)

    def value(index: Column) -> Column:
        found = F.coalesce(F.try_element_at(scope, F.get(wanted, index)), F.lit(NO_VALUE))
        return F.when(index < F.size(wanted), found).otherwise(F.lit(""))

    joined = F.array_join(F.transform(between, lambda part, index: F.concat(part, value(index))), "")
    return F.when(text.contains("{{"), joined).otherwise(text)


def render_column(template: Column, scope: Column, rounds: int = ROUNDS) -> Column:
    """Template text held in a column, filled for the given number of rounds."""
    for _ in range(rounds):
        template = let(template, lambda text: fill(text, scope))
    return template


def compile_template(template: str, schema: T.StructType, nested: list[str] | None = None) -> Column:
    """Expression for a constant template over the columns of ``schema``.

    Values may themselves hold placeholders: up to two further rounds fill them where any is left. ``nested`` names the paths these
    may use; not given, it is all paths that lead to plain values or lists of them.
    """
    pieces: list[Column] = []
    last = 0
    for match in _PLACEHOLDER.finditer(template):
        if match.start() > last:
            pieces.append(F.lit(template[last : match.start()]))
        pieces.append(_action(match.group(1), schema))
        last = match.end()
    if last < len(template):
        pieces.append(F.lit(template[last:]))
    text = F.concat(*pieces) if pieces else F.lit("")
    paths = plain_paths(schema) if nested is None else nested
    if not last or not paths:
        return text
    scope = scope_map(schema, paths)

    def again(once: Column) -> Column:
        return F.when(once.contains("{{"), let(scope, lambda values: render_column(once, values, ROUNDS - 1))).otherwise(once)

    return let(text, again)


def plain_paths(schema: T.StructType, before: str = "") -> list[str]:
    """Dotted paths to plain values and lists of plain values; maps are left out, as their names are data."""
    out: list[str] = []
    for field in schema.fields:
        kind = field.dataType.elementType if isinstance(field.dataType, T.ArrayType) else field.dataType
        if isinstance(field.dataType, T.StructType):
            out += plain_paths(field.dataType, f"{before}{field.name}.")
        elif not isinstance(kind, T.StructType | T.MapType | T.ArrayType | T.BinaryType) and re.fullmatch(r"\w+", field.name):
            out.append(before + field.name)
    return out


def render_templates(df: DataFrame, template: str, out: str = "rendered", nested: list[str] | None = None) -> DataFrame:
    """Add the rendered template as a column."""
    return df.withColumn(out, compile_template(template, df.schema, nested))
