"""JSON text as the common form of documents, fragments and answers.

Columns hold canonical JSON text rather than VARIANT, because text can be grouped, sorted and written by any sink.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Characters that printed JSON writes as escapes, so that it can stand inside markup.
MARKUP_ESCAPES = {"<": "\\u003c", ">": "\\u003e", "&": "\\u0026", "\u2028": "\\u2028", "\u2029": "\\u2029"}


def parse_strict(text: Column) -> Column:
    """VARIANT of a text that is exactly one JSON value, else null.

    Spark's own parser stops after the first value and accepts whatever follows. Inside brackets a second value would
    be counted, and inside an object stray text breaks the parse, so both together leave only complete values.
    """
    single = F.json_array_length(F.concat(F.lit("["), text, F.lit("]"))) == 1
    wrapped = F.try_parse_json(F.concat(F.lit('{"v":'), text, F.lit("}")))
    return F.when(single, F.variant_get(wrapped, "$.v", "variant"))


def json_kind(json: Column) -> Column:
    """Kind of a canonical JSON text, read off its first character."""
    return _kind_of_char(F.substring(json, 1, 1))


def _kind_of_char(first: Column) -> Column:
    return (
        F.when(first == "{", "object")
        .when(first == "[", "array")
        .when(first == '"', "string")
        .when(first.isin("t", "f"), "boolean")
        .when(first == "n", "null")
        .when(first.isNotNull(), "number")
    )


# Kind of a VARIANT by the leading word of its schema.
_SHAPE_KINDS = {
    "OBJECT": "object",
    "ARRAY": "array",
    "STRING": "string",
    "BOOLEAN": "boolean",
    "VOID": "null",
    "TINYINT": "number",
    "SMALLINT": "number",
    "INT": "number",
    "BIGINT": "number",
    "FLOAT": "number",
    "DOUBLE": "number",
    "DECIMAL": "number",
    "DATE": "string",
    "TIMESTAMP": "string",
    "TIMESTAMP_NTZ": "string",
}


def variant_kind(value: Column) -> Column:
    """Kind of a VARIANT: object, array, string, boolean, null or number. The value is referenced once only."""
    word = F.substring_index(F.substring_index(F.schema_of_variant(value), "<", 1), "(", 1)
    entries = [F.lit(text) for pair in _SHAPE_KINDS.items() for text in pair]
    return F.try_element_at(F.create_map(*entries), word)


def first_char(text: Column) -> Column:
    """First character of a JSON text after white space; it tells the kind of a valid text without parsing."""
    return F.substring(F.ltrim(text, F.lit(" \t\r\n")), 1, 1)


def as_map(value: Column) -> Column:
    """Members of a VARIANT object by name, null for any other kind."""
    return value.try_cast("map<string,variant>")


def as_list(value: Column) -> Column:
    """Items of a VARIANT list, null for any other kind."""
    return value.try_cast("array<variant>")


def members(value: Column) -> Column:
    """``MAP<STRING, STRING>`` from member name to JSON text."""
    return F.transform_values(as_map(value), lambda _, item: F.to_json(item))


def elements(value: Column) -> Column:
    """``ARRAY<STRING>`` of the items as JSON text."""
    return F.transform(as_list(value), lambda item: F.to_json(item))


def quote(text: Column) -> Column:
    """JSON string literal of a text."""
    return F.to_json(text.cast("variant"))


def list_text(items: Column) -> Column:
    """JSON list from an array of JSON texts."""
    return F.concat(F.lit("["), F.array_join(items, ","), F.lit("]"))


def object_text(entries: Column) -> Column:
    """JSON object from an array of ``struct(name, value)``, the values being JSON text."""
    pairs = F.transform(entries, lambda e: F.concat(quote(e["name"]), F.lit(":"), e["value"]))
    return F.concat(F.lit("{"), F.array_join(pairs, ","), F.lit("}"))


def _printed(column: Column, kind: T.DataType, indent: str | None, depth: int, skip_nulls: bool) -> Column:
    inner = "" if indent is None else "\n" + indent * (depth + 1)
    outer = "" if indent is None else "\n" + indent * depth
    colon = ":" if indent is None else ": "

    def wrapped(items: Column, opening: str, closing: str) -> Column:
        body = F.concat(F.lit(opening + inner), F.array_join(items, "," + inner), F.lit(outer + closing))
        return F.when(F.size(items) == 0, opening + closing).otherwise(body)

    def below(value: Column, value_kind: T.DataType) -> Column:
        return F.coalesce(_printed(value, value_kind, indent, depth + 1, False), F.lit("null"))

    if isinstance(kind, T.StructType):
        entries = []
        for name in sorted(kind.names):
            value = column[name]
            entry = F.concat(quote(F.lit(name)), F.lit(colon), below(value, kind[name].dataType))
            entries.append(F.when(value.isNotNull(), entry) if skip_nulls else entry)
        items = F.array_compact(F.array(*entries)) if entries else F.array().cast("array<string>")
        return F.when(column.isNotNull(), wrapped(items, "{", "}"))
    if isinstance(kind, T.MapType):
        pairs = F.array_sort(F.map_keys(column))
        value_kind = kind.valueType
        return wrapped(
            F.transform(pairs, lambda k: F.concat(quote(k), F.lit(colon), below(F.try_element_at(column, k), value_kind))),
            "{",
            "}",
        )
    if isinstance(kind, T.ArrayType):
        item_kind = kind.elementType
        return wrapped(F.transform(column, lambda item: below(item, item_kind)), "[", "]")
    if isinstance(kind, T.VariantType):
        return F.to_json(column)
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        whole = (column == F.floor(column)) & (F.abs(column) < 1e15)
        return F.when(whole, column.try_cast("bigint").cast("string")).otherwise(column.cast("string"))
    if isinstance(kind, (T.NumericType, T.BooleanType)):
        return column.cast("string")
    return quote(column.cast("string"))


def printed_json(column: Column, kind: T.DataType, indent: str | None = None, skip_nulls: bool = False) -> Column:
    """JSON text as prompts show it: names sorted, markup characters escaped, optionally indented; null stays null.

    ``skip_nulls`` leaves out the null fields of the outermost object. VARIANT values are printed without indentation.
    """
    text = _printed(column, kind, indent, 0, skip_nulls)
    for raw, escape in MARKUP_ESCAPES.items():
        text = F.replace(text, F.lit(raw), F.lit(escape))
    return text
