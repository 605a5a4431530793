"""Bulk parsing of text columns: JSON, CSV, key=value lines, mixed content and call arguments.

A table parser reads and parses its input once and returns one table of good rows and rejects, of which both are views.
"""

from __future__ import annotations

import csv
import io
import re
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stagewise.functions import json_text as J
from stagewise.functions.columns import Keys, let, names, ordered_values, ref


@dataclass(frozen=True)
class Parsed:
    """One parse as one table: ``tagged`` holds good rows, and rejects with a ``reason`` and otherwise their keys only.

    ``good`` and ``rejects`` are views of it. A caller that needs both writes the table once (``written``) and gets views that read their own files.
    """

    tagged: DataFrame
    keys: tuple[str, ...]

    @property
    def good(self) -> DataFrame:
        """Rows without a reason."""
        return self.tagged.filter("reason IS NULL").drop("reason")

    @property
    def rejects(self) -> DataFrame:
        """``(keys, reason)`` of the others."""
        return self.tagged.filter("reason IS NOT NULL").select(*[ref(name) for name in self.keys], "reason")

    def __iter__(self) -> Iterator[DataFrame]:
        return iter((self.good, self.rejects))

    def written(self, path: str) -> Parsed:
        """The same parse from a Parquet folder with one part for good rows and one for rejects."""
        flagged = self.tagged.withColumn("is_reject", F.col("reason").isNotNull())
        flagged.write.partitionBy("is_reject").parquet(path)
        stored = self.tagged.sparkSession.read.schema(flagged.schema).parquet(path)
        return _Written(stored.drop("is_reject"), self.keys, stored)


@dataclass(frozen=True)
class _Written(Parsed):
    """A parse read from its folder."""

    flagged: DataFrame

    @property
    def good(self) -> DataFrame:
        return self.flagged.filter(~F.col("is_reject")).drop("reason", "is_reject")

    @property
    def rejects(self) -> DataFrame:
        return self.flagged.filter("is_reject").select(*[ref(name) for name in self.keys], "reason")


# Reject reasons and the line format of parameters.
BAD_JSON = "cannot JSON-parse the input"
BAD_CSV_QUOTES = "wrong quoting in CSV"
BAD_CSV_WIDTH = "wrong number of fields"
BAD_KV = "invalid parameter format: "
KV_LINE = r"^[^=]+=[^=]+$"


def container_text(text: Column) -> Column:
    """Canonical JSON of a text that is one object or list, else null; the text null counts as an empty object.

    The first character decides, so plain text and bare scalars are never parsed.
    """
    container = F.when(J.first_char(text).isin("{", "["), F.to_json(J.parse_strict(text)))
    return F.coalesce(container, F.when(F.trim(text, F.lit(" \t\r\n")) == "null", F.lit("{}")))


def parse_json_table(df: DataFrame, keys: Keys, col: str) -> Parsed:
    """JSON documents to ``(keys, kind, json, reason)``: text to object or list; bare scalars and broken text are rejected."""

    def row(json: Column) -> Column:
        reason = F.when(json.isNull(), BAD_JSON)
        return F.struct(J.json_kind(json).alias("kind"), json.alias("json"), reason.alias("reason"))

    # Behind a generator the text is parsed once, whatever filters follow.
    rows = F.array(let(container_text(ref(col)), row))
    return Parsed(df.select(*[ref(name) for name in names(keys)], F.inline(rows)), tuple(names(keys)))


# A whole CSV text: fields without quotes, or quoted fields with doubled quotes that may span lines.
_CSV_FIELD = r'(?:"[^"]*(?:""[^"]*)*"|[^",\n]*)'
_CSV_TEXT = re.compile(rf"{_CSV_FIELD}(?:[,\n]{_CSV_FIELD})*")


def _quoted_rows(text: str | None) -> list[list[str]] | None:
    if text is None or not _CSV_TEXT.fullmatch(text):
        return None
    return [row for row in csv.reader(io.StringIO(text, newline="")) if row]


@F.pandas_udf(T.ArrayType(T.ArrayType(T.StringType())))
def _quoted_csv(texts: pd.Series) -> pd.Series:
    csv.field_size_limit(sys.maxsize)
    return texts.map(_quoted_rows)


def _plain_rows(unified: Column) -> Column:
    lines = F.filter(F.split(unified, "\n", -1), lambda line: line != "")
    return F.transform(lines, lambda line: F.split(line, ",", -1))


def unify_newlines(text: Column) -> Column:
    """Line ends as single newlines."""
    return F.regexp_replace(text, r"\r(\n|\z)", "$1")


def csv_rows(text: Column) -> Column:
    """``ARRAY<ARRAY<STRING>>`` of one CSV text; null when the quoting is wrong.

    Texts without quotes stay in the JVM. Only texts that hold a quote are sent to Python.
    """
    has_quote = text.contains('"')
    quoted = _quoted_csv(F.when(has_quote, unify_newlines(text)))
    return F.when(has_quote, quoted).otherwise(_plain_rows(unify_newlines(text)))


def tag_csv(df: DataFrame, keys: Keys, col: str) -> DataFrame:
    """``(keys, rows, _error)``: all rows of a document must be as wide as its first."""
    parsed = df.select(*names(keys), csv_rows(ref(col)).alias("rows"))
    sized = parsed.withColumn("_widths", F.transform("rows", lambda row: F.size(row)))
    even = F.array_min("_widths") == F.array_max("_widths")
    error = F.when(F.col("rows").isNull(), BAD_CSV_QUOTES).when(~even, BAD_CSV_WIDTH)
    return sized.withColumn("_error", error).drop("_widths")


def parse_csv_table(df: DataFrame, keys: Keys, col: str) -> Parsed:
    """CSV documents to ``(keys, row, cells, reason)``: a row for each of their lines, or one with the reason for the whole document."""
    none, text = F.lit(None), F.lit(None).cast("string")
    bad = F.struct(none.cast("int").alias("row"), none.cast("array<string>").alias("cells"), F.col("_error").alias("reason"))
    good = F.transform("rows", lambda cells, at: F.struct(at.alias("row"), cells.alias("cells"), text.alias("reason")))
    rows = F.when(F.col("_error").isNull(), good).otherwise(F.array(bad))
    return Parsed(tag_csv(df, keys, col).select(*[ref(name) for name in names(keys)], F.inline(rows)), tuple(names(keys)))


def content_value(text: Column) -> Column:
    """JSON text of one item: the object or list it spells, else the text itself as a JSON string."""
    return F.coalesce(container_text(text), J.quote(text))


def as_result_object(json: Column) -> Column:
    """Objects stay; every other value is wrapped as ``{"result": value}``."""
    return F.when(J.json_kind(json) == "object", json).otherwise(F.concat(F.lit('{"result":'), json, F.lit("}")))


def normalize_content(df: DataFrame, keys: Keys, pos: str, text: str, wrap: bool = False) -> DataFrame:
    """``(keys, value)``: the items of a group, in the order of ``pos``, as one JSON list; a group of one item unwraps."""
    cols = names(keys)
    items = df.select(*cols, ref(pos).alias("_pos"), content_value(ref(text)).alias("_item"))
    grouped = items.groupBy(*cols).agg(ordered_values(F.col("_item"), F.col("_pos")).alias("_items"))
    value = F.when(F.size("_items") == 1, F.get("_items", F.lit(0))).otherwise(J.list_text(F.col("_items")))
    return grouped.select(*cols, (as_result_object(value) if wrap else value).alias("value"))


def call_arguments(text: Column) -> Column:
    """VARIANT object of call arguments: an object, or a JSON string holding one; null for anything else."""
    first = J.first_char(text)
    inner = F.try_variant_get(J.parse_strict(text), "$", "string")
    spelled = let(F.when(first == '"', inner), J.parse_strict)
    return F.coalesce(F.when(first == "{", J.parse_strict(text)), spelled)


def normalize_calls(df: DataFrame, keys: Keys, args: str) -> DataFrame:
    """``(keys, arg, value)``: one row per argument; text that holds no object gives no arguments."""
    return df.select(*names(keys), F.explode(J.members(call_arguments(ref(args)))).alias("arg", "value"))


def parse_kv_table(df: DataFrame, keys: Keys, col: str, ignore_errors: bool = False) -> Parsed:
    """``k=v`` lines to ``(keys, k, v, reason)``, last line wins; each other line is a reject, or skipped."""
    cols = [ref(name) for name in names(keys)]
    lines = df.select(*cols, F.posexplode(F.split(ref(col), r"\r?\n", -1)).alias("_pos", "_line"))
    fits = F.col("_line").rlike(KV_LINE)
    if ignore_errors:
        lines = lines.filter(fits)
    # Good lines meet by their name, a bad line is a group of its own by its place.
    lines = lines.select(*cols, "_pos", "_line", F.when(fits, F.substring_index("_line", "=", 1)).alias("k"))
    lines = lines.withColumn("_bad", F.when(F.col("k").isNull(), F.col("_pos")))
    last = lines.groupBy(*cols, "k", "_bad").agg(F.max_by("_line", "_pos").alias("_line"))
    good = F.col("_bad").isNull()
    value = F.when(good, F.substring_index("_line", "=", -1))
    reason = F.when(~good, F.concat(F.lit(BAD_KV), F.col("_line")))
    return Parsed(last.select(*cols, "k", value.alias("v"), reason.alias("reason")), tuple(names(keys)))
