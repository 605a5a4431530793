"""Merging of partial JSON records.

The merge of a field depends on the order of its fragments, yet it needs no ordered fold. What decides the outcome are a
few positions: where the first list arrived, where the last plain value, object and null arrived. These are minima and
maxima, so they are pre-aggregated before the shuffle and a key with very many fragments costs one small row per task.
List items are never gathered: they stay rows, ordered by (seq, pos).

Result rows: ``(keys, field, kind, seq, pos, name, value)``

* ``scalar``: one row with the value;
* ``object``: a header row (name null) and one row per member;
* ``list``: a header row (pos -1) and one row per item.

Values are JSON text. These rows are the whole result for keys of any size; ``assemble_records`` turns them into one JSON
object per key, for keys whose record fits a cell.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stagewise.functions import json_text as J
from stagewise.functions.columns import Keys, join_on, names, ordered_values, ref

NOT_AN_OBJECT = "fragment is not a JSON object"
RESULT = ["field", "kind", "seq", "pos", "name", "value"]


def fragment_fields(df: DataFrame, keys: Keys, seq: str, fragment: str) -> DataFrame:
    """``(keys, seq, field, item)``: one row per field of each fragment, the item as VARIANT."""
    return df.select(
        *names(keys),
        ref(seq).alias("seq"),
        F.explode(J.as_map(J.parse_strict(ref(fragment)))).alias("field", "item"),
    )


def fragment_rejects(df: DataFrame, fragment: str) -> DataFrame:
    """Rows whose fragment is no JSON object, with the reason."""
    return df.filter(~is_object(ref(fragment))).withColumn("_error", F.lit(NOT_AN_OBJECT))


def is_object(text: Column) -> Column:
    """Whether a text is one JSON object; false for null."""
    return F.coalesce(J.variant_kind(J.parse_strict(text)) == "object", F.lit(False))


def _is_scalar() -> Column:
    return F.col("kind").isin("string", "number", "boolean")


def field_state(fields: DataFrame, keys: Keys) -> DataFrame:
    """State per (keys, field, name); plain minima and maxima, so it also runs as a streaming aggregation.

    Rows without a name hold the marks of a field: where its first list and its last object, null and plain value came,
    and that value. Named rows hold the last value of an object member and where it came.
    """
    typed = fields.withColumn("_text", F.to_json("item")).withColumn("kind", J.json_kind(F.col("_text")))
    # A nameless entry for the field itself, then the members of an object.
    entry = "array<struct<name:string,member:variant>>"
    itself = F.array(F.struct(F.lit(None), F.lit(None))).cast(entry)
    members = F.map_entries(J.as_map(F.when(F.col("kind") == "object", F.col("item")))).cast(entry)
    exploded = typed.select(
        *names(keys), "field", "seq", "kind", "_text", F.inline(F.concat(itself, F.coalesce(members, F.array().cast(entry))))
    )
    entries = exploded.withColumn(
        "value", F.when(F.col("name").isNotNull(), F.to_json("member")).when(_is_scalar(), F.col("_text"))
    )
    marked = F.col("name").isNull()
    at = F.col("seq")
    holds_value = F.when(_is_scalar() | ~marked, at)
    return entries.groupBy(*names(keys), "field", "name").agg(
        F.min(F.when(marked & (F.col("kind") == "array"), at)).alias("list_from"),
        F.max(F.when(marked & (F.col("kind") == "object"), at)).alias("object_at"),
        F.max(F.when(marked & (F.col("kind") == "null"), at)).alias("null_at"),
        F.max(holds_value).alias("at"),
        F.max_by("value", holds_value).alias("value"),
        F.bool_and(marked).alias("is_mark"),
    )


def field_kind() -> Column:
    """Kind of the merged field from its marks; null when nothing remains of it."""
    object_last = F.coalesce(F.col("object_at") > F.col("at"), F.col("object_at").isNotNull())
    removed = F.coalesce(F.col("null_at") > F.col("at"), F.lit(False))
    return (
        F.when(F.col("list_from").isNotNull(), "list")
        .when(object_last, "object")
        .when(F.col("at").isNotNull() & ~removed, "scalar")
    )


def list_items(fields: DataFrame, keys: Keys) -> DataFrame:
    """Everything a list would take in: items of lists, and plain values and objects as one item each."""
    pieces = F.coalesce(J.as_list(F.col("item")), F.array("item"))
    items = fields.filter(~F.is_variant_null("item")).select(
        *names(keys), "field", "seq", F.posexplode(pieces).alias("pos", "_piece")
    )
    return items.withColumn("value", F.to_json("_piece")).drop("_piece")


def resolve_merge(state: DataFrame, items: DataFrame, keys: Keys) -> DataFrame:
    """Result rows from the field states and the list candidates.

    The state is used twice with all its columns and filtered by ``is_mark``, which is an aggregate, so both uses share
    one shuffle of it. The marks have a row per key and field. Spark guesses their size from the file behind them and may be wrong by any
    factor, as texts grow and fragments split on the way; so it is told not to broadcast them.
    """
    cols = [*names(keys), "field"]
    kinds = state.withColumn("kind", field_kind())
    marks = kinds.filter("is_mark AND kind IS NOT NULL").select(
        *cols,
        F.col("kind").alias("_kind"),
        F.col("list_from").alias("_list_from"),
        F.col("at").alias("_scalar_at"),
        F.col("value").alias("_scalar"),
    )
    own_kind = F.when(F.col("is_mark"), F.col("kind")).otherwise("member")
    state_rows = kinds.select(
        *cols,
        own_kind.alias("_role"),
        F.when(own_kind == "list", F.col("list_from"))
        .when(own_kind == "object", F.col("object_at"))
        .otherwise(F.col("at"))
        .alias("seq"),
        F.when(own_kind.isin("list", "object"), -1).otherwise(0).alias("pos"),
        "name",
        F.when(own_kind == "member", F.col("value")).alias("value"),
    )
    item_rows = items.select(*cols, F.lit("item").alias("_role"), "seq", "pos", F.lit(None).cast("string").alias("name"), "value")
    joined = join_on(state_rows.filter("_role IS NOT NULL").unionByName(item_rows), marks.hint("merge"), cols)
    role, kind = F.col("_role"), F.col("_kind")
    kept = (
        F.when(role == "member", (kind == "object") & F.coalesce(F.col("seq") > F.col("_scalar_at"), F.lit(True)))
        .when(role == "item", (kind == "list") & (F.col("seq") >= F.col("_list_from")))
        .otherwise(F.lit(True))
    )
    value = F.when(role == "scalar", F.col("_scalar")).otherwise(F.col("value"))
    return joined.filter(kept).select(*cols, kind.alias("kind"), "seq", "pos", "name", value.alias("value"))


def merge_fragments(df: DataFrame, keys: Keys, seq: str, fragment: str) -> DataFrame:
    """Type-aware merge: lists append, objects overlay one level, plain values replace, null clears a plain value."""
    fields = fragment_fields(df, keys, seq, fragment)
    return resolve_merge(field_state(fields, keys), list_items(fields, keys), keys)


def overlay_fragments(df: DataFrame, keys: Keys, seq: str, fragment: str) -> DataFrame:
    """Shallow merge ``(keys, field, value)``: the last value of each field wins, null included."""
    fields = df.select(
        *names(keys), ref(seq).alias("_seq"), F.explode(J.members(J.parse_strict(ref(fragment)))).alias("field", "value")
    )
    return fields.groupBy(*names(keys), "field").agg(F.max_by("value", "_seq").alias("value"))


def merge_records(df: DataFrame, keys: Keys, seq: str, fragment: str) -> DataFrame:
    """Merge and assemble in one go."""
    return assemble_records(merge_fragments(df, keys, seq, fragment), keys)


def assemble_records(merged: DataFrame, keys: Keys) -> DataFrame:
    """``(keys, record)``: result rows as one JSON object per key, whatever its size; rows of kind ``error`` add nothing to it."""
    cols = names(keys)
    fields = merged.groupBy(*cols, "field").agg(
        F.first("kind").alias("kind"),
        ordered_values(
            F.struct("name", "value"), F.col("seq"), F.col("pos"), F.coalesce(F.col("name"), F.lit(""))
        ).alias("_rows"),
    )
    values = F.filter(F.col("_rows"), lambda row: row["value"].isNotNull())
    named = F.array_sort(F.filter(F.col("_rows"), lambda row: row["name"].isNotNull()))
    text = (
        F.when(F.col("kind") == "scalar", F.get(values, F.lit(0))["value"])
        .when(F.col("kind") == "object", J.object_text(named))
        .otherwise(J.list_text(F.transform(values, lambda row: row["value"])))
    )
    entry = F.struct(F.col("field").alias("name"), text.alias("value"))
    packed = F.array_sort(F.collect_list(F.when(F.col("kind") != "error", entry)))
    return fields.groupBy(*cols).agg(J.object_text(packed).alias("record"))
