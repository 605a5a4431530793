"""Progress events. The same code serves batch tables and streams: both operators are stateless."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stagewise.functions.columns import ref

# Levels, and the event fields that a flat listing shows, in order.
DEBUG = "debug"
INFO = "info"
EVENT_FIELDS = [
    "component",
    "type",
    "session",
    "resource",
    "phase",
    "iteration",
    "content",
    "function",
    "transformer",
    "engine",
    "err",
]


def event_level_filter(events: DataFrame, level: str, col: str = "level") -> DataFrame:
    """Debug events pass only at the debug level; all others always pass."""
    return events if level == DEBUG else events.filter(ref(col) != DEBUG)


def _text(column: Column, kind: T.DataType) -> Column:
    nested = isinstance(kind, (T.StructType, T.MapType, T.ArrayType, T.VariantType))
    return F.to_json(column) if nested else column.cast("string")


def flatten_events(events: DataFrame, id_col: str = "id", args: str = "args") -> DataFrame:
    """``(id, pos, name, value)``: the fields an event holds, then its extra arguments."""
    entries = [
        F.when(ref(name).isNotNull(), F.struct(F.lit(name).alias("name"), _text(ref(name), events.schema[name].dataType).alias("value")))
        for name in EVENT_FIELDS
        if name in events.columns
    ]
    present = F.array_compact(F.array(*entries))
    if args in events.columns:
        extra = F.transform(
            F.array_sort(F.map_entries(ref(args))),
            lambda e: F.struct(e["key"].alias("name"), e["value"].cast("string").alias("value")),
        )
        present = F.concat(present, F.coalesce(extra, F.array().cast("array<struct<name:string,value:string>>")))
    return events.select(ref(id_col).alias("id"), F.posexplode(present).alias("pos", "_e")).select(
        "id", "pos", F.col("_e.name").alias("name"), F.col("_e.value").alias("value")
    )
