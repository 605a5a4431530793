"""User functions by name: Python over Arrow batches, table lookups and table functions."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stagewise.functions.columns import Keys, names, ref


@dataclass(frozen=True)
class Registered:
    """One function: its declared inputs in order, its result, and how it is evaluated."""

    name: str
    inputs: tuple[str, ...]
    output: str
    group: str = ""
    description: str = ""
    apply: Callable[..., Column] | None = None
    table: DataFrame | None = None


@dataclass
class FunctionRegistry:
    """Functions a plan may call. Unknown names are an error when the plan is built."""

    entries: dict[str, Registered] = field(default_factory=dict)

    def get(self, name: str) -> Registered:
        """The function of that name."""
        if name not in self.entries:
            raise KeyError(f"function {name} not found")
        return self.entries[name]

    def in_group(self, group: str) -> "FunctionRegistry":
        """The functions of one group."""
        return FunctionRegistry({name: entry for name, entry in self.entries.items() if entry.group == group})

    def with_functions(self, other: "FunctionRegistry") -> "FunctionRegistry":
        """Both sets; the other's functions replace those of the same name."""
        return FunctionRegistry({**self.entries, **other.entries})

    def catalog(self, spark: SparkSession) -> DataFrame:
        """``(name, collection, description, schema)`` for lookups."""
        rows = [(e.name, e.group, e.description, e.output) for e in self.entries.values()]
        return spark.createDataFrame(rows, "name string, collection string, description string, schema string")

    def register_function(
        self,
        spark: SparkSession,
        name: str,
        fn: Callable[..., pd.Series],
        inputs: dict[str, str],
        output: str,
        group: str = "",
        description: str = "",
    ) -> Registered:
        """Register a function of pandas Series; it is also callable by name from SQL.

        ``inputs`` maps parameter names to Spark types in call order; arguments are cast to these types.
        """
        udf = F.pandas_udf(fn, output)
        spark.udf.register(name, udf)
        types = list(inputs.values())

        def apply(*args: Column) -> Column:
            return udf(*[arg.cast(kind) for arg, kind in zip(args, types, strict=True)])

        entry = Registered(name, tuple(inputs), output, group, description, apply)
        self.entries[name] = entry
        return entry

    def register_columns(
        self, name: str, fn: Callable[..., Column], inputs: Iterable[str], output: str, group: str = "", description: str = ""
    ) -> Registered:
        """Register a function made of Spark expressions; it never leaves the JVM."""
        entry = Registered(name, tuple(inputs), output, group, description, fn)
        self.entries[name] = entry
        return entry

    def register_table(
        self, name: str, table: DataFrame, inputs: Keys, output: str, group: str = "", description: str = ""
    ) -> Registered:
        """Register a lookup: ``output`` is the column it returns for a combination of the input columns.

        There has to be one row per combination; a repeated one stops the job that looks something up.
        """
        keys = names(inputs)
        if keys:
            counted = table.groupBy(*[ref(name) for name in keys])
            counted = counted.agg(F.any_value(ref(output)).alias(output), F.count(F.lit(1)).alias("_n"))
            twice = F.raise_error(F.lit(f"{name}: inputs are not unique")).cast(table.schema[output].dataType)
            table = counted.select(*keys, F.when(F.col("_n") == 1, ref(output)).otherwise(twice).alias(output))
        entry = Registered(name, tuple(names(inputs)), output, group, description, None, table)
        self.entries[name] = entry
        return entry


def map_batches(df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """Callback over Arrow batches of rows; groups are not gathered, so any partitioning will do."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield fn(batch)

    return df.mapInPandas(run, schema)


def call_table_function(df: DataFrame, udtf: Any, *args: Column) -> DataFrame:
    """Rows joined with the rows a table function returns for them."""
    return df.lateralJoin(udtf(*[arg.outer() for arg in args]))
