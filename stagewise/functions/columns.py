"""Small helpers shared by the operators."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Keys = str | Iterable[str]


def names(keys: Keys) -> list[str]:
    """One column name or several, always as a list."""
    return [keys] if isinstance(keys, str) else list(keys)


def ref(name: str) -> Column:
    """Column by its exact name, also when the name holds dots."""
    return F.col("`" + name.replace("`", "``") + "`")


def join_on(left: DataFrame, right: DataFrame, cols: list[str], how: str = "inner") -> DataFrame:
    """Equi-join on shared columns that also pairs null with null, as grouping does; keeps the left key columns."""
    renamed = right.withColumnsRenamed({name: f"_r_{name}" for name in cols})
    condition = reduce(lambda a, b: a & b, [ref(name).eqNullSafe(ref(f"_r_{name}")) for name in cols])
    return left.join(renamed, condition, how).drop(*[f"_r_{name}" for name in cols])


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that it uses several times, with the value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def if_present(value: Column) -> Column:
    """List of the value, empty for null.

    Exploding it drops the null rows like a filter would, but a filter on a computed column is pushed below the
    projection, and then computes the column a second time.
    """
    return F.array_compact(F.array(value))


def ordered_values(value: Column, *order: Column) -> Column:
    """Aggregate: the values of a group as one list in the given order; for groups that fit a cell."""
    fields = [column.alias(f"_o{i}") for i, column in enumerate(order)]
    packed = F.array_sort(F.collect_list(F.struct(*fields, value.alias("_v"))))
    return F.transform(packed, lambda item: item["_v"])
