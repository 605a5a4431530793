"""Projection, filtering, expansion and per-group row work."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stagewise.functions.columns import Keys, join_on, names, ref
from stagewise.operators.parse import container_text, csv_rows


def reshape(df: DataFrame, fields: dict[str, str], keep: Keys = ()) -> DataFrame:
    """New fields from SQL expressions over the row, after the columns to keep."""
    return df.select(*[ref(name) for name in names(keep)], *[F.expr(sql).alias(name) for name, sql in fields.items()])


def reshape_list(df: DataFrame, col: str, fields: dict[str, str], out: str | None = None) -> DataFrame:
    """The same for every object of a list column; expressions see the object as ``item``."""
    body = ", ".join(f"'{name}', {sql}" for name, sql in fields.items())
    return df.withColumn(out or col, F.expr(f"transform(`{col}`, item -> named_struct({body}))"))


def slice_rows(df: DataFrame, keys: Keys, pos: str, start: int | None = None, stop: int | None = None) -> DataFrame:
    """Rows of each group at positions ``[start:stop]``, counted from 0; negative bounds count from the end.

    Non-negative bounds are a plain filter. Only negative ones need the group sizes, from a pre-aggregated count.
    """
    cols = names(keys)
    bounded = df
    from_end = any(bound is not None and bound < 0 for bound in (start, stop))
    if from_end:
        sizes = df.groupBy(*cols).agg(F.count(F.lit(1)).alias("_rows"))
        bounded = join_on(df, sizes, cols)

    def edge(bound: int) -> Column:
        return F.lit(bound) if bound >= 0 else F.col("_rows") + F.lit(bound)

    if start is not None:
        bounded = bounded.filter(ref(pos) >= edge(start))
    if stop is not None:
        bounded = bounded.filter(ref(pos) < edge(stop))
    return bounded.drop("_rows") if from_end else bounded


def cells_to_records(df: DataFrame, fields: Sequence[str], cells: str = "cells", keep: Keys = ()) -> DataFrame:
    """Positional cells to named columns; a missing cell is null."""
    return df.select(
        *[ref(name) for name in names(keep)],
        *[F.get(ref(cells), F.lit(i)).alias(name) for i, name in enumerate(fields)],
    )


@dataclass(frozen=True)
class Rule:
    """One transformer. Steps run in this order: parser, path, expression, callback.

    ``parser`` is ``json`` or ``csv``; ``path`` and ``expr`` are SQL over ``args``, the value so far; ``callback`` maps a
    Column to a Column. Exactly one trigger names the resource or function the rule belongs to.
    """

    name: str
    on_resource: str | None = None
    on_input: str | None = None
    on_output: str | None = None
    parser: str | None = None
    path: str | None = None
    expr: str | None = None
    callback: Callable[[Column], Column] | None = None


def _typed_to_text(value: Column, kind: T.DataType) -> tuple[Column, bool]:
    """Body text and whether it is structured: lists and objects become JSON, other values their plain text."""
    if isinstance(kind, (T.StructType, T.MapType, T.ArrayType)):
        return F.to_json(value, {"ignoreNullFields": "false"}), True
    if isinstance(kind, T.VariantType):
        return F.to_json(value), True
    return value.cast("string"), False


def run_rule(df: DataFrame, rule: Rule) -> DataFrame:
    """Apply the steps of one rule to the column ``args``."""
    kind = df.schema["args"].dataType
    if rule.parser not in (None, "json", "csv"):
        raise ValueError(f"unknown parser: {rule.parser}")
    if rule.parser is not None and isinstance(kind, T.StringType):
        parse = csv_rows if rule.parser == "csv" else lambda text: F.try_parse_json(container_text(text))
        df = df.withColumn("_parsed", parse(F.col("args")))
        if "_failed" in df.columns:
            failed = F.col("args").isNotNull() & F.col("_parsed").isNull()
            reason = F.lit(f"{rule.name}: content is not {rule.parser.upper()}")
            df = df.withColumn("_failed", F.coalesce("_failed", F.when(failed, reason)))
        df = df.withColumn("args", F.col("_parsed")).drop("_parsed")
    for sql in (rule.path, rule.expr):
        if sql is not None:
            df = df.withColumn("args", F.expr(sql))
    if rule.callback is not None:
        df = df.withColumn("args", rule.callback(F.col("args")))
    return df


def apply_transformers(
    df: DataFrame, rules: Sequence[Rule], name: str, content: str, trigger: str = "on_resource", mode: str = "permissive"
) -> DataFrame:
    """Rewrite ``content`` by the rules whose trigger equals the row's ``name``, in list order.

    Adds ``structured``: true when the result is a list or an object (then ``content`` is its JSON). Rows without a rule
    pass unchanged, and so do rows whose content a parser refuses; ``_error`` tells them (an earlier ``_error`` stays), or stops the job
    with ``mode="failfast"``. Rules of different names work on one scan: each name has its own value column, null elsewhere.
    """
    if mode not in ("permissive", "failfast"):
        raise ValueError(f"unknown mode: {mode}")
    if "args" in df.columns:
        raise ValueError("the column name args is reserved for rule expressions")
    targets: dict[str, list[Rule]] = {}
    for rule in rules:
        target = getattr(rule, trigger)
        if target is not None:
            targets.setdefault(target, []).append(rule)
    body: Column = ref(content).cast("string")
    structured: Column = F.lit(False)
    scratch: list[str] = []
    df = df.withColumn("_failed", F.lit(None).cast("string"))
    for i, (target, chain) in enumerate(targets.items()):
        df = df.withColumn("args", F.when(ref(name) == target, ref(content).cast("string")))
        for rule in chain:
            df = run_rule(df, rule)
        text, nested = _typed_to_text(F.col("args"), df.schema["args"].dataType)
        df = df.withColumn(f"_rule{i}", text)
        scratch.append(f"_rule{i}")
        body = F.when(ref(name) == target, F.col(f"_rule{i}")).otherwise(body)
        structured = F.when(ref(name) == target, F.lit(nested)).otherwise(structured)
    failed = F.col("_failed")
    if mode == "failfast":
        failed = F.when(failed.isNotNull(), F.raise_error(failed).cast("string"))
    error = F.coalesce(ref("_error"), failed) if "_error" in df.columns else failed
    df = df.withColumn("structured", structured & F.col("_failed").isNull())
    df = df.withColumn(content, F.when(F.col("_failed").isNull(), body).otherwise(ref(content).cast("string")))
    return df.withColumn("_error", error).drop("args", "_failed", *scratch)


def typed_condition(df: DataFrame, sql: str) -> Column:
    """A condition whose analysed type is boolean; anything else is an error before any row is read."""
    condition = F.expr(sql)
    kind = df.select(condition.alias("_")).schema[0].dataType
    if not isinstance(kind, T.BooleanType):
        raise ValueError(f"not a boolean expression ({kind.simpleString()}): {sql}")
    return condition


def gate(df: DataFrame, sql: str) -> DataFrame:
    """Rows for which a boolean expression holds."""
    return df.filter(typed_condition(df, sql))


def iterate(df: DataFrame, sql: str | None = None) -> DataFrame:
    """One row per item of a list expression, as ``it`` with position ``it_pos``.

    Without an expression each row runs once. An empty list gives no rows.
    """
    if sql is None:
        return df.withColumn("it_pos", F.lit(0)).withColumn("it", F.lit(None).cast("string"))
    items = F.expr(sql)
    kind = df.select(items.alias("_")).schema[0].dataType
    if not isinstance(kind, T.ArrayType):
        raise ValueError(f"expression did not evaluate to an array ({kind.simpleString()}): {sql}")
    return df.select("*", F.posexplode(items).alias("it_pos", "it"))


def unique_rows(df: DataFrame, keys: Keys, value: str, seq: str) -> DataFrame:
    """``(keys, value, seq)``: each distinct value of a group with the order key it was first seen at."""
    return df.groupBy(*names(keys), value).agg(F.min(seq).alias(seq))


#: One row in so many may become a border of ranges, of a group at most so many rows do.
BORDER_SHARE, MOST_BORDERS = 1 << 12, 1 << 11


def range_borders(df: DataFrame, keys: Keys, seq: str) -> DataFrame:
    """``(keys, _borders)``: sorted values of ``seq`` that cut a large group into ranges of about equal size; small groups have none.

    Rows are drawn by the hash of key and order, so the borders are the same in every evaluation. A row's level is how often the share that
    draws it halves; a group keeps its rows from the lowest level on that leaves ``MOST_BORDERS`` of them at most.
    """
    cols = names(keys)
    place = F.shiftrightunsigned(F.xxhash64(*[ref(name) for name in cols], ref(seq)), 11) + 1
    level = F.floor(53 - F.log2(place.cast("double"))).alias("_level")
    drawn = df.select(*[ref(name) for name in cols], ref(seq).alias("_at"), level).filter(F.col("_level") >= BORDER_SHARE.bit_length() - 1)
    downward = W.partitionBy(*[ref(name) for name in cols]).orderBy(F.desc("_level"))
    sums = drawn.groupBy(*[ref(name) for name in cols], "_level").agg(F.count(F.lit(1)).alias("_n")).withColumn("_n", F.sum("_n").over(downward))
    least = sums.filter(F.col("_n") <= MOST_BORDERS).groupBy(*[ref(name) for name in cols]).agg(F.min("_level").alias("_least"))
    kept = join_on(drawn, least, cols).filter(F.col("_level") >= F.col("_least"))
    return kept.groupBy(*[ref(name) for name in cols]).agg(F.array_sort(F.collect_set("_at")).alias("_borders"))


def _range_of(value: Column) -> Column:
    """How many borders lie below a value, by halving steps."""
    size = F.size("_borders")

    def step(below: Column, power: Column) -> Column:
        further = below + power
        return F.when((further <= size) & (F.get("_borders", further - 1) < value), further).otherwise(below)

    powers = F.array(*[F.lit(1 << i) for i in reversed(range(MOST_BORDERS.bit_length()))])
    return F.when(F.col("_borders").isNull() | value.isNull(), 0).otherwise(F.aggregate(powers, F.lit(0), step))


def prefix_sums(df: DataFrame, keys: Keys, seq: str, amounts: dict[str, Column]) -> DataFrame:
    """Add, by name, the sums of some amounts over the rows of the group before each row, in ``seq`` order, for groups of any size.

    A large group is cut into ranges by borders that depend on its rows alone: sums of whole ranges are added up and joined back, and only the rows of
    a range meet. Nothing runs before the result is asked for. Rows with equal order are in one range, in any order. Null orders come first.
    """
    cols, group = names(keys), [ref(name) for name in names(keys)]
    ranged = join_on(df, range_borders(df, keys, seq), cols, "left").withColumn("_range", _range_of(ref(seq))).drop("_borders")
    ranged = ranged.withColumns({f"_amount_{name}": amount for name, amount in amounts.items()})
    earlier = W.partitionBy(*group).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    before = W.partitionBy(*group, "_range").orderBy(ref(seq)).rowsBetween(W.unboundedPreceding, -1)
    sums = ranged.groupBy(*group, "_range").agg(*[F.sum(f"_amount_{name}").alias(f"_offset_{name}") for name in amounts])
    nothing = F.lit(0)
    offsets = [F.coalesce(F.sum(f"_offset_{name}").over(earlier), nothing).alias(f"_offset_{name}") for name in amounts]
    inside = {f"_inside_{name}": F.coalesce(F.sum(f"_amount_{name}").over(before), nothing) for name in amounts}
    joined = join_on(ranged.withColumns(inside), sums.select(*group, "_range", *offsets), [*cols, "_range"])
    out = {name: (F.col(f"_offset_{name}") + F.col(f"_inside_{name}")).cast("bigint") for name in amounts}
    return joined.withColumns(out).drop("_range", *[f"_{part}_{name}" for part in ("offset", "inside", "amount") for name in amounts])


def numbered_rows(df: DataFrame, keys: Keys, seq: str, out: str = "rn") -> DataFrame:
    """Exact 0-based row number inside each group, in ``seq`` order, also for groups far larger than one task."""
    return prefix_sums(df, keys, seq, {out: F.lit(1)})


def chunk_rows(df: DataFrame, keys: Keys, seq: str, n: int) -> DataFrame:
    """Add ``chunk`` and ``chunk_pos``: consecutive groups of ``n`` rows, the last one may be short."""
    if n < 1:
        raise ValueError("chunk size must be at least 1")
    numbered = numbered_rows(df, keys, seq, "_rn")
    return (
        numbered.withColumn("chunk", F.floor(F.col("_rn") / n).cast("bigint"))
        .withColumn("chunk_pos", F.pmod("_rn", F.lit(n)).cast("bigint"))
        .drop("_rn")
    )


def chunk_array(items: Column, n: int) -> Column:
    """Array form of the same for one list value; an empty list has no chunks."""
    if n < 1:
        raise ValueError("chunk size must be at least 1")
    starts = F.sequence(F.lit(1), F.size(items), F.lit(n))
    chunks = F.transform(starts, lambda start: F.slice(items, start, n))
    return F.when(F.size(items) > 0, chunks).otherwise(F.slice(F.array(items), 1, 0))


def overlay_vars(levels: Sequence[DataFrame], keys: Keys, name: str = "name", value: str = "value") -> DataFrame:
    """``(keys, name, value)`` over variable tables given from the outermost level inwards; the later level wins."""
    cols = names(keys)
    tagged: DataFrame | None = None
    for level, table in enumerate(levels):
        part = table.select(*cols, ref(name).alias("name"), ref(value).alias("value"), F.lit(level).alias("_level"))
        tagged = part if tagged is None else tagged.unionByName(part)
    if tagged is None:
        raise ValueError("at least one level is needed")
    return tagged.groupBy(*cols, "name").agg(F.max_by("value", "_level").alias("value"))
