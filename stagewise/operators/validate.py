"""Validation of JSON values against a schema, as one expression per schema.

The driver walks the schema once and builds an array of violations per row; there is no shuffle and no Python in it.

A schema that refers to itself has no such expression. There the expression ends at the reference and gives what is left to check: the value as
VARIANT, its path and the component. These rows are the frontier of the next round, which holds them against the components' own
expressions, until none is left. What happens inside of a branch of ``anyOf`` is tagged with it; the branches are weighed when all is known.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stagewise.functions import json_text as J
from stagewise.functions.casts import text_to_boolean, text_to_integer, text_to_number
from stagewise.functions.columns import Keys, if_present, names, ref
from stagewise.plans.schema import REF_PREFIX, Schema, resolve_refs
from stagewise.session import materialize

# Names of the value kinds as the messages print them.
KIND_LABELS = {"object": "map", "array": "slice", "number": "float64", "boolean": "bool", "string": "string"}

NO_BRANCH = "value does not match any of the schemas in anyOf"

Path = str | Column


@dataclass(frozen=True)
class Check:
    """One rule at one place: the violation exists where ``failed`` is true."""

    failed: Column
    path: Path
    rule: str
    message: Column


@dataclass(frozen=True)
class Later:
    """A value that a reference leaves to a later round, where ``here`` is true, within branches ``alts`` of ``anyOf``."""

    here: Column
    path: Path
    target: str
    value: Column
    alts: tuple[Column, ...] = ()


@dataclass
class Found:
    """Rules of a value: single checks, and violation arrays of its list items; in a schema that refers to itself also what is left for later.

    ``deep`` tells that arrays hold entries of the long form, with what is left among them.
    """

    checks: list[Check]
    arrays: list[Column]
    later: list[Later] = field(default_factory=list)
    deep: bool = False

    def add(self, failed: Column, path: Path, rule: str, *message: Any) -> None:
        """Append a check; message parts are texts and columns."""
        parts = [part.cast("string") if isinstance(part, Column) else F.lit(str(part)) for part in message]
        self.checks.append(Check(failed, path, rule, F.concat(*parts) if len(parts) > 1 else parts[0]))

    def extend(self, other: "Found") -> None:
        """Append all rules of a part."""
        self.checks += other.checks
        self.arrays += other.arrays
        self.later += other.later
        self.deep = self.deep or other.deep

    def any_failed(self) -> Column:
        """True where at least one rule is broken for certain."""
        single = [F.coalesce(check.failed, F.lit(False)) for check in self.checks]
        broken = (lambda v: v["rule"].isNotNull() & (F.size(v["alts"]) == 0)) if self.deep else (lambda v: F.lit(True))
        listed = [F.coalesce(F.exists(array, broken), F.lit(False)) for array in self.arrays]
        return reduce(lambda a, b: a | b, single + listed, F.lit(False))

    def any_left(self) -> Column:
        """True where something is left for later."""
        single = [F.coalesce(later.here, F.lit(False)) for later in self.later]
        left = lambda v: v["ref"].isNotNull() | (F.size(v["alts"]) > 0)
        listed = [F.coalesce(F.exists(array, left), F.lit(False)) for array in self.arrays] if self.deep else []
        return reduce(lambda a, b: a | b, single + listed, F.lit(False))

    def to_entries(self) -> Column:
        """``to_array`` in the long form: with ``ref``, ``value`` and ``alts``, and an entry without a rule for each value left for later."""
        none = F.array().cast(ALTS)
        structs = [
            F.when(check.failed, _entry(_path(check.path), F.lit(check.rule), check.message, F.lit(None), F.lit(None), none)) for check in self.checks
        ]
        for later in self.later:
            alts = F.array(*later.alts).cast(ALTS) if later.alts else none
            structs.append(F.when(later.here, _entry(_path(later.path), F.lit(None), F.lit(None), F.lit(later.target), later.value, alts)))
        parts = [F.array_compact(F.array(*structs))] if structs else []
        parts += [F.coalesce(array, F.array().cast(ENTRIES)) for array in self.arrays]
        return F.concat(*parts) if parts else F.array().cast(ENTRIES)

    def to_array(self) -> Column:
        """``ARRAY<STRUCT<path, rule, message>>`` of the broken rules, in schema order."""
        structs = [
            F.when(
                check.failed,
                F.struct(_path(check.path).alias("path"), F.lit(check.rule).alias("rule"), check.message.alias("message")),
            )
            for check in self.checks
        ]
        parts = [F.array_compact(F.array(*structs))] if structs else []
        parts += [F.coalesce(array, F.array().cast(VIOLATIONS)) for array in self.arrays]
        return F.concat(*parts) if parts else F.array().cast(VIOLATIONS)


VIOLATIONS = "array<struct<path:string,rule:string,message:string>>"
ALTS = "array<struct<at:string,branch:int,n:int>>"
ENTRIES = f"array<struct<path:string,rule:string,message:string,ref:string,value:variant,alts:{ALTS}>>"


def _entry(path: Column, rule: Column, message: Column, target: Column, value: Column, alts: Column) -> Column:
    """One violation or value left for later, in the long form."""
    parts = {"path": path, "rule": rule, "message": message, "ref": target}
    texts = [part.cast("string").alias(name) for name, part in parts.items()]
    return F.struct(*texts, value.cast("variant").alias("value"), alts.alias("alts"))


class Bindings:
    """Values used more than once become columns, level by level, so that each is computed once per row.

    Inside list items there are no columns; there a value is simply repeated.
    """

    def __init__(self, inside_list: bool = False, deep: bool = False) -> None:
        self.levels: dict[int, dict[str, Column]] = {}
        self.inside_list = inside_list
        self.deep = deep
        self.count = 0

    def bind(self, level: int, value: Column) -> Column:
        """Name a value."""
        if self.inside_list:
            return value
        name = f"_b{self.count}"
        self.count += 1
        self.levels.setdefault(level, {})[name] = value
        return F.col(name)

    def bound_names(self) -> list[str]:
        """All names given so far."""
        return [name for level in self.levels.values() for name in level]

    def apply(self, df: DataFrame) -> DataFrame:
        """Add all named values."""
        for level in sorted(self.levels):
            df = df.withColumns(self.levels[level])
        return df


def _path(path: Path) -> Column:
    return F.lit(path) if isinstance(path, str) else path


def _below(path: Path, name: str) -> Path:
    if isinstance(path, str):
        return f"{path}.{name}" if path else name
    return F.concat(path, F.lit("." + name))


def _label(kind: Column) -> Column:
    return reduce(lambda acc, pair: F.when(kind == pair[0], pair[1]).otherwise(acc), KIND_LABELS.items(), F.lit("invalid"))


def _member(value: Column, name: str) -> Column:
    escaped = name.replace("\\", "\\\\").replace('"', '\\"')
    return F.try_variant_get(value, f'$["{escaped}"]', "variant")


def _number_text(number: Column) -> Column:
    whole = (number == F.floor(number)) & (F.abs(number) < 1e15)
    return F.when(whole, number.try_cast("bigint").cast("string")).otherwise(number.cast("string"))


def _bound_text(bound: float) -> str:
    return str(int(bound)) if float(bound).is_integer() else str(bound)


def _object_rules(value: Column, schema: Schema, path: Path, here: Column, soft: bool, bindings: Bindings, level: int) -> Found:
    found = Found([], [])
    low, high = schema.get("minProperties"), schema.get("maxProperties")
    if low is not None or high is not None:
        count = bindings.bind(level, F.size(F.map_keys(J.as_map(value))))
        if low is not None:
            found.add(here & (count < low), path, "property_count", "object has ", count, f" properties, minimum is {low}")
        if high is not None:
            found.add(here & (count > high), path, "property_count", "object has ", count, f" properties, maximum is {high}")
    fields = schema.get("properties") or {}
    members = {
        name: bindings.bind(level, _member(value, name)) for name in dict.fromkeys([*(schema.get("required") or []), *fields])
    }
    for name in schema.get("required") or []:
        found.add(here & members[name].isNull(), path, "required", f"missing required property: {name}")
    for name, field in fields.items():
        present = here & members[name].isNotNull()
        found.extend(rules_of(members[name], field, _below(path, name), present, soft, bindings, level + 1))
    return found


def _array_rules(value: Column, schema: Schema, path: Path, here: Column, soft: bool, bindings: Bindings, level: int) -> Found:
    found = Found([], [])
    items = bindings.bind(level, J.as_list(value))
    low, high = schema.get("minItems"), schema.get("maxItems")
    if low is not None:
        found.add(here & (F.size(items) < low), path, "item_count", "array has ", F.size(items), f" items, minimum is {low}")
    if high is not None:
        found.add(here & (F.size(items) > high), path, "item_count", "array has ", F.size(items), f" items, maximum is {high}")
    item_schema = schema.get("items")
    if item_schema:

        def item(x: Column, i: Column) -> Column:
            at = F.concat(_path(path), F.lit("["), i.cast("string"), F.lit("]"))
            inner = rules_of(x, item_schema, at, F.lit(True), soft, Bindings(inside_list=True, deep=bindings.deep), 0)
            return inner.to_entries() if bindings.deep else inner.to_array()

        found.arrays.append(F.when(here, F.flatten(F.transform(items, item))))
        found.deep = bindings.deep
    return found


def _string_rules(value: Column, schema: Schema, path: Path, here: Column, bindings: Bindings, level: int) -> Found:
    found = Found([], [])
    text = bindings.bind(level, F.try_variant_get(value, "$", "string"))
    length = F.octet_length(text)
    low, high = schema.get("minLength"), schema.get("maxLength")
    if low is not None:
        found.add(here & (length < low), path, "string_length", "string length is ", length, f", minimum is {low}")
    if high is not None:
        found.add(here & (length > high), path, "string_length", "string length is ", length, f", maximum is {high}")
    pattern = schema.get("pattern")
    if pattern:
        _checked_pattern(pattern)
        found.add(here & ~text.rlike(pattern), path, "pattern", f"string does not match pattern: {pattern}")
    choices = schema.get("enum")
    if choices:
        listed = " ".join(str(choice) for choice in choices)
        texts = [choice for choice in choices if isinstance(choice, str)]
        found.add(here & ~text.isin(texts), path, "enum", f"value must be one of: [{listed}]")
    return found


def _checked_pattern(pattern: str) -> None:
    """Let the engine that will run a pattern judge it, before any row is read."""
    try:
        SparkSession.active().sql("SELECT '' RLIKE :pattern", {"pattern": pattern}).collect()
    except PySparkException as wrong:
        raise ValueError(f"invalid pattern: {pattern}") from wrong


def _number_rules(number: Column, schema: Schema, path: Path, here: Column) -> Found:
    found = Found([], [])
    if schema.get("type") == "integer":
        found.add(here & (number != F.floor(number)), path, "is_integer", "expected integer, got float")
    low, high = schema.get("minimum"), schema.get("maximum")
    if low is not None:
        text = f" is less than minimum {_bound_text(low)}"
        found.add(here & (number < low), path, "number_range", "value ", _number_text(number), text)
    if high is not None:
        text = f" is greater than maximum {_bound_text(high)}"
        found.add(here & (number > high), path, "number_range", "value ", _number_text(number), text)
    return found


def rules_of(
    value: Column, schema: Schema, path: Path, guard: Column, soft: bool, bindings: Bindings, level: int = 0
) -> Found:
    """Rules of a VARIANT value that apply where ``guard`` holds."""
    found = Found([], [], deep=bindings.deep)
    if "$ref" in schema:
        if bindings.deep:
            found.later.append(Later(guard, path, schema["$ref"], value))
        return found
    kind = bindings.bind(level, J.variant_kind(value))
    empty = F.coalesce(kind == "null", F.lit(True))
    if not schema.get("nullable"):
        found.add(guard & empty, path, "not_null", "value is null but schema is not nullable")
    here = guard & ~empty
    level += 1

    if schema.get("anyOf"):
        branches = [rules_of(value, branch, path, F.lit(True), soft, bindings, level) for branch in schema["anyOf"]]
        all_fail = reduce(lambda a, b: a & b, [branch.any_failed() for branch in branches])
        found.add(here & all_fail, path, "any_of", NO_BRANCH)
        if bindings.deep:
            found.extend(_open_branches(branches, path, here, bindings))
        return found

    declared = schema.get("type") or ""
    if declared not in ("", "object", "array", "string", "number", "integer", "boolean"):
        found.add(here, path, "type_is", f"unsupported type: {declared}")
        return found

    wanted = "number" if declared == "integer" else declared
    fits = kind == wanted
    spelled: Column | None = None
    if soft and wanted in ("number", "boolean"):
        cast = text_to_number if wanted == "number" else text_to_boolean
        text = F.when(kind == "string", F.try_variant_get(value, "$", "string"))
        spelled = bindings.bind(level, cast(text))
        fits = fits | spelled.isNotNull()
        level += 1
    if declared:
        found.add(here & ~fits, path, "type_is", f"expected {wanted}, got ", _label(kind))

    if declared in ("", "object"):
        found.extend(_object_rules(value, schema, path, here & (kind == "object"), soft, bindings, level))
    if declared in ("", "array"):
        found.extend(_array_rules(value, schema, path, here & (kind == "array"), soft, bindings, level))
    if declared in ("", "string"):
        found.extend(_string_rules(value, schema, path, here & (kind == "string"), bindings, level))
    if declared in ("", "number", "integer"):
        number = F.try_variant_get(value, "$", "double")
        if spelled is not None:
            number = F.coalesce(spelled, number)
        found.extend(_number_rules(bindings.bind(level, number), schema, path, here & (fits if declared else kind == "number")))
    return found


def _open_branches(branches: list[Found], path: Path, here: Column, bindings: Bindings) -> Found:
    """What is left of the branches of an ``anyOf`` that hold so far, tagged with the branch; nothing if one of them holds for certain."""
    found = Found([], [], deep=True)
    level = max(bindings.levels, default=0) + 1
    failed = [bindings.bind(level, branch.any_failed()) for branch in branches]
    is_open = [bindings.bind(level + 1, ~fails & branch.any_left()) for fails, branch in zip(failed, branches, strict=True)]
    settled = reduce(lambda a, b: a | b, [~fails & ~still for fails, still in zip(failed, is_open, strict=True)])
    n = reduce(lambda a, b: a + b, [still.cast("int") for still in is_open])
    for i, (branch, still) in enumerate(zip(branches, is_open, strict=True)):
        alt = F.struct(_path(path).alias("at"), F.lit(i).alias("branch"), n.alias("n"))
        wanted = here & still & ~settled
        entries = F.filter(Found([], branch.arrays, branch.later, True).to_entries(), lambda v: v["ref"].isNotNull() | (F.size(v["alts"]) > 0))
        tagged = F.transform(entries, lambda v: v.withField("alts", F.concat(F.array(alt).cast(ALTS), v["alts"])))  # noqa: B023
        found.arrays.append(F.when(wanted, tagged))
    return found


def as_variant(df: DataFrame, col: str) -> Column:
    """VARIANT of a column: JSON text is parsed strictly, typed columns are converted."""
    kind = df.schema[col].dataType
    if isinstance(kind, T.VariantType):
        return ref(col)
    if isinstance(kind, T.StringType):
        return J.parse_strict(ref(col))
    if isinstance(kind, (T.StructType, T.MapType, T.ArrayType)):
        return F.to_variant_object(ref(col))
    return ref(col).cast("variant")


def _checked(df: DataFrame, col: str, schema: Schema, soft: bool, rules: Keys | None) -> tuple[DataFrame, Column, list[str]]:
    """Rows with the named values, the violations over them, and the names to drop."""
    bindings = Bindings()
    found = rules_of(F.col("_value"), schema, "", F.lit(True), soft, bindings)
    if rules is not None:
        wanted = names(rules)
        found.checks = [check for check in found.checks if check.rule in wanted]
        found.arrays = [F.filter(array, lambda v: v["rule"].isin(wanted)) for array in found.arrays]
    if isinstance(df.schema[col].dataType, T.StringType) and (rules is None or "parse" in names(rules)):
        broken = ref(col).isNotNull() & F.col("_value").isNull()
        found.add(broken, "", "parse", "value is not JSON")
    bound = bindings.apply(df.withColumn("_value", as_variant(df, col)))
    return bound, found.to_array(), ["_value", *bindings.bound_names()]


def with_violations(
    df: DataFrame, col: str, schema: Schema, soft: bool = False, rules: Keys | None = None, out: str = "violations"
) -> DataFrame:
    """Add the violations of each row as an array."""
    bound, found, drops = _checked(df, col, schema, soft, rules)
    return bound.withColumn(out, found).drop(*drops)


def validate(
    df: DataFrame,
    keys: Keys,
    col: str,
    schema: Schema,
    soft: bool = False,
    first_only: bool = False,
    rules: Keys | None = None,
    components: dict[str, Schema] | None = None,
) -> DataFrame:
    """``(keys, path, rule, message)``: every violation, the first per row by path, or those of some rules only.

    References are resolved by ``components``; an unknown one is an error. A schema that refers to itself is followed as deep as the values go, a
    round for each level, whose rows are written once; then the keys have to name the rows.
    """
    schema = resolve_refs(schema, components or {})
    if references_of(schema):
        return _validate_deep(df, keys, col, schema, soft, first_only, rules, components or {})
    needed = df.select(*[ref(name) for name in dict.fromkeys([*names(keys), col])])
    bound, found, _ = _checked(needed, col, schema, soft, rules)
    if first_only:
        return bound.select(*names(keys), F.inline(if_present(F.array_min(found))))
    # The array goes straight into the generator: as a column of its own it would be computed again by an inferred filter.
    return bound.select(*names(keys), F.inline(found))


def references_of(schema: Schema) -> set[str]:
    """References that are left in a schema, those of parts included."""
    found = {schema["$ref"]} if "$ref" in schema else set()
    parts = [*(schema.get("properties") or {}).values(), *(schema.get("anyOf") or []), *(schema.get("oneOf") or [])]
    if isinstance(schema.get("items"), dict):
        parts.append(schema["items"])
    return found.union(*map(references_of, parts))


def _recursive_parts(schema: Schema, components: dict[str, Schema]) -> dict[str, Schema]:
    """The components that are reached again and again, by reference. One that reaches itself without a member or item in between is an error."""
    parts: dict[str, Schema] = {}
    todo = references_of(schema)
    while todo:
        target = todo.pop()
        body = components[target.removeprefix(REF_PREFIX)]
        parts[target] = resolve_refs(body, components)
        todo |= references_of(parts[target]) - set(parts)
    for target, part in parts.items():
        near, seen = [part], set()
        while near:
            now = near.pop()
            if now.get("$ref") == target:
                raise ValueError(f"schema refers to itself at the same value: {target}")
            if "$ref" in now and now["$ref"] not in seen:
                seen.add(now["$ref"])
                near.append(parts[now["$ref"]])
            near += now.get("anyOf") or []
    return parts


def _validate_deep(
    df: DataFrame, keys: Keys, col: str, schema: Schema, soft: bool, first_only: bool, rules: Keys | None, components: dict[str, Schema]
) -> DataFrame:
    """``validate`` for a schema that refers to itself."""
    parts, group = _recursive_parts(schema, components), [ref(name) for name in names(keys)]

    def entries(rows: DataFrame, part: Schema, path: Path, before: Column) -> DataFrame:
        bindings = Bindings(deep=True)
        found = rules_of(F.col("_value"), part, path, F.lit(True), soft, bindings)
        if "_broken" in rows.columns:
            found.add(F.col("_broken"), "", "parse", "value is not JSON")
        told = bindings.apply(rows).select(*group, before.alias("_before"), F.inline(found.to_entries()))
        return told.withColumn("alts", F.concat("_before", "alts")).drop("_before")

    rows = df.select(*group, as_variant(df, col).alias("_value"), ref(col).isNotNull().alias("_there"))
    broken = F.col("_there") & F.col("_value").isNull() & F.lit(isinstance(df.schema[col].dataType, T.StringType))
    none = F.array().cast(ALTS)
    now = materialize(entries(rows.withColumn("_broken", broken), schema, "", none))
    told = now.filter("rule IS NOT NULL").drop("ref", "value")
    while not (frontier := now.filter("ref IS NOT NULL")).isEmpty():
        rounds = [
            entries(frontier.filter(F.col("ref") == target).withColumnsRenamed({"value": "_value", "path": "_path", "alts": "_alts"}), part, F.col("_path"), F.col("_alts"))
            for target, part in parts.items()
        ]
        now = materialize(reduce(DataFrame.unionByName, rounds))
        told = told.unionByName(now.filter("rule IS NOT NULL").drop("ref", "value"))
    depth = told.agg(F.coalesce(F.max(F.size("alts")), F.lit(0))).first()[0]
    for level in range(depth, 0, -1):
        # A branch fails with any violation in it, a group of branches if all of them fail.
        inside = told.filter(F.size("alts") == level).withColumn("_alt", F.get("alts", F.lit(level - 1)))
        outer = F.slice("alts", 1, level - 1)
        weighed = inside.groupBy(*group, outer.alias("alts"), F.col("_alt.at").alias("path"), F.col("_alt.n").alias("_n"))
        lost = weighed.agg(F.count_distinct("_alt.branch").alias("_failed")).filter("_failed = _n")
        lost = lost.select(*group, "path", F.lit("any_of").alias("rule"), F.lit(NO_BRANCH).alias("message"), "alts")
        told = told.filter(F.size("alts") < level).unionByName(lost)
    told = told.select(*group, "path", "rule", "message")
    if rules is not None:
        told = told.filter(F.col("rule").isin(names(rules)))
    if first_only:
        first = told.groupBy(*group).agg(F.min(F.struct("path", "rule", "message")).alias("_first"))
        told = first.select(*group, "_first.*")
    return told


def rule_summary(found: DataFrame) -> DataFrame:
    """``(rule, n)``: violations per rule."""
    return found.groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


def soft_cast(df: DataFrame, keys: Keys, schema: Schema) -> tuple[DataFrame, DataFrame]:
    """Text columns to typed ones by the schema's properties.

    Returns the typed rows (a text that does not fit becomes null) and the rejects ``(keys, field, text)``.
    """
    casts = {"number": text_to_number, "integer": text_to_integer, "boolean": text_to_boolean}
    fields = schema.get("properties") or {}
    typed: list[Column] = []
    bad: list[Column] = []
    for name, field in fields.items():
        cast = casts.get(field.get("type") or "")
        value = cast(ref(name)) if cast else ref(name)
        typed.append(value.alias(name))
        if cast:
            failed = ref(name).isNotNull() & value.isNull()
            bad.append(F.when(failed, F.struct(F.lit(name).alias("field"), ref(name).alias("text"))))
    cols = names(keys)
    rejects = df.select(*cols, F.inline(F.array_compact(F.array(*bad)))) if bad else (
        df.select(*cols, F.lit("").alias("field"), F.lit("").alias("text")).limit(0)
    )
    return df.select(*cols, *typed), rejects


def validate_params(df: DataFrame, keys: Keys, col: str, declared: dict[str, Schema], soft: bool = True) -> DataFrame:
    """Violations of a column of parameter sets: every declared name must be there and fit its schema."""
    return validate(df, keys, col, {"type": "object", "properties": declared, "required": list(declared)}, soft)
