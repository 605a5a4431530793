"""Stages: gates, dependency order, resources, iteration, merging of answers and splitting of records.

A stage adds columns to the rows it is given: ``status_<stage>``, ``answer_<stage>``, ``error_<stage>`` and the fields it owns inside the
``context`` struct. Gated-out rows are carried along with a null prompt, so the plan stays one scan for any number of
stages and a backend is never asked for them.

An answer is merged into the record by the kind of each field, in the row and without a shuffle: lists append, objects overlay one
level, plain values replace, and null clears a plain value. So several stages, and all items of an iterated one, may fill one field.

A stage with ``iterate_on`` asks once per item of a list. Its items become rows, so that those of a single row are asked in many tasks; their answers,
in item order, come back to the row by its keys. Resources of all stages of a layer are looked up by one join and come back the same way.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from graphlib import TopologicalSorter
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stagewise.functions.columns import Keys, join_on, names, ref
from stagewise.functions.json_text import as_list, as_map, printed_json, variant_kind
from stagewise.functions.registry import FunctionRegistry
from stagewise.functions.templates import compile_template
from stagewise.operators import lookup
from stagewise.operators.extract import BackendFactory, backend_answer, echo_answer
from stagewise.operators.lookup import TO_AI, TO_PRE_PROMPT, TO_VARS
from stagewise.operators.merge import NOT_AN_OBJECT, is_object, merge_fragments
from stagewise.operators.prompts import document_block, prompt_envelope
from stagewise.operators.reshape import Rule, iterate, run_rule, typed_condition
from stagewise.operators.validate import with_violations
from stagewise.operators.rollup import COMMITTED, FAILED, FINISHED, NOOP, QUEUED, RUNNING
from stagewise.plans.calls import TO_PROMPT, Call, call_functions
from stagewise.plans.schema import Schema, resolve_refs, stage_names, stage_schema, to_spark
from stagewise.session import materialize
from stagewise.sources.documents import NOT_FOUND

# Outcomes of a dependency check.
PASSED = "passed"
WAITING = "failed"
UNSOLVABLE = "unsolvable"


@dataclass(frozen=True)
class Dependency:
    """A stage that must have finished, a condition that must hold, or both."""

    stage: str | None = None
    expression: str | None = None


@dataclass(frozen=True)
class Resource:
    """A document a stage needs. The identifier is a template over the row.

    ``into`` says where it goes: in front of the first pre-prompt or prompt (``ai``), the first pre-prompt (``prePrompt``), the prompt (``prompt``), or
    to a variable (``vars``) named ``var`` or like the identifier.
    """

    identifier: str
    into: str = TO_AI
    var: str | None = None

    def variable(self) -> str:
        """Name of its variable."""
        return self.var if self.var is not None else re.sub(r"[^a-zA-Z0-9_]", "_", self.identifier)


@dataclass(frozen=True)
class Stage:
    """One extraction step. ``context`` is False, True (the record so far) or a template.

    Pre-prompts are sent before the prompt in the same conversation. The first text sent carries context and call results. ``iterate_on`` is an
    SQL list over the row, with the stage's variables; each item is asked for by itself, as ``it``.
    """

    name: str
    prompt: str
    depends_on: tuple[Dependency, ...] = ()
    context: bool | str = False
    calls: tuple[Call, ...] = ()
    attempts: int = 1
    pre_prompts: tuple[str, ...] = ()
    variables: dict[str, Any] = field(default_factory=dict)
    iterate_on: str | None = None
    resources: tuple[Resource, ...] = ()


def gate_outcome(df: DataFrame, dependencies: Sequence[Dependency], prefix: str = "status_") -> Column:
    """passed, failed (wait) or unsolvable (skip) per row; dependencies are checked in list order."""
    outcome: list[tuple[Column, str]] = []
    for dependency in dependencies:
        if dependency.stage is not None:
            if prefix + dependency.stage not in df.columns:
                raise KeyError(f"unknown stage: {dependency.stage}")
            status = ref(prefix + dependency.stage)
            outcome.append((status.isin(FAILED, NOOP), UNSOLVABLE))
            outcome.append((status.isin(QUEUED, COMMITTED, RUNNING), WAITING))
        if dependency.expression is not None:
            holds = F.coalesce(typed_condition(df, dependency.expression), F.lit(False))
            outcome.append((~holds, UNSOLVABLE))
    result: Column = F.lit(PASSED)
    for condition, name in reversed(outcome):
        result = F.when(condition, name).otherwise(result)
    return result


def gate_stage(df: DataFrame, dependencies: Sequence[Dependency], out: str = "gate") -> DataFrame:
    """Add the outcome of a dependency check."""
    return df.withColumn(out, gate_outcome(df, dependencies))


def stage_layers(stages: Sequence[Stage]) -> list[list[Stage]]:
    """Stages in layers that only depend on earlier ones; unknown names and cycles are errors."""
    by_name = {stage.name: stage for stage in stages}
    needs = {s.name: [d.stage for d in s.depends_on if d.stage is not None] for s in stages}
    for name, wanted in needs.items():
        for other in wanted:
            if other not in by_name:
                raise KeyError(f"stage {name} depends on unknown stage {other}")
    sorter = TopologicalSorter(needs)
    sorter.prepare()
    layers: list[list[Stage]] = []
    while sorter.is_active():
        ready = set(sorter.get_ready())
        layers.append([stage for stage in stages if stage.name in ready])
        sorter.done(*ready)
    return layers


def empty_context(schema: Schema) -> Column:
    """Record struct of the schema with nothing filled in yet."""
    fields = schema.get("properties") or {}
    return F.struct(*[F.lit(None).cast(to_spark(field)).alias(name) for name, field in fields.items()])


def _slot(kind: str, stage: Stage, i: int) -> str:
    """Column of one resource of a stage: its identifier (``id``) or content (``res``)."""
    return f"_{kind}_{stage.name}_{i}"


def _with_vars(df: DataFrame, stage: Stage) -> DataFrame:
    """Rows with the variables of the stage and its resources; what ``vars`` held before is in ``_vars``."""
    local = {name: F.lit(value) for name, value in stage.variables.items()}
    for i, resource in enumerate(stage.resources):
        if resource.into == TO_VARS and _slot("res", stage, i) in df.columns:
            local[resource.variable()] = ref(_slot("res", stage, i))
    if "vars" not in df.columns:
        return df.withColumn("vars", F.struct(*[value.alias(name) for name, value in local.items()])) if local else df
    scope = ref("vars")
    for name, value in local.items():
        scope = scope.withField(f"`{name}`", value)
    return df.withColumns({"_vars": ref("vars"), "vars": scope})


def _without_vars(df: DataFrame) -> DataFrame:
    """The reverse of ``_with_vars``."""
    if "_vars" not in df.columns:
        return df.drop("vars")
    return df.withColumn("vars", F.col("_vars")).drop("_vars")


def load_resources(
    df: DataFrame, stages: Sequence[Stage], catalog: DataFrame | None, keys: Keys, rules: Sequence[Rule] = ()
) -> DataFrame:
    """Add the content of all resources that some stages ask for, and ``_lost_<stage>`` with what is missing.

    The requests of a row are one list, its lookups one join with the ``catalog`` (``identifier``, ``content``, one row per identifier), and they come
    back by the row's keys, which must be unique. Rules with the resource's identifier, as it is written in the stage, as their
    ``on_resource`` turn its text into other text or into a list or an object.
    """
    slots = [(stage, i, resource) for stage in stages for i, resource in enumerate(stage.resources)]
    if not slots:
        return df
    if catalog is None or not names(keys):
        raise ValueError(f"resources of stage {slots[0][0].name} need a catalog and the keys of the rows")
    for stage, i, resource in slots:
        if resource.into not in (TO_AI, TO_PRE_PROMPT, lookup.TO_PROMPT, TO_VARS):
            raise ValueError(f"unknown destination: {resource.into}")
        if "{{" in resource.identifier:
            scoped = _with_vars(df, stage)
            df = _without_vars(scoped.withColumn(_slot("id", stage, i), compile_template(resource.identifier, scoped.schema)))
        else:
            df = df.withColumn(_slot("id", stage, i), F.lit(resource.identifier))
    wanted = [F.struct(F.lit(n).alias("_n"), ref(_slot("id", stage, i)).alias("_id")) for n, (stage, i, _) in enumerate(slots)]
    asked = df.select(*[ref(name) for name in names(keys)], F.inline(F.array(*wanted)))
    known = catalog.select(F.col("identifier").alias("_known"), F.col("content").cast("string").alias("_content"))
    hit = F.struct("_known", "_content")
    found = asked.join(known, F.col("_id") == F.col("_known"), "left")
    back = [F.any_value(F.when((F.col("_n") == n) & F.col("_known").isNotNull(), hit), True).alias(f"_hit{n}") for n in range(len(slots))]
    df = join_on(df, found.groupBy(*[ref(name) for name in names(keys)]).agg(*back), names(keys), "left")
    reasons: dict[str, list[Column]] = {}
    for n, (stage, i, resource) in enumerate(slots):
        chain = [rule for rule in rules if rule.on_resource == resource.identifier]
        df = df.withColumns({"args": F.col(f"_hit{n}._content"), "_failed": F.lit(None).cast("string")})
        for rule in chain:
            df = run_rule(df, rule)
        miss = F.when(F.col(f"_hit{n}._known").isNull(), F.concat(F.lit(NOT_FOUND), F.coalesce(ref(_slot("id", stage, i)), F.lit("null"))))
        df = df.withColumns({_slot("res", stage, i): F.col("args"), f"_why{n}": F.coalesce(miss, F.col("_failed"))})
        reasons.setdefault(stage.name, []).append(F.col(f"_why{n}"))
    lost = {f"_lost_{name}": F.nullif(F.concat_ws("; ", *why), F.lit("")) for name, why in reasons.items()}
    drops = [f"{kind}{n}" for n in range(len(slots)) for kind in ("_hit", "_why")]
    return df.withColumns(lost).drop("args", "_failed", *drops)


def _documents(df: DataFrame, stage: Stage, targets: tuple[str, ...]) -> list[Column]:
    """The resources of a stage that go to some targets, as blocks in front of a text."""
    blocks = []
    for i, resource in enumerate(stage.resources):
        if resource.into in targets:
            kind = df.schema[_slot("res", stage, i)].dataType
            text = ref(_slot("res", stage, i))
            text = text if isinstance(kind, T.StringType) else printed_json(text, kind)
            blocks.append(document_block(ref(_slot("id", stage, i)), F.coalesce(text, F.lit("")), "banner"))
    return blocks


def _stage_prompt(df: DataFrame, stage: Stage, functions: FunctionRegistry, rules: Sequence[Rule]) -> DataFrame:
    """Add ``_prompt`` and ``_before`` for one stage, over rows that have its variables; results of its calls are local to it."""
    work, outputs = call_functions(df, stage.calls, functions, rules) if stage.calls else (df, None)
    schema = work.schema
    body: Column | None = None
    if stage.context is True:
        body = F.coalesce(printed_json(ref("context"), schema["context"].dataType, "  ", skip_nulls=True), F.lit("{}"))
    elif isinstance(stage.context, str):
        body = compile_template(stage.context, schema)
    texts = [compile_template(text, schema) for text in (*stage.pre_prompts, stage.prompt)]
    texts[0] = prompt_envelope(texts[0], body, stage.context is True, outputs)
    if stage.pre_prompts:
        texts[0] = F.concat(*_documents(df, stage, (TO_AI, TO_PRE_PROMPT)), texts[0])
        texts[-1] = F.concat(*_documents(df, stage, (lookup.TO_PROMPT,)), texts[-1])
    else:
        texts[0] = F.concat(*_documents(df, stage, (TO_AI, lookup.TO_PROMPT)), texts[0])
    before = F.array(*texts[:-1]) if stage.pre_prompts else F.lit(None).cast("array<string>")
    # Two steps: in one, Spark loses track of the common parts of the texts in front of a Python function.
    return work.withColumn("_prompt", texts[-1]).withColumn("_before", before).drop(*[name for name in work.columns if name.startswith("_call_")])


def _openings(stage: Stage) -> Column | None:
    """What ``_stage_prompt`` has put in front of the prompt, none for a stage without pre-prompts."""
    return F.col("_before") if stage.pre_prompts else None


def _answered(
    df: DataFrame, prompt: Column, stage: Stage, owned: Schema | None, backend: BackendFactory | None, delay: float, in_flight: int
) -> DataFrame:
    """Ask, and add ``_text``, ``_wrong`` (why it is no use), and for a stage with fields ``_record`` and ``_given`` (its members by name)."""
    answer = (
        echo_answer(prompt, owned)
        if backend is None
        else backend_answer(prompt, owned, backend, max(1, stage.attempts), delay, _openings(stage), in_flight)
    )
    asked = df.withColumn("_asked", answer)
    error = F.col("_asked.error")
    if owned is None:
        return asked.withColumns({"_text": F.col("_asked.answer"), "_wrong": error}).drop("_asked")
    asked = with_violations(asked.withColumn("_text", F.col("_asked.answer")), "_text", owned, out="_violations")
    told = F.transform("_violations", lambda v: F.concat_ws(": ", F.nullif(v["path"], F.lit("")), v["message"]))
    broken = F.when(F.col("_text").isNotNull() & (F.size("_violations") > 0), F.array_join(told, "; "))
    asked = asked.withColumn("_wrong", F.coalesce(error, broken))
    good = F.when(F.col("_wrong").isNull(), F.col("_text"))
    asked = asked.withColumns({"_record": F.from_json(good, to_spark(owned)), "_given": as_map(F.try_parse_json(good))})
    return asked.drop("_asked", "_violations")


def folded(kind: T.DataType, old: Column, new: Column, given: Column) -> Column:
    """``new`` merged into ``old`` by the type of the field; ``given`` is the member as VARIANT, null where the answer lacks it."""
    if isinstance(kind, T.ArrayType):
        return F.coalesce(F.concat(old, new), new, old)
    if isinstance(kind, T.StructType):
        present = as_map(given)
        over = [F.when(F.map_contains_key(present, name), new[name]).otherwise(old[name]).alias(name) for name in kind.names]
        return F.when(new.isNull(), old).when(old.isNull(), new).otherwise(F.struct(*over).cast(kind))
    if isinstance(kind, T.MapType):
        over = F.map_zip_with(old, new, lambda k, a, b: F.when(F.map_contains_key(new, k), b).otherwise(a))
        return F.when(new.isNull(), old).when(old.isNull(), new).otherwise(over)
    if isinstance(kind, T.VariantType):
        return _folded_variant(old, given)
    return F.when(F.is_variant_null(given), F.lit(None).cast(kind)).otherwise(F.coalesce(new, old))


def _folded_variant(old: Column, given: Column) -> Column:
    """``folded`` where only the values themselves tell what they are."""
    before, now = variant_kind(old), variant_kind(given)
    appended = F.concat(as_list(old), F.coalesce(as_list(given), F.array(given))).cast("variant")
    over = F.map_zip_with(as_map(old), as_map(given), lambda k, a, b: F.when(F.map_contains_key(as_map(given), k), b).otherwise(a))
    keeps = before.isin("array", "object")
    return (
        F.when(given.isNull(), old)
        .when(now == "null", F.when(keeps, old))
        .when(before == "array", appended)
        .when((before == "object") & (now == "object"), F.to_variant_object(over))
        .otherwise(given)
    )


def _folded_items(kind: T.DataType, old: Column, items: Column, name: str) -> Column:
    """``folded`` over the answers of an iterated stage, in item order."""
    new: Callable[[Column], Column] = lambda item: item["record"][name]
    if isinstance(kind, T.ArrayType):
        none = F.array().cast(kind)
        more = F.flatten(F.transform(items, lambda item: F.coalesce(new(item), none)))
        return F.when(F.exists(items, lambda item: new(item).isNotNull()), F.concat(F.coalesce(old, none), more)).otherwise(old)
    if isinstance(kind, T.StructType | T.MapType | T.VariantType):
        step = lambda acc, item: folded(kind, acc, new(item), F.try_element_at(item["given"], F.lit(name))).cast(kind)
        return F.aggregate(items, old, step)
    told = F.filter(items, lambda item: F.map_contains_key(item["given"], F.lit(name)))
    return F.when(F.size(told) == 0, old).otherwise(F.try_element_at(told, F.lit(-1))["record"][name])


def _ask_items(df: DataFrame, stage: Stage, keys: Keys, ready: Column, prompt: Callable[[DataFrame], DataFrame], answer) -> DataFrame:
    """Add ``_items``: position, text, error, record and members of the answer for each item, in item order; an empty list without items."""
    cols = [ref(name) for name in names(keys)]
    if not cols:
        raise ValueError(f"stage {stage.name} iterates and needs the keys of the rows")
    items = answer(prompt(iterate(df.filter(ready), stage.iterate_on)).select(*cols, "it_pos", "_prompt", "_before"))
    parts = {"pos": "it_pos", "text": "_text", "error": "_wrong", "record": "_record", "given": "_given"}
    packed = F.struct(*[F.col(column).alias(name) for name, column in parts.items() if column in items.columns])
    # A VARIANT has no order: the items are sorted by their position alone.
    in_order = lambda a, b: F.when(a["pos"] < b["pos"], -1).when(a["pos"] > b["pos"], 1).otherwise(0)
    own = items.groupBy(*cols).agg(F.collect_list(packed).alias("_items"), F.max("it_pos").alias("_most"))
    twice = F.raise_error(F.lit(f"stage {stage.name}: the keys of the rows are not unique")).cast(own.schema["_items"].dataType)
    whole = F.when(F.size("_items") == F.col("_most") + 1, F.array_sort("_items", in_order)).otherwise(twice)
    own = own.withColumn("_items", whole).drop("_most")
    none = F.array().cast(own.schema["_items"].dataType)
    # As many rows as the table has, whatever Spark guesses: not to be broadcast.
    return join_on(df, own.hint("merge"), names(keys), "left").withColumn("_items", F.when(ready, F.coalesce("_items", none)))


def run_stage(
    df: DataFrame,
    stage: Stage,
    schema: Schema,
    backend: BackendFactory | None = None,
    functions: FunctionRegistry | None = None,
    rules: Sequence[Rule] = (),
    mode: str = "permissive",
    delay: float = 0.0,
    keys: Keys = (),
    catalog: DataFrame | None = None,
    in_flight: int = 1,
) -> DataFrame:
    """Gate, resources, prompt, answer and record fields of one stage.

    An answer that does not fit the stage's schema is kept as it came in ``answer_<stage>``; its violations stand in
    ``error_<stage>``, the status is failed and the record keeps what it had. A row that has to wait stays queued. A missing resource fails
    the stage without asking. With ``iterate_on``, ``answer_<stage>`` is the list of answers, those that fit are merged, and the stage has
    failed if an item has; a row without items is finished.
    """
    functions = functions or FunctionRegistry()
    owned = stage_schema(schema, stage.name) if stage.name in stage_names(schema) else None
    lost_in = f"_lost_{stage.name}"
    if stage.resources and lost_in not in df.columns:
        df = load_resources(df, [stage], catalog, keys, rules)
    lost = ref(lost_in) if stage.resources else F.lit(None).cast("string")
    gated = _with_vars(df.withColumn("_gate", gate_outcome(df, stage.depends_on)), stage)
    ready = (F.col("_gate") == PASSED) & lost.isNull()

    def prompted(rows: DataFrame) -> DataFrame:
        return _stage_prompt(rows, stage, functions, rules)

    def answered(rows: DataFrame, prompt: Column) -> DataFrame:
        return _answered(rows, prompt, stage, owned, backend, delay, in_flight)

    fields = to_spark(owned).fields if owned is not None else []
    context, texts = ref("context"), F.lit(None).cast("array<string>")
    if stage.iterate_on is None:
        asked = answered(prompted(gated), F.when(ready, F.col("_prompt")))
        wrong, answer = F.coalesce(lost, F.col("_wrong")), F.col("_text")
        for item in fields:
            given = F.try_element_at(F.col("_given"), F.lit(item.name))
            context = context.withField(f"`{item.name}`", folded(item.dataType, ref("context")[item.name], F.col("_record")[item.name], given))
        texts = F.when(answer.isNotNull(), F.array(answer))
    else:
        asked = _ask_items(gated, stage, keys, ready, prompted, lambda rows: answered(rows, F.col("_prompt")))
        failed = F.filter("_items", lambda item: item["error"].isNotNull())
        told = F.transform(failed, lambda item: F.concat(F.lit("item "), item["pos"], F.lit(": "), item["error"]))
        wrong = F.coalesce(lost, F.when(F.size(failed) > 0, F.array_join(told, "; ")))
        answer = F.transform("_items", lambda item: item["text"])
        good = F.filter("_items", lambda item: item["error"].isNull())
        for item in fields:
            merged = F.when(good.isNotNull(), _folded_items(item.dataType, ref("context")[item.name], good, item.name))
            context = context.withField(f"`{item.name}`", merged.otherwise(ref("context")[item.name]))
        texts = F.filter(answer, lambda text: text.isNotNull())
    if mode == "failfast":
        wrong = F.when(wrong.isNotNull(), F.raise_error(wrong).cast("string"))
    wrong = F.when(F.col("_gate") == PASSED, wrong)
    if owned is None:
        # Without a schema of its own a stage gives free text, kept as a list under the stage's name.
        held = df.schema["context"].dataType
        if isinstance(held, T.StructType) and stage.name in held.names:
            texts = F.coalesce(F.concat(ref("context")[stage.name], texts), texts, ref("context")[stage.name])
        context = context.withField(f"`{stage.name}`", texts)
    done = asked.withColumns({"_wrong": wrong, "_answer": answer, "context": context})
    status = (
        F.when(F.col("_gate") == UNSOLVABLE, NOOP)
        .when(F.col("_gate") == WAITING, QUEUED)
        .when(F.col("_wrong").isNotNull(), FAILED)
        .otherwise(FINISHED)
    )
    kept = [ref(name) for name in df.columns if name not in (lost_in, "vars", *(_slot(k, stage, i) for k in ("id", "res") for i in range(len(stage.resources))))]
    if "vars" in df.columns:
        kept.append(F.col("_vars").alias("vars"))
    added = {f"answer_{stage.name}": F.col("_answer"), f"error_{stage.name}": F.col("_wrong"), f"status_{stage.name}": status}
    return done.select(*kept, *[value.alias(name) for name, value in added.items()])


def run_stages(
    df: DataFrame,
    stages: Sequence[Stage],
    schema: Schema,
    backend: BackendFactory | None = None,
    functions: FunctionRegistry | None = None,
    rules: Sequence[Rule] = (),
    mode: str = "permissive",
    checkpoint_layers: bool = False,
    calls: Sequence[Call] = (),
    delay: float = 0.0,
    keys: Keys = (),
    catalog: DataFrame | None = None,
    in_flight: int = 1,
    components: dict[str, Schema] | None = None,
) -> DataFrame:
    """Apply all stages in dependency order.

    ``calls`` run once per row before the first stage; their results go to variables, the context or a table. ``keys`` name a row; plans
    with iterated stages or resources need them, the latter also a ``catalog`` (``identifier``, ``content``). References of the schema are resolved
    by ``components``; an unknown one stops the plan. A backend is asked up to ``in_flight`` questions at a time in each task.

    A skipped stage skips its dependents. With a backend, what is answered so far is written once in front of an iterated stage, whose
    items and rows are read from it separately. With a real backend use ``checkpoint_layers``: each layer is then written once,
    so lost executors or later branches never ask the model again.
    """
    if mode not in ("permissive", "failfast"):
        raise ValueError(f"unknown mode: {mode}")
    schema = resolve_refs(schema, components or {})
    if "context" not in df.columns:
        df = df.withColumn("context", empty_context(schema))
    if calls:
        if any(call.into == TO_PROMPT for call in calls):
            raise ValueError("calls of the plan have no prompt to go to")
        df, _ = call_functions(df, calls, functions or FunctionRegistry(), rules)
    answered = False
    for layer in stage_layers(stages):
        df = load_resources(df, layer, catalog, keys, rules)
        for stage in layer:
            if answered and stage.iterate_on is not None:
                df, answered = materialize(df), False
            df = run_stage(df, stage, schema, backend, functions, rules, mode, delay, keys, catalog, in_flight)
            answered = backend is not None
        if checkpoint_layers:
            df, answered = materialize(df), False
    return df


def iterate_stage(
    df: DataFrame,
    keys: Keys,
    stage: Stage,
    items: str,
    schema: Schema,
    backend: BackendFactory | None = None,
    mode: str = "permissive",
    functions: FunctionRegistry | None = None,
    rules: Sequence[Rule] = (),
    delay: float = 0.0,
) -> DataFrame:
    """Run a stage once per item of a list expression and merge the answers in item order.

    Returns merge result rows ``(keys, field, kind, seq, pos, name, value)``. An item whose question failed or whose answer is no JSON
    object is a row of kind ``error`` with the reason as its value, so no item and no key gets lost. Gates, calls and pre-prompts of the
    stage count as in ``run_stage``; rows behind a closed gate have no items. The plan needs one row per key. With a backend the answers
    are written once before they are merged, so no item is asked twice.
    """
    if mode not in ("permissive", "failfast"):
        raise ValueError(f"unknown mode: {mode}")
    passed = df.withColumn("_gate", gate_outcome(df, stage.depends_on)).filter(F.col("_gate") == PASSED).drop("_gate")
    prompted = _stage_prompt(iterate(_with_vars(passed, stage), items), stage, functions or FunctionRegistry(), rules)
    prompt = F.col("_prompt")
    asked = (
        echo_answer(prompt, schema)
        if backend is None
        else backend_answer(prompt, schema, backend, max(1, stage.attempts), delay, _openings(stage))
    )
    rows = prompted.withColumn("_asked", asked).select(*names(keys), "it_pos", "_asked.answer", "_asked.error")
    if backend is not None:
        rows = materialize(rows)
    failed = F.when(~is_object(F.col("answer")), NOT_AN_OBJECT)
    reason = F.coalesce("error", failed)
    if mode == "failfast":
        reason = F.when(reason.isNotNull(), F.raise_error(reason).cast("string"))
    rows = rows.withColumn("error", reason)
    merged = merge_fragments(rows, keys, "it_pos", "answer")
    nothing = F.lit(None).cast("string")
    errors = rows.filter("error IS NOT NULL").select(
        *names(keys), nothing.alias("field"), F.lit("error").alias("kind"), F.col("it_pos").alias("seq"),
        F.lit(0).alias("pos"), nothing.alias("name"), F.col("error").alias("value"),
    )
    return merged.unionByName(errors)


def split_record(df: DataFrame, keys: Keys, schema: Schema, stages: Sequence[str] | None = None) -> dict[str, DataFrame]:
    """One narrow table per stage from a wide record table, by the owner of each field."""
    wanted = list(stages) if stages is not None else stage_names(schema)
    parts: dict[str, DataFrame] = {}
    for stage in wanted:
        fields = stage_schema(schema, stage)["properties"]
        parts[stage] = df.select(*names(keys), *[ref(name) for name in fields])
    return parts
