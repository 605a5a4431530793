"""Stages, calls, gates, extraction, user functions."""

import json
import re
import time
import tracemalloc

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stagewise.functions.registry import FunctionRegistry
from stagewise.operators.extract import ask_question, extract
from stagewise.operators.reshape import Rule
from stagewise.plans.calls import Call, call_functions, expression_argument
from stagewise.plans.schema import load_schema
from stagewise.plans.stages import Dependency, Resource, Stage, folded, gate_stage, iterate_stage, run_stages, stage_layers
from workload.stages import flaky_backend


def test_stages_without_dependencies(spark):
    schema = load_schema({"properties": {"title": {"x-session": "head", "type": "string"}, "tone": {"x-session": "mood", "type": "string"}}})
    stages = [Stage("head", "name the poem"), Stage("mood", "how does {{ .params.poet }} sound?")]
    df = spark.range(1).select("id", F.struct(F.lit("Sappho").alias("poet")).alias("params"))
    record = run_stages(df, stages, schema).select("context.*").first()
    opening = '<Prompt description="The task to execute"><![CDATA[ '
    assert (record["title"], record["tone"]) == (f"{opening}name the poem ]]></Prompt>", f"{opening}how does Sappho sound? ]]></Prompt>")


def test_gates_between_stages(spark):
    owners = {"soil": "dig", "seed": "choose", "plan": "plant", "roof": "build"}
    schema = load_schema({"properties": {name: {"type": "string", "x-session": stage} for name, stage in owners.items()}})
    schema["properties"]["permit"] = {"type": "string"}
    stages = [
        Stage("plant", "lay out the bed", context=True, depends_on=(Dependency("dig", "context.soil <> ''"), Dependency("choose"))),
        Stage("paint", "colour the roof", depends_on=(Dependency("build"),)),
        Stage("build", "raise a roof", depends_on=(Dependency("dig", "context.permit IS NOT NULL"),)),
        Stage("choose", "pick seeds"),
        Stage("dig", "test the soil"),
    ]
    for checkpointed in (False, True):
        row = run_stages(spark.range(1), stages, schema, checkpoint_layers=checkpointed).first()
        assert {name: row[f"status_{name}"] for name in ("dig", "choose", "plant", "build", "paint")} == {
            "dig": "finished", "choose": "finished", "plant": "finished", "build": "noop", "paint": "noop"
        }
        assert row["context"]["roof"] is None and "<Scope>" in row["context"]["plan"] and '"soil"' in row["context"]["plan"]


def test_layers_reject_bad_plans():
    with pytest.raises(KeyError):
        stage_layers([Stage("a", "x", depends_on=(Dependency("zzz"),))])
    with pytest.raises(ValueError):
        stage_layers([Stage("a", "x", depends_on=(Dependency("b"),)), Stage("b", "x", depends_on=(Dependency("a"),))])


GATES = [
    ("finished", None, "passed"),
    ("failed", None, "unsolvable"),
    ("noop", None, "unsolvable"),
    ("queued", None, "failed"),
    ("committed", None, "failed"),
    ("running", None, "failed"),
    ("finished", "1 = 1", "passed"),
    ("finished", "1 = 2", "unsolvable"),
    ("finished", "cast(null AS boolean)", "unsolvable"),
    ("queued", "1 = 2", "failed"),
]


@pytest.mark.parametrize("status, expression, want", GATES)
def test_gate_truth_table(spark, status, expression, want):
    df = spark.range(1).withColumn("status_s", F.lit(status))
    assert gate_stage(df, [Dependency("s", expression)]).collect()[0]["gate"] == want


def test_gate_errors(spark):
    with pytest.raises(ValueError):
        gate_stage(spark.range(1), [Dependency(expression="id + 1")])
    with pytest.raises(KeyError):
        gate_stage(spark.range(1), [Dependency("unknown")])
    assert gate_stage(spark.range(1), []).collect()[0]["gate"] == "passed"


def test_failed_stage_skips_dependents(spark):
    def backend():
        def ask(prompt, _schema):
            if "bad" in prompt:
                raise RuntimeError("no")
            return '{"a": "fine"}'

        return ask

    schema = load_schema({"properties": {"a": {"type": "string", "x-session": "one"}, "b": {"type": "string", "x-session": "two"}}})
    df = spark.createDataFrame([(1, "good"), (2, "bad")], "k int, word string")
    stages = [Stage("one", "{{ .word }}"), Stage("two", "then {{ .context.a }}", depends_on=(Dependency("one"),))]
    rows = run_stages(df, stages, schema, backend, checkpoint_layers=True).orderBy("k").collect()
    assert [(r["status_one"], r["status_two"]) for r in rows] == [("finished", "finished"), ("failed", "noop")]
    assert rows[0]["context"]["a"] == "fine" and "no" in rows[1]["error_one"]


def test_pre_prompts_share_the_conversation(spark):
    def recorder():
        """A client that answers with all texts of the current conversation."""

        class Client:
            def start(self):
                self.sent = []

            def __call__(self, prompt, schema):
                self.sent.append(prompt)
                return json.dumps({"log": self.sent}) if schema is not None else "ok"

        return Client()

    schema = load_schema({"properties": {"log": {"type": "array", "items": {"type": "string"}, "x-session": "s"}}})
    stage = Stage("s", "then {{ .k }}", context=True, pre_prompts=("first {{ .k }}", "second"))
    df = spark.createDataFrame([(1,), (2,)], "k int").coalesce(1)
    rows = run_stages(df, [stage], schema, recorder, checkpoint_layers=True).orderBy("k").collect()
    head = '<Scope>\n <Context contentType="application/json"><![CDATA[ {} ]]></Context>\n</Scope>\n'
    for row in rows:
        first = f'{head}<Prompt description="The task to execute"><![CDATA[ first {row["k"]} ]]></Prompt>'
        assert row["context"]["log"] == [first, "second", f"then {row['k']}"]


def test_stage_without_schema_keeps_free_text(spark):
    schema = load_schema({"properties": {"a": {"type": "string", "x-session": "s"}}})
    stages = [Stage("s", "one"), Stage("free", "say {{ .context.a }}", depends_on=(Dependency("s"),))]
    backend = lambda: lambda prompt, s: '{"a": "x"}' if s else "heard " + prompt.split("[ ")[1].split(" ]")[0]
    row = run_stages(spark.range(1), stages, schema, backend).collect()[0]
    assert row["context"].asDict() == {"a": "x", "free": ["heard say x"]}


def test_calls_of_the_plan(spark):
    functions = FunctionRegistry()
    functions.register_columns("f", lambda: F.lit("val"), [], "string")
    schema = load_schema({"properties": {"a": {"type": "string", "x-session": "s"}}})
    stages = [Stage("s", "{{ .vars.x }} {{ .context.y }}")]
    calls = [Call("f", "x", into="vars"), Call("f", "y", into="context")]
    row = run_stages(spark.range(1), stages, schema, functions=functions, calls=calls).collect()[0]
    assert "[ val val ]" in row["context"]["a"]
    with pytest.raises(ValueError):
        run_stages(spark.range(1), stages, schema, functions=functions, calls=[Call("f", "x")])


def test_expression_arguments():
    assert expression_argument("$(vars.a)") == "vars.a"
    assert expression_argument("$((a + 1) * (b))") == "(a + 1) * (b)"
    assert expression_argument("$(a) and $(b)") is None
    assert expression_argument("$(a") is None
    assert expression_argument("{{ .a }}") is None
    assert expression_argument("$(a \\( b)") == "a \\( b"
    assert expression_argument("$()") == ""


def test_chained_calls(spark):
    """A later call takes the result of an earlier one, by expression or within a text."""
    functions = FunctionRegistry()
    functions.register_columns("half", lambda of: of / 2, ["of"], "double")
    functions.register_columns("label", lambda size, unit: F.concat_ws(" ", F.round(size, 1), unit), ["size", "unit"], "string")
    calls = [
        Call("half", "small", {"of": "$(id + 7)"}, into="vars"),
        Call("half", "tiny", {"of": "$(vars.small)"}, into="vars"),
        Call("label", "tag", {"size": "$(vars.tiny)", "unit": "of {{ .vars.small }}"}, into="vars"),
    ]
    done, outputs = call_functions(spark.range(3, 4), calls, functions)
    assert done.select("vars.*").first().asDict() == {"small": 5.0, "tiny": 2.5, "tag": "2.5 of 5.0"} and outputs == []


def test_call_rules_and_destinations(spark):
    functions = FunctionRegistry()
    functions.register_columns("weigh", lambda grams: F.struct(grams.alias("grams")), ["grams"], "struct", group="scales")
    kilos = Rule("kilos", on_input="weigh", expr="named_struct('grams', args.kilos * 1000)")
    weigh = lambda into: call_functions(spark.range(1), [Call("weigh", "parcel", {"kilos": 3}, into=into)], functions, [kilos])
    done, outputs = weigh("ai")
    assert done.select(outputs[0].result).first()[0] == '{"grams":3000}'
    assert weigh("context")[0].first()["context"]["parcel"]["grams"] == 3000
    done, outputs = weigh("db")
    assert spark.table("parcel").first()["value"]["grams"] == 3000 and "vars" not in done.columns and not outputs
    with pytest.raises(ValueError, match="object"):
        call_functions(spark.range(1), [Call("weigh", "p", {"kilos": 3})], functions, [Rule("flat", on_input="weigh", expr="args.kilos")])
    with pytest.raises(KeyError):
        call_functions(spark.range(1), [Call("guess", "p")], functions)
    assert list(functions.in_group("scales").entries) == ["weigh"] and not functions.in_group("rulers").entries


def test_retries_errors_and_single_question(spark):
    def backend():
        calls = {}

        def ask(prompt, _schema):
            calls[prompt] = calls.get(prompt, 0) + 1
            if prompt == "never" or calls[prompt] < 3:
                raise ConnectionError("503")
            return "not json" if prompt == "text" else '{"answer": "yes"}'

        return ask

    df = spark.createDataFrame([("ok",), ("never",), ("text",), (None,)], "p string").coalesce(1)
    schema = {"properties": {"answer": {"type": "string"}}}
    rows = {r["p"]: r for r in extract(df, "p", schema, backend, attempts=4).collect()}
    assert rows["ok"]["answer"] == '{"answer": "yes"}' and rows["ok"]["_attempts"] == 3
    assert rows["never"]["answer"] is None and "503" in rows["never"]["_error"] and rows["never"]["_attempts"] == 4
    assert rows["text"]["_error"].startswith("JSONDecodeError")
    assert rows[None]["answer"] is None and rows[None]["_error"] is None
    assert {r["p"]: r["answer"] for r in ask_question(df, "p", backend, attempts=3).collect()}["ok"] == "yes"
    with pytest.raises(Exception, match="503"):
        extract(df, "p", schema, backend, mode="failfast").collect()


def test_iterated_stage_appends_in_item_order(spark):
    def backend():
        return lambda prompt, _schema: '{"names": ["%s"]}' % prompt.split("meet ")[1].split(" ]]>")[0]

    df = spark.createDataFrame([(1, ["Pat", "Sam", "Kim"]), (2, [])], "k int, people array<string>")
    schema = {"properties": {"names": {"type": "array", "items": {"type": "string"}}}}
    rows = iterate_stage(df, "k", Stage("s", "meet {{ .it }}"), "people", schema, backend).filter("pos >= 0")
    assert [r["value"] for r in rows.orderBy("seq").collect()] == ['"Pat"', '"Sam"', '"Kim"']


def test_wrong_answers_are_kept_and_told(spark):
    schema = {"type": "object", "properties": {"n": {"type": "integer", "x-session": "s"}, "t": {"type": "string", "x-session": "s"}}}
    answers = {"a": '{"n": 3, "t": "x"}', "b": '{"n": "twelve", "t": "ok"}', "c": "no json"}
    df = spark.createDataFrame([(k,) for k in answers], "k string")
    done = run_stages(df, [Stage("s", "{{ .k }}")], schema, lambda: lambda prompt, _: answers[prompt.split("[CDATA[ ")[1][0]])
    rows = {r["k"]: r for r in done.collect()}
    assert {k: r["status_s"] for k, r in rows.items()} == {"a": "finished", "b": "failed", "c": "failed"}
    assert all(rows[k]["answer_s"] == answers[k] for k in "ab")
    assert rows["a"]["context"]["n"] == 3 and rows["b"]["context"]["n"] is None and "n: " in rows["b"]["error_s"]


def test_failed_items_are_rows_and_asked_once(spark, tmp_path):
    log = tmp_path / "asked"

    def backend():
        def ask(prompt, schema):
            item = prompt.split("[CDATA[ ")[1].split(" ]]")[0]
            with open(log, "a") as sink:
                sink.write(item + "\n")
            if item in ("b", "z"):
                raise RuntimeError(f"no answer for {item}")
            return json.dumps({"names": [item]})

        return ask

    schema = {"type": "object", "properties": {"names": {"type": "array", "items": {"type": "string"}}}}
    df = spark.createDataFrame([(1, ["a", "b", "c"]), (2, ["z"])], "k int, items array<string>")
    rows = iterate_stage(df, "k", Stage("s", "{{ .it }}"), "items", schema, backend).collect()
    assert sorted((r["k"], r["seq"], r["value"]) for r in rows if r["kind"] == "error") == [
        (1, 1, "RuntimeError: no answer for b"),
        (2, 0, "RuntimeError: no answer for z"),
    ]
    assert [r["value"] for r in sorted(rows, key=lambda r: r["seq"]) if r["k"] == 1 and r["kind"] == "list" and r["pos"] >= 0] == ['"a"', '"c"']
    assert sorted(log.read_text().split()) == ["a", "b", "c", "z"]


def test_lookups_need_one_row_per_input(spark):
    functions = FunctionRegistry()
    pairs = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "k string, v int")
    functions.register_table("size", pairs, "k", "v")
    asked = spark.createDataFrame([("b",)], "k string")
    with pytest.raises(Exception, match="not unique"):
        call_functions(spark.createDataFrame([("a",)], "k string"), [Call("size", "s", {"k": "$(k)"}, into="vars")], functions)[0].collect()
    functions.register_table("all", pairs.limit(1), [], "v")
    with pytest.raises(ValueError, match="inputs"):
        call_functions(asked, [Call("all", "s", {}, into="vars")], functions)


def reciting(answers):
    """A backend that answers a prompt by what follows its last ``ask:``."""

    def backend():
        def ask(prompt, _schema):
            answer = answers(prompt.split("ask: ")[1].split(" ]]>")[0])
            if isinstance(answer, Exception):
                raise answer
            return answer

        return ask

    return backend


VOYAGES = {
    "properties": {
        "ports": {"type": "array", "items": {"type": "string"}, "x-session": ["outbound", "legs", "home"]},
        "ship": {"type": "object", "properties": {"name": {"type": "string", "nullable": True}, "tons": {"type": "integer"}}, "x-session": ["outbound", "home"]},
        "flag": {"type": "string", "nullable": True, "x-session": ["outbound", "home"]},
        "cargo": {"type": "object", "x-session": ["legs", "home"]},
        "report": {"type": "string", "x-session": "report"},
    }
}


def test_stages_that_share_fields_merge_by_kind(spark):
    answers = {
        "out 1": '{"ports": ["Bergen"], "ship": {"name": "Fram", "tons": 402}, "flag": "no"}',
        "home 1": '{"ports": ["Hobart", "Oslo"], "ship": {"name": null}, "flag": null, "cargo": {"ice": 1}}',
        "out 2": '{"ports": ["Kiel"]}',
        "home 2": '{"flag": "de", "ship": {"tons": 7}, "ports": null}',
    }
    schema = load_schema(VOYAGES)
    schema["properties"]["ports"]["nullable"] = True
    stages = [Stage("home", "ask: home {{ .k }}", depends_on=(Dependency("outbound"),)), Stage("outbound", "ask: out {{ .k }}")]
    df = spark.createDataFrame([(1,), (2,)], "k int")
    rows = {r["k"]: r for r in run_stages(df, stages, schema, reciting(answers.__getitem__)).selectExpr("k", "context.*", "error_home").collect()}
    assert rows[1]["ports"] == ["Bergen", "Hobart", "Oslo"] and rows[1]["ship"].asDict() == {"name": None, "tons": 402} and rows[1]["flag"] is None
    assert rows[2]["ports"] == ["Kiel"] and rows[2]["ship"].asDict() == {"name": None, "tons": 7} and rows[2]["flag"] == "de"
    assert not any(r["error_home"] for r in rows.values())


def test_an_iterated_stage_feeds_later_ones(spark, tmp_path):
    log = tmp_path / "asked"

    def answers(asked):
        with open(log, "a") as sink:
            sink.write(asked + "\n")
        if asked == "b of 1":
            return RuntimeError("fog")
        if asked.startswith("tell"):
            return json.dumps({"report": asked})
        return json.dumps({"ports": [asked.split()[0]], "cargo": {"last": asked, asked[0]: 1}})

    stages = [
        Stage("report", "ask: tell {{ .context.ports }} {{ .vars.tone }}", depends_on=(Dependency("legs"),), variables={"tone": "dry"}),
        Stage("legs", "ask: {{ .it }} of {{ .k }}", iterate_on="concat(array(vars.first), stops)", variables={"first": "a"}, depends_on=(Dependency(expression="k < 9"),)),
    ]
    rows = [(1, ["b", "c"]), (2, []), (3, ["z", "y"]), (9, ["x"]), (None, ["q"])]
    df = spark.createDataFrame(rows, "k int, stops array<string>").withColumn("more", F.lit(1)).repartition(3)
    gate = Stage(**{**stages[1].__dict__, "depends_on": (Dependency(expression="coalesce(k, 0) < 9"),)})
    for checkpointed in (False, True):
        log.write_text("")
        done = run_stages(df, [stages[0], gate], load_schema(VOYAGES), reciting(answers), keys="k", checkpoint_layers=checkpointed)
        got = {r["k"]: r for r in done.collect()}
        assert len(got) == 5 and set(df.columns) < set(done.columns)
        assert got[1]["context"]["ports"] == ["a", "c"] and got[1]["status_legs"] == "failed" and got[1]["status_report"] == "noop"
        assert "item 1: RuntimeError: fog" in got[1]["error_legs"] and got[1]["answer_legs"][1] is None
        assert got[3]["context"]["ports"] == ["a", "z", "y"] and got[3]["context"]["report"] == "tell [a z y] dry"
        assert {k: v.toPython() for k, v in got[3]["context"]["cargo"].items()} == {"last": "y of 3", "a": 1, "z": 1, "y": 1}
        assert got[2]["context"]["ports"] == ["a"] and got[2]["status_report"] == "finished"
        assert got[None]["context"]["ports"] == ["a", "q"]
        assert got[9]["status_legs"] == "noop" and got[9]["context"]["ports"] is None and got[9]["answer_legs"] is None
        if checkpointed:
            asked = sorted(log.read_text().splitlines())
            assert asked == sorted(set(asked)) and len([x for x in asked if not x.startswith("tell")]) == 9


def test_iteration_over_results_of_a_stage_without_items(spark):
    schema = load_schema({"properties": {"names": {"type": "array", "items": {"type": "string"}, "x-session": "list"}, "n": {"type": "integer", "nullable": True, "x-session": "each"}}})
    answers = {"list 1": '{"names": ["p", "q"]}', "list 2": '{"names": []}', "p": '{"n": 5}', "q": '{"n": null}'}
    stages = [
        Stage("list", "ask: list {{ .k }}"),
        Stage("each", "ask: {{ .it }}", iterate_on="context.names", depends_on=(Dependency("list"),)),
        Stage("notes", "ask: {{ .it }}", iterate_on="context.names", depends_on=(Dependency("each"),)),
    ]
    done = run_stages(spark.createDataFrame([(1,), (2,)], "k int"), stages, schema, reciting(lambda x: answers[x]), keys=["k"])
    got = {r["k"]: r for r in done.collect()}
    assert got[1]["context"]["n"] is None and got[1]["context"]["notes"] == ['{"n": 5}', '{"n": null}']
    assert got[2]["status_notes"] == "finished" and got[2]["context"]["notes"] == [] and got[2]["answer_each"] == []
    with pytest.raises(Exception, match="not unique"):
        twice = spark.createDataFrame([(1, ["a"]), (1, ["b"])], "k int, l array<string>")
        run_stages(twice, [Stage("each", "ask: p", iterate_on="l")], schema, reciting(lambda x: answers["p"]), keys="k").collect()
    with pytest.raises(ValueError, match="keys"):
        run_stages(twice, [Stage("each", "ask: p", iterate_on="l")], schema)


def test_resources_reach_variables_and_prompts(spark):
    sails = "name,area\r\nmain,90\r\njib,40\r\n"
    catalog = spark.createDataFrame([("sails.csv", sails), ("log-1", "calm"), ("log-2", "gale]]>"), ("rules", "none")], "identifier string, content string")
    catalog = catalog.withColumn("content", F.encode("content", "utf-8"))
    schema = load_schema({"properties": {n: {"type": "array", "items": {"type": "string"}, "x-session": n} for n in ("rig", "talk")} | {"log": {"type": "string", "x-session": "log"}}})
    stages = [
        Stage("rig", "ask: {{ .it }}", resources=(Resource("sails.csv", "vars", "sails"),), iterate_on="transform(vars.sails, s -> s[0])"),
        Stage("log", "sum up {{ .k }}", resources=(Resource("log-{{ .vars.no }}"),), variables={"no": 2}),
        Stage("own", "sum up", resources=(Resource("log-{{ .k }}", "vars"), Resource("rules", "prompt"), Resource("log-1")), pre_prompts=("first",)),
    ]
    rules = [Rule("cells", on_resource="sails.csv", parser="csv", expr="filter(args, r -> r[0] <> 'name')")]
    df = spark.createDataFrame([(1,), (2,), (3,)], "k int")

    def backend():
        return lambda prompt, s: json.dumps({"rig": [prompt.split("ask: ")[1].split(" ]]>")[0]]} if s and "rig" in s["properties"] else {"log": prompt}) if s else prompt

    done = run_stages(df, stages, schema, backend, rules=rules, keys="k", catalog=catalog)
    got = {r["k"]: r for r in done.collect()}
    assert set(done.columns) == {"k", "context", *(f"{x}_{s.name}" for x in ("answer", "error", "status") for s in stages)}
    assert all(r["context"]["rig"] == ["main", "jib"] for r in got.values())
    block = '=== log-2 ===\ngale]]>\n===\n<Prompt description="The task to execute"><![CDATA[ sum up 1 ]]></Prompt>'
    assert got[1]["context"]["log"] == block
    assert got[3]["status_own"] == "failed" and "log-{{ .k }}" not in got[3]["error_own"] and "log-3" in got[3]["error_own"]
    assert got[2]["context"]["own"] == ["=== rules ===\nnone\n===\nsum up"]
    with pytest.raises(ValueError, match="catalog"):
        run_stages(df, stages, schema, backend, keys="k")
    with pytest.raises(ValueError, match="destination"):
        run_stages(df, [Stage("s", "x", resources=(Resource("a", "nowhere"),))], schema, keys="k", catalog=catalog)
    bad = [Rule("cells", on_resource="rules", parser="json")]
    one = run_stages(df, [Stage("s", "x", resources=(Resource("rules"),))], schema, rules=bad, keys="k", catalog=catalog).first()
    assert one["status_s"] == "failed" and "JSON" in one["error_s"]


def test_references_are_resolved_before_a_plan_runs(spark):
    part = {"type": "object", "properties": {"n": {"type": "integer"}}}
    schema = {"properties": {"a": {"$ref": "#/components/schemas/part", "x-session": "s"}}}
    row = run_stages(spark.range(1), [Stage("s", "ask: x")], schema, reciting(lambda _: '{"a": {"n": 3}}'), components={"part": part}).first()
    assert row["context"]["a"]["n"] == 3
    with pytest.raises(KeyError, match="part"):
        run_stages(spark.range(1), [Stage("s", "x")], schema)


KINDS = ["1", '"x"', "true", "null", "[]", "[1, null]", "{}", '{"a": 1, "b": [2]}', '{"a": null}', None]


@pytest.mark.parametrize("old", KINDS)
def test_fold_of_untyped_values(spark, old):
    def want(before, now):
        a, b = (None if x is None else json.loads(x) for x in (before, now))
        if now is None or (now == "null" and isinstance(a, list | dict)):
            return a
        if isinstance(a, list):
            return a + (b if isinstance(b, list) else [b])
        return {**a, **b} if isinstance(a, dict) and isinstance(b, dict) else b

    df = spark.createDataFrame([(i, old, new) for i, new in enumerate(KINDS)], "i int, old string, new string")
    given = F.try_parse_json("new")
    merged = folded(T.VariantType(), F.try_parse_json("old"), given, given)
    got = {r["i"]: r["v"] for r in df.select("i", F.to_json(merged).alias("v")).collect()}
    assert {i: None if v is None else json.loads(v) for i, v in got.items()} == {i: want(old, new) for i, new in enumerate(KINDS)}


@pytest.mark.parametrize("many", [1, 5])
def test_questions_in_flight(spark, tmp_path, many):
    def backend():
        def ask(prompt, _schema):
            name = tmp_path / f"{many}-{prompt}"
            name.write_text("")
            time.sleep(0.05)
            n = len(list(tmp_path.glob(f"{many}-*")))
            with open(tmp_path / f"seen-{many}", "a") as sink:
                sink.write(f"{n}\n")
            name.unlink()
            if prompt == "p7":
                raise TimeoutError("late")
            return json.dumps({"answer": prompt})

        return ask

    df = spark.createDataFrame([(i, f"p{i}" if i % 6 else None) for i in range(40)], "i int, p string").coalesce(1)
    schema = {"properties": {"answer": {"type": "string"}}}
    rows = extract(df, "p", schema, backend, attempts=2, in_flight=many).collect()
    for r in rows:
        if r["p"] == "p7":
            assert r["answer"] is None and "late" in r["_error"] and r["_attempts"] == 2
        else:
            assert r["answer"] == (None if r["p"] is None else json.dumps({"answer": r["p"]}))
            assert r["_attempts"] == (None if r["p"] is None else 1)
    seen = list(map(int, (tmp_path / f"seen-{many}").read_text().split()))
    assert max(seen) == many and len(seen) == len([r for r in rows if r["p"]]) + 1
    with pytest.raises(ValueError):
        extract(df, "p", schema, backend, in_flight=0)


def test_answers_of_items_are_merged_without_broadcast(spark, tmp_path):
    """With and without a backend (F2, F3)."""
    schema = {"type": "object", "properties": {"names": {"type": "array", "items": {"type": "string"}}}}
    spark.createDataFrame([(1, ["a", "b"]), (2, ["c"])], "k int, items array<string>").write.parquet(f"{tmp_path}/rows")
    df = spark.read.parquet(f"{tmp_path}/rows")
    for backend in (None, reciting(lambda item: json.dumps({"names": [item]}))):
        merged = iterate_stage(df, "k", Stage("s", "ask: {{ .it }}"), "items", schema, backend)
        assert "Broadcast" not in merged._jdf.queryExecution().executedPlan().toString()
    assert sorted((r["k"], r["seq"], r["value"]) for r in merged.collect() if r["pos"] >= 0) == [(1, 0, '"a"'), (1, 1, '"b"'), (2, 0, '"c"')]


def test_answers_in_front_of_an_iterated_stage_are_asked_for_once(spark, tmp_path):
    """Items and rows are read from one written answer (F4)."""
    log = tmp_path / "asked"

    def answer(asked):
        with open(log, "a") as sink:
            sink.write(asked + "\n")
        return json.dumps({"ports": ["Bergen", "Hobart"] if asked.startswith("out") else [f"past {asked}"]})

    stages = [Stage("outbound", "ask: out {{ .k }}"), Stage("legs", "ask: leg {{ .it }}", depends_on=(Dependency("outbound"),), iterate_on="context.ports")]
    df = spark.createDataFrame([(1,)], "k int")
    row = run_stages(df, stages, load_schema(VOYAGES), reciting(answer), keys="k", in_flight=2).first()
    assert row["context"]["ports"] == ["Bergen", "Hobart", "past leg Bergen", "past leg Hobart"]
    assert sorted(log.read_text().split("\n")[:-1]) == ["leg Bergen", "leg Hobart", "out 1"]


def test_questions_without_openings_send_none(spark):
    """A column of null lists takes a time that grows with the square of a batch (F4)."""
    asked = extract(spark.createDataFrame([("a",)], "p string"), "p", None, reciting(lambda x: x))
    assert re.search(r"ask_\w+\(p#\d+\)", asked._jdf.queryExecution().executedPlan().toString())


def test_flaky_backend_keeps_no_prompts():
    """What it holds does not grow with the table (F5)."""

    def asked_twice(ask, prompt):
        with pytest.raises(ConnectionError):
            ask(prompt, None)
        return ask(prompt, None)

    tracemalloc.start()
    ask = flaky_backend()
    for i in range(1000):
        assert asked_twice(ask, "x" * 10_000 + f" {i}") == '{"words": 2}'
    held, _ = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert held < 1_000_000
    few = flaky_backend(10)
    for i in range(100):
        asked_twice(few, f"de {i}")
    assert few("de 99", None) == '{"words": 2}' and asked_twice(few, "de 0") == '{"words": 2}'


def final_plan(df):
    """The plan as it ran, with what Spark changed on the way."""
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_iterated_echo_stays_out_of_the_driver_as_it_runs(spark, tmp_path):
    """Sizes that Spark learns on the way do not bring a broadcast back (F2)."""
    spark.range(2_000).selectExpr("id AS k", "array('a', 'b') AS items").write.parquet(f"{tmp_path}/rows")
    schema = {"type": "object", "properties": {"about": {"type": "string"}}}
    merged = iterate_stage(spark.read.parquet(f"{tmp_path}/rows"), "k", Stage("s", "ask: {{ .it }}"), "items", schema)
    plan = final_plan(merged)
    assert "Final Plan" in plan and "Broadcast" not in plan
    assert merged.count() == 2_000


def test_iterated_backend_stays_out_of_the_driver_as_it_runs(spark, tmp_path):
    """The written answers are read from a checkpoint, whose size Spark guesses by itself (F3)."""
    spark.range(500).selectExpr("id AS k", "array('a', 'b') AS items").write.parquet(f"{tmp_path}/rows")
    schema = {"type": "object", "properties": {"names": {"type": "array", "items": {"type": "string"}}}}
    backend = reciting(lambda item: json.dumps({"names": [item]}))
    merged = iterate_stage(spark.read.parquet(f"{tmp_path}/rows"), "k", Stage("s", "ask: {{ .it }}"), "items", schema, backend)
    plan = final_plan(merged)
    assert "Final Plan" in plan and "Broadcast" not in plan
    assert merged.count() == 1_500
