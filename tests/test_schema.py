"""Schema model, validation, casts and inference."""

import json
import random

import pytest
from pyspark.sql import types as T

from stagewise.operators.infer import infer_schema
from stagewise.operators.validate import rule_summary, soft_cast, validate, validate_params
from stagewise.plans.schema import from_spark, load_schema, resolve_refs, stage_names, stage_schema, to_spark


def test_type_lists_are_folded():
    assert load_schema('{"type":["string","null"]}') == {"type": "string", "nullable": True}
    assert load_schema({"type": ["null", "integer"]}) == {"type": "integer", "nullable": True}
    assert load_schema({"type": ["null"]}) == {"type": "", "nullable": True}
    assert load_schema({"type": ["object", "string", "null"]})["type"] == "object"
    nested = load_schema({"type": "object", "properties": {"name": {"type": ["string", "null"]}, "age": {"type": "integer"}}})
    assert nested["properties"]["name"] == {"type": "string", "nullable": True}
    assert load_schema({"type": "array"})["items"] == {"type": "string"}


REF = "#/components/schemas/"
BERTH = {"type": "object", "required": ["quay"], "properties": {"quay": {"type": "integer"}}}


def test_references():
    """Every place a reference can stand in; the field keeps its own stage, and what leads back to itself stays."""
    harbour = {
        "berth": BERTH,
        "fleet": {"type": "array", "items": {"$ref": REF + "berth"}},
        "crane": {"properties": {"beside": {"$ref": REF + "crate"}, "at": {"$ref": REF + "berth"}}},
        "crate": {"properties": {"under": {"oneOf": [{"$ref": REF + "crane"}, {"type": "null"}]}}, "x-session": "lost"},
    }
    places = {"home": {"$ref": REF + "berth", "x-session": "dock"}, "all": {"$ref": REF + "fleet"}, "either": {"oneOf": [{"$ref": REF + "berth"}]}}
    done = resolve_refs({"properties": places}, harbour)["properties"]
    assert done == {"home": {**BERTH, "x-session": "dock"}, "all": {"type": "array", "items": BERTH}, "either": {"oneOf": [BERTH]}}
    assert harbour["fleet"]["items"] == {"$ref": REF + "berth"}
    round_trip = resolve_refs({"$ref": REF + "crate", "x-session": "lift"}, harbour)
    crane = round_trip["properties"]["under"]["oneOf"][0]
    assert round_trip["x-session"] == "lift" and crane["properties"]["at"] == BERTH
    assert crane["properties"]["beside"] == {"$ref": REF + "crate"}
    with pytest.raises(KeyError, match="buoy"):
        resolve_refs({"items": {"$ref": REF + "buoy"}}, harbour)


def test_stage_parts_and_spark_types():
    fields = {
        "depth": {"type": "number", "x-session": "sound"},
        "pilot": {"type": "string", "x-session": "board", "x-ui-order": 2},
        "lights": {"type": "array", "items": {"type": "boolean"}, "x-session": ["sound", "board"]},
        "notes": {"type": "object"},
        "wind": {"oneOf": [{"type": "integer"}, {"type": "string"}]},
    }
    schema = load_schema({"type": "object", "required": ["pilot", "lights", "depth"], "properties": fields})
    assert stage_names(schema) == ["sound", "board"]
    board = stage_schema(schema, "board")
    assert list(board["properties"]) == ["pilot", "lights"] and board["required"] == ["pilot", "lights"]
    with pytest.raises(KeyError, match="anchor"):
        stage_schema(schema, "anchor")
    shape = to_spark(schema)
    assert shape["pilot"].metadata == {"x-session": "board", "x-ui-order": 2}
    assert {f.name: f.dataType.simpleString() for f in shape.fields} == {
        "depth": "double", "pilot": "string", "lights": "array<boolean>", "notes": "map<string,variant>", "wind": "variant",
    }
    back = from_spark(T.StructType().add("a", "long", False).add("b", T.ArrayType(T.StringType()), True))
    assert back["required"] == ["a", "b"]
    assert back["properties"] == {"a": {"type": "integer"}, "b": {"type": "array", "items": {"type": "string"}, "nullable": True}}


def broken(spark, value, schema, **kw):
    df = spark.createDataFrame([(1, json.dumps(value))], "k int, j string")
    return [(r["path"], r["rule"]) for r in validate(df, "k", "j", schema, **kw).collect()]


PARCEL = {"type": "object", "required": ["label", "grams"], "properties": {"label": {"type": "string"}, "grams": {"type": "integer"}}}
VOYAGE = {
    "type": "object",
    "required": ["ship", "ports", "crew"],
    "properties": {
        "ship": {"type": "object", "required": ["draught"], "properties": {"draught": {"type": "number"}, "decks": {"type": "integer"}}},
        "ports": {"type": "array", "items": {"type": "object", "properties": {"berth": {"type": "integer"}}}},
        "crew": {"type": "object", "properties": {"cook": {"type": "object", "required": ["name"]}}},
    },
}

CASES = [
    ("rope", {"type": "string"}, []),
    ("rope", {"type": "integer"}, [("", "type_is")]),
    (1.5, {"type": "integer"}, [("", "is_integer")]),
    (2.0, {"type": "integer"}, []),
    ({"label": "tea", "grams": 250}, PARCEL, []),
    ({"label": 7, "grams": "heavy", "stamps": [1]}, PARCEL, [("label", "type_is"), ("grams", "type_is")]),
    ({"label": "tea"}, PARCEL, [("", "required")]),
    ({"label": "tea", "grams": None}, PARCEL, [("grams", "not_null")]),
    (["a", 1, None], {"type": "array", "items": {"type": "string"}}, [("[1]", "type_is"), ("[2]", "not_null")]),
    ([{"label": "a", "grams": 1}, {"label": "b", "grams": []}], {"type": "array", "items": PARCEL}, [("[1].grams", "type_is")]),
    ({"ship": {"draught": 4.2, "decks": 3}, "ports": [], "crew": {"cook": {"name": "Ada"}}}, VOYAGE, []),
    (
        {"ship": {"draught": "deep", "decks": 2.5}, "ports": [{}, {"berth": "west"}], "crew": {"cook": {"age": 9}}},
        VOYAGE,
        [("ship.draught", "type_is"), ("ship.decks", "is_integer"), ("crew.cook", "required"), ("ports[1].berth", "type_is")],
    ),
    ([[1, "x"]], {"type": "array", "items": {"type": "array", "items": {"type": "number"}}}, [("[0][1]", "type_is")]),
    (None, {"type": "string", "nullable": True}, []),
    (None, {"anyOf": [{"type": "string"}]}, [("", "not_null")]),
    (True, {"anyOf": [{"type": "string"}, {"type": "number"}]}, [("", "any_of")]),
    ("x", {"anyOf": [{"type": "string"}, {"type": "number"}], "maxLength": 0}, []),
    ("é", {"type": "string", "maxLength": 1}, [("", "string_length")]),
    ("abc", {"type": "string", "pattern": "b"}, []),
    ("abc", {"maxLength": 1}, [("", "string_length")]),
    (5, {"minimum": 6}, [("", "number_range")]),
    ({"a": 1}, {"minProperties": 2}, [("", "property_count")]),
    (5, {"type": "integer", "enum": ["x"]}, []),
    ("y", {"type": "string", "enum": ["x", 1]}, [("", "enum")]),
    ("y", {"type": "uuid"}, [("", "type_is")]),
    ({"a b": {"c.d": 1}}, {"type": "object", "required": ["a b"], "properties": {"a b": {"required": ["c.d"]}}}, []),
]


@pytest.mark.parametrize("value, schema, want", CASES)
def test_rules(spark, value, schema, want):
    assert sorted(broken(spark, value, schema)) == sorted(want)


def test_soft_rules(spark):
    """Texts count as the number or truth value they spell, and only where one is wanted."""
    schema = {"properties": {"draught": {"type": "number", "maximum": 9}, "crew": {"type": "integer"}, "laden": {"type": "boolean"}, "port": {"type": "string"}}}
    spelled = {"draught": "8.25", "crew": "14", "laden": "False", "port": "0"}
    assert broken(spark, spelled, schema, soft=True) == []
    assert sorted(broken(spark, spelled, schema)) == [("crew", "type_is"), ("draught", "type_is"), ("laden", "type_is")]
    odd = {"draught": "9.5", "crew": "14.5", "laden": "maybe", "port": 3}
    assert sorted(broken(spark, odd, schema, soft=True)) == [
        ("crew", "is_integer"), ("draught", "number_range"), ("laden", "type_is"), ("port", "type_is"),
    ]


def test_first_only_selected_rules_and_summary(spark):
    value = {"label": 7, "grams": "heavy"}
    assert broken(spark, value, PARCEL, first_only=True) == [("grams", "type_is")]
    assert broken(spark, value, PARCEL, rules="required") == []
    df = spark.createDataFrame([(1, json.dumps(value))], "k int, j string")
    assert [tuple(r) for r in rule_summary(validate(df, "k", "j", PARCEL)).collect()] == [("type_is", 2)]
    with pytest.raises(ValueError):
        broken(spark, "x", {"type": "string", "pattern": "("})


def test_casts_and_params(spark):
    rows = [(1, "1e2", "t"), (2, " 1", "yes"), (3, "1d", "False"), (4, None, None), (5, ".5", "0"), (6, "NaN", "1")]
    df = spark.createDataFrame(rows, "k int, n string, b string")
    schema = {"properties": {"n": {"type": "number"}, "b": {"type": "boolean"}}}
    typed, rejects = soft_cast(df, "k", schema)
    assert [tuple(r) for r in typed.orderBy("k").collect()] == [
        (1, 100.0, True), (2, None, None), (3, None, False), (4, None, None), (5, 0.5, False), (6, None, True),
    ]
    assert sorted(tuple(r) for r in rejects.collect()) == [(2, "b", "yes"), (2, "n", " 1"), (3, "n", "1d"), (6, "n", "NaN")]
    sets = [(1, {"tonnes": "12"}), (2, {"knots": "3"}), (3, {"tonnes": "full"})]
    found = validate_params(spark.createDataFrame(sets, "k int, p map<string,string>"), "k", "p", {"tonnes": {"type": "integer"}}).collect()
    assert sorted((r["k"], r["path"], r["rule"]) for r in found) == [(2, "", "required"), (3, "tonnes", "type_is")]


def inferred(spark, *values):
    df = spark.createDataFrame([(json.dumps(v),) for v in values], "j string")
    return json.loads(infer_schema(df, "j").first()["schema"])


def test_inference(spark):
    for value, kind in [("hello", "string"), (True, "boolean"), (42, "integer"), (3.14, "number"), (3.0, "integer")]:
        assert inferred(spark, value) == {"type": kind}
    assert inferred(spark, None) == {"nullable": True}
    assert inferred(spark, []) == {"type": "array"}
    assert inferred(spark, {"name": "Alice", "age": 30}) == {
        "type": "object",
        "properties": {"age": {"type": "integer"}, "name": {"type": "string"}},
    }
    people = inferred(spark, {"id": 1, "name": "A", "email": "a"}, {"id": 2, "name": "B"}, {"id": 3, "name": "C", "email": "c"})
    assert people["required"] == ["id", "name"]
    mixed = inferred(spark, {"value": "hello"}, {"value": 42})
    assert mixed["properties"]["value"] == {"oneOf": [{"type": "integer"}, {"type": "string"}]}
    assert inferred(spark, {"tag": "go"}, {"tag": None})["properties"]["tag"] == {"type": "string", "nullable": True}
    assert inferred(spark, ["hello", 42, True])["items"] == {
        "oneOf": [{"type": "boolean"}, {"type": "integer"}, {"type": "string"}]
    }
    odd = {'we"ird.[]': [{"x": None}]}
    assert list(inferred(spark, odd)["properties"]) == ['we"ird.[]']
    deep = value = {}
    for _ in range(30):
        value["n"] = {}
        value = value["n"]
    schema = inferred(spark, deep)
    for _ in range(30):
        schema = schema["properties"]["n"]
    assert schema == {"type": "object", "properties": {}}


def test_inference_is_linear_in_the_size_of_a_text(spark):
    text = json.dumps([{"a": i, "b": [{"c": str(i)}]} for i in range(100_000)])
    found = infer_schema(spark.createDataFrame([(text,)], "j string"), "j").first()["schema"]
    assert json.loads(found)["items"]["properties"]["b"] == {
        "type": "array",
        "items": {"type": "object", "properties": {"c": {"type": "string"}}, "required": ["c"]},
    }


def test_broken_text_patterns_and_large_integers(spark):
    df = spark.createDataFrame([(1, "{broken"), (2, "null"), (3, None), (4, '"ü"'), (5, '"1"')], "k int, j string")
    found = validate(df, "k", "j", {"type": "string", "nullable": True, "pattern": r"^\p{L}+$"}).collect()
    assert sorted((r["k"], r["rule"]) for r in found) == [(1, "parse"), (5, "pattern")]
    numbers = spark.createDataFrame([(1, "9007199254740993"), (2, "1e300"), (3, "1e3")], "k int, n string")
    typed, rejects = soft_cast(numbers, "k", {"type": "object", "properties": {"n": {"type": "integer"}}})
    assert sorted((r["k"], r["n"]) for r in typed.collect() if r["n"] is not None) == [(1, 9007199254740993), (3, 1000)]
    assert [(r["k"], r["text"]) for r in rejects.collect()] == [(2, "1e300")]


TREE = {"tree": {"type": "object", "required": ["n"], "properties": {"n": {"type": "number", "maximum": 9}, "kids": {"type": "array", "items": {"$ref": REF + "tree"}}}}}
LISP = {
    "form": {"anyOf": [{"type": "number"}, {"type": "array", "items": {"$ref": REF + "form"}}, {"type": "object", "required": ["op"], "properties": {"op": {"$ref": REF + "word"}, "of": {"$ref": REF + "form"}}}]},
    "word": {"type": "string", "maxLength": 3},
}


def plain(value, schema, components, path=""):
    """Violations by plain recursion, for the rules the schemas above use."""
    if "$ref" in schema:
        return plain(value, components[schema["$ref"].removeprefix(REF)], components, path)
    if value is None:
        return [(path, "not_null")]
    if "anyOf" in schema:
        return [(path, "any_of")] if all(plain(value, s, components, path) for s in schema["anyOf"]) else []
    kinds = {"number": (int, float), "array": list, "object": dict, "string": str}
    if "type" in schema and (isinstance(value, bool) or not isinstance(value, kinds[schema["type"]])):
        return [(path, "type_is")]
    out = []
    if isinstance(value, dict):
        out += [(path, "required") for name in schema.get("required", []) if name not in value]
        for name, part in schema.get("properties", {}).items():
            if name in value:
                out += plain(value[name], part, components, f"{path}.{name}" if path else name)
    if isinstance(value, list) and "items" in schema:
        out += [x for i, item in enumerate(value) for x in plain(item, schema["items"], components, f"{path}[{i}]")]
    if isinstance(value, int | float) and value > schema.get("maximum", value):
        out.append((path, "number_range"))
    if isinstance(value, str) and len(value) > schema.get("maxLength", len(value)):
        out.append((path, "string_length"))
    return out


def test_a_tree_is_followed_to_its_leaves(spark):
    deep = {"n": 10}
    for i in range(50):
        deep = {"n": i % 9, "kids": [{"n": 1, "kids": []}, deep]}
    wide = {"n": 1, "kids": [{"n": 3, "kids": [{"n": 99}, {}, {"n": "x"}, None]}, {"n": 2, "kids": {}}]}
    rows = [(1, json.dumps(deep)), (2, json.dumps(wide)), (3, "no json"), (4, "{}"), (5, json.dumps({"n": 1}))]
    df = spark.createDataFrame(rows, "k int, j string")
    schema = {"$ref": REF + "tree"}
    found = validate(df, "k", "j", schema, components=TREE).collect()
    got = {k: sorted((r["path"], r["rule"]) for r in found if r["k"] == k) for k, _ in rows}
    assert got[1] == [("kids[1]." * 50 + "n", "number_range")]
    assert got[2] == sorted(plain(wide, schema, TREE)) and got[3] == [("", "not_null"), ("", "parse")] and got[4] == [("", "required")] and got[5] == []
    first = validate(df, "k", "j", schema, components=TREE, first_only=True, rules=["number_range", "required"]).collect()
    assert sorted((r["k"], r["rule"]) for r in first) == [(1, "number_range"), (2, "number_range"), (4, "required")]


@pytest.mark.parametrize("seed", [1, 2])
def test_branches_that_lead_back_are_weighed_at_the_end(spark, seed):
    chance = random.Random(seed)

    def form(depth):
        pick = chance.random()
        if depth == 0 or pick < 0.3:
            return chance.choice([1, 2.5, 3, "odd", None, {}, []]) if chance.random() < 0.25 else 7
        if pick < 0.65:
            return [form(depth - 1) for _ in range(chance.randint(0, 3))]
        return {"op": chance.choice(["add", "mul", "longer", 3]) if chance.random() < 0.3 else "sub", "of": form(depth - 1)}

    values = {i: form(6) for i in range(60)}
    schema = {"type": "object", "properties": {"a": {"$ref": REF + "form"}, "b": {"type": "array", "items": {"$ref": REF + "form"}}}}
    rows = {i: {"a": v, "b": [values[(i + 1) % 60], 4]} for i, v in values.items()}
    df = spark.createDataFrame([(i, json.dumps(v)) for i, v in rows.items()], "k int, j string")
    got = {(r["k"], r["path"], r["rule"]) for r in validate(df, "k", "j", schema, components=LISP).collect()}
    want = {(i, *x) for i, v in rows.items() for x in plain(v, schema, LISP)}
    assert got == want and 5 < len({k for k, _, _ in want}) < 60


def test_references_without_a_way_out(spark):
    df = spark.createDataFrame([(1, "{}")], "k int, j string")
    with pytest.raises(KeyError, match="gone"):
        validate(df, "k", "j", {"properties": {"a": {"$ref": REF + "gone"}}})
    circle = {"a": {"anyOf": [{"type": "string"}, {"$ref": REF + "b"}]}, "b": {"anyOf": [{"$ref": REF + "a"}]}}
    with pytest.raises(ValueError, match="itself"):
        validate(df, "k", "j", {"$ref": REF + "a"}, components=circle)
