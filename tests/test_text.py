"""Templates, envelopes and prompts."""

import xml.etree.ElementTree as ET

import pytest
from pyspark.sql import functions as F

from stagewise.functions.envelope import Node
from stagewise.functions.json_text import printed_json
from stagewise.functions.templates import compile_template, placeholders, render_column, scope_map, render_templates
from stagewise.operators.prompts import CallOutput, expand_preprompts, prompt_envelope, wrap_documents


def render(spark, template, columns, nested=None):
    df = spark.range(1).select(*[value.alias(name) for name, value in columns.items()])
    return df.select(compile_template(template, df.schema, nested)).collect()[0][0]


def test_paths_indexes_and_filters(spark):
    person = F.struct(F.lit("Pat").alias("first_name"), F.lit(None).cast("string").alias("nick"))
    columns = {"vars": F.struct(F.array(person, person).alias("data"), F.lit(7).alias("n")), "tags": F.array(F.lit("a"), F.lit("b"))}
    assert render(spark, "who is {{ (index .vars.data 1).first_name }}?", columns) == "who is Pat?"
    assert render(spark, "{{ .vars.n }}-{{.vars.gone}}-{{ .nothing.at.all }}", columns) == "7-<no value>-<no value>"
    assert render(spark, "{{ index .tags 1 }} {{ .tags }} {{ json .tags }}", columns) == 'b [a b] [\n "a",\n "b"\n]'
    assert render(spark, "{{ (index .vars.data 0).nick }}", columns) == "<no value>"
    assert render(spark, "no placeholders", columns) == "no placeholders"


def test_printed_json(spark):
    value = F.struct(
        F.lit("<a&b>").alias("z"),
        F.lit(2.0).alias("n"),
        F.create_map(F.lit("k"), F.array(F.lit(1), F.lit(None).cast("int"))).alias("m"),
        F.array().cast("array<string>").alias("e"),
        F.lit(None).cast("string").alias("gone"),
    )
    df = spark.range(1).select(value.alias("v"))
    kind = df.schema["v"].dataType

    def text(**kw):
        return df.select(printed_json(F.col("v"), kind, **kw)).collect()[0][0]

    assert text() == '{"e":[],"gone":null,"m":{"k":[1,null]},"n":2,"z":"\\u003ca\\u0026b\\u003e"}'
    assert text(indent="  ", skip_nulls=True) == (
        '{\n  "e": [],\n  "m": {\n    "k": [\n      1,\n      null\n    ]\n  },\n  "n": 2,\n  "z": "\\u003ca\\u0026b\\u003e"\n}'
    )


def test_values_with_placeholders_take_up_to_three_rounds(spark):
    columns = {"ship": F.lit("{{.kind}} of {{.port}}"), "kind": F.lit("tug"), "port": F.lit("Riga")}
    assert render(spark, "a {{.ship}}", columns, ["ship", "kind", "port"]) == "a tug of Riga"
    chain = {"a": F.lit("{{.b}}"), "b": F.lit("{{.c}}"), "c": F.lit("{{.d}}"), "d": F.lit("end")}
    assert render(spark, "{{.a}}", chain, list("abcd")) == "{{.d}}"


def test_templates_from_data(spark):
    df = spark.createDataFrame([("What do we say? {{ .banana }}", "come $1 \\monkey!"), ("plain", "x")], "t string, banana string")
    out = df.select(render_column(F.col("t"), scope_map(df.schema, ["banana"])).alias("r")).collect()
    assert [r["r"] for r in out] == ["What do we say? come $1 \\monkey!", "plain"]


def test_unsupported_actions_are_errors(spark):
    with pytest.raises(ValueError):
        render(spark, "{{ if .a }}x{{ end }}", {"a": F.lit(1)})
    with pytest.raises(ValueError):
        render(spark, "{{ .a }}", {"a": F.struct(F.lit(1).alias("b"))})


def test_placeholders():
    assert placeholders("{{ .a.b }} {{.c}} {{ .a.b }}") == ["a.b", "c"]


def text_of(spark, node):
    return spark.range(1).select(node.to_column()).collect()[0][0]


ENVELOPES = [
    (Node("item"), "<item></item>"),
    (Node("item", content="hello world"), "<item><![CDATA[ hello world ]]></item>"),
    (Node("item", content=""), "<item></item>"),
    (Node("parent", children=(Node("child"),)), "<parent>\n <child></child>\n</parent>"),
    (
        Node("item", name="myName", description="myDesc", content_type="text/plain"),
        '<item name="myName" description="myDesc" contentType="text/plain"></item>',
    ),
    (Node("item", name="onlyName", description=""), '<item name="onlyName"></item>'),
    (
        Node("item", name="quotes\"and'apostrophes", description="less<than>greater & more"),
        '<item name="quotes&#34;and&#39;apostrophes" description="less&lt;than&gt;greater &amp; more"></item>',
    ),
    (Node("item", content="<p>fish & chips</p>"), "<item><![CDATA[ <p>fish & chips</p> ]]></item>"),
    (Node("item", content="日本語 & émojis 🎉\nline two"), "<item><![CDATA[ 日本語 & émojis 🎉\nline two ]]></item>"),
    (Node("item", content="a ]]> b"), "<item><![CDATA[ a ]]]]><![CDATA[> b ]]></item>"),
    (
        Node("root", children=(Node("a", content="alpha"), Node("b", content="beta"), Node("c"))),
        "<root>\n <a><![CDATA[ alpha ]]></a>\n <b><![CDATA[ beta ]]></b>\n <c></c>\n</root>",
    ),
    (
        Node("l1", children=(Node("l2", children=(Node("l3", content="deep"),)),)),
        "<l1>\n <l2>\n  <l3><![CDATA[ deep ]]></l3>\n </l2>\n</l1>",
    ),
    (Node("item", content="text", children=(Node("hidden"),)), "<item><![CDATA[ text ]]></item>"),
]


@pytest.mark.parametrize("node, want", ENVELOPES)
def test_envelopes(spark, node, want):
    got = text_of(spark, node)
    assert got == want
    ET.fromstring(got)


def test_absent_children(spark):
    children = (Node("x", present=F.lit(False)), Node("y", content="t", present=F.lit(True)))
    assert text_of(spark, Node("root", children=children)) == "<root>\n <y><![CDATA[ t ]]></y>\n</root>"
    assert text_of(spark, Node("root", children=children[:1])) == "<root></root>"


def test_call_result(spark):
    node = Node("CallResult", content='"7 kn"', name="speed", description="over <ground>", content_type="application/json")
    want = '<CallResult name="speed" description="over &lt;ground&gt;" contentType="application/json"><![CDATA[ "7 kn" ]]></CallResult>'
    assert text_of(spark, node) == want


def test_prompt_envelope(spark):
    def text(*args, **kw):
        return spark.range(1).select(prompt_envelope(*args, **kw)).collect()[0][0]

    prompt = '<Prompt description="The task to execute"><![CDATA[ do it ]]></Prompt>'
    assert text(F.lit("do it")) == prompt
    assert text(F.lit("do it"), calls=[]) == "<Scope>\n <Calls></Calls>\n</Scope>\n" + prompt
    one = text(F.lit("do it"), F.lit("{}"), calls=[CallOutput("f", F.lit("1"))])
    assert one == (
        '<Scope>\n <Context contentType="application/json"><![CDATA[ {} ]]></Context>\n <Calls>\n'
        '  <CallResult name="f" contentType="application/json"><![CDATA[ 1 ]]></CallResult>\n </Calls>\n</Scope>\n' + prompt
    )


def test_preprompts_and_documents(spark):
    df = spark.createDataFrame([(1, "x")], "k int, t string")
    rows = expand_preprompts(df, ["first {{ .t }}", "second"]).orderBy("pp_pos").collect()
    assert [r["preprompt"] for r in rows] == [
        '<Prompt description="The task to execute"><![CDATA[ first x ]]></Prompt>',
        "second",
    ]
    docs = spark.createDataFrame([(1, i, f"d{i}", f"t{i}") for i in range(3)], "k int, p int, n string, t string")
    banner = wrap_documents(docs, "k", "p", "n", "t").collect()[0]["text"]
    assert banner == "=== d0 ===\nt0\n===\n=== d1 ===\nt1\n===\n=== d2 ===\nt2\n===\n"
    parts = wrap_documents(docs, "k", "p", "n", "t", style="element").collect()
    assert [r["text"].count("<Document") for r in parts] == [3]


def test_values_with_placeholders_are_filled_by_default(spark):
    df = spark.createDataFrame([("{{ .b }}", "{{ .n }}!", 7, "plain"), ("x", "y", 8, None)], "a string, b string, n int, c string")
    rows = [r["rendered"] for r in render_templates(df, "<{{ .a }}|{{ .c }}>").collect()]
    assert rows == ["<7!|plain>", "<x|<no value>>"]
