import json

import pytest

from stagewise.operators.parse import (
    normalize_calls,
    normalize_content,
    parse_csv_table,
    parse_json_table,
    parse_kv_table,
    tag_csv,
)

TEXTS = {
    1: '{"moor": "heath"}',
    2: '["moor", "heath"]',
    3: "3",
    4: '"x"',
    5: "null",
    6: '{"a":1} x',
    7: "[1] x",
    8: "[1], [2]",
    9: '{"a":1}, "w": {"b":2}',
    10: "",
    11: ' \n{"b": {"c": [1, {"d": null}]}} ',
    12: '{"a":1,"a":2}',
    13: "{'a': 1}",
    14: "true",
}


def test_json_accepts_exactly_one_container(spark):
    df = spark.createDataFrame(list(TEXTS.items()), "k int, t string")
    good, rejects = parse_json_table(df, "k", "t")
    got = {r["k"]: (r["kind"], json.loads(r["json"])) for r in good.collect()}
    assert got == {
        1: ("object", {"moor": "heath"}),
        2: ("array", ["moor", "heath"]),
        5: ("object", {}),
        11: ("object", {"b": {"c": [1, {"d": None}]}}),
        12: ("object", {"a": 2}),
    }
    assert {r["k"] for r in rejects.collect()} == set(TEXTS) - set(got)


def csv_of(spark, text):
    df = spark.createDataFrame([(1, text)], "k int, t string")
    row = tag_csv(df, "k", "t").collect()[0]
    return row["rows"] if row["_error"] is None else row["_error"]


def test_csv_cases(spark):
    assert csv_of(spark, "oak,21\nelm,8") == [["oak", "21"], ["elm", "8"]]
    assert csv_of(spark, "kiel,oslo\r\nbonn,riga\r\n") == [["kiel", "oslo"], ["bonn", "riga"]]
    assert csv_of(spark, "a,\n\n,b\n") == [["a", ""], ["", "b"]]
    assert csv_of(spark, 'a,"x\ny"\n"q ""u""",b') == [["a", "x\ny"], ['q "u"', "b"]]
    assert csv_of(spark, 'a,"x\r\ny"\r\nb,c') == [["a", "x\ny"], ["b", "c"]]
    assert csv_of(spark, "a,b\nc") == "wrong number of fields"
    assert csv_of(spark, 'a,b"c\n') == "wrong quoting in CSV"
    assert csv_of(spark, 'a,"b"c\n') == "wrong quoting in CSV"
    assert csv_of(spark, 'a,"b\n') == "wrong quoting in CSV"
    assert csv_of(spark, "") == []


def test_csv_rows_and_rejects(spark):
    df = spark.createDataFrame([(1, "a,b\nc,d"), (2, "a\nb,c")], "k int, t string")
    good, rejects = parse_csv_table(df, "k", "t")
    assert [(r["k"], r["row"], r["cells"]) for r in good.orderBy("row").collect()] == [(1, 0, ["a", "b"]), (1, 1, ["c", "d"])]
    assert [(r["k"], r["reason"]) for r in rejects.collect()] == [(2, "wrong number of fields")]


@pytest.mark.parametrize("parse", [parse_json_table, parse_csv_table, parse_kv_table])
def test_parsers_read_and_parse_once(spark, tmp_path, parse, capsys):
    rows = [(1, '{"a": 1}'), (2, "x=1\nx=2\nbad"), (None, "a,b\nc"), (4, 'a,"b\n'), (5, None)]
    spark.createDataFrame(rows, "id int, t string").write.parquet(str(tmp_path / "in"))
    parsed = parse(spark.read.parquet(str(tmp_path / "in")), "id", "t")
    parsed.tagged.explain()
    plan = capsys.readouterr().out
    assert plan.count("FileScan") == 1 and plan.count("Generate") == 1 and plan.count("ArrowEvalPython") <= 1
    good, rejects = parsed
    assert good.count() + rejects.count() == parsed.tagged.count()
    stored = parsed.written(str(tmp_path / "out"))
    order = lambda df: sorted(map(repr, df.collect()))
    assert order(stored.good) == order(good) and order(stored.rejects) == order(rejects) and order(stored.tagged) == order(parsed.tagged)
    stored.rejects.explain()
    assert "PartitionFilters: [isnotnull(is_reject" in capsys.readouterr().out


def test_kv_lines(spark):
    df = spark.createDataFrame([(1, "a=1\nb=2\na=3\nbad\nc==d\n=x")], "id int, t string")
    good, rejects = parse_kv_table(df, "id", "t")
    assert sorted((r[1], r[2]) for r in good.collect()) == [("a", "3"), ("b", "2")]
    assert len(rejects.collect()) == 3
    assert parse_kv_table(df, "id", "t", ignore_errors=True).rejects.count() == 0


def test_content_unwraps_single_items(spark):
    rows = [(1, 0, '{"a": 1}'), (2, 0, "plain"), (3, 0, "[1]"), (3, 1, "x\"y"), (4, 0, "7")]
    df = spark.createDataFrame(rows, "k int, p int, t string")
    got = {r["k"]: json.loads(r["value"]) for r in normalize_content(df, "k", "p", "t").collect()}
    assert got == {1: {"a": 1}, 2: "plain", 3: [[1], 'x"y'], 4: "7"}
    wrapped = {r["k"]: json.loads(r["value"]) for r in normalize_content(df, "k", "p", "t", wrap=True).collect()}
    assert wrapped[1] == {"a": 1} and wrapped[2] == {"result": "plain"}


def test_large_groups_follow_the_same_rule(spark):
    df = spark.range(30_000).selectExpr("id % 2 AS k", "id AS p", "cast(id AS string) AS t").filter("k = 1 OR p = 0")
    got = {r["k"]: json.loads(r["value"]) for r in normalize_content(df, "k", "p", "t").collect()}
    assert got[0] == "0" and got[1] == [str(i) for i in range(1, 30_000, 2)]


def test_call_arguments(spark):
    texts = {1: '{"a": 1, "b": [2]}', 2: json.dumps('{"a": "x"}'), 3: json.dumps("nope"), 4: "bad", 5: "[1]", 6: "null"}
    df = spark.createDataFrame(list(texts.items()), "k int, t string")
    got = sorted((r["k"], r["arg"], r["value"]) for r in normalize_calls(df, "k", "t").collect())
    assert got == [(1, "a", "1"), (1, "b", "[2]"), (2, "a", '"x"')]
