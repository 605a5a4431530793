"""Sources, sinks, reshaping, lookups, conversations, events."""

import bisect
import json

import pytest
from pyspark.sql import functions as F

from stagewise.functions.registry import FunctionRegistry
from stagewise.operators.conversation import attach_once, join_parts, loop_guard
from stagewise.operators.lookup import attach_resources, missing_required, route_resources, upsert_by_key
from stagewise.operators import reshape
from stagewise.operators.prompts import document_blocks, wrap_documents
from stagewise.operators.reshape import (
    Rule,
    apply_transformers,
    chunk_array,
    chunk_rows,
    gate,
    iterate,
    numbered_rows,
    prefix_sums,
    slice_rows,
    unique_rows,
)
from stagewise.operators.rollup import resources_to_vars, run_status
from stagewise.sources.documents import media_type, read_resources, resolve_resources, resources_from_table
from stagewise.sources.sinks import publish_table, write_records
from stagewise.streaming.events import event_level_filter, flatten_events

MEDIA = {
    "document.pdf": "application/pdf", "file.txt": "text/plain", "readme.md": "text/plain", "data.csv": "text/plain",
    "image.jpg": "text/plain", "file": "text/plain", "": "text/plain", ".pdf": "application/pdf",
    "test.PDF": "application/pdf", "dir.pdf/file": "text/plain",
}


def test_media_types(spark):
    df = spark.createDataFrame([(name,) for name in MEDIA], "n string")
    assert {r["n"]: r["m"] for r in df.select("n", media_type(F.col("n")).alias("m")).collect()} == MEDIA


def test_files(spark, tmp_path):
    (tmp_path / "sub dir").mkdir()
    (tmp_path / "a.csv").write_text("elm,8\noak,21")
    (tmp_path / "sub dir" / "b%20+é.pdf").write_bytes(b"\x00\x01")
    rows = {r["identifier"]: r for r in read_resources(spark, str(tmp_path)).collect()}
    assert set(rows) == {"a.csv", "sub dir/b%20+é.pdf"}
    assert bytes(rows["sub dir/b%20+é.pdf"]["content"]) == b"\x00\x01"
    assert [r["identifier"] for r in read_resources(spark, str(tmp_path), [".csv", ".md"]).collect()] == ["a.csv"]
    with pytest.raises(Exception):
        read_resources(spark, str(tmp_path / "gone")).collect()


def test_csv_resource_to_records(spark, tmp_path):
    (tmp_path / "tides.csv").write_text("dover,6.8\nbrest,7.3\nemden,3.2")
    docs = read_resources(spark, str(tmp_path)).withColumn("content", F.decode("content", "utf-8"))
    shape = "transform(args, r -> named_struct('port', r[0], 'metres', cast(r[1] AS double)))"
    row = apply_transformers(docs, [Rule("csv", on_resource="tides.csv", parser="csv", expr=shape)], "identifier", "content").first()
    assert row["structured"]
    assert [(r["port"], r["metres"]) for r in json.loads(row["content"])] == [("dover", 6.8), ("brest", 7.3), ("emden", 3.2)]


PORT = '{"port": "Dover", "tide": {"high": 6.8}, "open": true}'
TRANSFORMS = [
    (Rule("r", on_resource="x", parser="json", expr="named_struct('name', variant_get(args, '$.port', 'string'))"), PORT, {"name": "Dover"}),
    (Rule("r", on_resource="x", parser="json", expr="transform(cast(args AS array<variant>), p -> variant_get(p, '$.tide.high', 'double'))"),
     f"[{PORT},{PORT}]", [6.8, 6.8]),
    (Rule("r", on_resource="x", parser="csv", expr="transform(args, r -> array_size(r))"), "a,b,c\nd", [3, 1]),
    (Rule("r", on_resource="x", parser="json", path="variant_get(args, '$.tide', 'variant')"), PORT, {"high": 6.8}),
]


@pytest.mark.parametrize("rule, text, want", TRANSFORMS)
def test_transformers(spark, rule, text, want):
    df = spark.createDataFrame([("x", text), ("y", "same")], "n string, c string")
    rows = {r["n"]: r for r in apply_transformers(df, [rule], "n", "c").collect()}
    assert json.loads(rows["x"]["c"]) == want and rows["x"]["structured"]
    assert rows["y"]["c"] == "same" and not rows["y"]["structured"]


def test_loaders(spark):
    a = resources_from_table(spark.createDataFrame([("f.txt", "old", 1), ("f.txt", "new", 2)], "i string, c string, s int"), "i", "c", "s")
    b = resources_from_table(spark.createDataFrame([("g", "aGk=")], "i string, c string"), "i", "c", base64=True)
    asks = [("f.txt", {"loader": "a"}), ("g", {"loader": "b"}), ("f.txt", {}), ("f.txt", {"loader": "zz"}), ("h", {"loader": "a"})]
    df = spark.createDataFrame(asks, "identifier string, params map<string,string>")
    got = [(r["content"] and bytes(r["content"]).decode(), r["_error"]) for r in resolve_resources(df, {"a": a, "b": b}).collect()]
    assert sorted(got, key=str) == sorted(
        [
            ("new", None), ("hi", None), (None, "no loader selector provided"),
            (None, "no loader found for resource"), (None, "resource not found: h"),
        ],
        key=str,
    )


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, None), (2, "x")], "a int, b string")
    write_records(df, str(tmp_path / "j"))
    lines = sorted(line for p in (tmp_path / "j").glob("*.json") for line in p.read_text().splitlines())
    assert lines == ['{"a":1,"b":null}', '{"a":2,"b":"x"}']
    write_records(df, str(tmp_path / "t"), "template", "{{ .a }}/{{ .b }}")
    assert sorted(r["value"] for r in spark.read.text(str(tmp_path / "t")).collect()) == ["1/<no value>", "2/x"]
    with pytest.raises(ValueError):
        write_records(df, str(tmp_path / "u"), "yaml")
    publish_table("rows_by_name", df)
    assert spark.sql("SELECT sum(a) AS s FROM rows_by_name").collect()[0]["s"] == 3


def test_saved_tables_grow(spark):
    spark.sql("DROP TABLE IF EXISTS stagewise_saved")
    publish_table("stagewise_saved", spark.range(3), saved=True)
    publish_table("stagewise_saved", spark.range(2), saved=True)
    assert spark.table("stagewise_saved").count() == 5
    spark.sql("DROP TABLE stagewise_saved")


def test_attach_and_route(spark):
    docs = resources_from_table(spark.createDataFrame([("d1", "text")], "i string, c string"), "i", "c")
    stage = spark.sql(
        "SELECT 1 AS k, true AS pre, array(named_struct('identifier', 'd1', 'dest', cast(null AS string), 'var', 'v'), "
        "named_struct('identifier', 'd9', 'dest', 'vars', 'var', cast(null AS string))) AS requests"
    )
    rows = route_resources(attach_resources(stage, docs), "pre").orderBy("req_pos").collect()
    assert [(r["identifier"], r["dest"], r["target"], r["_error"]) for r in rows] == [
        ("d1", "ai", "prePrompt", None),
        ("d9", "vars", "vars", "resource not found: d9"),
    ]
    need = spark.createDataFrame([("a", "function"), ("b", "mcp")], "name string, type string")
    assert missing_required(need, None).count() == 0
    assert missing_required(need, need.filter("name = 'a'")).collect()[0]["name"] == "b"


def test_gate_and_iterate(spark):
    df = spark.createDataFrame([(["reef"], {"k": 1}), ([], {})], "marks array<string>, m map<string,int>")
    assert gate(df, "array_contains(marks, 'reef') AND map_contains_key(m, 'k') AND size(marks) > 0").count() == 1
    with pytest.raises(ValueError):
        gate(df, "marks")
    assert [(r["it_pos"], r["it"]) for r in iterate(df, "marks").collect()] == [(0, "reef")]
    assert iterate(df).count() == 2
    with pytest.raises(ValueError):
        iterate(df, "size(marks)")


def test_slices(spark):
    df = spark.createDataFrame([("a", i) for i in range(5)] + [("b", 0), (None, 0), (None, 1)], "k string, p int")
    for start, stop in [(1, None), (None, 2), (-2, None), (1, -1), (None, -10), (0, 0), (-1, None)]:
        got = sorted((str(r["k"]), r["p"]) for r in slice_rows(df, "k", "p", start, stop).collect())
        want = sorted((str(k), p) for k, n in (("a", 5), ("b", 1), (None, 2)) for p in list(range(n))[start:stop])
        assert got == want, (start, stop)


def test_numbers_of_a_hot_key(spark):
    rows = [("hot", i * 3) for i in range(3000)] + [(f"k{i % 50}", i) for i in range(200)] + [(None, 4), (None, 2)]
    df = spark.createDataFrame(rows, "k string, s bigint").repartition(8)
    got = {(r["k"], r["s"]): r["rn"] for r in numbered_rows(df, "k", "s").collect()}
    by_key = {}
    for k, s in rows:
        by_key.setdefault(k, []).append(s)
    assert got == {(k, s): i for k, v in by_key.items() for i, s in enumerate(sorted(v))}


@pytest.mark.parametrize(("share", "most"), [(2, 8), (4, 64), (1 << 12, 1 << 11)])
def test_prefix_sums_over_ranges(spark, monkeypatch, share, most):
    monkeypatch.setattr(reshape, "BORDER_SHARE", share)
    monkeypatch.setattr(reshape, "MOST_BORDERS", most)
    rows = [("hot", f"{i:05}", i % 7) for i in range(4000)] + [(f"k{i % 30}", f"{i:05}", 1) for i in range(300)] + [(None, "b", 2), (None, None, 5)]
    df = spark.createDataFrame(rows, "k string, s string, v int").repartition(8)
    before = len(spark.sparkContext.statusTracker().getJobIdsForGroup(None))
    summed = prefix_sums(df, "k", "s", {"n": F.lit(1), "total": F.col("v")})
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup(None)) == before
    want, last = {}, {}
    for k, s, v in sorted(rows, key=lambda r: (r[0] or "", r[1] or "")):
        n, total = last.get(k, (0, 0))
        want[k, s], last[k] = (n, total), (n + 1, total + v)
    assert {(r["k"], r["s"]): (r["n"], r["total"]) for r in summed.collect()} == want
    borders = {r["k"]: r["_borders"] for r in reshape.range_borders(df, "k", "s").collect()}
    if share < 10:
        assert most // 4 <= len(borders["hot"]) <= most
        ranges = range_borders_counts(df, borders["hot"])
        assert max(ranges) < 4000 * 12 / len(borders["hot"])
    else:
        assert len(borders.get("hot", [])) < 8


def range_borders_counts(df, borders):
    values = sorted(r["s"] for r in df.filter("k = 'hot'").collect())
    edges = [bisect.bisect_left(values, b) for b in borders]
    return [b - a for a, b in zip([0, *edges], [*edges, len(values)])]


def test_blocks_of_a_group_have_places(spark):
    rows = [("a", i, f"d{i}", "\u00e4" * (i % 5)) for i in range(40)] + [("b", 1, "x", "y"), ("b", 0, "n", None)]
    blocks = document_blocks(spark.createDataFrame(rows, "g string, at int, id string, t string"), "g", "at", "id", "t").collect()
    whole = {r["g"]: r["text"] for r in wrap_documents(spark.createDataFrame(rows, "g string, at int, id string, t string"), "g", "at", "id", "t").collect()}
    for g in "ab":
        own = sorted((r for r in blocks if r["g"] == g), key=lambda r: r["block"])
        assert [r["block"] for r in own] == list(range(len(own)))
        data = whole[g].encode()
        assert "".join(r["text"] for r in own if r["text"]) == whole[g]
        assert all(data[r["offset"] :].startswith((r["text"] or "").encode()) for r in own)


def test_chunks_and_unique(spark):
    df = spark.createDataFrame([("a", i, i % 2) for i in range(7)], "k string, s int, v int")
    rows = chunk_rows(df, "k", "s", 3).orderBy("s").collect()
    assert [(r["chunk"], r["chunk_pos"]) for r in rows] == [(i // 3, i % 3) for i in range(7)]
    with pytest.raises(ValueError):
        chunk_rows(df, "k", "s", 0)
    assert sorted((r["v"], r["s"]) for r in unique_rows(df, "k", "v", "s").collect()) == [(0, 0), (1, 1)]
    lists = spark.createDataFrame([([1, 2, 3],), ([],)], "l array<int>").select(chunk_array(F.col("l"), 2).alias("c"))
    assert [r["c"] for r in lists.collect()] == [[[1, 2], [3]], []]


def test_conversation_rules(spark):
    rows = [(1, i, "assistant" if i % 2 else "user", str(i)) for i in range(20)] + [(2, 3, "user", "x")]
    df = spark.createDataFrame(rows, "c int, turn int, role string, text string")
    assert {r["c"]: r["looping"] for r in loop_guard(df, "c").collect()} == {1: True, 2: False}
    assert sorted((r["c"], r["turn"]) for r in attach_once(df, "c").filter("with_documents").collect()) == [(1, 0), (2, 3)]
    parts = join_parts(df.filter("c = 1"), "c", "turn", "text").collect()
    assert [r["text"] for r in parts] == ["".join(str(i) for i in range(20))]


def test_rollups(spark):
    df = spark.createDataFrame([(1, "a", "finished"), (1, "b", "failed"), (2, "a", "queued")], "run int, stage string, status string")
    assert [tuple(r) for r in run_status(df, "run").orderBy("run").collect()] == [(1, True, ["b"]), (2, False, [])]
    docs = spark.createDataFrame(
        [(1, 0, "a/b.csv", None, None, "text"), (1, 1, "x", "v", "[1]", "raw"), (1, 2, "y", "v", None, "last")],
        "k int, s int, identifier string, var string, structured string, content string",
    )
    got = {r["name"]: r["value"] for r in resources_to_vars(docs, "k", "s").collect()}
    assert got == {"a_b_csv": "text", "v": "last"}


def test_events(spark):
    rows = [("1", "debug", "runner", "start", None, 3, {"b": "2", "a": "1"}), ("2", "err", "ai", "error", "s1", None, None)]
    df = spark.createDataFrame(
        rows, "id string, level string, component string, type string, session string, iteration int, args map<string,string>"
    )
    assert event_level_filter(df, "info").count() == 1 and event_level_filter(df, "debug").count() == 2
    got = {}
    for r in flatten_events(df).orderBy("id", "pos").collect():
        got.setdefault(r["id"], []).append((r["name"], r["value"]))
    assert got == {
        "1": [("component", "runner"), ("type", "start"), ("iteration", "3"), ("a", "1"), ("b", "2")],
        "2": [("component", "ai"), ("type", "error"), ("session", "s1")],
    }


def test_registry(spark):
    functions = FunctionRegistry()
    functions.register_function(spark, "twice", lambda s: s * 2, {"n": "bigint"}, "bigint", group="math")
    assert spark.range(3).select(functions.get("twice").apply(F.col("id")).alias("x")).collect()[2]["x"] == 4
    assert spark.sql("SELECT twice(21) AS x").collect()[0]["x"] == 42
    other = FunctionRegistry()
    other.register_columns("twice", lambda n: n, ["n"], "bigint", group="other")
    assert functions.with_functions(other).get("twice").group == "other"
    assert functions.catalog(spark).collect()[0]["collection"] == "math"
    with pytest.raises(KeyError):
        functions.get("thrice")


def test_refused_content_stays_and_is_told(spark):
    df = spark.createDataFrame([("a", '{"x": 1}'), ("a", "{broken"), ("b", "free")], "n string, c string")
    rule = Rule("pick", on_resource="a", parser="json", path="variant_get(args, '$.x', 'int')")
    rows = sorted((r["n"], r["c"], r["structured"], r["_error"]) for r in apply_transformers(df, [rule], "n", "c").collect())
    assert rows == [("a", "1", False, None), ("a", "{broken", False, "pick: content is not JSON"), ("b", "free", False, None)]
    with pytest.raises(Exception, match="content is not JSON"):
        apply_transformers(df, [rule], "n", "c", mode="failfast").collect()


def test_repeated_identifiers_without_an_order_stop(spark):
    docs = resources_from_table(spark.createDataFrame([("f", "a"), ("f", "b")], "i string, c string"), "i", "c")
    with pytest.raises(Exception, match="not unique"):
        docs.collect()


def test_null_keys_are_replaced(spark):
    base, patch = (spark.createDataFrame([(None, v), (v, v)], "k string, v string") for v in ("old", "new"))
    assert sorted((r["k"] or "", r["v"]) for r in upsert_by_key(base, patch, "k").collect()) == [("", "new"), ("new", "new"), ("old", "old")]
