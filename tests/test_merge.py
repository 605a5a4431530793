import json
import random

import pytest
from pyspark.sql import functions as F

from stagewise.operators.merge import (
    assemble_records,
    fragment_rejects,
    merge_fragments,
    overlay_fragments,
)
from stagewise.streaming.merge import merge_fragments_stream, read_merged


def fold(fragments):
    """The merge rules, one fragment after the other."""
    record = {}
    for fragment in fragments:
        for name, new in fragment.items():
            if name not in record:
                if new is not None:
                    record[name] = list(new) if isinstance(new, list) else dict(new) if isinstance(new, dict) else new
                continue
            old = record[name]
            if isinstance(old, list):
                if isinstance(new, list):
                    record[name] = old + new
                elif new is not None:
                    record[name] = [*old, new]
            elif isinstance(old, dict):
                if isinstance(new, dict):
                    record[name] = {**old, **new}
                elif new is not None:
                    record[name] = list(new) if isinstance(new, list) else new
            elif new is None:
                del record[name]
            else:
                record[name] = list(new) if isinstance(new, list) else new
    return record


def merged_records(spark, rows):
    df = spark.createDataFrame([(k, s, json.dumps(f)) for k, s, f in rows], "k string, s bigint, f string")
    out = assemble_records(merge_fragments(df, "k", "s", "f"), "k").collect()
    return {row["k"]: json.loads(row["record"]) for row in out}


# What a field is after one fragment and then another, by the kinds of both values; NOTHING where no field remains.
NOTHING = object()
CELLS = {
    ("none", "scalar"): ([21.5], 21.5),
    ("none", "object"): ([{"low": 3}], {"low": 3}),
    ("none", "list"): ([["rain"]], ["rain"]),
    ("none", "null"): ([None], NOTHING),
    ("scalar", "scalar"): ([21.5, "warm"], "warm"),
    ("scalar", "object"): ([21.5, {"low": 3}], {"low": 3}),
    ("scalar", "list"): ([21.5, ["rain", "hail"]], ["rain", "hail"]),
    ("scalar", "null"): ([21.5, None], NOTHING),
    ("object", "scalar"): ([{"low": 3}, False], False),
    ("object", "object"): ([{"low": {"at": 4}, "high": 9}, {"low": {"by": "north"}}], {"low": {"by": "north"}, "high": 9}),
    ("object", "list"): ([{"low": 3}, ["fog"]], ["fog"]),
    ("object", "null"): ([{"low": 3}, None], {"low": 3}),
    ("list", "scalar"): ([["rain"], 7], ["rain", 7]),
    ("list", "object"): ([["rain"], {"mm": 2}], ["rain", {"mm": 2}]),
    ("list", "list"): ([["rain"], ["hail", ["fog"]]], ["rain", "hail", ["fog"]]),
    ("list", "null"): ([["rain"], None], ["rain"]),
}


def test_every_pair_of_kinds(spark):
    rows = [("/".join(kinds), i, {"sky": value}) for kinds, (values, _) in CELLS.items() for i, value in enumerate(values)]
    rows += [(key, 9, {"station": 4}) for key in {key for key, _, _ in rows}]
    got = merged_records(spark, rows)
    for kinds, (_, want) in CELLS.items():
        assert got["/".join(kinds)] == ({"station": 4} if want is NOTHING else {"station": 4, "sky": want}), kinds


def random_value(rng):
    return rng.choice(
        [
            lambda: None,
            lambda: rng.randint(0, 9),
            lambda: rng.choice(["x", "1", 'q"u\\o']),
            lambda: True,
            lambda: [rng.choice([1, "1", None, {"z": 1}, [2]]) for _ in range(rng.randint(0, 3))],
            lambda: {name: rng.choice([1, None, "v", [1]]) for name in rng.sample("abc", rng.randint(0, 3))},
        ]
    )()


def random_rows(seed, keys=40, longest=9):
    rng = random.Random(seed)
    rows = []
    for k in range(keys):
        for s in range(rng.randint(1, longest)):
            names = rng.sample(["f", "g", "h"], rng.randint(0, 3))
            rows.append((f"k{k}", s * 3, {name: random_value(rng) for name in names}))
    rng.shuffle(rows)
    return rows


def expected(rows):
    by_key = {}
    for k, s, f in rows:
        by_key.setdefault(k, []).append((s, f))
    folded = {k: fold([f for _, f in sorted(v, key=lambda p: p[0])]) for k, v in by_key.items()}
    return {k: v for k, v in folded.items() if v}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_random_fragments_equal_the_fold(spark, seed):
    rows = random_rows(seed)
    assert merged_records(spark, rows) == expected(rows)


def test_large_groups_equal_the_fold(spark):
    rows = [("hot", i, {"items": [i, i + 1], "last": i, "map": {f"n{i % 7}": i}}) for i in range(12_000)]
    rows += [("cold", 0, {"items": [1]}), (None, 5, {"items": [2]})]
    assert merged_records(spark, rows) == expected(rows)


def test_null_cells(spark):
    rows = [("a", 0, {"s": 1}), ("a", 1, {"s": None}), ("b", 0, {"s": None}), ("b", 1, {"s": 2}), ("c", 0, {"s": {}}), ("c", 1, {"s": None})]
    assert merged_records(spark, rows) == {"b": {"s": 2}, "c": {"s": {}}}


def test_overlay_keeps_null_and_replaces(spark):
    rows = [("a", 0, '{"p1": "v1", "p2": [1]}'), ("a", 1, '{"p2": null, "p3": {"x": 1}}')]
    df = spark.createDataFrame(rows, "k string, s int, f string")
    got = {r["field"]: r["value"] for r in overlay_fragments(df, "k", "s", "f").collect()}
    assert got == {"p1": '"v1"', "p2": "null", "p3": '{"x":1}'}


def test_rejects(spark):
    df = spark.createDataFrame([(1, '{"a":1}'), (2, "[1]"), (3, '{"a":1} x'), (4, None)], "k int, f string")
    assert sorted(r["k"] for r in fragment_rejects(df, "f").collect()) == [2, 3, 4]


def test_stream_in_many_batches_equals_batch(spark, tmp_path):
    rows = random_rows(11)
    data = [(k, s, json.dumps(f)) for k, s, f in rows]
    for i in range(5):
        part = spark.createDataFrame(data[i::5], "k string, s bigint, f string").coalesce(1)
        part.write.mode("append").parquet(str(tmp_path / "in"))
    stream = (
        spark.readStream.schema("k string, s bigint, f string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    )
    running = merge_fragments_stream(
        stream, "k", "s", "f", str(tmp_path / "out"), str(tmp_path / "ckpt"), {"availableNow": True}
    )
    running.awaitTermination()
    assert running.exception() is None
    key = ["k", "field", "seq", "pos", "name"]
    got = read_merged(spark, "k", str(tmp_path / "out")).orderBy(*key).collect()
    batch = spark.createDataFrame(data, "k string, s bigint, f string")
    want = merge_fragments(batch, "k", "s", "f").select(*[F.col(c) for c in batch.columns[:1]], "field", "kind", "seq", "pos", "name", "value")
    assert got == want.orderBy(*key).collect()


def test_marks_are_never_broadcast(spark, tmp_path):
    """Marks have a row per key and field; Spark takes them for small, whatever the table (F1)."""
    rows = spark.createDataFrame([("k", i, '{"sky": "x%d"}' % i) for i in range(3)], "k string, s bigint, f string")
    rows.write.parquet(f"{tmp_path}/rows")
    df = spark.read.parquet(f"{tmp_path}/rows")
    merged = merge_fragments(df, "k", "s", "f")
    assert "Broadcast" not in merged._jdf.queryExecution().executedPlan().toString()
    assert [tuple(row) for row in merged.collect()] == [("k", "sky", "scalar", 2, 0, None, '"x2"')]
