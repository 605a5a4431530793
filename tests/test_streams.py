"""The merge of a stream, seen while it runs."""

import json
import random

import pytest

from stagewise.operators.merge import merge_fragments
from stagewise.streaming import merge
from stagewise.streaming.merge import merge_fragments_stream, read_merged

VALUES = [1, "x", None, True, [1, 2], ["y"], [], {"a": 1}, {"a": None, "b": [2]}, {}]


def rows_of(df):
    return sorted(map(repr, df.select("k", "field", "kind", "seq", "pos", "name", "value").collect()))


@pytest.mark.parametrize("fan", [2, 8])
def test_readers_in_mid_stream_see_whole_versions(spark, tmp_path, monkeypatch, fan):
    monkeypatch.setattr(merge, "FAN", fan)
    chance = random.Random(fan)
    schema, source, out = "k string, s long, f string", str(tmp_path / "in"), str(tmp_path / "out")
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema(schema).json(source)
    running = merge_fragments_stream(stream, "k", "s", "f", out, str(tmp_path / "state"), {"processingTime": "0 seconds"})
    try:
        seen, versions = [], {}
        for batch in range(9):
            rows = []
            for _ in range(12):
                fields = {name: chance.choice(VALUES) for name in chance.sample(["p", "q", "r"], 2)}
                rows.append((chance.choice(["a", "b", None]), len(seen) + len(rows), json.dumps(fields)))
            chance.shuffle(rows)
            rows.append(("a", 10_000 + batch, "no json"))
            seen += rows
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(source)
            running.processAllAvailable()
            want = rows_of(merge_fragments(spark.createDataFrame(seen, schema), "k", "s", "f"))
            assert rows_of(read_merged(spark, "k", out)) == want
            folder = merge._Folder(spark, out)
            versions[folder.versions()[-1]] = want
            assert len(folder.versions()) <= merge.KEPT
            assert len(folder.parts(folder.versions()[-1])) <= fan + 3
            assert len(folder.listed(merge.STATE)) <= fan + 3 + 2 * merge.KEPT
            for version in folder.versions():
                assert rows_of(read_merged(spark, "k", out, version)) == versions[version]
    finally:
        running.stop()


def test_a_batch_is_committed_once(spark, tmp_path):
    schema, source, out = "k string, s long, f string", str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame([("a", 1, '{"l": [1]}')], schema).write.json(source)
    for run in range(2):
        stream = spark.readStream.schema(schema).json(source)
        merge_fragments_stream(stream, "k", "s", "f", out, str(tmp_path / f"state{run}"), {"availableNow": True}).awaitTermination()
        values = [r["value"] for r in read_merged(spark, "k", out).filter("pos >= 0").collect()]
        assert values == ["1"]
    with pytest.raises(ValueError, match="committed"):
        read_merged(spark, "k", str(tmp_path / "none"))
