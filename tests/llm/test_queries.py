"""Registered queries: those with SQL against it, the pipeline stage by stage."""

import pytest

import corpus_pipeline
from __spark_entry__ import oracle_sql, queries
from check import compare, connect
from stagewise.llm.queries import ORACLES, QUERIES

SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, name):
    assert name in queries() and name in oracle_sql()
    result = compare(spark, connect(SF_DIR), name, QUERIES[name], ORACLES[name], SF_DIR)
    assert result.startswith("ok"), result


def test_all_operators_are_registered():
    assert sorted({int(name[2:].split("_")[0]) for name in QUERIES}) == list(range(1, 14))
    assert "pipeline" in queries()


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    now, counts = docs, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = spark.createDataFrame(stage(spark, now, SF_DIR).toPandas(), docs.schema)
        assert now.columns == docs.columns
        counts.append(now.count())
    assert counts[0] >= counts[1] >= counts[2] >= counts[3] > 0.5 * counts[0]
    last = corpus_pipeline.STAGES[-1][1](spark, now, SF_DIR)
    whole = corpus_pipeline.run(spark, SF_DIR)
    assert last.count() == counts[-1]
    assert sorted(map(tuple, whole.drop("shard", "place").collect())) == sorted(map(tuple, last.drop("shard", "place").collect()))


AWKWARD = [
    (1, "a text that stands here twice and is long enough to be told apart from others", "en", "s", 1),
    (1, "a text that stands here twice and is long enough to be told apart from others", "en", "s", 1),
    (None, "ein Text ohne Nummer, der auch einmal vorkommt und lang genug ist", "de", None, 2),
    (2, None, "en", "s", 0),
    (3, "", None, None, None),
    (4, "a text that stands here " + "again and again " * 30_000, "en", "t", 9),
    (5, "ein anderer Text, der nur hier steht, mit eigenen Worten", "de", "t", 3),
] * 2


@pytest.mark.parametrize("rows", [AWKWARD, AWKWARD[:1], []])
def test_pipeline_takes_awkward_rows(spark, rows):
    columns = "doc_id long, text string, lang string, source string, n_chars long"
    extra = "copies long, _copies long, `row` struct<a:int>, part double, size long, `a.b` string"
    docs = now = spark.createDataFrame([(*r, 1, 2, (3,), 0.5, 4, "x") for r in rows], f"{columns}, {extra}")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        now = spark.createDataFrame(stage(spark, now, SF_DIR).collect(), docs.schema)
        assert now.columns == docs.columns
        for r in now.collect():
            assert any((r.doc_id, r.text, r.lang, r.source, r.n_chars) == x for x in rows)
    found = corpus_pipeline.STAGES[-1][1](spark, now, SF_DIR)
    assert found.count() == now.count()
