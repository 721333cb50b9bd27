import pytest

import __spark_entry__ as entry
import corpus_pipeline
from tests.verify import compare, duckdb_connection
from tests.conftest import SF0001

LLM = [k for k in entry.queries() if k.startswith("op") or k == "pipeline"]


def test_all_are_registered():
    assert sorted(k.split("_")[0] for k in LLM) == sorted([*(f"op{n}" for n in range(1, 14)), "pipeline"])


@pytest.mark.parametrize("name", [k for k in LLM if k in entry.oracle_sql()])
def test_sql(spark, name):
    r = compare(spark, name, entry.queries()[name], entry.oracle_sql()[name], SF0001, duckdb_connection(SF0001))
    assert r["ok"], r


def test_pipeline_stages_take_effect(spark):
    docs = spark.read.parquet(f"{SF0001}/documents.parquet")
    kept = docs.columns
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, SF0001).cache()
        assert after.columns == kept, name
        assert after.select("doc_id").exceptAll(before.select("doc_id")).count() == 0
        if name == "personal_data":
            assert after.count() == before.count()
            assert after.filter("text like '%@mail%'").count() == 0 < before.filter("text like '%@mail%'").count()
        before = after
    tokens = corpus_pipeline.STAGES[-1][1](spark, before, SF0001)
    assert tokens.count() == before.count() == tokens.filter("round_trip").count()
    assert corpus_pipeline.run(spark, SF0001).select("doc_id").exceptAll(tokens.select("doc_id")).count() == 0
