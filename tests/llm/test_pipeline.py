"""The corpus pipeline on hard and empty tables."""

import pytest

import corpus_pipeline
from tests.llm.helpers import docs, hard_rows

BENCH = "item_id long, text string"


def _tables(spark, path, documents, benchmark):
    docs(spark, documents).withColumnRenamed("n_words", "text_hash").withColumnRenamed("root", "gone_id").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(benchmark, BENCH).write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def test_hard_rows(spark, tmp_path):
    said = "the quick brown fox jumps over the lazy dog while the old man looks on and says nothing at all about it to anyone"
    item = "what is the name of the river that runs through the middle of the old town and then down to the sea"
    rows = [*hard_rows(), (7, said), (8, said), (7, said), (9, f"{said} and {item} or so"), (10, "Mail to dasl.78@mail3.example.com about the lazy dog"), (None, "some english words here"), (None, "some english words here")]
    path = _tables(spark, tmp_path, rows, [(1, item), (2, None), (None, "x" * 80)])
    result = corpus_pipeline.run(spark, path)
    assert result.columns == ["doc_id", "tokens", "round_trip", "scan_ok"]
    got = sorted((r.doc_id is not None, r.doc_id or 0) for r in result.collect())
    ids = [d for known, d in got if known]
    assert len(ids) == len(set(ids)) and 7 in ids and 10 in ids
    # null, empty, blank; a copy; a benchmark passage
    assert not {1, 2, 3, 8, 9} & set(ids) and sum(not known for known, _ in got) <= 2
    assert result.filter("not round_trip").count() == 0


@pytest.mark.parametrize("documents,benchmark", [([], []), ([], [(1, "some benchmark item of a certain length, asked once")]), ([(1, None), (2, "")], [])])
def test_empty_tables(spark, tmp_path, documents, benchmark):
    assert corpus_pipeline.run(spark, _tables(spark, tmp_path, documents, benchmark)).collect() == []


def test_nothing_is_lost_without_a_benchmark(spark, tmp_path):
    rows = [(i, f"document number {i} says a thing or two about topic {i * 7} of {i * i}") for i in range(12)]
    got = corpus_pipeline.run(spark, _tables(spark, tmp_path, rows, []))
    assert sorted(r.doc_id for r in got.collect()) == list(range(12))
