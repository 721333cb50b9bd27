import numpy as np

from ridelens.llm import vectors
from ridelens.llm.common import table
from tests.conftest import SF001


def exact(data, q, k=10):
    """The true nearest (distance, vec_id) of query q."""
    d = sorted((float(np.sqrt(((np.array(v, float) - np.array(data[q], float)) ** 2).sum())), i) for i, v in data.items() if i != q)
    return d[:k]


def test_recall_and_exact_scores(spark, monkeypatch):
    monkeypatch.setattr(vectors, "SHARD_ROWS", 200)
    # Small batches, so that a shard's rows and its queries come in several.
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    rows = table(spark, SF001, "embeddings")
    data = {r.vec_id: r.embedding for r in rows.collect()}
    got = {}
    for r in vectors.nearest_neighbours(rows, rows.filter("vec_id % 10 = 0")).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    found = total = 0
    for q, own in got.items():
        own.sort()
        assert [r for r, _, _ in own] == list(range(1, 11))
        assert own == sorted(own, key=lambda x: (x[2], x[1]))
        for _, i, s in own:
            assert abs(s - np.linalg.norm(np.array(data[i], float) - np.array(data[q], float))) < 1e-12
        want = {i for _, i in exact(data, q)}
        found += len(want & {i for _, i, _ in own})
        total += len(want)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert len(got) == 50 and found / total >= 0.9


def test_hard_rows(spark):
    rows = [
        (1, [1.0, 0.0]), (2, [1.0, 0.0]), (2, [9.0, 9.0]), (3, [0.0, 0.0]), (4, None), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]),
        (7, [None, 1.0]), (8, []), (None, [1.0, 1.0]), (9, [0.0, 1.0]), (10, [1.0, 0.0, 0.0]), (2, [1.0, 0.0]),
    ]
    df = spark.createDataFrame([(*r, 1.0, 2) for r in rows], "vec_id long, embedding array<double>, score double, shard int")
    got = sorted((r.query_id, r.rank, r.vec_id) for r in vectors.nearest_neighbours(df, df, k=3).collect())
    assert got == [(1, 1, 2), (1, 2, 9), (2, 1, 1), (2, 2, 9), (9, 1, 1), (9, 2, 2)]
    assert vectors.nearest_neighbours(df.limit(0), df.limit(0)).collect() == []


def recall(data, queries, k=10):
    forest = vectors.Forest(np.arange(len(data)), data)
    found = 0
    for q in queries:
        d = np.sqrt(((data - data[q]) ** 2).sum(axis=1))
        d[q] = np.inf
        found += len({i for _, i in forest.nearest(int(q), data[q], k)} & set(np.argsort(d)[:k].tolist()))
    return found / (k * len(queries))


def test_recall_with_a_hot_cluster():
    rng = np.random.default_rng(5)
    for wide, off in ((0.05, 3.0), (0.3, 16.0), (0.1, 0.0)):
        data = rng.standard_normal((6000, 64))
        data[:2000] = off * rng.standard_normal(64) / 8 + wide * rng.standard_normal((2000, 64))
        assert recall(data, range(0, 2000, 100)) >= 0.9
        assert recall(data, range(2000, 6000, 200)) >= 0.9


def test_recall_with_uneven_norms():
    rng = np.random.default_rng(6)
    data = rng.standard_normal((6000, 64)) * rng.lognormal(0, 1, (6000, 1))
    by_norm = np.argsort((data**2).sum(axis=1))
    assert recall(data, by_norm[:1500:75]) >= 0.9
    assert recall(data, by_norm[1500::225]) >= 0.9


def test_few_rows_are_ranked_on_clustered_data():
    rng = np.random.default_rng(7)
    centers = rng.standard_normal((80, 64))
    data = centers[rng.integers(0, 80, 8000)] + 0.05 * rng.standard_normal((8000, 64))
    forest = vectors.Forest(np.arange(len(data)), data)
    queries, found = range(0, 8000, 200), 0
    for q in queries:
        d = np.sqrt(((data - data[q]) ** 2).sum(axis=1))
        d[q] = np.inf
        found += len({i for _, i in forest.nearest(q, data[q], 10)} & set(np.argsort(d)[:10].tolist()))
    assert found / 400 >= 0.9 and forest.ranked < 0.3 * len(queries) * len(data), forest.ranked / len(queries) / len(data)


def test_repeated_ids_are_merged_before_they_are_dealt(spark):
    rows = [(1, [0.0, float(1 + i % 7)]) for i in range(300)] + [(2, [0.0, 2.0]), (3, [0.0, 5.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = [tuple(r) for r in vectors.nearest_neighbours(df, df.filter("vec_id = 1")).orderBy("rank").collect()]
    assert got == [(1, 1, 2, 1.0), (1, 2, 3, 4.0)]
