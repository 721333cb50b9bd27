import numpy as np
import pytest
from pyspark.sql import functions as F

from ridelens.llm import hardneg

SCHEMA = "vec_id long, embedding array<float>, label int, shard int, own string, score double"


def table(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], label, 1, "x", 0.5) for i, v, label in rows], SCHEMA)


def plain(rows, is_anchor, positives=5, negatives=3, scale=256):
    """The definition, row by row."""
    rows = [(i, v, lab) for i, v, lab in rows if i is not None and lab is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    width = max((len(v) for _, v, _ in rows), default=0)
    ints = [[int(np.floor(float(np.float32(x)) * scale)) for x in v] + [0] * (width - len(v)) for _, v, _ in rows]
    out, seen = [], set()
    for (a, v, lab), x in zip(rows, ints):
        if not is_anchor(a) or (a, lab, tuple(x)) in seen:
            continue
        seen.add((a, lab, tuple(x)))
        scored = sorted((-sum(p * q for p, q in zip(x, y)), i, other == lab) for (i, _, other), y in zip(rows, ints) if i != a)
        for s, p, _ in [r for r in scored if r[2]][:positives]:
            fits = [r for r in scored if not r[2] and 50 * -s <= 100 * -r[0] <= 95 * -s][:negatives]
            out += [(a, p, k + 1, n, -s, -t) for k, (t, n, _) in enumerate(fits)]
    return sorted(out)


def mined(df, every=5, **kw):
    return sorted(map(tuple, hardneg.mine(df, F.col("vec_id") % every == 0, **kw).collect()))


@pytest.fixture
def small_shards(monkeypatch):
    monkeypatch.setattr(hardneg, "SHARD_ROWS", 60)
    monkeypatch.setattr(hardneg, "LEAF_ROWS", 10)
    monkeypatch.setattr(hardneg, "ANCHOR_BATCH", 7)


def clustered(n=500, width=8, seed=1):
    rng = np.random.default_rng(seed)
    centers = rng.normal(0, 1, (12, width))
    return [(i, (centers[i % 12] + rng.normal(0, 0.2, width)).astype(np.float32), int(rng.integers(0, 4))) for i in range(n)]


def test_equals_the_definition_on_several_shards(spark, small_shards):
    rows = clustered()
    want = plain(rows, lambda a: a % 5 == 0)
    assert len(want) > 300 and mined(table(spark, rows).repartition(4)) == want


def test_hot_vector_ties_repeats_gaps_and_uneven_norms(spark, small_shards):
    rng = np.random.default_rng(2)
    rows = [(i, (v * 2.0 ** rng.integers(-3, 3)).astype(np.float32), i % 3) for i, v in enumerate(rng.normal(0, 0.3, (260, 6)))]
    hot = rng.normal(0, 0.3, 6).astype(np.float32)
    rows += [(1000 + i, hot, i % 2) for i in range(200)]  # one vector in four shards
    rows += [(10, rows[11][1], 1), (10, rows[11][1], 1), (10, rows[10][1], 2), (3000, np.zeros(6, np.float32), 1), (3005, [0.5, 0.5], 1)]
    rows += [(None, hot, 1), (4000, hot, None), (4005, None, 1), (4010, [1.0, None], 1), (4015, [float("nan")] * 6, 1), (4020, [float("-inf")] * 6, 1), (4025, [], 1)]
    assert mined(table(spark, rows).repartition(3)) == plain(rows, lambda a: a % 5 == 0)


def test_nothing_and_little(spark):
    assert mined(table(spark, [])) == [] and mined(table(spark, [(5, None, 1)])) == []
    assert mined(table(spark, [(5, [1.0], 1), (6, [1.0], 1)])) == []  # no negative
    assert mined(table(spark, [(5, [1.0], 1), (6, [1.0], 2)])) == []  # no positive
    rows = [(5, [1.0, 0.0], 1), (6, [1.0, 0.0], 1), (7, [0.5, 0.0], 2), (8, [0.95, 0.0], 2), (9, [0.96, 0.0], 2), (11, [0.49, 0.0], 2)]
    assert mined(table(spark, rows)) == plain(rows, lambda a: a % 5 == 0) == [(5, 6, 1, 8, 65536, 62208), (5, 6, 2, 7, 65536, 32768)]
    huge = [(5, [3e38, 0.0], 1), (6, [3e38, 0.0], 1), (7, [1e5, 0.0], 2)]
    assert len(mined(table(spark, huge))) <= 1


def test_negative_scores_have_empty_windows(spark):
    rows = [(5, [1.0], 1), (6, [-1.0], 1), (7, [-0.7], 2), (8, [0.0], 1), (9, [0.0], 2)]
    assert mined(table(spark, rows)) == plain(rows, lambda a: a % 5 == 0) == [(5, 8, 1, 9, 0, 0)]


def test_ranges_leave_out_most_rows_of_clustered_data_and_lose_none():
    rows = clustered(4000, 16, 3)
    vectors = np.floor(np.array([v for _, v, _ in rows]) * 256).astype(float)
    ids, labels = np.arange(4000), np.array([lab for _, _, lab in rows])
    tree = hardneg.Tree(ids, labels, vectors, float((vectors**2).sum(axis=1).max()), leaf_rows=64)
    ask = np.arange(0, 4000, 40)
    scores = vectors[ask] @ vectors.T
    infinite = np.full(len(ask), np.inf)
    best = tree.search(vectors[ask], ask, labels[ask], -infinite, infinite, 5, True)
    assert tree.scored < 0.35 * len(ask) * 4000
    allowed = (labels == labels[ask][:, None]) & (ids != ask[:, None])
    want = -np.sort(-np.where(allowed, scores, -np.inf), axis=1)[:, :5]
    assert np.array_equal(best.scores, want)
    high, low = np.floor(0.95 * want[:, 0]), np.ceil(0.5 * want[:, 0])
    found = tree.search(vectors[ask], ask, labels[ask], low, high, 3, False)
    fits = (labels != labels[ask][:, None]) & (scores >= low[:, None]) & (scores <= high[:, None])
    assert np.array_equal(found.scores, -np.sort(-np.where(fits, scores, -np.inf), axis=1)[:, :3])


def test_an_annulus_misses_rows_too_near_and_too_far():
    may = lambda inner, outer: bool(hardneg.may_hold(np.array([[10.0]]), np.array([2.0]), np.array([3.0]), np.array([inner]), np.array([outer]))[0])
    # rows lie between 7 and 13 from the anchor
    assert may(0, 7) and may(13, 20) and may(9, 10) and not may(0, 6.9) and not may(13.1, 20)


def test_root_sends_anchors_to_few_shards_on_clustered_data(spark, small_shards):
    rows = clustered(600, 16, 4)
    stored = hardneg._packed(
        table(spark, rows).select("vec_id", F.col("label").cast("long").alias("label"), F.lit(True).alias("anchor"), F.transform("embedding", lambda x: F.floor(x * 256).cast("int")).alias("vector")), 16
    ).cache()
    root = hardneg._grow_root(stored, 16)
    vectors = np.floor(np.array([v for _, v, _ in rows]) * 256).astype(float)
    top = np.sort(vectors @ vectors.T, axis=1)[:, -6]
    sent = root.shards_for(vectors, np.arange(600), top, np.full(600, np.inf))
    assert len(root.points) > 5 and sum(map(len, sent)) < 0.5 * 600 * root.shards.sum()
    side, _ = root.subtree(vectors)
    scores = vectors @ vectors.T
    for i in range(0, 600, 13):  # every subtree with a row that reaches the score is asked
        need = {s for j in np.flatnonzero(scores[i] >= top[i]) for s in range(root.first[side[j]], root.first[side[j]] + root.shards[side[j]])}
        assert need <= set(sent[i].tolist())
