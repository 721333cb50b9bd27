"""Models: ridge against its closed form; deterministic sampling; trees."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from ridelens.operators import models


@pytest.mark.parametrize("lam", [0.0, 0.3])
def test_ridge_matches_closed_form(cohort_small, lam):
    model, (r2, rmse, n) = models.fit_duration_ridge(cohort_small, lam)
    xy = models.ridge_inputs(cohort_small).select(F.col("DistanceKM").alias("x"), F.col("label").alias("y"))
    m = xy.agg(
        F.covar_pop("x", "y").alias("c"), F.var_pop("x").alias("vx"),
        F.stddev_pop("y").alias("sy"), F.avg("x").alias("mx"), F.avg("y").alias("my"),
        F.count(F.lit(1)).alias("n"),
    ).first()
    w = m.c / m.vx / (1 + lam / m.sy)
    b = m.my - w * m.mx
    assert model.coefficients[0] == pytest.approx(w, rel=1e-8)
    assert model.intercept == pytest.approx(b, rel=1e-8)
    sse = xy.agg(F.sum(F.pow(F.col("y") - (F.lit(b) + F.lit(w) * F.col("x")), 2))).first()[0]
    sst = xy.agg(F.sum(F.pow(F.col("y") - F.lit(m.my), 2))).first()[0]
    assert n == m.n
    assert r2 == pytest.approx(1 - sse / sst, rel=1e-8)
    assert rmse == pytest.approx((sse / n) ** 0.5, rel=1e-8)


@pytest.mark.parametrize("lam", [0.0, 0.3])
def test_one_pass_ridge_matches_mllib(cohort_small, lam):
    model, (r2, rmse, n) = models.fit_duration_ridge(cohort_small, lam)
    r = models.ridge_by_moments(cohort_small, lam).first()
    assert r.coefficient == pytest.approx(model.coefficients[0], rel=1e-8)
    assert r.intercept == pytest.approx(model.intercept, rel=1e-8)
    assert r.r2 == pytest.approx(r2, rel=1e-6, abs=1e-12)
    assert r.rmse == pytest.approx(rmse, rel=1e-8)
    assert r.numInstances == n


def test_sample_is_deterministic_and_sized(cohort_small):
    n = cohort_small.count()
    a = models.sample_trips(cohort_small.repartition(3), 0.1, seed=42)
    b = models.sample_trips(cohort_small.repartition(7), 0.1, seed=42)
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0
    assert abs(a.count() - 0.1 * n) < 0.03 * n
    c = models.sample_trips(cohort_small, 0.1, seed=43)
    assert c.exceptAll(a).count() > 0


def test_split_disjoint_and_complete(cohort_small):
    train, test = models.train_test_split(cohort_small)
    n = cohort_small.count()
    assert train.count() + test.count() == n
    assert train.intersect(test).count() == 0 or train.intersectAll(test).count() == 0
    assert abs(train.count() - 0.7 * n) < 0.05 * n


def test_tree_sweep_and_rmse(spark, cohort_small):
    sweep = models.tree_depth_sweep(spark, cohort_small, depths=[0, 1, 3], fraction=0.5).collect()
    assert [r.maxDepth for r in sweep] == [0, 1, 3]
    assert sweep[0].numNodes == 1 and all(r.rmse > 0 for r in sweep)

    train, test = models.tree_split(cohort_small, 0.5)
    m = models.fit_duration_tree(train, 2)
    ev = models.evaluate_rmse(m, test)
    sql = m.transform(test).agg(models.rmse_sql()).first()[0]
    assert ev == pytest.approx(sql, rel=1e-9)
    text, imp = models.describe_tree(m)
    assert "DecisionTreeRegressionModel" in text and "depth=2" in text
    assert [f for f, _ in imp] == models.TREE_FEATURES
    assert sum(v for _, v in imp) == pytest.approx(1.0) or sum(v for _, v in imp) == 0


def test_station_index_frequency_order(cohort_small):
    rows = models.tree_inputs(cohort_small)
    idx = models.station_indexer().fit(rows).transform(rows)
    counts = {
        r.start: r.n for r in rows.groupBy("start").agg(F.count(F.lit(1)).alias("n")).collect()
    }
    order = sorted(counts, key=lambda s: (-counts[s], s))
    got = {r.start: int(r.startIndex) for r in idx.select("start", "startIndex").distinct().collect()}
    assert [s for s, _ in sorted(got.items(), key=lambda kv: kv[1])] == order


def test_depth_zero_tree_equals_mean_predictor(spark, cohort_small):
    """A depth-0 tree predicts the training mean: its test RMSE has an exact SQL form."""
    sweep = {r.maxDepth: r for r in models.tree_depth_sweep(spark, cohort_small, depths=[0]).collect()}
    train, test = models.tree_split(cohort_small)
    mean = train.agg(F.avg("label")).first()[0]
    want = test.agg(F.sqrt(F.avg(F.pow(F.col("label") - F.lit(mean), 2)))).first()[0]
    assert sweep[0].numNodes == 1
    assert sweep[0].rmse == pytest.approx(want, rel=1e-9)


def test_depth_sweep_fits_features_once_and_equals_whole_pipelines(spark, cohort_small, monkeypatch):
    fitted = []
    whole = models.feature_stages
    monkeypatch.setattr(models, "feature_stages", lambda **kw: fitted.append(1) or whole(**kw))
    sweep = {r.maxDepth: r.rmse for r in models.tree_depth_sweep(spark, cohort_small, depths=[0, 2, 5], fraction=0.5).collect()}
    assert len(fitted) == 1
    train, test = models.tree_split(cohort_small, 0.5)
    for depth, rmse in sweep.items():
        m = models.fit_duration_tree(train, depth)
        assert rmse == pytest.approx(models.evaluate_rmse(m, test), rel=1e-9)


def test_train_rows_are_bounded(cohort_small):
    n = cohort_small.count()
    few = models.bounded_train_rows(cohort_small, n // 4).count()
    assert 0.6 * n / 4 < few < 1.4 * n / 4
    assert models.bounded_train_rows(cohort_small, n).count() == n


def _keys(spark, rows):
    return spark.createDataFrame(rows, "bikeID long, startTime timestamp_ntz, endTime timestamp_ntz")


def test_no_row_is_lost_with_null_keys(spark):
    t = dt.datetime(2018, 6, 1, 8)
    rows = [(i, t, t) for i in range(60)] + [(None, t, t)] * 5 + [(7, None, t)] * 5 + [(None, None, None)] * 3
    df = _keys(spark, rows)
    train, test = models.train_test_split(df)
    assert train.count() + test.count() == len(rows)
    assert models.sample_trips(df, 1.0).count() == len(rows)


def test_neighbouring_keys_are_independent(spark):
    t = dt.datetime(2018, 6, 1, 8)
    df = _keys(spark, [(i, t, t) for i in range(2000)])
    train, _ = models.train_test_split(df)
    per_block = {r.b: r.n for r in train.groupBy(F.expr("bikeID div 100").alias("b")).agg(F.count("*").alias("n")).collect()}
    assert len(per_block) == 20 and all(55 <= n <= 85 for n in per_block.values())


def test_ridge_leaves_out_missing_coordinates(spark, make_trips):
    from ridelens.operators.cohort import derive
    from tests.conftest import trip

    good = [trip(bikeID=i, duration=300 + 37 * i % 900, startStationLat=40.7 + (i * i % 17) / 100) for i in range(60)]
    bad = [trip(bikeID=100 + i, duration=5000, startStationLat=None) for i in range(20)]
    both, clean = derive(make_trips(good + bad)), derive(make_trips(good))
    want = models.ridge_by_moments(clean).first()
    got = models.ridge_by_moments(both).first()
    assert (got.numInstances, got.droppedRows, want.droppedRows) == (60, 20, 0)
    assert got.coefficient == pytest.approx(want.coefficient) and got.r2 == pytest.approx(want.r2)
    model, (r2, rmse, n) = models.fit_duration_ridge(both)
    assert n == 60 and model.coefficients[0] == pytest.approx(got.coefficient) and rmse == pytest.approx(got.rmse)
    predicted = models.ridge_predictions(both).collect()
    assert len(predicted) == 80 and sum(r.prediction is None for r in predicted) == 20


def test_station_index_query_equals_the_indexer(cohort_small):
    rows = models.tree_inputs(cohort_small)
    idx = models.station_indexer().fit(rows).transform(rows)
    want = {("start", r.start, r.startIndex) for r in idx.select("start", "startIndex").distinct().collect()}
    want |= {("end", r.end, r.endIndex) for r in idx.select("end", "endIndex").distinct().collect()}
    assert {tuple(r) for r in models.station_index(cohort_small).collect()} == want


@pytest.mark.parametrize("query", ["station_index", "split_sizes"])
def test_one_scan_of_trips(spark, cohort_small, query):
    plan = getattr(models, query)(cohort_small)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("l_orderkey") and plan.split("== Initial")[0].count("lineitem.parquet") == 1


def test_epoch_seconds_name_the_time_once_and_round_down(spark):
    # Once: four times a field, the sample's and the split's filter became a method that the JVM does not compile.
    assert str(models._unit_hash(1, models.TRIP_KEY)).count("startTime") == 1
    seconds = {
        "1970-01-01 00:00:00": 0,
        "1969-12-31 23:59:59.5": -1,
        "1900-03-01 00:00:00.25": -2_203_891_200,
        "2018-03-11 02:30:00.999999": 1_520_735_400,
        None: None,
    }
    rows = spark.createDataFrame([(t,) for t in seconds], "t string").select("t", models.epoch_seconds(F.col("t").cast("timestamp_ntz")).alias("s"))
    assert {r.t: r.s for r in rows.collect()} == seconds
