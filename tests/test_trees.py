"""A fitted tree as relations: cuts, rules, kinds of features, and the stored pipeline in a stream."""

from __future__ import annotations

import os
import tempfile

import numpy as np
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.regression import DecisionTreeRegressor
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from ridelens.operators import models, trees
from ridelens.operators.cohort import clean_cohort
from ridelens.plans import catalog
from ridelens.schema import TRIP_COLUMNS
from ridelens.sources.files import write_trip_files
from ridelens.streaming.ingest import start_scoring

from .conftest import trip


def test_one_fit_gives_what_a_fit_for_each_depth_gives(spark, cohort_small):
    depths = [0, 1, 2, 4, 7, 11, 16, 30]
    sweep = {r.maxDepth: r for r in models.tree_depth_sweep(spark, cohort_small, depths, fraction=0.5).collect()}
    train, test = models.tree_split(cohort_small, 0.5)
    features = Pipeline(stages=models.feature_stages()).fit(train)
    train, test = features.transform(train).persist(), features.transform(test).persist()
    for depth in depths:
        model = models.tree_stages(depth)[-1].fit(train)
        assert sweep[depth].numNodes == model.numNodes
        assert sweep[depth].rmse == pytest.approx(models.evaluate_rmse(model, test), rel=1e-9)


def test_the_sweep_fits_one_tree(spark, cohort_small, monkeypatch):
    fits = []
    whole = DecisionTreeRegressor._fit
    monkeypatch.setattr(DecisionTreeRegressor, "_fit", lambda self, data: fits.append(1) or whole(self, data))
    assert models.tree_depth_sweep(spark, cohort_small, fraction=0.5).count() == 31 and len(fits) == 1
    assert models.tree_depth_sweep(spark, cohort_small, []).count() == 0


def test_cuts_join_leaves_that_predict_the_same(spark):
    """x halves the labels' means only together with z: the split on top gains nothing below some depth."""
    rng = np.random.default_rng(4)
    rows = [(float(a), float(b), float(10 * (a > 3) + (b > 5) * (a > 3))) for a, b in rng.integers(0, 8, (300, 2))]
    data = VectorAssembler(inputCols=["x", "z"], outputCol="features").transform(spark.createDataFrame(rows, "x double, z double, label double"))
    fit = lambda d: DecisionTreeRegressor(maxDepth=d, seed=1).fit(data)
    table = trees.NodeTable(spark, fit(8))
    for d in range(9):
        assert table.size(d) == fit(d).numNodes
    assert table.size(50) == fit(8).numNodes


def test_rules_predict_what_the_model_predicts(spark, cohort_small):
    train, test = models.tree_split(cohort_small, 0.5)
    fitted = models.fit_duration_tree(train.filter("start <> 'Station 07'"), 6)
    labels = trees.labels_of(fitted)
    rules = trees.leaf_rules(spark, trees.NodeTable(spark, fitted.stages[-1]), labels)
    assert rules.count() == fitted.stages[-1].numNodes // 2 + 1
    odd = test.limit(3).select(*models.TRIP_KEY, F.lit("nowhere").alias("start"), F.lit(None).cast("string").alias("end"), "label", "age", F.lit("?").alias("gender"), "userType")
    every = test.unionByName(odd).withColumn("n", F.monotonically_increasing_id()).cache()
    got = {r.n: r.prediction for r in trees.score_by_rules(every, rules, labels).collect()}
    want = {r.n: r.prediction for r in fitted.transform(every).collect()}
    assert len(want) > 100 and got == want  # each row meets exactly one rule
    plan = trees.score_by_rules(every, rules, labels)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan and "Python" not in plan


def test_rules_on_a_root_alone_and_beyond_the_broadcast_bound(spark, cohort_small, monkeypatch):
    train, test = models.tree_split(cohort_small, 0.5)
    fitted = models.fit_duration_tree(train, 0)
    labels = trees.labels_of(fitted)
    rules = trees.leaf_rules(spark, trees.NodeTable(spark, fitted.stages[-1]), labels)
    assert [(r.leaf, r.depth, r.rule) for r in rules.collect()] == [(1, 0, "")]
    monkeypatch.setattr(trees, "BROADCAST_RULES", 3)
    assert trees.score_by_rules(test, rules, labels).count() == test.count()


@pytest.mark.parametrize("most", [3, 20])
def test_kinds_are_those_of_the_vector_indexer(spark, most):
    rows = [(float(i % 3), float(i), float(i % 4 - 1), -1.5 if i % 2 else 2.0, None) for i in range(200)]
    names = ["a", "b", "c", "d"]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double, e double")
    from pyspark.ml.feature import VectorIndexer

    maps = VectorIndexer(inputCol="v", outputCol="o", maxCategories=most).fit(VectorAssembler(inputCols=names, outputCol="v").transform(df)).categoryMaps
    got = {r.feature: r for r in trees.feature_kinds(df, [*names, "e"], most).collect()}
    for i, name in enumerate(names):
        if i in maps:
            assert got[name].kind == "categorical" and got[name].categories == len(maps[i])
            assert dict((float(x.split(":")[0]), int(x.split(":")[1])) for x in got[name].map.split(",")) == {float(k): int(v) for k, v in maps[i].items()}
        else:
            assert (got[name].kind, got[name].categories, got[name].map) == ("continuous", None, None)
    assert (got["e"].kind, got["e"].categories, got["e"].map) == ("categorical", 0, "")
    assert trees.feature_kinds(df, [], most).count() == 0


def test_only_deep_trees_are_thinned(cohort_small):
    n = cohort_small.count()
    assert models.rows_for_depth(cohort_small, 5, 40).count() == n
    assert models.rows_for_depth(cohort_small, 30, n // 4).count() < n
    assert models.rows_for_depth(cohort_small, 30, n).count() == n


def test_stream_predictions_equal_batch_predictions_after_a_reload(spark, trips_small):
    d = tempfile.mkdtemp(prefix="ridelens-score-")
    cohort = clean_cohort(trips_small)
    fitted = models.fit_duration_tree(models.tree_inputs(cohort), 4)
    path = models.save_pipeline(fitted, f"{d}/model")
    with pytest.raises(Exception, match="exists"):
        models.save_pipeline(fitted, path)
    year = F.year("startTime")
    for k, part in enumerate((trips_small.filter(year < 1995), trips_small.filter(year >= 1995))):
        write_trip_files(part, f"{d}/landing/drop{k}")
        q = start_scoring(spark, f"{d}/landing", f"{d}/scored", f"{d}/ckpt", path, max_files_per_trigger=40)
        q.awaitTermination()
        assert q.exception() is None
    columns = [*models.TRIP_KEY, "label", "prediction"]
    got, want = spark.read.parquet(f"{d}/scored").select(*columns), fitted.transform(models.tree_inputs(cohort)).select(*columns)
    assert got.count() == want.count() > 100
    assert got.exceptAll(want).count() == 0


def test_feature_kinds_query_reads_the_trips_once(spark, monkeypatch):
    plans, kinds = [], trees.feature_kinds
    kept = spark._jsc.sc().getPersistentRDDs().size()  # of other tests
    monkeypatch.setattr(trees, "feature_kinds", lambda rows, *a: plans.append(rows._jdf.queryExecution().executedPlan().toString()) or kinds(rows, *a))
    assert catalog.QUERIES["tree_feature_kinds"](spark, "/root/testdata/sf0.001").count() == 5
    assert "InMemoryTableScan" in plans[0]
    assert spark._jsc.sc().getPersistentRDDs().size() <= kept


def test_the_sweep_keeps_node_ids_instead_of_sending_the_tree(spark, cohort_small, monkeypatch):
    kept, whole = [], DecisionTreeRegressor._fit
    monkeypatch.setattr(DecisionTreeRegressor, "_fit", lambda self, data: kept.append(self.getCacheNodeIds()) or whole(self, data))
    assert models.tree_depth_sweep(spark, cohort_small, [0, 12], fraction=0.5).count() == 2
    assert kept == [True]


def test_scoring_keeps_no_rows_and_rejects_lines_with_any_bad_field(spark, make_trips, monkeypatch):
    d = tempfile.mkdtemp(prefix="ridelens-score-")
    good = make_trips([trip(bikeID=k, startStationName=f"S{k % 3}") for k in range(30)])
    path = models.save_pipeline(models.fit_duration_tree(models.tree_inputs(clean_cohort(good)), 1), f"{d}/model")
    write_trip_files(good, f"{d}/landing")
    line = [str(x) for x in trip(bikeID=99)]
    line[TRIP_COLUMNS.index("endStationLong")] = "west"  # a field that the scores don't use
    os.makedirs(f"{d}/landing/month=201807")
    with open(f"{d}/landing/month=201807/bad.csv", "w") as f:
        f.write(",".join(TRIP_COLUMNS) + "\n" + ",".join(line) + "\n")
    kept, persist = [], type(good).persist
    monkeypatch.setattr(type(good), "persist", lambda self, *a: kept.append(1) or persist(self, *a))
    q = start_scoring(spark, f"{d}/landing", f"{d}/scored", f"{d}/ckpt", path)
    q.awaitTermination()
    assert q.exception() is None and not kept
    assert {r.bikeID for r in spark.read.parquet(f"{d}/scored").collect()} == set(range(30))
