"""Trees that the driver does not hold: the top by MLlib, the rest grown in tasks, from all training rows."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.ml import Pipeline
from pyspark.sql import functions as F

from ridelens.operators import models


def _sweep(*args):
    return {r.maxDepth: (r.numNodes, pytest.approx(r.rmse, rel=1e-9)) for r in models.tree_depth_sweep(*args).collect()}


def _rows(spark, n: int, stations: int, ages: int, labels: int, seed: int):
    """Trips with few labels, so that many gains and means are equal, and stations that few trips or none name."""
    rng = np.random.default_rng(seed)
    ends = [[f"S{int(i)}" if i else None for i in rng.integers(0, stations, n)] for _ in range(2)]
    numbers = [c.tolist() for c in (60 * rng.integers(1, labels + 1, n), rng.integers(0, ages, n), rng.integers(1, 3, n), rng.integers(0, 2, n))]
    rows = [(i, f"2018-06-01 08:{i % 60:02d}:00", a, b, y, x, f"g{g}", f"u{u}") for i, (a, b, y, x, g, u) in enumerate(zip(*ends, *numbers))]
    df = spark.createDataFrame(rows, "bikeID long, startTime string, startStationName string, endStationName string, duration int, age int, gender string, userType string")
    return df.withColumn("startTime", F.col("startTime").cast("timestamp_ntz")).withColumn("endTime", F.col("startTime"))


def test_a_tree_beyond_the_driver_is_grown_from_all_rows(spark, cohort_small):
    depths = [0, 1, 4, 5, 9, 30]
    sweep = {r.maxDepth: r for r in models.tree_depth_sweep(spark, cohort_small, depths, 0.5, 16).collect()}
    train, test = models.tree_split(cohort_small, 0.5)
    features = Pipeline(stages=models.feature_stages()).fit(train)
    train, test = features.transform(train).persist(), features.transform(test).persist()
    for depth in depths:
        model = models.tree_stages(depth)[-1].fit(train)
        assert sweep[depth].numNodes == model.numNodes
        assert sweep[depth].rmse == pytest.approx(models.evaluate_rmse(model, test), rel=1e-9)


@pytest.mark.parametrize("stations, ages, labels, leaves", [(4, 3, 2, 1), (300, 30, 3, 8), (2, 60, 40, 8)])
def test_ties_and_unknown_values_are_those_of_one_fit(spark, stations, ages, labels, leaves):
    trips = _rows(spark, 900, stations, ages, labels, stations + labels).cache()
    whole = _sweep(spark, trips, None, 1.0, 10**6)
    assert len(whole) == 31 and whole[30][0] > 63
    assert _sweep(spark, trips, None, 1.0, leaves) == whole


def test_cuts_are_of_all_rows_not_of_the_sample_that_mllib_takes(spark):
    """Beyond 828 ** 2 training rows it would miss some of the ages that a single row has."""
    assert models.bins_of_all(828**2, [None]) == 828 and models.bins_of_all(828**2 + 1, [None]) == 829
    time = F.lit("2018-06-01 08:00:00").cast("timestamp_ntz")
    age = F.when(F.col("id") < 400, F.col("id") + 31).otherwise(30).cast("int")
    trips = spark.range(1_000_000).select(
        F.col("id").alias("bikeID"), time.alias("startTime"), time.alias("endTime"), F.lit("A").alias("startStationName"), F.lit("B").alias("endStationName"),
        (age * 10).alias("duration"), age.alias("age"), F.lit("Male").alias("gender"), F.lit("Subscriber").alias("userType"),
    )
    train = trips.filter(models.in_train())
    rows, ages = train.agg(F.count("*"), F.count_distinct("age")).first()
    assert rows > 828**2 and ages > 200
    assert models.tree_depth_sweep(spark, trips, [30], 1.0).first().numNodes == 2 * ages - 1
