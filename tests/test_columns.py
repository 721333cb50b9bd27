"""Scalar operators on hand-written edge values (FIXTURES section 4)."""

from __future__ import annotations

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from ridelens.functions import columns as C
from ridelens.functions.sql import register_sql_functions


def _one(spark, expr, values, typ):
    df = spark.createDataFrame([(v,) for v in values], f"x {typ}")
    return [r[0] for r in df.select(expr(F.col("x"))).collect()]


def test_gender_decode(spark):
    got = _one(spark, C.to_gender, [0, 1, 2, 3, None], "int")
    assert got == ["Unknown", "Male", "Female", "Unknown", "Unknown"]


def test_time_bands(spark):
    got = _one(spark, C.time_band, [4, 5, 11, 12, 17, 18, 21, 22, None], "int")
    assert got == [
        "Late Night", "Morning", "Morning", "Afternoon", "Afternoon",
        "Evening", "Evening", "Late Night", None,
    ]


def test_age_bands(spark):
    ages = [16, 24, 25, 32, 33, 40, 41, 48, 49, 56, 57, 64, 65, 72, 73, 80]
    got = _one(spark, C.age_band, ages, "int")
    labels = [label for _, label in C.AGE_BANDS] + [C.AGE_BAND_LAST]
    assert got == [lab for lab in labels for _ in range(2)]


def test_day_names_and_types(spark):
    assert _one(spark, C.day_name, [1, 2, 7, None], "int") == ["Sunday", "Monday", "Saturday", None]
    days = [dt.datetime(2018, 6, d, 12) for d in (1, 2, 3, 4)]  # Fri Sat Sun Mon
    df = spark.createDataFrame([(d,) for d in days], "t timestamp_ntz")
    a = [r[0] for r in df.select(C.day_type_of("t")).collect()]
    b = [r[0] for r in df.select(C.day_type(C.day_name(F.dayofweek("t")))).collect()]
    assert a == b == ["Weekday", "Weekend", "Weekend", "Weekday"]


def _haversine(lat1, lon1, lat2, lon2):
    p1, p2 = math.radians(lat1), math.radians(lat2)
    dphi, dl = math.radians(lat2 - lat1), math.radians(lon2 - lon1)
    a = math.sin(dphi / 2) ** 2 + math.cos(p1) * math.cos(p2) * math.sin(dl / 2) ** 2
    return 2 * 6371 * math.asin(math.sqrt(a))


def test_distance_cases(spark):
    pts = [
        (40.75, -73.99, 40.75, -73.99),  # identical
        (40.75, -73.99, 40.765625, -73.99),  # pure north-south
        (40.75, -74.0, 40.75, -73.984375),  # pure east-west
    ]
    df = spark.createDataFrame(pts, "a float, b float, c float, d float")
    rows = df.select(
        C.haversine_km("a", "b", "c", "d").alias("ok"),
        C.haversine_km("a", "b", "c", "d", legacy=True).alias("legacy"),
    ).collect()
    assert rows[0].ok == 0 and rows[0].legacy == 0
    assert rows[1].ok == pytest.approx(rows[1].legacy, rel=1e-12)
    assert rows[1].ok == pytest.approx(_haversine(*pts[1]), rel=1e-9)
    assert rows[2].ok == pytest.approx(_haversine(*pts[2]), rel=1e-9)
    # cos(40.75 rad)^2 vs cos(40.75 deg)^2 -> legacy east-west ~1.31x too long
    assert rows[2].legacy / rows[2].ok == pytest.approx(1.31, abs=0.01)


def test_rider_age_parameter(spark):
    df = spark.createDataFrame([(1953,), (1952,), (None,)], "y int")
    assert [r[0] for r in df.select(C.rider_age("y", 2018)).collect()] == [65, 66, None]
    assert [r[0] for r in df.select(C.rider_age("y", 2020)).collect()][:2] == [67, 68]


def test_parse_raw_time(spark):
    df = spark.createDataFrame(
        [('"2018-01-01 13:50:57.4340"',), ("2018-01-01 13:50:57",), ("not a time",), (None,)],
        "s string",
    )
    got = [r[0] for r in df.select(C.parse_raw_time("s")).collect()]
    assert got == [
        dt.datetime(2018, 1, 1, 13, 50, 57, 434000),
        dt.datetime(2018, 1, 1, 13, 50, 57),
        None,
        None,
    ]


def test_sql_functions_match_columns(spark):
    register_sql_functions(spark)
    df = spark.range(-2, 130).select(F.col("id").cast("int").alias("x"))
    df = df.union(spark.createDataFrame([(None,)], "x int"))
    df.createOrReplaceTempView("ints")
    sql = spark.sql(
        "SELECT x, to_gender(x) g, time_band(x) t, age_band(x) a, day_name(x) d, "
        "day_type(day_name(x)) dt, rider_age(x, 2018) r FROM ints"
    )
    col = df.select(
        "x",
        C.to_gender("x").alias("g"),
        C.time_band(F.when((F.col("x") >= 0) & (F.col("x") < 24), F.col("x"))).alias("t0"),
        C.age_band("x").alias("a"),
        C.day_name("x").alias("d"),
        C.day_type(C.day_name("x")).alias("dt"),
        C.rider_age("x", 2018).alias("r"),
    )
    s = {r.x: r for r in sql.collect()}
    for r in col.collect():
        q = s[r.x]
        assert (q.g, q.a, q.d, q.dt, q.r) == (r.g, r.a, r.d, r.dt, r.r)
        if r.t0 is not None:
            assert q.t == r.t0


def test_sql_haversine_matches_column(spark):
    register_sql_functions(spark)
    df = spark.createDataFrame(
        [(40.75, -74.0, 40.765625, -73.96875), (40.625, -73.9, 40.7, -74.0)],
        "a float, b float, c float, d float",
    )
    df.createOrReplaceTempView("pts")
    s = spark.sql("SELECT haversine_km(a,b,c,d) h, haversine_km_legacy(a,b,c,d) l FROM pts").collect()
    c = df.select(
        C.haversine_km("a", "b", "c", "d").alias("h"),
        C.haversine_km("a", "b", "c", "d", legacy=True).alias("l"),
    ).collect()
    for x, y in zip(s, c):
        assert x.h == pytest.approx(y.h, rel=1e-12) and x.l == pytest.approx(y.l, rel=1e-12)
