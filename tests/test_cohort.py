"""Cohort rules: bounds, equivalence of the one-filter and union forms, funnel."""

from __future__ import annotations

import datetime as dt

from ridelens.operators import cohort as CO
from ridelens.operators import fleet

from .conftest import SF0001, trip


def _kept(df):
    return sorted(r.duration for r in df.collect())


def test_customer_bounds(make_trips):
    rows = [trip(userType="Customer", duration=d) for d in (119, 120, 1800, 1801)]
    assert _kept(CO.clean_cohort(make_trips(rows))) == [120, 1800]


def test_subscriber_bounds(make_trips):
    rows = [trip(userType="Subscriber", duration=d) for d in (0, 60, 2700, 2701)]
    assert _kept(CO.clean_cohort(make_trips(rows))) == [0, 60, 2700]


def test_age_bound(make_trips):
    rows = [
        trip(birthYear=1953, duration=1),  # 65 -> in
        trip(birthYear=1952, duration=2),  # 66 -> out
        trip(birthYear=None, duration=3),  # null -> out
    ]
    assert _kept(CO.clean_cohort(make_trips(rows), as_of_year=2018)) == [1]
    # the year is a parameter, not the clock
    assert _kept(CO.clean_cohort(make_trips(rows), as_of_year=2017)) == [1, 2]


def test_gender_and_round_trip(make_trips):
    rows = [
        trip(gender=0, duration=1),
        trip(gender=None, duration=2),
        trip(gender=2, duration=3),
        trip(startStationName="X", endStationName="X", startStationID="1", endStationID="2", duration=4),
    ]
    out = CO.clean_cohort(make_trips(rows)).collect()
    assert [(r.duration, r.gender) for r in out] == [(3, "Female")]


def test_cohort_columns(make_trips):
    out = CO.clean_cohort(make_trips([trip()]))
    assert out.columns == [
        "duration", "startTime", "endTime", "startStationName", "startStationLat",
        "startStationLong", "endStationName", "endStationLat", "endStationLong", "bikeID",
        "userType", "age", "gender",
    ]
    r = out.first()
    assert r.age == 38 and r.gender == "Male" and r.startTime == dt.datetime(2018, 6, 1, 8)


def test_one_filter_equals_union(trips_small):
    a = CO.clean_cohort(trips_small)
    b = CO.clean_cohort_union(trips_small)
    assert a.count() == b.count()
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_fixture_counts(spark, trips_small, cohort_small):
    # Table in FIXTURES.md section 3 for sf0.001.
    assert trips_small.count() == 6000
    assert cohort_small.count() == 2130
    assert fleet.distinct_bikes(cohort_small).first().NumBikes == 200
    assert fleet.rarely_used_bike_count(cohort_small).first().NumBikes == 2
    assert fleet.most_used_bikes(cohort_small, 1).first().Num == 21


def test_cleaning_funnel(trips_small, cohort_small):
    f = CO.cleaning_funnel(trips_small).first()
    assert f.rows_in == 6000 and f.rows_out == cohort_small.count()
    assert f.rows_in >= f.after_gender >= f.after_age >= f.after_round_trip >= f.rows_out
    assert f.short_term + f.annual == f.rows_out
    assert abs(f.pct_removed - 100 * (f.rows_in - f.rows_out) / f.rows_in) < 1e-9


def test_rules_reach_scans(spark):
    from ridelens.plans.inspect import plan_text
    from ridelens.sources.tables import trips_from_tables

    plan = plan_text(CO.clean_cohort(trips_from_tables(spark, SF0001)))
    # gender -> customer scan, age -> orders scan (evaluated right after the scan)
    assert "(c_nationkey" in plan and "% 3) IN (1,2)" in plan
    assert "o_custkey" in plan and ">= 1953" in plan


def test_rules_become_parquet_pushed_filters(spark, trips_small):
    """On trip files the rules written on raw columns reach the parquet reader."""
    import tempfile

    from ridelens.plans.inspect import plan_text

    path = tempfile.mkdtemp(prefix="ridelens-parquet-") + "/trips"
    trips_small.write.parquet(path)
    cohort = CO.clean_cohort(spark.read.parquet(path))
    pushed = [line for line in plan_text(cohort).splitlines() if line.startswith("PushedFilters")]
    assert len(pushed) == 1
    assert "In(gender, [1,2])" in pushed[0]
    assert "GreaterThanOrEqual(birthYear,1953)" in pushed[0]
    assert "Or(" in pushed[0]  # the user-type/duration disjunction is pushed too
    assert cohort.count() == 2130
