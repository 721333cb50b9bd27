"""Rider, fleet and distance questions; invariants I3-I7 and equivalence pairs."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from ridelens.functions import columns as C
from ridelens.operators import cohort as CO
from ridelens.operators import distance, fleet, riders

from .conftest import trip


def test_age_in_one_user_type(make_trips):
    rows = [
        trip(birthYear=2002, userType="Subscriber"),  # age 16, subscribers only
        trip(birthYear=1990, userType="Subscriber"),
        trip(birthYear=1990, userType="Customer"),
    ]
    c = CO.clean_cohort(make_trips(rows))
    assert [r.ageS for r in riders.usertype_share_by_age(c).collect()] == [28]
    assert sorted(r.ageS for r in riders.usertype_share_by_age(c, keep_all=True).collect()) == [16, 28]
    assert [r.ageS for r in riders.usertype_by_age_join(c).collect()] == [28]


def test_share_invariants(cohort_small):
    # I3
    for r in riders.usertype_share_by_age(cohort_small, keep_all=True).collect():
        assert r.NumSubs + r.NumCusts == r.Total
        assert r.PercSubs + r.PercCusts == pytest.approx(100, abs=1e-9)


def test_conditional_aggregate_equals_join(cohort_small):
    a = riders.usertype_share_by_age(cohort_small).select("ageS", "NumSubs", "NumCusts")
    b = riders.usertype_by_age_join(cohort_small).select("ageS", "NumSubs", "NumCusts")
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_age_bands_sum_per_age(cohort_small):
    # I4: per-age counts summed by band equal the band table; Percent = Num / sum.
    per_age = riders.usertype_share_by_age(cohort_small, keep_all=True)
    by_band = {
        r.ageGroup: (r.s, r.c)
        for r in per_age.groupBy(C.age_band("ageS").alias("ageGroup"))
        .agg(F.sum("NumSubs").alias("s"), F.sum("NumCusts").alias("c"))
        .collect()
    }
    share = riders.age_band_share(cohort_small).collect()
    totals = {}
    for r in share:
        totals[r.userType] = totals.get(r.userType, 0) + r.Num
        want = by_band[r.ageGroup][0 if r.userType == "Subscriber" else 1]
        assert r.Num == want
    for r in share:
        assert r.Percent == pytest.approx(r.Num / totals[r.userType], rel=1e-12)
    for r in riders.age_band_totals(cohort_small).collect():
        assert (r.NumSubs, r.NumCusts) == by_band[r.ageGroup] and r.Total == sum(by_band[r.ageGroup])


def test_gender_share_sums_to_one(trips_small):
    rows = riders.gender_share(trips_small).collect()
    assert sum(r.Share for r in rows) == pytest.approx(1.0)
    assert {r.gender for r in rows} <= {"Male", "Female", "Unknown"}


def test_age_profile_max(trips_small):
    rows = riders.age_profile(trips_small).collect()
    top = max(r.age for r in rows)
    assert [r.age for r in rows if r.isMaxAge] == [top]


def test_bike_lists(cohort_small):
    used = {r.bikeID: r.Num for r in fleet.most_used_bikes(cohort_small, 10).collect()}
    hours = fleet.most_hours_bikes(cohort_small, 10).collect()
    assert len(used) == 10 and len(hours) == 10
    for r in hours:
        assert abs(r.HoursUsed * 3600 - round(r.HoursUsed * 3600)) < 1e-6  # I5
        if r.bikeID in used:
            assert used[r.bikeID] == r.Num  # I6
    both = {r.bikeID for r in fleet.bikes_in_both_top(cohort_small, 10).collect()}
    assert both == set(used) & {r.bikeID for r in hours}


def test_rare_and_heavy_counts(cohort_small):
    usage = fleet.bike_usage(cohort_small).collect()
    assert fleet.rarely_used_bike_count(cohort_small, 5).first().NumBikes == sum(
        1 for r in usage if r.Num < 5
    )
    assert fleet.heavily_used_bike_count(cohort_small, 15).first().NumBikes == sum(
        1 for r in usage if r.Num > 15
    )
    exact = fleet.distinct_bikes(cohort_small).first().NumBikes
    approx = fleet.distinct_bikes(cohort_small, approximate=True).first().NumBikes
    assert exact == len(usage) and abs(approx - exact) <= 0.05 * exact


def test_daily_rate(cohort_small):
    days = cohort_small.select(F.to_date("startTime")).distinct().count()
    for r in fleet.bike_daily_rate(cohort_small, 10).collect():
        assert r.Days == days and r.TripsPerDay == pytest.approx(r.Num / days)


def test_zero_duration_speed(make_trips):
    rows = [trip(duration=0), trip(duration=1800)]
    c = CO.clean_cohort(make_trips(rows))
    speeds = [r.Speed for r in distance.trip_speed(c).orderBy("TimeHR").collect()]
    assert speeds[0] is None and speeds[1] > 0
    avg = distance.avg_speed(c).first().avgSpeed
    assert avg == pytest.approx(speeds[1])  # null ignored by avg


def test_distance_stats_order(cohort_small):
    # I7
    for r in distance.distance_stats(cohort_small).collect():
        assert r.minDist <= r.avgDist + 1e-12 and r.avgDist <= r.maxDist + 1e-12


def test_speed_gap(cohort_small):
    sp = {(r.Age, r.gender): r.avgSpeed for r in distance.avg_speed(cohort_small).collect()}
    for r in distance.speed_gender_gap(cohort_small).collect():
        if r.MaleSpeed is not None and r.FemaleSpeed is not None:
            assert r.MaleSpeed == pytest.approx(sp[(r.Age, "Male")])
            assert r.Gap == pytest.approx(r.MaleSpeed - r.FemaleSpeed)


def test_gender_totals_equal_user_type_totals(cohort_small):
    # I2: male + female = subscribers + customers = cohort size.
    from ridelens.operators import demand

    n = cohort_small.count()
    leaving = (
        demand.hourly_usage(cohort_small)
        .filter(F.col("Type") == "Leaving")
        .groupBy("gender")
        .agg(F.sum("Num").alias("n"))
        .collect()
    )
    assert sum(r.n for r in leaving) == n and {r.gender for r in leaving} <= {"Male", "Female"}
    share = riders.usertype_share_by_age(cohort_small, keep_all=True).agg(F.sum("Total")).first()[0]
    assert share == n
