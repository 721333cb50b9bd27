"""Top destinations, hourly usage and peak hours; invariants I1, I8, I9."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ridelens.operators import cohort as CO
from ridelens.operators import demand

from .conftest import trip


def test_top_k_ties_by_name(make_trips):
    t = dt.datetime(2018, 6, 1, 7, 0)
    rows = []
    for name, n in [("C", 3), ("B", 2), ("A", 2), ("D", 1)]:
        rows += [trip(startStationName="Z", endStationName=name, startTime=t, endTime=t + dt.timedelta(minutes=5))] * n
    got = demand.top_destinations_by_band(CO.clean_cohort(make_trips(rows)), k=3).collect()
    assert [(r.rank, r.endStationName, r.Number) for r in got] == [(1, "C", 3), (2, "A", 2), (3, "B", 2)]
    single = demand.top_destinations(CO.clean_cohort(make_trips(rows)), "Morning", k=3).collect()
    assert [(r.endStationName, r.Number) for r in single] == [("C", 3), ("A", 2), ("B", 2)]


def test_band_uses_end_time_by_default(make_trips):
    rows = [trip(startTime=dt.datetime(2018, 6, 1, 11, 55), endTime=dt.datetime(2018, 6, 1, 12, 5))]
    c = CO.clean_cohort(make_trips(rows))
    assert demand.top_destinations_by_band(c).first().Time == "Afternoon"
    assert demand.top_destinations_by_band(c, time_col="startTime").first().Time == "Morning"


def test_trip_over_midnight(make_trips):
    rows = [
        trip(
            startTime=dt.datetime(2018, 6, 1, 23, 50),  # Friday
            endTime=dt.datetime(2018, 6, 2, 0, 10),  # Saturday
            duration=1200,
        )
    ]
    got = {
        (r.Type, r.DayType, r.Hour): r.Num
        for r in demand.hourly_usage(CO.clean_cohort(make_trips(rows))).collect()
    }
    assert got == {("Leaving", "Weekday", 23): 1, ("Arriving", "Weekend", 0): 1}


def test_stack_equals_union(cohort_small):
    a = demand.hourly_usage(cohort_small).select("gender", "Hour", "DayType", "Num", "Type")
    b = demand.hourly_usage_union(cohort_small).select(
        "gender", "startHour", "startDay", "Num", F.col("Leaving").alias("Type")
    )
    assert b.columns[1:3] == ["startHour", "startDay"]  # positional union keeps left names
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_leaving_equals_arriving_per_gender(cohort_small):
    # I1: every trip leaves once and arrives once.
    rows = demand.hourly_usage(cohort_small).groupBy("gender", "Type").agg(F.sum("Num").alias("n"))
    got = {(r.gender, r.Type): r.n for r in rows.collect()}
    for g in ("Male", "Female"):
        assert got[(g, "Leaving")] == got[(g, "Arriving")]
    assert sum(v for (g, t), v in got.items() if t == "Leaving") == cohort_small.count()


def test_hourly_slice_shape(cohort_small):
    # I8: 24 hours x 2 directions when every hour is populated.
    s = demand.hourly_slice(cohort_small, "Male", "Weekday").collect()
    assert len(s) <= 48
    assert {r.Type for r in s} <= {"Leaving", "Arriving"}


def test_band_lists_sorted(cohort_small):
    # I9: each band's list is at most k rows, counts non-increasing by rank.
    rows = demand.top_destinations_by_band(cohort_small, 10).collect()
    by_band = {}
    for r in rows:
        by_band.setdefault(r.Time, []).append((r.rank, r.Number))
    assert set(by_band) <= {"Morning", "Afternoon", "Evening", "Late Night"}
    for lst in by_band.values():
        lst.sort()
        assert len(lst) <= 10 and [k for k, _ in lst] == list(range(1, len(lst) + 1))
        assert all(a[1] >= b[1] for a, b in zip(lst, lst[1:]))


def test_peak_hours_tie_earliest(make_trips):
    rows = []
    for h, n in [(7, 2), (9, 2), (3, 1), (4, 1)]:
        s = dt.datetime(2018, 6, 4, h, 0)  # Monday
        rows += [trip(startTime=s, endTime=s + dt.timedelta(minutes=1), duration=60)] * n
    p = {
        r.Type: r
        for r in demand.peak_hours(CO.clean_cohort(make_trips(rows))).collect()
    }["Leaving"]
    assert (p.peakHour, p.peakNum, p.lowHour, p.lowNum) == (7, 2, 3, 1)
    assert p.lowHighRatio == 0.5
