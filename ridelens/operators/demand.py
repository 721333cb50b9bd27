"""Demand questions: where riders go by time of day, and when they ride.

All operators take the cleaned cohort and stay declarative; each compiles to one
scan, one partial (map-side) aggregate, one small exchange of partial counts, and
a final aggregate.  Top-k per band is a ``row_number`` window that Spark turns into
a ``WindowGroupLimit`` (per-partition top-k before the exchange), so skew in a
hot station or band never moves raw rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C


def time_band_counts(cohort: DataFrame, time_col: str = "endTime") -> DataFrame:
    """Trips per time-of-day band (hour of ``time_col``)."""
    return (
        cohort.filter(F.col(time_col).isNotNull())
        .select(C.time_band(F.hour(time_col)).alias("Time"))
        .groupBy("Time")
        .agg(F.count(F.lit(1)).alias("Num"))
    )


def day_type_counts(cohort: DataFrame, time_col: str = "startTime") -> DataFrame:
    """Trips per day name and Weekday/Weekend of ``time_col``."""
    name = C.day_name(F.dayofweek(time_col))
    return (
        cohort.filter(F.col(time_col).isNotNull())
        .select(name.alias("Day"), C.day_type(name).alias("DayType"))
        .groupBy("Day", "DayType")
        .agg(F.count(F.lit(1)).alias("Num"))
    )


def _band_station_counts(cohort: DataFrame, time_col: str) -> DataFrame:
    # The band is null exactly when the time is null; filtering the time itself
    # keeps the predicate pushed into the scan cheap (no CASE over hour()).
    return (
        cohort.filter(F.col(time_col).isNotNull())
        .select(C.time_band(F.hour(time_col)).alias("Time"), "endStationName")
        .groupBy("Time", "endStationName")
        # COUNT(endStationName): a null station is a group with count 0.
        .agg(F.count("endStationName").alias("Number"))
    )


def top_destinations_by_band(
    cohort: DataFrame, k: int = 10, time_col: str = "endTime"
) -> DataFrame:
    """Top-k end stations per time band; ties broken by station name.

    ``time_col`` defaults to ``endTime`` for parity with the original analysis
    (its "time of departure" bands are computed on the end time).
    """
    w = Window.partitionBy("Time").orderBy(F.desc("Number"), F.asc_nulls_last("endStationName"))
    return (
        _band_station_counts(cohort, time_col)
        .withColumn("rank", F.row_number().over(w))
        .filter(F.col("rank") <= k)
        .select("Time", "rank", "endStationName", "Number")
        .orderBy("Time", "rank")
    )


def top_destinations(
    cohort: DataFrame, band: str, k: int = 10, time_col: str = "endTime"
) -> DataFrame:
    """Top-k end stations for one band (``TakeOrderedAndProject``)."""
    return (
        cohort.filter(C.time_band(F.hour(time_col)) == F.lit(band))
        .groupBy("endStationName")
        .agg(F.count("endStationName").alias("Number"))
        .orderBy(F.desc("Number"), F.asc_nulls_last("endStationName"))
        .limit(k)
    )


def hourly_usage(cohort: DataFrame) -> DataFrame:
    """Trips per (gender, Weekday/Weekend, hour, Leaving/Arriving).

    Both ends of each trip are unpivoted with ``stack`` so that one scan and one
    aggregate replace the four aggregates + two unions of the original.  A trip
    that starts on Friday 23:50 and ends Saturday 00:10 counts as Leaving in
    Weekday hour 23 and Arriving in Weekend hour 0.
    """
    ends = cohort.select(
        "gender",
        F.stack(
            F.lit(2),
            F.lit("Leaving"),
            F.hour("startTime"),
            C.day_type_of("startTime"),
            F.lit("Arriving"),
            F.hour("endTime"),
            C.day_type_of("endTime"),
        ).alias("Type", "Hour", "DayType"),
    )
    return (
        ends.filter(F.col("Hour").isNotNull())  # a null time has no hour
        .groupBy("gender", "DayType", "Hour", "Type")
        .agg(F.count("Hour").alias("Num"))
        .orderBy("gender", "DayType", "Type", "Hour")
    )


def hourly_slice(cohort: DataFrame, gender: str, day_type: str) -> DataFrame:
    """One chart's rows: (Hour, Num, Type) for a gender and day type."""
    return (
        hourly_usage(cohort.filter(F.col("gender") == gender))
        .filter(F.col("DayType") == day_type)
        .select("Hour", "Num", "Type")
    )


def hourly_usage_union(cohort: DataFrame) -> DataFrame:
    """The original two-aggregate + positional-union form of ``hourly_usage``.

    Positional union keeps the left side's names, so the hour/day columns are called
    ``startHour``/``startDay`` and the direction column ``Leaving`` even for
    arriving rows.  Kept as the equivalence baseline for ``hourly_usage``.
    """
    leaving = cohort.filter(F.col("startTime").isNotNull()).groupBy(
        "gender",
        F.hour("startTime").alias("startHour"),
        C.day_type(C.day_name(F.dayofweek("startTime"))).alias("startDay"),
    ).agg(F.count(F.lit(1)).alias("Num"), F.lit("Leaving").alias("Leaving"))
    arriving = cohort.filter(F.col("endTime").isNotNull()).groupBy(
        "gender",
        F.hour("endTime").alias("endHour"),
        C.day_type(C.day_name(F.dayofweek("endTime"))).alias("endDay"),
    ).agg(F.count(F.lit(1)).alias("Num"), F.lit("Arriving").alias("Arriving"))
    return leaving.union(arriving)


def peak_hours(cohort: DataFrame) -> DataFrame:
    """Busiest and quietest hour per (gender, day type, direction), and their ratio.

    Ties resolve to the earliest hour (order key ``Num * 100 -/+ Hour``).
    """
    h = hourly_usage(cohort)
    return h.groupBy("gender", "DayType", "Type").agg(
        F.max_by("Hour", F.col("Num") * 100 - F.col("Hour")).alias("peakHour"),
        F.max("Num").alias("peakNum"),
        F.min_by("Hour", F.col("Num") * 100 + F.col("Hour")).alias("lowHour"),
        F.min("Num").alias("lowNum"),
        (F.min("Num") / F.max("Num")).alias("lowHighRatio"),
    )
