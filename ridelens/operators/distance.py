"""Distance and speed questions (great-circle distance between stations)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C


def with_distance(cohort: DataFrame, legacy: bool = False) -> DataFrame:
    """Adds ``DistanceKM`` and ``TimeHR`` (duration in hours)."""
    return cohort.withColumns(
        {
            "DistanceKM": C.haversine_km(
                "startStationLat", "startStationLong", "endStationLat", "endStationLong", legacy
            ),
            "TimeHR": C.hours("duration"),
        }
    )


def trip_distance(cohort: DataFrame) -> DataFrame:
    """Per-trip distance with the standard formula and the legacy variant."""
    return cohort.select(
        "bikeID",
        "startTime",
        "startStationName",
        "endStationName",
        C.haversine_km(
            "startStationLat", "startStationLong", "endStationLat", "endStationLong"
        ).alias("DistanceKM"),
        C.haversine_km(
            "startStationLat", "startStationLong", "endStationLat", "endStationLong", legacy=True
        ).alias("DistanceKMLegacy"),
    )


def trip_speed(cohort: DataFrame, legacy: bool = False) -> DataFrame:
    """Per-trip hours, km and km/h; a zero duration gives a null speed."""
    d = with_distance(cohort, legacy)
    return d.select(
        "bikeID",
        "startTime",
        "TimeHR",
        "DistanceKM",
        C.safe_ratio("DistanceKM", "TimeHR").alias("Speed"),
    )


def distance_stats(cohort: DataFrame, legacy: bool = False) -> DataFrame:
    """avg/max/min distance per (age, gender)."""
    return (
        with_distance(cohort, legacy)
        .groupBy(F.col("age").alias("Age"), "gender")
        .agg(
            F.avg("DistanceKM").alias("avgDist"),
            F.max("DistanceKM").alias("maxDist"),
            F.min("DistanceKM").alias("minDist"),
        )
        .select("Age", "avgDist", "maxDist", "minDist", "gender")
        .orderBy("Age", "gender")
    )


def avg_speed(cohort: DataFrame, legacy: bool = False) -> DataFrame:
    """Mean of per-trip speeds (not total km / total hours) per (age, gender)."""
    return (
        with_distance(cohort, legacy)
        .filter(F.col("startStationName") != F.col("endStationName"))
        .groupBy(F.col("age").alias("Age"), "gender")
        .agg(F.avg(C.safe_ratio("DistanceKM", "TimeHR")).alias("avgSpeed"))
        .select("Age", "avgSpeed", "gender")
        .orderBy("Age", "gender")
    )


def speed_gender_gap(cohort: DataFrame, legacy: bool = False) -> DataFrame:
    """Male and female mean speed per age and their difference (male - female)."""
    sp = with_distance(cohort, legacy).select(
        F.col("age").alias("Age"),
        "gender",
        C.safe_ratio("DistanceKM", "TimeHR").alias("Speed"),
    )
    wide = sp.groupBy("Age").pivot("gender", [C.GENDER_MALE, C.GENDER_FEMALE]).agg(F.avg("Speed"))
    return wide.select(
        "Age",
        F.col(C.GENDER_MALE).alias("MaleSpeed"),
        F.col(C.GENDER_FEMALE).alias("FemaleSpeed"),
        (F.col(C.GENDER_MALE) - F.col(C.GENDER_FEMALE)).alias("Gap"),
    )
