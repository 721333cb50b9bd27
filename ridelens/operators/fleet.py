"""Fleet questions: most/least used bikes, hours in use, daily rates.

Per-bike counts are a hash aggregate with map-side combine: each task emits at
most one partial row per bike, so even a bike holding a third of all trips costs
one row per task in the exchange.  Top-k uses ``orderBy(...).limit(k)``, which
plans as ``TakeOrderedAndProject`` (per-partition top-k, then a k-row merge).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C


def bike_usage(cohort: DataFrame) -> DataFrame:
    """(bikeID, Num, HoursUsed) for every bike."""
    return cohort.groupBy("bikeID").agg(
        F.count("bikeID").alias("Num"),
        C.hours(F.sum("duration")).alias("HoursUsed"),
    )


def most_used_bikes(cohort: DataFrame, k: int = 10) -> DataFrame:
    return (
        cohort.groupBy("bikeID")
        .agg(F.count("bikeID").alias("Num"))
        .orderBy(F.desc("Num"), F.asc("bikeID"))
        .limit(k)
    )


def most_hours_bikes(cohort: DataFrame, k: int = 10) -> DataFrame:
    return bike_usage(cohort).orderBy(F.desc("HoursUsed"), F.asc("bikeID")).limit(k)


def rarely_used_bikes(cohort: DataFrame, threshold: int = 5) -> DataFrame:
    """Bikes with fewer than ``threshold`` trips."""
    return (
        cohort.groupBy("bikeID")
        .agg(F.count("bikeID").alias("Num"))
        .filter(F.col("Num") < threshold)
    )


def rarely_used_bike_count(cohort: DataFrame, threshold: int = 5) -> DataFrame:
    return rarely_used_bikes(cohort, threshold).agg(F.count(F.lit(1)).alias("NumBikes"))


def heavily_used_bike_count(cohort: DataFrame, threshold: int = 1500) -> DataFrame:
    """Number of bikes with more than ``threshold`` trips."""
    return (
        cohort.groupBy("bikeID")
        .agg(F.count("bikeID").alias("Num"))
        .filter(F.col("Num") > threshold)
        .agg(F.count(F.lit(1)).alias("NumBikes"))
    )


def distinct_bikes(cohort: DataFrame, approximate: bool = False, rsd: float = 0.01) -> DataFrame:
    """Number of distinct bikes; exact by default, HyperLogLog++ on request."""
    if approximate:
        return cohort.agg(F.approx_count_distinct("bikeID", rsd).alias("NumBikes"))
    return cohort.agg(F.count_distinct("bikeID").alias("NumBikes"))


#: Base-2 logarithm of the sketch's registers; the relative standard error is 1.04 / sqrt(2 ** SKETCH_BITS).
SKETCH_BITS = 14


def bike_sketches(cohort: DataFrame, bits: int = SKETCH_BITS) -> DataFrame:
    """``month, sketch``: a mergeable sketch of the bikes in use in each start month.

    A sketch has a bounded size, whatever the number of bikes; new months add rows, and any set of
    months merges without reading a trip again.
    """
    month = F.date_format("startTime", "yyyyMM").alias("month")
    return cohort.groupBy(month).agg(F.hll_sketch_agg("bikeID", F.lit(bits)).alias("sketch"))


def distinct_bikes_of(sketches: DataFrame) -> DataFrame:
    """Estimated number of distinct bikes (``NumBikes``) of all the sketches' months together; 0 for none."""
    merged = sketches.agg(F.hll_union_agg("sketch").alias("sketch"))
    return merged.select(F.coalesce(F.hll_sketch_estimate("sketch"), F.lit(0)).cast("long").alias("NumBikes"))


def bikes_in_both_top(cohort: DataFrame, k: int = 10) -> DataFrame:
    """Bikes in both the top-k by trips and the top-k by hours (semi join)."""
    by_hours = most_hours_bikes(cohort, k).select("bikeID")
    return most_used_bikes(cohort, k).join(by_hours, "bikeID", "left_semi")


def bike_daily_rate(cohort: DataFrame, k: int = 10) -> DataFrame:
    """Trips and hours per day of the period for the top-k bikes by trips.

    Trips are first added up by bike and day; both the bikes' sums and the period length (distinct
    days with any trip, a scalar subquery) are taken from that one aggregate, whose
    exchange Spark reuses.
    """
    per_day = cohort.groupBy("bikeID", F.to_date("startTime").alias("day")).agg(
        F.count("bikeID").alias("trips"), F.sum("duration").alias("seconds")
    )
    days = per_day.select(F.count_distinct("day")).scalar()
    usage = per_day.groupBy("bikeID").agg(
        F.sum("trips").alias("Num"), C.hours(F.sum("seconds")).alias("HoursUsed")
    )
    # Bind the subquery once (three references would plan three subqueries) and
    # before the top-k, so the top-k still plans as TakeOrderedAndProject.
    rates = usage.withColumn("Days", days).select(
        "bikeID",
        "Num",
        "HoursUsed",
        "Days",
        (F.col("Num") / F.col("Days")).alias("TripsPerDay"),
        (F.col("HoursUsed") / F.col("Days")).alias("HoursPerDay"),
    )
    return rates.orderBy(F.desc("Num"), F.asc("bikeID")).limit(k)
