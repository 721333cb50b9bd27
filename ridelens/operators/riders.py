"""Rider questions: user type by age, age bands, gender share, age profile."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C


def _is_sub():
    return F.col("userType") == C.SUBSCRIBER


def _is_cust():
    return F.col("userType") != C.SUBSCRIBER


def subs_by_age(cohort: DataFrame) -> DataFrame:
    return (
        cohort.filter(_is_sub())
        .groupBy(F.col("age").alias("ageS"))
        .agg(F.count("userType").alias("NumSubs"))
        .orderBy("ageS")
    )


def custs_by_age(cohort: DataFrame) -> DataFrame:
    return (
        cohort.filter(_is_cust())
        .groupBy(F.col("age").alias("ageC"))
        .agg(F.count("userType").alias("NumCusts"))
        .orderBy("ageC")
    )


def usertype_by_age_join(cohort: DataFrame) -> DataFrame:
    """The original aggregate-then-join form (ages present in only one type vanish)."""
    s = subs_by_age(cohort)
    c = custs_by_age(cohort)
    return (
        s.join(c, s.ageS == c.ageC, "inner")
        .select("ageS", "NumSubs", "ageC", "NumCusts")
        .orderBy("ageS")
    )


def usertype_share_by_age(cohort: DataFrame, keep_all: bool = False) -> DataFrame:
    """Per age: subscribers, customers, total and percentage split.

    One conditional aggregate instead of two aggregates and a join.  By default
    only ages with both user types are kept (the original inner join); with
    ``keep_all=True`` every age is returned.
    """
    agg = cohort.groupBy(F.col("age").alias("ageS")).agg(
        F.count_if(_is_sub()).alias("NumSubs"), F.count_if(_is_cust()).alias("NumCusts")
    )
    if not keep_all:
        agg = agg.filter((F.col("NumSubs") > 0) & (F.col("NumCusts") > 0))
    total = F.col("NumSubs") + F.col("NumCusts")
    return agg.select(
        "ageS",
        "NumSubs",
        "NumCusts",
        total.alias("Total"),
        (F.lit(100) * F.try_divide(F.col("NumSubs"), total)).alias("PercSubs"),
        (F.lit(100) * F.try_divide(F.col("NumCusts"), total)).alias("PercCusts"),
    ).orderBy("ageS")


def age_band_counts(cohort: DataFrame) -> DataFrame:
    return (
        cohort.groupBy(C.age_band("age").alias("ageGroup"))
        .agg(F.count(F.lit(1)).alias("Num"))
    )


def age_band_share(cohort: DataFrame) -> DataFrame:
    """Trips and share of the user type's trips per age band.

    The share window runs on the aggregated rows (user types x 8 bands), so
    partitioning it by user type moves a handful of rows.
    """
    counts = cohort.groupBy(
        F.when(_is_sub(), F.lit(C.SUBSCRIBER)).otherwise(F.lit(C.CUSTOMER)).alias("userType"),
        C.age_band("age").alias("ageGroup"),
    ).agg(F.count(F.lit(1)).alias("Num"))
    w = Window.partitionBy("userType")
    return counts.withColumn("Percent", F.col("Num") / F.sum("Num").over(w)).orderBy(
        "userType", "ageGroup"
    )


def age_band_totals(cohort: DataFrame) -> DataFrame:
    """Subscribers + customers per band (the stacked-bar total)."""
    return (
        cohort.groupBy(C.age_band("age").alias("ageGroup"))
        .agg(F.count_if(_is_sub()).alias("NumSubs"), F.count_if(_is_cust()).alias("NumCusts"))
        .withColumn("Total", F.col("NumSubs") + F.col("NumCusts"))
    )


def gender_share(trips: DataFrame) -> DataFrame:
    """Share of raw (uncleaned) trips per decoded gender.

    The whole-table window runs after aggregation on at most three rows.
    """
    counts = trips.groupBy(C.to_gender("gender").alias("gender")).agg(
        F.count(F.lit(1)).alias("Num")
    )
    return counts.withColumn("Share", F.col("Num") / F.sum("Num").over(Window.partitionBy()))


def gender_decode(trips: DataFrame) -> DataFrame:
    """Raw gender code -> label, with trip counts per code."""
    return trips.groupBy(
        F.col("gender").alias("genderCode"), C.to_gender("gender").alias("gender")
    ).agg(F.count(F.lit(1)).alias("Num"))


def rider_age(trips: DataFrame, as_of_year: int = C.DEFAULT_AS_OF_YEAR) -> DataFrame:
    """Birth year -> age at ``as_of_year``, with trip counts per birth year."""
    return trips.groupBy(
        "birthYear", C.rider_age("birthYear", as_of_year).alias("age")
    ).agg(F.count(F.lit(1)).alias("Num"))


def age_profile(trips: DataFrame, as_of_year: int = C.DEFAULT_AS_OF_YEAR) -> DataFrame:
    """Raw trips per age before cleaning; ``isMaxAge`` flags the oldest age found."""
    counts = trips.groupBy(C.rider_age("birthYear", as_of_year).alias("age")).agg(
        F.count(F.lit(1)).alias("Num")
    )
    oldest = counts.select(F.max("age")).scalar()
    return counts.withColumn("isMaxAge", F.col("age") == oldest)
