"""Raw trips -> cleaned rider cohort.

Rules (fixed by the original analysis):
  * gender known (code 1 or 2);
  * age <= 65 at ``as_of_year`` (no lower bound; null age dropped);
  * start station name differs from end station name (no round trips);
  * customers ("not Subscriber"): 120 s <= duration <= 1800 s;
  * subscribers: duration <= 2700 s (no minimum).

The cohort is one scan with one conjunctive/disjunctive filter - not a union of two
filtered copies of the input, which Catalyst would not merge (two scans).  The
union form is kept (``clean_cohort_union``) as the equivalence baseline.

Filters are written on the *raw* columns where that is equivalent
(``gender IN (1, 2)``, ``birthYear >= as_of_year - 65``) so that on trip files they
become parquet ``PushedFilters`` (row-group skipping), not only post-scan filters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..schema import COHORT_COLUMNS


def derive(trips: DataFrame, as_of_year: int = C.DEFAULT_AS_OF_YEAR) -> DataFrame:
    """Project the raw record into the 13 cohort columns (no filtering)."""
    return trips.select(
        "duration",
        "startTime",
        "endTime",
        "startStationName",
        "startStationLat",
        "startStationLong",
        "endStationName",
        "endStationLat",
        "endStationLong",
        "bikeID",
        "userType",
        C.rider_age("birthYear", as_of_year).alias("age"),
        C.to_gender("gender").alias("gender"),
    )


# --- single rules, on raw trips ------------------------------------------------


def known_gender_rule() -> Column:
    return F.col("gender").isin(1, 2)


def age_cap_rule(as_of_year: int = C.DEFAULT_AS_OF_YEAR) -> Column:
    # as_of_year - birthYear <= 65  <=>  birthYear >= as_of_year - 65 (null -> dropped)
    return F.col("birthYear") >= F.lit(int(as_of_year) - C.MAX_AGE)


def not_round_trip_rule() -> Column:
    return F.col("startStationName") != F.col("endStationName")


def short_term_rule() -> Column:
    return (F.col("userType") != C.SUBSCRIBER) & F.col("duration").between(
        C.CUSTOMER_MIN_SECONDS, C.CUSTOMER_MAX_SECONDS
    )


def annual_rule() -> Column:
    return (F.col("userType") == C.SUBSCRIBER) & (F.col("duration") <= C.SUBSCRIBER_MAX_SECONDS)


def represented_rule(as_of_year: int = C.DEFAULT_AS_OF_YEAR) -> Column:
    return known_gender_rule() & age_cap_rule(as_of_year) & not_round_trip_rule()


def cohort_rule(as_of_year: int = C.DEFAULT_AS_OF_YEAR) -> Column:
    return represented_rule(as_of_year) & (short_term_rule() | annual_rule())


# --- operators -----------------------------------------------------------------


def filter_known_gender(trips: DataFrame) -> DataFrame:
    return trips.filter(known_gender_rule())


def filter_age_cap(trips: DataFrame, as_of_year: int = C.DEFAULT_AS_OF_YEAR) -> DataFrame:
    return trips.filter(age_cap_rule(as_of_year))


def filter_round_trips(trips: DataFrame) -> DataFrame:
    return trips.filter(not_round_trip_rule())


def short_term_cohort(trips: DataFrame, as_of_year: int = C.DEFAULT_AS_OF_YEAR) -> DataFrame:
    """Customer trips of the cohort (derived columns)."""
    return derive(trips.filter(represented_rule(as_of_year) & short_term_rule()), as_of_year)


def annual_cohort(trips: DataFrame, as_of_year: int = C.DEFAULT_AS_OF_YEAR) -> DataFrame:
    """Subscriber trips of the cohort (derived columns)."""
    return derive(trips.filter(represented_rule(as_of_year) & annual_rule()), as_of_year)


def clean_cohort(trips: DataFrame, as_of_year: int = C.DEFAULT_AS_OF_YEAR) -> DataFrame:
    """The cleaned cohort: one scan, one filter, 13 columns."""
    return derive(trips.filter(cohort_rule(as_of_year)), as_of_year).select(*COHORT_COLUMNS)


def clean_cohort_union(trips: DataFrame, as_of_year: int = C.DEFAULT_AS_OF_YEAR) -> DataFrame:
    """Same rows as ``clean_cohort`` written as the union of the two disjoint cohorts."""
    return short_term_cohort(trips, as_of_year).unionByName(annual_cohort(trips, as_of_year))


def cleaning_funnel(trips: DataFrame, as_of_year: int = C.DEFAULT_AS_OF_YEAR) -> DataFrame:
    """Rows surviving each rule, cumulatively, in one aggregate pass (one row)."""
    g = known_gender_rule()
    ga = g & age_cap_rule(as_of_year)
    gar = ga & not_round_trip_rule()
    short = gar & short_term_rule()
    annual = gar & annual_rule()
    n_raw = F.count(F.lit(1))
    n_cohort = F.count_if(short) + F.count_if(annual)
    return trips.agg(
        n_raw.alias("rows_in"),
        F.count_if(g).alias("after_gender"),
        F.count_if(ga).alias("after_age"),
        F.count_if(gar).alias("after_round_trip"),
        F.count_if(short).alias("short_term"),
        F.count_if(annual).alias("annual"),
        n_cohort.alias("rows_out"),
        F.round(F.lit(100) * F.try_divide(n_raw - n_cohort, n_raw), 6).alias("pct_removed"),
    )
