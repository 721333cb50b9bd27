"""The scalar trip operators as SQL functions, plus the two SQL views.

They are SQL-bodied temporary functions (``CREATE TEMPORARY FUNCTION ... RETURN
expr``), which Catalyst inlines: a filter on ``to_gender(gender)`` folds into the
scan's filters and runs in generated code, unlike a Python UDF (a separate
``BatchEvalPython`` step above the scan).  Bodies match ``functions.columns``;
the tests check both forms agree row by row.

``day`` is a built-in Spark function and cannot be replaced, hence ``day_name``.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from . import columns as C

_AGE_CASES = " ".join(f"WHEN a <= {u} THEN '{label}'" for u, label in C.AGE_BANDS)
_DAY_CASES = " ".join(f"WHEN d = {i} THEN '{n}'" for i, n in enumerate(C.DAY_NAMES[:-1], start=1))


def _haversine_body(legacy: bool) -> str:
    if legacy:
        cos_part = "cos(CAST(lat1 AS DOUBLE)) * cos(CAST(lat2 AS DOUBLE))"
    else:
        cos_part = "cos(radians(lat1)) * cos(radians(lat2))"
    return (
        f"2 * {C.EARTH_RADIUS_KM} * asin(sqrt(pow(sin(radians(lat2 - lat1) / 2), 2) + "
        f"{cos_part} * pow(sin(radians(lon2 - lon1) / 2), 2)))"
    )


SQL_FUNCTIONS: dict[str, str] = {
    "to_gender": (
        "(g INT) RETURNS STRING RETURN "
        f"CASE WHEN g = 1 THEN '{C.GENDER_MALE}' WHEN g = 2 THEN '{C.GENDER_FEMALE}' "
        f"ELSE '{C.GENDER_UNKNOWN}' END"
    ),
    "time_band": (
        "(hr INT) RETURNS STRING RETURN "
        f"CASE WHEN hr IS NULL THEN NULL WHEN hr >= 22 OR hr < 5 THEN '{C.BAND_LATE_NIGHT}' "
        f"WHEN hr < 12 THEN '{C.BAND_MORNING}' WHEN hr < 18 THEN '{C.BAND_AFTERNOON}' "
        f"ELSE '{C.BAND_EVENING}' END"
    ),
    "age_band": (
        "(a INT) RETURNS STRING RETURN "
        f"CASE WHEN a IS NULL THEN NULL {_AGE_CASES} ELSE '{C.AGE_BAND_LAST}' END"
    ),
    "day_name": (
        "(d INT) RETURNS STRING RETURN "
        f"CASE WHEN d IS NULL THEN NULL {_DAY_CASES} ELSE '{C.DAY_NAMES[-1]}' END"
    ),
    "day_type": (
        "(name STRING) RETURNS STRING RETURN "
        f"CASE WHEN name IS NULL THEN NULL WHEN name IN ('{C.DAY_NAMES[0]}', '{C.DAY_NAMES[6]}') THEN '{C.WEEKEND}' "
        f"ELSE '{C.WEEKDAY}' END"
    ),
    "haversine_km": (
        "(lat1 FLOAT, lon1 FLOAT, lat2 FLOAT, lon2 FLOAT) RETURNS DOUBLE RETURN "
        + _haversine_body(False)
    ),
    "haversine_km_legacy": (
        "(lat1 FLOAT, lon1 FLOAT, lat2 FLOAT, lon2 FLOAT) RETURNS DOUBLE RETURN "
        + _haversine_body(True)
    ),
    "rider_age": "(birth_year INT, as_of_year INT) RETURNS INT RETURN as_of_year - birth_year",
}


def register_sql_functions(spark: SparkSession) -> list[str]:
    """Create (or replace) every trip function in the session; returns their names."""
    for name, body in SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}{body}")
    return list(SQL_FUNCTIONS)


def register_views(spark: SparkSession, trips, as_of_year: int = C.DEFAULT_AS_OF_YEAR) -> None:
    """``trips_raw`` (raw records) and ``trips`` (cleaned cohort) temp views."""
    from ..operators.cohort import clean_cohort

    trips.createOrReplaceTempView("trips_raw")
    clean_cohort(trips, as_of_year).createOrReplaceTempView("trips")
