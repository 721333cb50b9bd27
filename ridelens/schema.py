"""Declared schemas: the raw trip record and the cleaned cohort."""

from __future__ import annotations

from pyspark.sql import types as T

# Raw trip file, 15 positional fields.  Times are local wall clock -> TIMESTAMP_NTZ.
TRIP_SCHEMA = T.StructType(
    [
        T.StructField("duration", T.IntegerType()),
        T.StructField("startTime", T.TimestampNTZType()),
        T.StructField("endTime", T.TimestampNTZType()),
        T.StructField("startStationID", T.StringType()),
        T.StructField("startStationName", T.StringType()),
        T.StructField("startStationLat", T.FloatType()),
        T.StructField("startStationLong", T.FloatType()),
        T.StructField("endStationID", T.StringType()),
        T.StructField("endStationName", T.StringType()),
        T.StructField("endStationLat", T.FloatType()),
        T.StructField("endStationLong", T.FloatType()),
        T.StructField("bikeID", T.LongType()),
        T.StructField("userType", T.StringType()),
        T.StructField("birthYear", T.IntegerType()),
        T.StructField("gender", T.IntegerType()),
    ]
)

TRIP_COLUMNS = [f.name for f in TRIP_SCHEMA.fields]

# Cleaned cohort: station IDs dropped, birth year -> age, gender code -> label.
COHORT_COLUMNS = [
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
    "age",
    "gender",
]

CORRUPT_COLUMN = "_corrupt_record"

# Fixed text format of the raw files' time fields (four fractional digits).
RAW_TIME_FORMAT = "yyyy-MM-dd HH:mm:ss.SSSS"


def with_corrupt_column(schema: T.StructType = TRIP_SCHEMA) -> T.StructType:
    return T.StructType(list(schema.fields) + [T.StructField(CORRUPT_COLUMN, T.StringType())])
