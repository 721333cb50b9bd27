"""Independent SQL (DuckDB dialect) for every checkable query in the catalogue.

The oracle is written from the original analysis' semantics, not from our Spark
plans: the cohort is filtered on the *decoded* columns (``gender <> 'Unknown'``,
``age <= 65``), the user-type split is the original union of two filters, the
top-k is a plain window, the hourly usage is a UNION ALL of two aggregates, and
so on.  Outputs follow the same normalisation as ``catalog.stable``: doubles
rounded to 6 places, timestamps as ``YYYY-MM-DD HH:MM:SS`` text, and integer
widths matching Spark's (``INTEGER`` for int, ``BIGINT`` for counts/sums).

Fixed values (band labels, age limits, day names, radii, seeds and shares) are written out here
once more; only the mapping of the test tables to trips is shared with the engine.
"""

from __future__ import annotations

from ..sources.tables import TRIPS_SQL

AS_OF_YEAR = 2018


def _ts(x: str) -> str:
    return f"strftime({x}, '%Y-%m-%d %H:%M:%S')"


def _r(x: str) -> str:
    return f"round(CAST({x} AS DOUBLE), 6)"


def _hour(x: str) -> str:
    return f"CAST(hour({x}) AS INTEGER)"


def _band(h: str) -> str:
    return (
        f"CASE WHEN {h} IS NULL THEN NULL WHEN {h} >= 22 OR {h} < 5 THEN 'Late Night' "
        f"WHEN {h} >= 5 AND {h} < 12 THEN 'Morning' "
        f"WHEN {h} >= 12 AND {h} < 18 THEN 'Afternoon' ELSE 'Evening' END"
    )


def _dayname(ts: str) -> str:
    d = f"(dayofweek({ts}) + 1)"
    names = ["Sunday", "Monday", "Tuesday", "Wednesday", "Thursday", "Friday"]
    whens = " ".join(f"WHEN {d} = {i} THEN '{n}'" for i, n in enumerate(names, start=1))
    return f"CASE {whens} ELSE 'Saturday' END"


def _daytype(ts: str) -> str:
    return f"CASE WHEN {_dayname(ts)} IN ('Saturday', 'Sunday') THEN 'Weekend' ELSE 'Weekday' END"


def _ageband(a: str) -> str:
    return (
        f"CASE WHEN {a} IS NULL THEN NULL WHEN {a} <= 24 THEN '16 to 24' WHEN {a} <= 32 THEN '25 to 32' "
        f"WHEN {a} <= 40 THEN '33 to 40' WHEN {a} <= 48 THEN '41 to 48' "
        f"WHEN {a} <= 56 THEN '49 to 56' WHEN {a} <= 64 THEN '57 to 64' "
        f"WHEN {a} <= 72 THEN '65 to 72' ELSE '73 to 80' END"
    )


def _gender(code: str) -> str:
    return f"CASE WHEN {code} = 1 THEN 'Male' WHEN {code} = 2 THEN 'Female' ELSE 'Unknown' END"


def _dist(legacy: bool = False) -> str:
    lat1, lon1, lat2, lon2 = "startStationLat", "startStationLong", "endStationLat", "endStationLong"
    if legacy:
        cos_part = f"cos(CAST({lat1} AS DOUBLE)) * cos(CAST({lat2} AS DOUBLE))"
    else:
        cos_part = f"cos(radians({lat1})) * cos(radians({lat2}))"
    return (
        f"(2 * 6371 * asin(sqrt(pow(sin(radians({lat2} - {lat1}) / 2), 2) + "
        f"{cos_part} * pow(sin(radians({lon2} - {lon1}) / 2), 2))))"
    )


# Ridge fit with one feature and standardisation: w = cov/var(x) / (1 + lambda/sd(y)),
# population moments (closed form of Spark's normal-equation solver).
_RIDGE = """
xy AS (SELECT bikeID, startTime, DistanceKM AS x, TimeHR AS y FROM dist),
ridge AS (
  SELECT covar_pop(x, y) / var_pop(x) / (1 + 0.3 / stddev_pop(y)) AS w,
         avg(y) - covar_pop(x, y) / var_pop(x) / (1 + 0.3 / stddev_pop(y)) * avg(x) AS b,
         avg(y) AS my
  FROM xy
)"""

_RIDGE_LEGACY = _RIDGE.replace("FROM dist)", "FROM dist_legacy)")

def _epoch(ts: str) -> str:
    return (
        f"(date_diff('day', DATE '1970-01-01', CAST({ts} AS DATE)) * 86400"
        f" + hour({ts}) * 3600 + minute({ts}) * 60 + second({ts}))"
    )


def _unit_hash(seed: int) -> str:
    """The first 32 bits of md5('seed|bike|start|end'), null fields as '-', scaled to [0, 1)."""
    fields = ["CAST(bikeID AS BIGINT)", _epoch("startTime"), _epoch("endTime")]
    text = f"'{seed}'" + "".join(f" || '|' || coalesce(CAST({x} AS VARCHAR), '-')" for x in fields)
    return f"(CAST('0x' || substr(md5({text}), 1, 8) AS BIGINT) / 4294967296.0)"


_SPEED = "CASE WHEN TimeHR = 0 THEN NULL ELSE DistanceKM / TimeHR END"

_PREFIX = f"""
WITH trips AS ({TRIPS_SQL}),
derived AS (
  SELECT duration, startTime, endTime, startStationName, startStationLat, startStationLong,
         endStationName, endStationLat, endStationLong, bikeID, userType,
         CAST({AS_OF_YEAR} - birthYear AS INTEGER) AS age, {_gender('gender')} AS gender
  FROM trips
),
represented AS (
  SELECT * FROM derived
  WHERE gender <> 'Unknown' AND age <= 65 AND startStationName <> endStationName
),
short_term AS (
  SELECT * FROM represented
  WHERE duration <= 60 * 30 AND duration >= 120 AND userType <> 'Subscriber'
),
annual AS (
  SELECT * FROM represented WHERE duration <= 60 * 45 AND userType = 'Subscriber'
),
cohort AS (SELECT * FROM short_term UNION ALL SELECT * FROM annual),
dist AS (
  SELECT *, duration / 3600 AS TimeHR, {_dist()} AS DistanceKM FROM cohort
),
dist_legacy AS (
  SELECT *, duration / 3600 AS TimeHR, {_dist(True)} AS DistanceKM FROM cohort
),
bikes AS (
  SELECT bikeID, count(bikeID) AS Num, CAST(sum(duration) AS BIGINT) / 3600 AS HoursUsed
  FROM cohort GROUP BY bikeID
)
"""

_COHORT_COLS = f"""duration, {_ts('startTime')} AS startTime, {_ts('endTime')} AS endTime,
  startStationName, {_r('startStationLat')} AS startStationLat,
  {_r('startStationLong')} AS startStationLong, endStationName,
  {_r('endStationLat')} AS endStationLat, {_r('endStationLong')} AS endStationLong,
  bikeID, userType, age, gender"""

_RAW_COLS = f"""duration, {_ts('startTime')} AS startTime, {_ts('endTime')} AS endTime,
  startStationID, startStationName, {_r('startStationLat')} AS startStationLat,
  {_r('startStationLong')} AS startStationLong, endStationID, endStationName,
  {_r('endStationLat')} AS endStationLat, {_r('endStationLong')} AS endStationLong,
  bikeID, userType, birthYear, gender"""


def _band_top(band: str) -> str:
    return f"""
SELECT endStationName, count(endStationName) AS "Number"
FROM cohort WHERE {_band(_hour('endTime'))} = '{band}'
GROUP BY endStationName ORDER BY "Number" DESC, endStationName LIMIT 10"""


def _hourly() -> str:
    return f"""
hourly AS (
  SELECT gender, DayType, "Hour", "Type", count("Hour") AS Num FROM (
    SELECT gender, {_daytype('startTime')} AS DayType, {_hour('startTime')} AS "Hour",
           'Leaving' AS "Type" FROM cohort
    UNION ALL
    SELECT gender, {_daytype('endTime')} AS DayType, {_hour('endTime')} AS "Hour",
           'Arriving' AS "Type" FROM cohort
  ) GROUP BY ALL
)"""


BODIES: dict[str, str] = {
    "top_destinations_by_band": f"""
SELECT "Time", CAST("rank" AS INTEGER) AS "rank", endStationName, "Number" FROM (
  SELECT "Time", endStationName, "Number",
         row_number() OVER (PARTITION BY "Time" ORDER BY "Number" DESC, endStationName) AS "rank"
  FROM (
    SELECT {_band(_hour('endTime'))} AS "Time", endStationName, count(endStationName) AS "Number"
    FROM cohort GROUP BY ALL
  ) WHERE "Time" IS NOT NULL
) WHERE "rank" <= 10""",
    "top_destinations_morning": _band_top("Morning"),
    "top_destinations_afternoon": _band_top("Afternoon"),
    "top_destinations_evening": _band_top("Evening"),
    "top_destinations_late_night": _band_top("Late Night"),
    "time_band_counts": f"""
SELECT {_band(_hour('endTime'))} AS "Time", count(*) AS Num FROM cohort GROUP BY ALL""",
    "day_type_counts": f"""
SELECT {_dayname('startTime')} AS "Day", {_daytype('startTime')} AS DayType, count(*) AS Num
FROM cohort GROUP BY ALL""",
    "hourly_usage": f", {_hourly()} SELECT * FROM hourly",
    "hourly_slice": f""", {_hourly()}
SELECT "Hour", Num, "Type" FROM hourly WHERE gender = 'Male' AND DayType = 'Weekday'""",
    "hourly_usage_union": f"""
SELECT gender, {_hour('startTime')} AS startHour, {_daytype('startTime')} AS startDay,
       count(*) AS Num, 'Leaving' AS "Leaving" FROM cohort GROUP BY ALL
UNION ALL
SELECT gender, {_hour('endTime')}, {_daytype('endTime')}, count(*), 'Arriving'
FROM cohort GROUP BY ALL""",
    "peak_hours": f""", {_hourly()}
SELECT gender, DayType, "Type",
       arg_max("Hour", Num * 100 - "Hour") AS peakHour, max(Num) AS peakNum,
       arg_min("Hour", Num * 100 + "Hour") AS lowHour, min(Num) AS lowNum,
       {_r('min(Num) / max(Num)')} AS lowHighRatio
FROM hourly GROUP BY ALL""",
    "subs_by_age": """
SELECT age AS ageS, count(userType) AS NumSubs FROM cohort WHERE userType = 'Subscriber'
GROUP BY age""",
    "custs_by_age": """
SELECT age AS ageC, count(userType) AS NumCusts FROM cohort WHERE userType <> 'Subscriber'
GROUP BY age""",
    "usertype_by_age_join": """
SELECT s.ageS, s.NumSubs, c.ageC, c.NumCusts FROM
  (SELECT age AS ageS, count(userType) AS NumSubs FROM cohort WHERE userType = 'Subscriber' GROUP BY age) s
JOIN
  (SELECT age AS ageC, count(userType) AS NumCusts FROM cohort WHERE userType <> 'Subscriber' GROUP BY age) c
ON s.ageS = c.ageC""",
    "usertype_share_by_age": f"""
SELECT s.ageS, s.NumSubs, c.NumCusts, s.NumSubs + c.NumCusts AS Total,
       {_r('100 * (s.NumSubs / (s.NumSubs + c.NumCusts))')} AS PercSubs,
       {_r('100 * (c.NumCusts / (s.NumSubs + c.NumCusts))')} AS PercCusts
FROM
  (SELECT age AS ageS, count(userType) AS NumSubs FROM cohort WHERE userType = 'Subscriber' GROUP BY age) s
JOIN
  (SELECT age AS ageC, count(userType) AS NumCusts FROM cohort WHERE userType <> 'Subscriber' GROUP BY age) c
ON s.ageS = c.ageC""",
    "usertype_share_by_age_all": f"""
SELECT ageS, NumSubs, NumCusts, NumSubs + NumCusts AS Total,
       {_r('100 * (NumSubs / (NumSubs + NumCusts))')} AS PercSubs,
       {_r('100 * (NumCusts / (NumSubs + NumCusts))')} AS PercCusts
FROM (
  SELECT age AS ageS,
         CAST(sum(CASE WHEN userType = 'Subscriber' THEN 1 ELSE 0 END) AS BIGINT) AS NumSubs,
         CAST(sum(CASE WHEN userType <> 'Subscriber' THEN 1 ELSE 0 END) AS BIGINT) AS NumCusts
  FROM cohort GROUP BY age
)""",
    "age_band_counts": f"""
SELECT {_ageband('age')} AS ageGroup, count(*) AS Num FROM cohort GROUP BY ALL""",
    "age_band_share": f"""
SELECT userType, ageGroup, Num, {_r('Num / sum(Num) OVER (PARTITION BY userType)')} AS "Percent"
FROM (
  SELECT CASE WHEN userType = 'Subscriber' THEN 'Subscriber' ELSE 'Customer' END AS userType,
         {_ageband('age')} AS ageGroup, count(*) AS Num
  FROM cohort GROUP BY ALL
)""",
    "age_band_totals": f"""
SELECT ageGroup, NumSubs, NumCusts, NumSubs + NumCusts AS Total FROM (
  SELECT {_ageband('age')} AS ageGroup,
         CAST(sum(CASE WHEN userType = 'Subscriber' THEN 1 ELSE 0 END) AS BIGINT) AS NumSubs,
         CAST(sum(CASE WHEN userType <> 'Subscriber' THEN 1 ELSE 0 END) AS BIGINT) AS NumCusts
  FROM cohort GROUP BY ALL
)""",
    "gender_share": f"""
SELECT gender, Num, {_r('Num / sum(Num) OVER ()')} AS Share FROM (
  SELECT {_gender('gender')} AS gender, count(*) AS Num FROM trips GROUP BY ALL
)""",
    "gender_decode": f"""
SELECT gender AS genderCode, {_gender('gender')} AS gender, count(*) AS Num
FROM trips GROUP BY ALL""",
    "rider_age": f"""
SELECT birthYear, CAST({AS_OF_YEAR} - birthYear AS INTEGER) AS age, count(*) AS Num
FROM trips GROUP BY ALL""",
    "age_profile": f"""
SELECT age, Num, age = max(age) OVER () AS isMaxAge FROM (
  SELECT CAST({AS_OF_YEAR} - birthYear AS INTEGER) AS age, count(*) AS Num FROM trips GROUP BY ALL
)""",
    "most_used_bikes": """
SELECT bikeID, Num FROM bikes ORDER BY Num DESC, bikeID LIMIT 10""",
    "most_hours_bikes": f"""
SELECT bikeID, Num, {_r('HoursUsed')} AS HoursUsed FROM bikes
ORDER BY HoursUsed DESC, bikeID LIMIT 10""",
    "rarely_used_bikes": """
SELECT bikeID, Num FROM bikes WHERE Num < 5""",
    "rarely_used_bike_count": """
SELECT count(*) AS NumBikes FROM bikes WHERE Num < 5""",
    "heavily_used_bike_count": """
SELECT count(*) AS NumBikes FROM bikes WHERE Num > 15""",
    "distinct_bikes": """
SELECT count(DISTINCT bikeID) AS NumBikes FROM cohort""",
    "bikes_in_both_top10": """
SELECT bikeID, Num FROM (SELECT bikeID, Num FROM bikes ORDER BY Num DESC, bikeID LIMIT 10)
WHERE bikeID IN (SELECT bikeID FROM bikes ORDER BY HoursUsed DESC, bikeID LIMIT 10)""",
    "bike_daily_rate": f"""
SELECT bikeID, Num, {_r('HoursUsed')} AS HoursUsed, Days,
       {_r('Num / Days')} AS TripsPerDay, {_r('HoursUsed / Days')} AS HoursPerDay
FROM (SELECT * FROM bikes ORDER BY Num DESC, bikeID LIMIT 10),
     (SELECT count(DISTINCT CAST(startTime AS DATE)) AS Days FROM cohort)""",
    "trip_distance": f"""
SELECT bikeID, {_ts('startTime')} AS startTime, startStationName, endStationName,
       {_r(_dist())} AS DistanceKM, {_r(_dist(True))} AS DistanceKMLegacy
FROM cohort""",
    "trip_speed": f"""
SELECT bikeID, {_ts('startTime')} AS startTime, {_r('TimeHR')} AS TimeHR,
       {_r('DistanceKM')} AS DistanceKM, {_r(_SPEED)} AS Speed
FROM dist""",
    "distance_stats": f"""
SELECT age AS Age, {_r('avg(DistanceKM)')} AS avgDist, {_r('max(DistanceKM)')} AS maxDist,
       {_r('min(DistanceKM)')} AS minDist, gender
FROM dist GROUP BY age, gender""",
    "distance_stats_legacy": f"""
SELECT age AS Age, {_r('avg(DistanceKM)')} AS avgDist, {_r('max(DistanceKM)')} AS maxDist,
       {_r('min(DistanceKM)')} AS minDist, gender
FROM dist_legacy GROUP BY age, gender""",
    "avg_speed": f"""
SELECT age AS Age, {_r('avg(' + _SPEED + ')')} AS avgSpeed, gender
FROM dist WHERE startStationName <> endStationName GROUP BY age, gender""",
    "avg_speed_legacy": f"""
SELECT age AS Age, {_r('avg(' + _SPEED + ')')} AS avgSpeed, gender
FROM dist_legacy WHERE startStationName <> endStationName GROUP BY age, gender""",
    "speed_gender_gap": f"""
SELECT Age, {_r('m')} AS MaleSpeed, {_r('f')} AS FemaleSpeed, {_r('m - f')} AS Gap FROM (
  SELECT age AS Age,
         avg(CASE WHEN gender = 'Male' THEN {_SPEED} END) AS m,
         avg(CASE WHEN gender = 'Female' THEN {_SPEED} END) AS f
  FROM dist GROUP BY age
)""",
    "duration_ridge": f""", {_RIDGE}
SELECT {_r('b')} AS intercept, {_r('w')} AS coefficient, {_r('0.3')} AS regParam FROM ridge""",
    "duration_ridge_onepass": f""", {_RIDGE}
SELECT {_r('b')} AS intercept, {_r('w')} AS coefficient, {_r('0.3')} AS regParam,
       {_r('(SELECT 1 - sum(pow(y - (b + w * x), 2)) / sum(pow(y - my, 2)) FROM xy)')} AS r2,
       {_r('(SELECT sqrt(avg(pow(y - (b + w * x), 2))) FROM xy)')} AS rmse,
       (SELECT count(*) FROM xy) AS numInstances, CAST(0 AS BIGINT) AS droppedRows
FROM ridge""",
    "duration_ridge_legacy": f""", {_RIDGE_LEGACY}
SELECT {_r('b')} AS intercept, {_r('w')} AS coefficient, {_r('0.3')} AS regParam,
       {_r('(SELECT 1 - sum(pow(y - (b + w * x), 2)) / sum(pow(y - my, 2)) FROM xy)')} AS r2,
       {_r('(SELECT sqrt(avg(pow(y - (b + w * x), 2))) FROM xy)')} AS rmse
FROM ridge""",
    "duration_ridge_metrics": f""", {_RIDGE}
SELECT {_r('1 - sum(pow(y - (b + w * x), 2)) / sum(pow(y - my, 2))')} AS r2,
       {_r('sqrt(avg(pow(y - (b + w * x), 2)))')} AS rmse, count(*) AS numInstances, CAST(0 AS BIGINT) AS droppedRows
FROM xy, ridge""",
    "duration_predictions": f""", {_RIDGE}
SELECT bikeID, {_ts('startTime')} AS startTime, round(x, 5) AS DistanceKM, round(y, 5) AS label,
       round(b + w * x, 5) AS prediction
FROM xy, ridge""",
    "station_index": """
SELECT role, station, CAST(row_number() OVER (PARTITION BY role ORDER BY n DESC, station) - 1 AS DOUBLE) AS idx
FROM (
  SELECT 'start' AS role, startStationName AS station, count(*) AS n FROM cohort GROUP BY ALL
  UNION ALL
  SELECT 'end', endStationName, count(*) FROM cohort GROUP BY ALL
)""",
    "scan_trips": f"SELECT {_RAW_COLS} FROM trips",
    "scan_rejects": """
SELECT count(*) FILTER (d = 0 OR d > 5) AS parsedRows, count(*) FILTER (d BETWEEN 1 AND 5) AS rejectedRows,
       count(*) FILTER (d = 1) AS null_duration, count(*) FILTER (d = 4) AS "null_startTime",
       CAST(0 AS BIGINT) AS "null_endTime", CAST(0 AS BIGINT) AS "null_startStationID",
       CAST(0 AS BIGINT) AS "null_startStationName", CAST(0 AS BIGINT) AS "null_startStationLat",
       CAST(0 AS BIGINT) AS "null_startStationLong", CAST(0 AS BIGINT) AS "null_endStationID",
       CAST(0 AS BIGINT) AS "null_endStationName", CAST(0 AS BIGINT) AS "null_endStationLat",
       CAST(0 AS BIGINT) AS "null_endStationLong",
       count(*) FILTER (d = 5) AS "null_bikeID", count(*) FILTER (d = 5) AS "null_userType",
       count(*) FILTER (d IN (3, 5)) AS "null_birthYear", count(*) FILTER (d IN (2, 5)) AS null_gender
FROM (SELECT bikeID % 97 AS d FROM trips)""",
    "extract_types": """
SELECT * FROM (VALUES (0, 'bikeID', 'int'), (1, 'Num', 'int'), (2, 'HoursUsed', 'double')) t(position, "column", "type")""",
    "union_months": "SELECT strftime(startTime, '%Y%m') AS month, count(*) AS Num FROM trips GROUP BY ALL",
    "trips_one_month": f"""
SELECT "Time", CAST("rank" AS INTEGER) AS "rank", endStationName, "Number" FROM (
  SELECT "Time", endStationName, "Number",
         row_number() OVER (PARTITION BY "Time" ORDER BY "Number" DESC, endStationName) AS "rank"
  FROM (
    SELECT {_band(_hour('endTime'))} AS "Time", endStationName, count(endStationName) AS "Number"
    FROM cohort WHERE strftime(startTime, '%Y%m') = '199710' GROUP BY ALL
  ) WHERE "Time" IS NOT NULL
) WHERE "rank" <= 10""",
    "parse_timestamps": f"""
SELECT strftime(startTime, '%Y-%m-%d %H:%M:%S') || '.0000' AS startTimeText, {_ts('startTime')} AS startTime,
       strftime(endTime, '%Y-%m-%d %H:%M:%S') || '.0000' AS endTimeText, {_ts('endTime')} AS endTime
FROM trips""",
    "export_csv": "SELECT bikeID, Num FROM bikes ORDER BY Num DESC, bikeID LIMIT 10",
    "extract_roundtrip": f"""
SELECT CAST(bikeID AS VARCHAR) AS bikeID, CAST(Num AS INTEGER) AS Num, {_r('HoursUsed')} AS HoursUsed
FROM bikes ORDER BY HoursUsed DESC, bikeID LIMIT 10""",
    "sql_functions": f"""
SELECT {_gender('gender')} AS gender, {_band(_hour('endTime'))} AS "Time",
       {_ageband(f'CAST({AS_OF_YEAR} - birthYear AS INTEGER)')} AS ageGroup,
       {_daytype('startTime')} AS DayType, count(*) AS Num,
       {_r('avg(' + _dist() + ')')} AS avgDist, {_r('avg(' + _dist(True) + ')')} AS avgDistLegacy
FROM trips GROUP BY ALL""",
    "stream_ingest": "SELECT strftime(startTime, '%Y%m') AS month, count(*) AS Num FROM cohort GROUP BY ALL",
    "sample_trips": f"SELECT {_COHORT_COLS} FROM cohort WHERE {_unit_hash(42)} < 0.1",
    "train_test_split": f"""
SELECT CASE WHEN {_unit_hash(7)} < 0.7 THEN 'train' ELSE 'test' END AS split, count(*) AS Num
FROM cohort GROUP BY ALL""",
    "clean_cohort": f"SELECT {_COHORT_COLS} FROM cohort",
    "clean_cohort_union": f"SELECT {_COHORT_COLS} FROM cohort",
    "clean_projection": f"SELECT {_COHORT_COLS} FROM derived",
    "filter_known_gender": f"SELECT {_RAW_COLS} FROM trips WHERE {_gender('gender')} <> 'Unknown'",
    "filter_age_cap": f"SELECT {_RAW_COLS} FROM trips WHERE {AS_OF_YEAR} - birthYear <= 65",
    "filter_round_trips": f"SELECT {_RAW_COLS} FROM trips WHERE startStationName <> endStationName",
    "short_term_cohort": f"SELECT {_COHORT_COLS} FROM short_term",
    "annual_cohort": f"SELECT {_COHORT_COLS} FROM annual",
    "cleaning_funnel": f"""
SELECT rows_in, after_gender, after_age, after_round_trip, short_term, annual, rows_out,
       {_r('100 * ((rows_in - rows_out) / rows_in)')} AS pct_removed
FROM (
  SELECT (SELECT count(*) FROM trips) AS rows_in,
         (SELECT count(*) FROM derived WHERE gender <> 'Unknown') AS after_gender,
         (SELECT count(*) FROM derived WHERE gender <> 'Unknown' AND age <= 65) AS after_age,
         (SELECT count(*) FROM represented) AS after_round_trip,
         (SELECT count(*) FROM short_term) AS short_term,
         (SELECT count(*) FROM annual) AS annual,
         (SELECT count(*) FROM cohort) AS rows_out
)""",
    "row_counts": """
SELECT (SELECT count(*) FROM trips) AS rawRows, (SELECT count(*) FROM cohort) AS cohortRows""",
}


BODIES["scan_by_header"] = f"SELECT {_RAW_COLS} FROM trips WHERE bikeID % 3 <> 2"
BODIES["file_ledger"] = """
SELECT CASE bikeID % 3 WHEN 0 THEN 'standard' WHEN 1 THEN 'by name' ELSE 'unknown header' END AS status,
       CASE bikeID % 3
         WHEN 0 THEN '"duration","startTime","endTime","startStationID","startStationName","startStationLat","startStationLong","endStationID","endStationName","endStationLat","endStationLong","bikeID","userType","birthYear","gender"'
         WHEN 1 THEN '"gender","birthYear","userType","bikeID","endstationlongitude","endstationlatitude","endStationName","endStationID","startstationlongitude","startstationlatitude","startStationName","startStationID","stoptime","startTime","tripduration","colour"'
         ELSE '"duration","startTime","endTime","startStationID","startStationName","startStationLat","startStationLong","endStationID","endStationName","endStationLat","endStationLong","bikeID","userType","birthYear","colour"'
       END AS header,
       count(*) AS Num
FROM trips GROUP BY ALL"""
BODIES["distinct_bikes_sketch"] = "SELECT count(DISTINCT bikeID) AS NumBikes, true AS withinError FROM cohort"
BODIES["incremental_cohort"] = """
SELECT month, CAST(n * CASE WHEN month = '199710' THEN 2 ELSE 1 END AS BIGINT) AS Num, month = '199710' AS refreshed
FROM (SELECT strftime(startTime, '%Y%m') AS month, count(*) AS n FROM cohort GROUP BY ALL)"""


# --- trees ---------------------------------------------------------------------------
# Grown level by level by recursion.  A node's categories are ordered by their mean label in it (ties: the more
# frequent on the training side, then the name), ages by number; a cut lies between neighbours and, for
# ages, half way to the next age of the whole training side.  The best cut has the largest drop in variance
# (ties: the first feature, the first cut).  Values that a node has not seen go right.
_FEATURE = ["start", "end", "age", "gender", "userType"]
_INDEX = ["startIndex", "endIndex", "age", "genderIndex", "userTypeIndex"]


def _named(names: list[str], f: str) -> str:
    return f"list_extract([{', '.join(repr(n) for n in names)}], {f} + 1)"


def _grown(depth: int, rest: bool = False) -> str:
    """``t``: every sampled trip (with ``rest``, every trip) in each node on its way, down to ``depth``."""
    return f"""
, s AS MATERIALIZED (
  SELECT row_number() OVER () AS id, startTime, startStationName AS "start", endStationName AS "end", CAST(age AS DOUBLE) AS age,
         gender, userType, CAST(duration AS DOUBLE) AS y,
         CASE WHEN {_unit_hash(42)} >= 0.1 THEN 'rest' WHEN {_unit_hash(7)} < 0.7 THEN 'train' ELSE 'test' END AS side
  FROM cohort {'' if rest else f'WHERE {_unit_hash(42)} < 0.1'}
),
vals AS MATERIALIZED (
  SELECT id, side, y, unnest([0, 1, 3, 4]) AS f, unnest(["start", "end", gender, userType]) AS v, CAST(NULL AS DOUBLE) AS x FROM s
  UNION ALL SELECT id, side, y, 2, NULL, age FROM s
),
category AS MATERIALIZED (
  SELECT f, v, row_number() OVER (PARTITION BY f ORDER BY count(*) DESC, v) AS c FROM vals WHERE side = 'train' AND f <> 2 GROUP BY f, v
),
ages AS MATERIALIZED (
  SELECT x, (x + lead(x) OVER (ORDER BY x)) / 2 AS cut FROM (SELECT DISTINCT x FROM vals WHERE side = 'train' AND f = 2)
),
known AS MATERIALIZED (
  SELECT vals.id, vals.side, vals.y, vals.f, vals.v, vals.x, c, cut
  FROM vals LEFT JOIN category USING (f, v) LEFT JOIN ages ON vals.f = 2 AND ages.x = vals.x
),
t AS (
  SELECT id, side, y, 0 AS depth, CAST(1 AS BIGINT) AS node, -1 AS "by", '' AS rule FROM s
  UNION ALL
  SELECT * FROM (
    WITH per AS (
      SELECT t.node, f, v, c, cut, count(*) AS n, sum(k.y) AS sy, sum(k.y * k.y) AS syy
      FROM t JOIN known k ON k.id = t.id WHERE k.side = 'train' GROUP BY ALL
    ),
    ordered AS (
      SELECT *, row_number() OVER (PARTITION BY node, f ORDER BY CASE WHEN f = 2 THEN cut ELSE sy / n END NULLS LAST, c) AS k FROM per
    ),
    sums AS (
      SELECT node, f, k, cut, sum(n) OVER w AS nl, sum(sy) OVER w AS sl, sum(syy) OVER w AS ql, list(v) OVER w AS vs,
             sum(n) OVER a AS n, sum(sy) OVER a AS s, sum(syy) OVER a AS q
      FROM ordered WINDOW w AS (PARTITION BY node, f ORDER BY k), a AS (PARTITION BY node, f)
    ),
    gains AS (
      SELECT *, (q - s * s / n) / n - nl / n * ((ql - sl * sl / nl) / nl)
                - (n - nl) / n * ((q - ql - (s - sl) * (s - sl) / (n - nl)) / (n - nl)) AS gain
      FROM sums WHERE nl < n
    ),
    best AS (SELECT node, f, cut, vs FROM gains WHERE gain > 0 QUALIFY row_number() OVER (PARTITION BY node ORDER BY gain DESC, f, k) = 1),
    sent AS (
      SELECT t.*, best.f, best.cut, best.vs,
             CASE WHEN best.f = 2 THEN k.x <= best.cut ELSE coalesce(list_contains(best.vs, k.v), false) END AS l
      FROM t JOIN best USING (node) JOIN known k ON k.id = t.id AND k.f = best.f WHERE depth < {depth}
    )
    SELECT id, side, y, depth + 1, node * 2 + CASE WHEN l THEN 0 ELSE 1 END, f,
           rule || CASE WHEN rule = '' THEN '' ELSE ' and ' END || {_named(_FEATURE, 'f')} ||
           CASE WHEN f = 2 THEN CASE WHEN l THEN ' <= ' ELSE ' > ' END || CAST(cut AS VARCHAR)
                ELSE CASE WHEN l THEN ' in {{' ELSE ' not in {{' END || array_to_string(list_sort(vs), '|') || '}}' END
    FROM sent
  )
),
stats AS MATERIALIZED (
  SELECT depth, node, any_value("by") AS "by", any_value(rule) AS rule, avg(y) AS p, count(*) AS n, count(*) * var_pop(y) AS loss
  FROM t WHERE side = 'train' GROUP BY depth, node
),
leaf AS MATERIALIZED (SELECT id, side, y, depth, node FROM t QUALIFY row_number() OVER (PARTITION BY id ORDER BY depth DESC) = 1)"""


def _errors(depths: str) -> str:
    return f"""
, wide AS (SELECT unnest({depths}) AS m),
tests AS (
  SELECT m AS maxDepth, sqrt(avg(pow(t.y - p, 2))) AS rmse
  FROM leaf JOIN wide ON leaf.side = 'test' JOIN t ON t.id = leaf.id AND t.depth = least(leaf.depth, m) JOIN stats ON stats.node = t.node
  GROUP BY m
)
SELECT CAST(maxDepth AS INTEGER) AS maxDepth, {_r('rmse')} AS rmse,
       (SELECT CAST(count(*) AS INTEGER) FROM stats WHERE depth <= maxDepth) AS numNodes
FROM tests"""


TREE_BODIES = {
    "duration_tree_depth0": _grown(0) + _errors("[0]"),
    "duration_tree_depth1": _grown(1) + _errors("[1]"),
    "duration_tree": _grown(5) + _errors("[5]"),
    "tree_depth_sweep": _grown(30) + _errors("range(0, 31)"),
    "duration_tree_rmse": f"""{_grown(5)}
SELECT {_r('sqrt(avg(pow(y - p, 2)))')} AS rmseEvaluator, {_r('sqrt(avg(pow(y - p, 2)))')} AS rmseSql
FROM leaf JOIN stats USING (node) WHERE side = 'test'""",
    "tree_feature_importances": f"""{_grown(5)}
, won AS (
  SELECT c."by" AS f, any_value(p.loss) - sum(c.loss) AS gain FROM stats c JOIN stats p ON p.node = c.node // 2 WHERE c.depth > 0 GROUP BY p.node, c."by"
)
SELECT {_named(_INDEX, 'f')} AS feature, {_r('coalesce(sum(gain) / (SELECT sum(gain) FROM won), 0)')} AS importance
FROM (SELECT unnest(range(5)) AS f) LEFT JOIN won USING (f) GROUP BY f""",
    "tree_rules": f"""{_grown(5)}
SELECT leaf.node AS leaf, CAST(any_value(stats.depth) AS INTEGER) AS depth, any_value(rule) AS rule, {_r('any_value(p)')} AS prediction,
       count(*) FILTER (side = 'train') AS trainRows, count(*) FILTER (side = 'test') AS testRows,
       {_r("sqrt(avg(pow(y - p, 2)) FILTER (side = 'test'))")} AS testRmse
FROM leaf JOIN stats USING (node) GROUP BY leaf.node""",
    "tree_feature_kinds": f"""{_grown(0)}
, many AS (
  SELECT f, CAST(CASE WHEN f = 2 THEN count(DISTINCT x) ELSE count(DISTINCT v) END AS INTEGER) AS n FROM vals WHERE side = 'train' GROUP BY f
),
number AS (
  SELECT f, c - 1 AS i, CAST(c - 1 AS DOUBLE) AS x FROM category
  UNION ALL SELECT 2, row_number() OVER (ORDER BY x <> 0, x) - 1, x FROM ages
)
SELECT {_named(_INDEX, 'f')} AS feature, CASE WHEN n <= 20 THEN 'categorical' ELSE 'continuous' END AS kind,
       CASE WHEN n <= 20 THEN n END AS categories,
       CASE WHEN n <= 20 THEN (SELECT string_agg(x || ':' || i, ',' ORDER BY i) FROM number WHERE number.f = many.f) END AS map
FROM many""",
    "stream_predictions": f"""{_grown(5, rest=True)}
SELECT strftime(startTime, '%Y%m') AS month, count(*) AS Num, {_r('avg(p)')} AS meanPrediction, {_r('sqrt(avg(pow(s.y - p, 2)))')} AS rmse
FROM s JOIN leaf USING (id) JOIN stats USING (node) GROUP BY ALL""",
}


def oracle_sql() -> dict[str, str]:
    recursive = _PREFIX.replace("WITH", "WITH RECURSIVE", 1)
    return {name: _PREFIX + body for name, body in BODIES.items()} | {name: recursive + body for name, body in TREE_BODIES.items()}
