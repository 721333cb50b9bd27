"""Trips derived from the star-schema test tables.

One ``lineitem`` row is one trip.  The mapping (see FIXTURES.md section 3) only
uses integer arithmetic on keys, so Spark and an independent SQL engine produce
bit-identical trips.

Plan shape, chosen for scale:

* every scan reads only the 3-5 columns it needs (parquet column pruning);
* rider attributes come from ``orders JOIN customer`` first (the two smaller
  tables), and the result is joined to ``lineitem`` on ``orderkey`` - so the
  largest table is exchanged at most once and never re-shuffled on ``custkey``;
* cohort filters written on the derived columns are pushed by Catalyst into the
  side that owns the inputs (gender -> customer scan, age -> orders scan, round
  trips -> lineitem scan), i.e. rows are dropped before any exchange;
* join strategy is Spark's: broadcast only below ``autoBroadcastJoinThreshold``
  (a size check on the pruned relation), sort-merge above it, with AQE splitting
  skewed keys (a customer owning a third of all orders) at run time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


# ---------------------------------------------------------------------------
# Fixed values of the table-to-trip mapping (FIXTURES.md section 3).
# ---------------------------------------------------------------------------
STATIONS = 50
SECONDS_PER_DAY = 86400
START_OFFSET_MULTIPLIERS = (7919, 3571)  # orderkey, linenumber
START_STATION_MULTIPLIERS = (31, 7)  # orderkey, linenumber
END_STATION_MULTIPLIERS = (17, 1)  # partkey, linenumber
GRID_STEP_DEG = 0.015625  # 1/64 degree, exact in float32
LAT_ORIGIN = 40.625
LONG_ORIGIN = -74.0
CUSTOMER_SEGMENT = "HOUSEHOLD"  # c_mktsegment that maps to user type 'Customer'
BIRTH_YEAR_BASE = 1925
BIRTH_YEAR_MULTIPLIER = 37
BIRTH_YEAR_SPAN = 78
GENDER_MODULUS = 3
# ---------------------------------------------------------------------------


# Declared read schemas (only the columns the mapping uses).  Declaring them skips
# footer-based schema inference at planning time and doubles as column pruning.
TABLE_SCHEMAS = {
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_linenumber int, l_quantity double, "
    "l_shipdate timestamp_ntz",
    "orders": "o_orderkey bigint, o_custkey bigint",
    "customer": "c_custkey bigint, c_nationkey int, c_mktsegment string",
}


def table_path(sf_dir: str, name: str) -> str:
    return f"{sf_dir.rstrip('/')}/{name}.parquet"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    schema = TABLE_SCHEMAS.get(name)
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.parquet(table_path(sf_dir, name))


# Station names by rule: "Station 00" ... "Station 49".
STATION_NAMES = [f"Station {i:02d}" for i in range(STATIONS)]


def _station_name(station_id):
    # Lookup in a constant array: no per-row string building, so the round-trip
    # predicate (name <> name) that Catalyst pushes into the lineitem scan is cheap.
    return F.element_at(F.array(*[F.lit(n) for n in STATION_NAMES]), (station_id + 1).cast("int"))


def _lat(station_id):
    return (F.lit(LAT_ORIGIN) + (station_id % 10) * F.lit(GRID_STEP_DEG)).cast("float")


def _long(station_id):
    return (F.lit(LONG_ORIGIN) + F.floor(station_id / 10) * F.lit(GRID_STEP_DEG)).cast("float")


def trips_from_tables(spark: SparkSession, sf_dir: str, by_month: bool = False) -> DataFrame:
    """Raw trips (the 15-field trip record) derived from lineitem/orders/customer.

    ``by_month`` brings the trips of a start month together (``rebalance``: hot months are split) before the columns
    are derived, so that the exchange carries nine narrow fields instead of the whole record.
    """
    lineitem = read_table(spark, sf_dir, "lineitem")
    orders = read_table(spark, sf_dir, "orders")
    customer = read_table(spark, sf_dir, "customer")

    # Rider attributes per order: userType and gender from the customer,
    # birth year from the customer key carried by the order.
    riders = orders.join(customer, orders.o_custkey == customer.c_custkey, "inner").select(
        "o_orderkey",
        F.when(F.col("c_mktsegment") == CUSTOMER_SEGMENT, F.lit("Customer"))
        .otherwise(F.lit("Subscriber"))
        .alias("userType"),
        (
            F.lit(BIRTH_YEAR_BASE)
            + (F.col("o_custkey") * BIRTH_YEAR_MULTIPLIER) % BIRTH_YEAR_SPAN
        )
        .cast("int")
        .alias("birthYear"),
        (F.col("c_nationkey") % GENDER_MODULUS).cast("int").alias("gender"),
    )

    ok, ln, pk = F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey")
    sid = (ok * START_STATION_MULTIPLIERS[0] + ln * START_STATION_MULTIPLIERS[1]) % STATIONS
    eid = (pk * END_STATION_MULTIPLIERS[0] + ln * END_STATION_MULTIPLIERS[1]) % STATIONS
    offset = (ok * START_OFFSET_MULTIPLIERS[0] + ln * START_OFFSET_MULTIPLIERS[1]) % SECONDS_PER_DAY
    duration = (F.col("l_quantity") * 60).cast("int")

    # The ship date and the integer offset travel through the join; both times are
    # derived after it (in the parallel post-join tasks), and the end time is one
    # addition from the ship date (identical to start + duration for wall-clock
    # NTZ values), which keeps a pushed "end time is not null" predicate cheap.
    legs = lineitem.select(
        "l_orderkey",
        duration.alias("duration"),
        "l_shipdate",
        offset.alias("offset"),
        sid.alias("sid"),
        eid.alias("eid"),
        pk.alias("bikeID"),
    )
    ship, off = F.col("l_shipdate"), F.col("offset")
    joined = legs.join(riders, legs.l_orderkey == riders.o_orderkey, "inner")
    if by_month:
        start = F.timestamp_add("SECOND", off, ship)
        joined = joined.drop("l_orderkey", "o_orderkey").withColumn("inMonth", F.year(start) * 12 + F.month(start)).hint("rebalance", "inMonth")
    return joined.select(
        "duration",
        F.timestamp_add("SECOND", off, ship).alias("startTime"),
        F.timestamp_add("SECOND", off + F.col("duration"), ship).alias("endTime"),
        F.col("sid").cast("string").alias("startStationID"),
        _station_name(F.col("sid")).alias("startStationName"),
        _lat(F.col("sid")).alias("startStationLat"),
        _long(F.col("sid")).alias("startStationLong"),
        F.col("eid").cast("string").alias("endStationID"),
        _station_name(F.col("eid")).alias("endStationName"),
        _lat(F.col("eid")).alias("endStationLat"),
        _long(F.col("eid")).alias("endStationLong"),
        F.col("bikeID"),
        "userType",
        "birthYear",
        "gender",
    )


# SQL text of the same mapping for an independent engine (DuckDB dialect); the
# oracle queries in ``ridelens.plans.oracle`` build on it.
TRIPS_SQL = f"""
SELECT
  duration, startTime,
  startTime + to_seconds(duration) AS endTime,
  CAST(sid AS VARCHAR) AS startStationID,
  'Station ' || lpad(CAST(sid AS VARCHAR), 2, '0') AS startStationName,
  CAST({LAT_ORIGIN}::DOUBLE + (sid % 10) * {GRID_STEP_DEG}::DOUBLE AS FLOAT) AS startStationLat,
  CAST({LONG_ORIGIN}::DOUBLE + (sid // 10) * {GRID_STEP_DEG}::DOUBLE AS FLOAT) AS startStationLong,
  CAST(eid AS VARCHAR) AS endStationID,
  'Station ' || lpad(CAST(eid AS VARCHAR), 2, '0') AS endStationName,
  CAST({LAT_ORIGIN}::DOUBLE + (eid % 10) * {GRID_STEP_DEG}::DOUBLE AS FLOAT) AS endStationLat,
  CAST({LONG_ORIGIN}::DOUBLE + (eid // 10) * {GRID_STEP_DEG}::DOUBLE AS FLOAT) AS endStationLong,
  bikeID, userType, birthYear, gender
FROM (
  SELECT
    CAST(l.l_quantity * 60 AS INTEGER) AS duration,
    l.l_shipdate + to_seconds((l.l_orderkey * {START_OFFSET_MULTIPLIERS[0]}
        + l.l_linenumber * {START_OFFSET_MULTIPLIERS[1]}) % {SECONDS_PER_DAY}) AS startTime,
    (l.l_orderkey * {START_STATION_MULTIPLIERS[0]}
        + l.l_linenumber * {START_STATION_MULTIPLIERS[1]}) % {STATIONS} AS sid,
    (l.l_partkey * {END_STATION_MULTIPLIERS[0]}
        + l.l_linenumber * {END_STATION_MULTIPLIERS[1]}) % {STATIONS} AS eid,
    l.l_partkey AS bikeID,
    CASE WHEN c.c_mktsegment = '{CUSTOMER_SEGMENT}' THEN 'Customer' ELSE 'Subscriber' END AS userType,
    CAST({BIRTH_YEAR_BASE} + (o.o_custkey * {BIRTH_YEAR_MULTIPLIER}) % {BIRTH_YEAR_SPAN} AS INTEGER) AS birthYear,
    CAST(c.c_nationkey % {GENDER_MODULUS} AS INTEGER) AS gender
  FROM lineitem l
  JOIN orders o ON l.l_orderkey = o.o_orderkey
  JOIN customer c ON o.o_custkey = c.c_custkey
) x
"""
