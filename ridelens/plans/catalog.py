"""Named queries: ``name -> fn(spark, sf_dir) -> DataFrame``.

Each query reads the whole driver tables (through the trip adapter) and returns
a lazy DataFrame.  Outputs are normalised for cross-engine comparison: doubles
rounded to ``DIGITS`` places, timestamps rendered as ``yyyy-MM-dd HH:mm:ss``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import columns as C
from ..operators import cohort as CO
from ..operators import demand, distance, fleet, riders
from ..sources.tables import trips_from_tables

DIGITS = 6
TIME_TEXT = "yyyy-MM-dd HH:mm:ss"
# Report-level parameters of the registered queries.
TOP_K = 10
RARE_THRESHOLD = 5
# Cut of the registered heavy-use query, a parameter of the operator.  The original's 1500 trips
# suit a city's year; the test tables have at most some 26 trips per bike, so that the query
# there takes 15.
HEAVY_THRESHOLD = 15

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}


def stable(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    """Round floating columns and render timestamps as text (deterministic output)."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.round(c.cast("double"), digits)
        elif isinstance(f.dataType, (T.TimestampNTZType, T.TimestampType)):
            c = F.date_format(c, TIME_TEXT)
        cols.append(c.alias(f.name))
    return df.select(*cols)


def register(name: str, digits: int = DIGITS):
    def deco(fn: QueryFn) -> QueryFn:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return stable(fn(spark, sf_dir), digits)

        run.__name__ = name
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        return fn

    return deco


def trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trips_from_tables(spark, sf_dir)


def cohort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return CO.clean_cohort(trips(spark, sf_dir))


# --- demand ---------------------------------------------------------------------


@register("top_destinations_by_band")
def _q_top_dest(spark, sf):
    """Flagship: top-10 end stations per time-of-day band."""
    return demand.top_destinations_by_band(cohort(spark, sf), TOP_K)


def _band_query(band: str) -> QueryFn:
    def q(spark, sf):
        return demand.top_destinations(cohort(spark, sf), band, TOP_K)

    q.__doc__ = f"Top-10 end stations in the {band} band."
    return q


for _key, _band in [
    ("top_destinations_morning", C.BAND_MORNING),
    ("top_destinations_afternoon", C.BAND_AFTERNOON),
    ("top_destinations_evening", C.BAND_EVENING),
    ("top_destinations_late_night", C.BAND_LATE_NIGHT),
]:
    register(_key)(_band_query(_band))


@register("time_band_counts")
def _q_time_band_counts(spark, sf):
    return demand.time_band_counts(cohort(spark, sf))


@register("day_type_counts")
def _q_day_type_counts(spark, sf):
    return demand.day_type_counts(cohort(spark, sf))


@register("hourly_usage")
def _q_hourly_usage(spark, sf):
    return demand.hourly_usage(cohort(spark, sf))


@register("hourly_slice")
def _q_hourly_slice(spark, sf):
    """Male / Weekday chart rows."""
    return demand.hourly_slice(cohort(spark, sf), C.GENDER_MALE, C.WEEKDAY)


@register("hourly_usage_union")
def _q_hourly_usage_union(spark, sf):
    return demand.hourly_usage_union(cohort(spark, sf))


@register("peak_hours")
def _q_peak_hours(spark, sf):
    return demand.peak_hours(cohort(spark, sf))


# --- riders ---------------------------------------------------------------------


@register("subs_by_age")
def _q_subs_by_age(spark, sf):
    return riders.subs_by_age(cohort(spark, sf))


@register("custs_by_age")
def _q_custs_by_age(spark, sf):
    return riders.custs_by_age(cohort(spark, sf))


@register("usertype_by_age_join")
def _q_usertype_by_age_join(spark, sf):
    return riders.usertype_by_age_join(cohort(spark, sf))


@register("usertype_share_by_age")
def _q_usertype_share_by_age(spark, sf):
    return riders.usertype_share_by_age(cohort(spark, sf))


@register("usertype_share_by_age_all")
def _q_usertype_share_by_age_all(spark, sf):
    return riders.usertype_share_by_age(cohort(spark, sf), keep_all=True)


@register("age_band_counts")
def _q_age_band_counts(spark, sf):
    return riders.age_band_counts(cohort(spark, sf))


@register("age_band_share")
def _q_age_band_share(spark, sf):
    return riders.age_band_share(cohort(spark, sf))


@register("age_band_totals")
def _q_age_band_totals(spark, sf):
    return riders.age_band_totals(cohort(spark, sf))


@register("gender_share")
def _q_gender_share(spark, sf):
    return riders.gender_share(trips(spark, sf))


@register("gender_decode")
def _q_gender_decode(spark, sf):
    return riders.gender_decode(trips(spark, sf))


@register("rider_age")
def _q_rider_age(spark, sf):
    return riders.rider_age(trips(spark, sf))


@register("age_profile")
def _q_age_profile(spark, sf):
    return riders.age_profile(trips(spark, sf))


# --- fleet ----------------------------------------------------------------------


@register("most_used_bikes")
def _q_most_used_bikes(spark, sf):
    return fleet.most_used_bikes(cohort(spark, sf), TOP_K)


@register("most_hours_bikes")
def _q_most_hours_bikes(spark, sf):
    return fleet.most_hours_bikes(cohort(spark, sf), TOP_K)


@register("rarely_used_bikes")
def _q_rarely_used_bikes(spark, sf):
    return fleet.rarely_used_bikes(cohort(spark, sf), RARE_THRESHOLD)


@register("rarely_used_bike_count")
def _q_rarely_used_bike_count(spark, sf):
    return fleet.rarely_used_bike_count(cohort(spark, sf), RARE_THRESHOLD)


@register("heavily_used_bike_count")
def _q_heavily_used_bike_count(spark, sf):
    return fleet.heavily_used_bike_count(cohort(spark, sf), HEAVY_THRESHOLD)


@register("distinct_bikes")
def _q_distinct_bikes(spark, sf):
    return fleet.distinct_bikes(cohort(spark, sf))


@register("distinct_bikes_sketch")
def _q_distinct_bikes_sketch(spark, sf):
    """Distinct bikes exactly, and whether the merged monthly sketches come within three standard errors."""
    from ..session import shared_path

    path = shared_path(spark, "bike-sketches")
    fleet.bike_sketches(cohort(spark, sf)).write.parquet(path)
    months = spark.read.parquet(path)
    estimate = fleet.distinct_bikes_of(months).withColumnRenamed("NumBikes", "estimate").scalar()
    error = 3 * 1.04 / 2 ** (fleet.SKETCH_BITS / 2)
    exact = fleet.distinct_bikes(cohort(spark, sf))
    close = F.abs(F.col("estimate") - F.col("NumBikes")) <= F.greatest(F.col("NumBikes") * error, F.lit(1.0))
    return exact.withColumn("estimate", estimate).select("NumBikes", F.coalesce(close, F.lit(False)).alias("withinError"))


@register("bikes_in_both_top10")
def _q_bikes_in_both(spark, sf):
    return fleet.bikes_in_both_top(cohort(spark, sf), TOP_K)


@register("bike_daily_rate")
def _q_bike_daily_rate(spark, sf):
    return fleet.bike_daily_rate(cohort(spark, sf), TOP_K)


# --- distance / speed -----------------------------------------------------------


@register("trip_distance")
def _q_trip_distance(spark, sf):
    return distance.trip_distance(cohort(spark, sf))


@register("trip_speed")
def _q_trip_speed(spark, sf):
    return distance.trip_speed(cohort(spark, sf))


@register("distance_stats")
def _q_distance_stats(spark, sf):
    return distance.distance_stats(cohort(spark, sf))


@register("distance_stats_legacy")
def _q_distance_stats_legacy(spark, sf):
    return distance.distance_stats(cohort(spark, sf), legacy=True)


@register("avg_speed")
def _q_avg_speed(spark, sf):
    return distance.avg_speed(cohort(spark, sf))


@register("avg_speed_legacy")
def _q_avg_speed_legacy(spark, sf):
    """Mean speed with the original's degree-valued cos distance."""
    return distance.avg_speed(cohort(spark, sf), legacy=True)


@register("speed_gender_gap")
def _q_speed_gender_gap(spark, sf):
    return distance.speed_gender_gap(cohort(spark, sf))


# --- cohort ---------------------------------------------------------------------


@register("clean_cohort")
def _q_clean_cohort(spark, sf):
    return cohort(spark, sf)


@register("clean_cohort_union")
def _q_clean_cohort_union(spark, sf):
    return CO.clean_cohort_union(trips(spark, sf))


@register("clean_projection")
def _q_clean_projection(spark, sf):
    """All raw trips projected to the 13 cohort columns (no filter)."""
    return CO.derive(trips(spark, sf))


@register("filter_known_gender")
def _q_filter_known_gender(spark, sf):
    return CO.filter_known_gender(trips(spark, sf))


@register("filter_age_cap")
def _q_filter_age_cap(spark, sf):
    return CO.filter_age_cap(trips(spark, sf))


@register("filter_round_trips")
def _q_filter_round_trips(spark, sf):
    return CO.filter_round_trips(trips(spark, sf))


@register("short_term_cohort")
def _q_short_term(spark, sf):
    return CO.short_term_cohort(trips(spark, sf))


@register("annual_cohort")
def _q_annual(spark, sf):
    return CO.annual_cohort(trips(spark, sf))


@register("cleaning_funnel")
def _q_cleaning_funnel(spark, sf):
    return CO.cleaning_funnel(trips(spark, sf))


@register("row_counts")
def _q_row_counts(spark, sf):
    """Raw and cleaned row counts in one pass over the raw trips."""
    return trips(spark, sf).agg(
        F.count(F.lit(1)).alias("rawRows"), F.count_if(CO.cohort_rule()).alias("cohortRows")
    )


# --- models -----------------------------------------------------------------------
# Fitted on the whole cohort; the tree queries use the original's 10 % sample and
# 70/30 split (hash-based, seeded).

TREE_DEPTH = 5


@register("duration_ridge")
def _q_duration_ridge(spark, sf):
    from ..operators import models

    return models.ridge_by_moments(cohort(spark, sf)).select("intercept", "coefficient", "regParam")


@register("duration_ridge_onepass")
def _q_duration_ridge_onepass(spark, sf):
    """Ridge coefficients and fit metrics from one aggregate pass (no cache, no driver data)."""
    from ..operators import models

    return models.ridge_by_moments(cohort(spark, sf))


@register("duration_ridge_legacy")
def _q_duration_ridge_legacy(spark, sf):
    """The fit as originally reported: hours ~ legacy distance."""
    from ..operators import models

    fit = models.ridge_by_moments(cohort(spark, sf), legacy=True)
    return fit.select("intercept", "coefficient", "regParam", "r2", "rmse")


@register("duration_ridge_metrics")
def _q_duration_ridge_metrics(spark, sf):
    from ..operators import models

    return models.ridge_by_moments(cohort(spark, sf)).select("r2", "rmse", "numInstances", "droppedRows")


@register("duration_predictions", digits=5)
def _q_duration_predictions(spark, sf):
    from ..operators import models

    return models.ridge_predictions(cohort(spark, sf))


@register("station_index")
def _q_station_index(spark, sf):
    """Frequency-ordered index of start and end station names (0 = most trips)."""
    from ..operators import models

    return models.station_index(cohort(spark, sf))


@register("sample_trips")
def _q_sample_trips(spark, sf):
    from ..operators import models

    return models.sample_trips(cohort(spark, sf), models.TREE_SAMPLE_FRACTION, seed=42)


@register("train_test_split")
def _q_train_test_split(spark, sf):
    from ..operators import models

    return models.split_sizes(cohort(spark, sf))


class _Fitted:
    """A tree pipeline fitted for a query; the sampled rows are persisted while it is in use."""

    def __init__(self, spark, sf, depth):
        from ..operators import models

        self.rows = models.sample_trips(models.tree_inputs(cohort(spark, sf)), models.TREE_SAMPLE_FRACTION).persist()
        self.train, self.test = models.train_test_split(self.rows)
        self.depth = depth

    def __enter__(self):
        from ..operators import models

        try:
            self.pipeline = models.fit_duration_tree(self.train, self.depth)
        except BaseException:
            self.rows.unpersist()
            raise
        self.tree = self.pipeline.stages[-1]
        return self

    def __exit__(self, *_):
        self.rows.unpersist()


def _tree_by_depth(spark, sf, depth):
    """(maxDepth, rmse, numNodes) of one tree, the RMSE on the held-out side."""
    from ..operators import models

    with _Fitted(spark, sf, depth) as fit:
        row = (depth, float(models.evaluate_rmse(fit.pipeline, fit.test)), int(fit.tree.numNodes))
    return spark.createDataFrame([row], "maxDepth int, rmse double, numNodes int")


@register("duration_tree_depth0")
def _q_duration_tree_depth0(spark, sf):
    """The root alone: the mean of the training side."""
    return _tree_by_depth(spark, sf, 0)


@register("duration_tree_depth1")
def _q_duration_tree_depth1(spark, sf):
    """One split: the best of all thresholds of all features."""
    return _tree_by_depth(spark, sf, 1)


@register("duration_tree")
def _q_duration_tree(spark, sf):
    return _tree_by_depth(spark, sf, TREE_DEPTH)


@register("duration_tree_rmse")
def _q_duration_tree_rmse(spark, sf):
    """Held-out RMSE by the evaluator and recomputed as a SQL aggregate."""
    from ..operators import models

    with _Fitted(spark, sf, TREE_DEPTH) as fit:
        by_sql = fit.pipeline.transform(fit.test).agg(models.rmse_sql()).first()[0]
        row = (float(models.evaluate_rmse(fit.pipeline, fit.test)), float(by_sql))
    return spark.createDataFrame([row], "rmseEvaluator double, rmseSql double")


@register("tree_feature_importances")
def _q_tree_feature_importances(spark, sf):
    """Which inputs the depth-5 tree splits on (the fitted model, inspected)."""
    from ..operators import models

    with _Fitted(spark, sf, TREE_DEPTH) as fit:
        _, imp = models.describe_tree(fit.pipeline)
    return spark.createDataFrame(imp, "feature string, importance double")


@register("tree_rules")
def _q_tree_rules(spark, sf):
    """The depth-5 tree as text, a rule for each leaf, and how the held-out rows that meet it fare; these are
    matched by a join with the rules, not by the model."""
    from ..operators import models, trees

    with _Fitted(spark, sf, TREE_DEPTH) as fit:
        labels = trees.labels_of(fit.pipeline)
        rules = trees.leaf_rules(spark, trees.NodeTable(spark, fit.tree), labels)
        met = trees.score_by_rules(fit.test, rules, labels).groupBy("leaf").agg(
            F.count(F.lit(1)).alias("testRows"), models.rmse_sql().alias("testRmse")
        )
        rows = rules.join(met, "leaf", "left").select(
            "leaf", "depth", "rule", "prediction", "trainRows", F.coalesce("testRows", F.lit(0)).alias("testRows"), "testRmse"
        )
        out = rows.collect()  # at most 2 ** TREE_DEPTH rows
        schema = rows.schema
    return spark.createDataFrame(out, schema)


@register("tree_feature_kinds")
def _q_tree_feature_kinds(spark, sf):
    """Which features of the training rows are categories, and the number of each of their values."""
    from pyspark.ml import Pipeline

    from ..operators import models, trees

    rows = models.sample_trips(models.tree_inputs(cohort(spark, sf)), models.TREE_SAMPLE_FRACTION)
    # Kept for the indexers and both passes over the features: one join and one sampling of the trips.
    train = models.train_test_split(rows)[0].persist()
    try:
        indexed = Pipeline(stages=models.feature_stages()[:1]).fit(train).transform(train)
        return trees.feature_kinds(indexed, models.TREE_FEATURES, models.VECTOR_MAX_CATEGORIES)
    finally:
        train.unpersist()


@register("tree_depth_sweep")
def _q_tree_depth_sweep(spark, sf):
    from ..operators import models

    return models.tree_depth_sweep(spark, cohort(spark, sf))


# --- files, SQL surface, streaming --------------------------------------------------
# Trip files are first produced by Spark from the tables (monthly CSV directories
# in the shared checkpoint folder), then read back through the file source.

ONE_MONTH = "199710"


def _trip_tables(sf_dir: str) -> list[str]:
    return [f"{sf_dir.rstrip('/')}/{name}.parquet" for name in ("lineitem", "orders", "customer")]


def staged_trip_files(spark: SparkSession, sf_dir: str) -> str:
    """Monthly trip CSV files derived from the tables, written once for a state of the tables and shared
    by all readers (``session.made_once``)."""
    from ..session import made_once
    from ..sources import files

    return made_once(spark, "trip-files", _trip_tables(sf_dir), lambda path: files.write_trip_files(trips_from_tables(spark, sf_dir, by_month=True), path, by_month=True))


# Fixed rule of the files in several layouts: bikeID mod 3 names the folder; 2 has a header that is not a trip's.
LAYOUT_FOLDERS = ["standard", "renamed", "unknown"]


def files_in_layouts(spark: SparkSession, sf_dir: str) -> str:
    """All trips as CSV in three layouts: the usual one, one with other names in the opposite order and a further
    column, and one whose header lacks a trip column; written once for a state of the tables."""
    from ..schema import TRIP_COLUMNS
    from ..session import made_once
    from ..sources import files
    from ..sources.headers import OTHER_NAMES

    other = {column: name for name, column in OTHER_NAMES.items()}
    columns = {
        "standard": TRIP_COLUMNS,
        "renamed": [*[F.col(c).alias(other.get(c, c)) for c in TRIP_COLUMNS[::-1]], F.lit("blue").alias("colour")],
        "unknown": [F.col(c).alias("colour" if c == "gender" else c) for c in TRIP_COLUMNS],
    }

    def write(path: str) -> None:
        for k, folder in enumerate(LAYOUT_FOLDERS):
            part = trips(spark, sf_dir).filter(F.pmod("bikeID", F.lit(3)) == k).select(*columns[folder])
            files.write_trip_csv(part, f"{path}/{folder}")

    return made_once(spark, "layouts", _trip_tables(sf_dir), write)


# Fixed rule of the spoiled trip lines: bikeID mod SPOIL_MODULUS names the damage.
SPOIL_MODULUS = 97


def spoiled_trip_lines(spark: SparkSession, sf_dir: str) -> str:
    """All trips as CSV lines without header; a fixed rule on the bike spoils single fields (1:
    duration, 2: gender, 3: birth year, 4: start time) or cuts the line after 11 fields (5)."""
    from ..schema import RAW_TIME_FORMAT, TRIP_SCHEMA
    from ..session import shared_path

    damage = F.pmod("bikeID", F.lit(SPOIL_MODULUS))
    bad = {"duration": (1, "ten"), "gender": (2, "m"), "birthYear": (3, "19x0"), "startTime": (4, "not a time")}
    texts = []
    for f in TRIP_SCHEMA.fields:
        time = isinstance(f.dataType, T.TimestampNTZType)
        text = F.date_format(f.name, RAW_TIME_FORMAT) if time else F.col(f.name).cast("string")
        if f.name in bad:
            code, junk = bad[f.name]
            text = F.when(damage == code, F.lit(junk)).otherwise(text)
        texts.append(F.concat(F.lit('"'), F.coalesce(text, F.lit("")), F.lit('"')))
    path = shared_path(spark, "spoiled-lines")
    cut = F.when(damage == 5, F.concat_ws(",", *texts[:11])).otherwise(F.concat_ws(",", *texts))
    trips(spark, sf_dir).select(cut.alias("value")).write.text(path)
    return path


def _month_dirs(spark: SparkSession, root: str) -> list[str]:
    """Months that have a directory right below ``root``."""
    from ..session import child_names

    return [n.split("=")[1] for n in child_names(spark, root) if n.startswith("month=") and n[6:].isdigit()]


@register("scan_trips")
def _q_scan_trips(spark, sf):
    """Typed CSV scan of the monthly trip files (header, quoted fields)."""
    from ..schema import TRIP_COLUMNS
    from ..sources import files

    return files.read_trip_csv(spark, staged_trip_files(spark, sf)).select(*TRIP_COLUMNS)


@register("scan_by_header")
def _q_scan_by_header(spark, sf):
    """Trip files of several layouts read by the names in their headers; those of an unknown one are left out."""
    from ..sources import files

    return files.read_trip_csv(spark, files_in_layouts(spark, sf))


@register("file_ledger")
def _q_file_ledger(spark, sf):
    """How files are read: status and header of each layout, and its lines."""
    from ..sources import headers

    root = files_in_layouts(spark, sf)
    lines = spark.read.option("recursiveFileLookup", True).text(root).groupBy(F.col("_metadata.file_path").alias("file")).agg((F.count(F.lit(1)) - 1).alias("Num"))
    tail = lambda c: F.regexp_extract(c, "[^/]+/[^/]+$", 0)  # noqa: E731  (folder and name; schemes are written in several ways)
    ledger = headers.file_ledger(spark, root).withColumn("file", tail("file"))
    return ledger.join(lines.withColumn("file", tail("file")), "file").groupBy("status", "header").agg(F.sum("Num").alias("Num"))


@register("scan_rejects")
def _q_scan_rejects(spark, sf):
    """Rejected lines of spoiled trip files, in all and by field."""
    from ..sources import files

    lines = spoiled_trip_lines(spark, sf)
    return files.reject_summary(files.read_trip_csv(spark, lines, rejects=True, header=False))


@register("union_months")
def _q_union_months(spark, sf):
    """One read over the list of monthly paths; trips per start month."""
    from ..sources import files

    root = staged_trip_files(spark, sf)
    paths = files.month_paths(root, _month_dirs(spark, root))
    return (
        files.read_trip_csv(spark, paths)
        .groupBy(F.date_format("startTime", files.MONTH_FORMAT).alias("month"))
        .agg(F.count(F.lit(1)).alias("Num"))
    )


@register("trips_one_month")
def _q_trips_one_month(spark, sf):
    """The question-1 answer for a single month (directory pruning on ``month``)."""
    from ..sources import files

    raw = files.read_trip_csv(spark, staged_trip_files(spark, sf))
    one = raw.filter(F.col(files.MONTH_COLUMN) == F.lit(int(ONE_MONTH)))
    return demand.top_destinations_by_band(CO.clean_cohort(one), TOP_K)


@register("parse_timestamps")
def _q_parse_timestamps(spark, sf):
    """Raw time text (``yyyy-MM-dd HH:mm:ss.SSSS``) parsed to TIMESTAMP_NTZ."""
    from ..sources import files

    text = files.read_trip_text(spark, staged_trip_files(spark, sf))
    return text.select(
        F.col("startTime").alias("startTimeText"),
        C.parse_raw_time("startTime").alias("startTime"),
        F.col("endTime").alias("endTimeText"),
        C.parse_raw_time("endTime").alias("endTime"),
    )


@register("incremental_cohort")
def _q_incremental_cohort(spark, sf):
    """The cohort table built from the monthly files, then brought up to date after one month got its trips
    a second time: rows per month."""
    from ..session import shared_path
    from ..sources import files
    from .suite import refresh_cohort

    landing, table = shared_path(spark, "months"), shared_path(spark, "cohort-by-month")
    files.write_trip_files(trips_from_tables(spark, sf, by_month=True), landing, by_month=True)
    refresh_cohort(spark, landing, table)
    month = trips(spark, sf).filter(F.date_format("startTime", files.MONTH_FORMAT) == ONE_MONTH)
    files.write_trip_files(month, landing, mode="append")
    again = refresh_cohort(spark, landing, table)
    rows = spark.read.parquet(table).groupBy(F.col(files.MONTH_COLUMN).cast("string").alias("month")).agg(F.count(F.lit(1)).alias("Num"))
    return rows.withColumn("refreshed", F.col("month").isin(again) if again else F.lit(False))


@register("export_csv")
def _q_export_csv(spark, sf):
    """Most-used bikes written as a one-file unquoted CSV extract and read back."""
    from ..session import shared_path
    from ..sources import files

    path = files.export_csv(
        fleet.most_used_bikes(cohort(spark, sf), TOP_K),
        shared_path(spark, "extracts", "mostUsedBikes"),
        single_file=True,
        quote="\u0000",
    )
    return spark.read.schema("bikeID bigint, Num bigint").option("header", True).csv(path)


@register("extract_roundtrip")
def _q_extract_roundtrip(spark, sf):
    """Extract re-read with inferred types; bike IDs cast to text for charting."""
    from ..session import shared_path
    from ..sources import files

    path = files.export_csv(
        fleet.most_hours_bikes(cohort(spark, sf), TOP_K),
        shared_path(spark, "extracts", "mostHoursUsedBikes"),
        single_file=True,
    )
    back = files.read_extract(spark, path)
    return back.select(F.col("bikeID").cast("string").alias("bikeID"), "Num", "HoursUsed")


@register("extract_types")
def _q_extract_types(spark, sf):
    """Column types of an extract as they are inferred when it is read back."""
    from ..session import shared_path
    from ..sources import files

    path = files.export_csv(
        fleet.most_hours_bikes(cohort(spark, sf), TOP_K), shared_path(spark, "extracts", "types"), single_file=True
    )
    return files.column_types(files.read_extract(spark, path))


@register("sql_functions")
def _q_sql_functions(spark, sf):
    """The SQL surface: trip functions applied in ``spark.sql`` over the raw view."""
    from ..functions.sql import register_sql_functions

    register_sql_functions(spark)
    trips(spark, sf).createOrReplaceTempView("trips_raw")
    return spark.sql(
        f"""
        SELECT to_gender(gender) AS gender,
               time_band(hour(endTime)) AS Time,
               age_band(rider_age(birthYear, {C.DEFAULT_AS_OF_YEAR})) AS ageGroup,
               day_type(day_name(dayofweek(startTime))) AS DayType,
               count(*) AS Num,
               avg(haversine_km(startStationLat, startStationLong, endStationLat, endStationLong))
                 AS avgDist,
               avg(haversine_km_legacy(startStationLat, startStationLong, endStationLat,
                                       endStationLong)) AS avgDistLegacy
        FROM trips_raw
        GROUP BY ALL
        """
    )


@register("stream_ingest")
def _q_stream_ingest(spark, sf):
    """Monthly files streamed into a month-partitioned cohort table; rows per month."""
    from ..session import shared_path
    from ..streaming.ingest import start_cohort_ingest

    landing = staged_trip_files(spark, sf)
    table = shared_path(spark, "cohort-table")
    q = start_cohort_ingest(
        spark, landing, table, shared_path(spark, "cohort-table-ckpt"), shared_path(spark, "cohort-rejects")
    )
    q.awaitTermination()
    if q.exception() is not None:
        raise q.exception()
    return (
        spark.read.parquet(table)
        .groupBy(F.col("month").cast("string").alias("month"))
        .agg(F.count(F.lit(1)).alias("Num"))
    )


@register("stream_predictions")
def _q_stream_predictions(spark, sf):
    """The depth-5 tree written to shared storage, loaded again, and applied to the streamed trip files;
    trips, mean prediction and RMSE by month."""
    from ..operators import models
    from ..session import shared_path
    from ..streaming.ingest import start_scoring

    path = shared_path(spark, "tree-pipeline")
    with _Fitted(spark, sf, TREE_DEPTH) as fit:
        models.save_pipeline(fit.pipeline, path)
    scored = shared_path(spark, "scored-trips")
    q = start_scoring(spark, staged_trip_files(spark, sf), scored, shared_path(spark, "scored-trips-ckpt"), path)
    q.awaitTermination()
    if q.exception() is not None:
        raise q.exception()
    return (
        spark.read.parquet(scored)
        .groupBy(F.date_format("startTime", "yyyyMM").alias("month"))
        .agg(F.count(F.lit(1)).alias("Num"), F.avg("prediction").alias("meanPrediction"), models.rmse_sql().alias("rmse"))
    )


def all_queries() -> dict[str, QueryFn]:
    """Every registered query."""
    return dict(QUERIES)
