"""All questions from one cleaned cohort (the original workflow, done once).

The cohort is materialised before the questions run, in one of two ways:

* ``"table"`` (default): written as parquet, partitioned by start month, to the
  shared checkpoint folder and read back.  Lineage is cut (an executor loss
  re-reads files instead of re-running the three-table join), every question
  reads only its own 2-4 columns, and month predicates prune directories.  This is
  the mode for large inputs.
* ``"persist"``: ``persist(MEMORY_AND_DISK)`` - cheaper for small inputs; lost
  blocks are recomputed from lineage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import cohort as CO
from ..operators import demand, distance, fleet, riders
from ..schema import TRIP_COLUMNS
from ..sources.files import MONTH_COLUMN, MONTH_FORMAT, recover
from ..sources.tables import trips_from_tables


def questions(cohort: DataFrame, k: int = 10) -> dict[str, DataFrame]:
    """Every question of the analysis as a lazy DataFrame over ``cohort``."""
    return {
        "top_destinations_by_band": demand.top_destinations_by_band(cohort, k),
        "usertype_share_by_age": riders.usertype_share_by_age(cohort),
        "age_band_share": riders.age_band_share(cohort),
        "hourly_usage": demand.hourly_usage(cohort),
        "most_used_bikes": fleet.most_used_bikes(cohort, k),
        "rarely_used_bike_count": fleet.rarely_used_bike_count(cohort),
        "most_hours_bikes": fleet.most_hours_bikes(cohort, k),
        "distance_stats": distance.distance_stats(cohort),
        "avg_speed": distance.avg_speed(cohort),
    }


def materialize_cohort(
    spark: SparkSession,
    trips: DataFrame,
    mode: str = "table",
    path: str | None = None,
    as_of_year: int = C.DEFAULT_AS_OF_YEAR,
) -> DataFrame:
    cohort = CO.clean_cohort(trips, as_of_year)
    if mode == "persist":
        cohort = cohort.persist(StorageLevel.MEMORY_AND_DISK)
        cohort.count()
        return cohort
    if mode != "table":
        raise ValueError(f"unknown mode {mode!r}")
    if path is None:
        from ..session import shared_path

        path = shared_path(spark, "cohort")
    (
        cohort.withColumn(MONTH_COLUMN, F.date_format("startTime", MONTH_FORMAT))
        .hint("rebalance", MONTH_COLUMN)  # right-sized files per month, hot months split
        .write.mode("overwrite")
        .partitionBy(MONTH_COLUMN)
        .parquet(path)
    )
    return spark.read.parquet(path)


def refresh_cohort(spark: SparkSession, trip_dir: str, table_dir: str, as_of_year: int = C.DEFAULT_AS_OF_YEAR) -> list[str]:
    """Bring the cohort table (by start month) up to the trip files below ``trip_dir/month=yyyyMM/``;
    returns the months that were cleaned again or removed.

    A manifest beside the table (``<table_dir>.manifest``) lists the files and sizes that each month was built from.  Only months
    whose files differ are read; their partitions are replaced (dynamic partition overwrite), the others stay as they
    are.  The manifest is replaced last, so a run that is cut off does the same months again.
    """
    from ..session import listing, path_exists, remove
    from ..sources.files import export_csv, month_paths, read_trip_csv

    manifest_dir = f"{table_dir.rstrip('/')}.manifest"
    schema = "month string, file string, bytes long, changed long, asOfYear int"
    now = set()
    for file, size, changed in listing(spark, trip_dir):
        month = [p[len(MONTH_COLUMN) + 1 :] for p in file.split("/") if p.startswith(f"{MONTH_COLUMN}=")]
        if not month:
            raise ValueError(f"{file} is in no folder {MONTH_COLUMN}=yyyyMM")
        now.add((month[-1], file, size, changed, as_of_year))
    recover(spark, manifest_dir)
    before = {tuple(r) for r in spark.read.schema(schema).option("header", True).csv(manifest_dir).collect()} if path_exists(spark, manifest_dir) else set()
    changed_months = sorted({m for m, *_ in now ^ before})
    present = sorted({m for m, *_ in now} & set(changed_months))
    if present:
        trips = read_trip_csv(spark, month_paths(trip_dir, present))
        rows = CO.clean_cohort(trips.select(*TRIP_COLUMNS), as_of_year).withColumn(MONTH_COLUMN, F.date_format("startTime", MONTH_FORMAT))
        (
            rows.hint("rebalance", MONTH_COLUMN)
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy(MONTH_COLUMN)
            .parquet(table_dir)
        )
    held = {r[0] for r in spark.read.parquet(table_dir).filter(F.col(MONTH_COLUMN).isin([int(m) for m in present])).select(F.col(MONTH_COLUMN).cast("string")).distinct().collect()} if present else set()
    for month in changed_months:
        stale = month not in present
        if stale or month not in held:  # no file left, or none of its trips passes the cleaning
            remove(spark, f"{table_dir.rstrip('/')}/{MONTH_COLUMN}={month}")
    if changed_months:
        export_csv(spark.createDataFrame(sorted(now), schema), manifest_dir, mode="overwrite", single_file=True)
    return changed_months


def run_all(
    spark: SparkSession,
    sf_dir: str,
    sink: Callable[[DataFrame], None],
    mode: str = "table",
    with_model: bool = True,
    parallelism: int = 4,
) -> DataFrame:
    """Materialise the cohort once, then send every question's result to ``sink``.

    The questions are independent jobs over the same materialised cohort; they are
    submitted from ``parallelism`` driver threads so their (small) stages overlap
    on the executors instead of queueing one after another.
    """
    from concurrent.futures import ThreadPoolExecutor

    from ..operators import models

    cohort = materialize_cohort(spark, trips_from_tables(spark, sf_dir), mode)
    try:
        work = [lambda df=df: sink(df) for df in questions(cohort).values()]
        if with_model:
            work.append(lambda: models.fit_duration_ridge(cohort))
        with ThreadPoolExecutor(max_workers=max(1, parallelism)) as pool:
            for f in [pool.submit(w) for w in work]:
                f.result()
    finally:
        if mode == "persist":
            cohort.unpersist()
    return cohort
