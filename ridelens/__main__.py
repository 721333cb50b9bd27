"""Answer every question and print the tables: ``python -m ridelens SOURCE``.

SOURCE is either a folder with the star-schema tables (``lineitem.parquet`` ...)
or one or more trip CSV files/folders.  The cohort is cleaned once, persisted,
and each question's table is printed with ``show`` (rows bounded by the
question: top-k lists, per-age or per-hour tables).
"""

from __future__ import annotations

import argparse

from pyspark import StorageLevel
from pyspark.sql import functions as F


def main(argv: list[str] | None = None) -> None:
    ap = argparse.ArgumentParser(prog="ridelens", description=__doc__.splitlines()[0])
    ap.add_argument("source", nargs="+", help="tables folder, or trip CSV files/folders")
    ap.add_argument("--master", default=None, help="Spark master (default: from the environment)")
    ap.add_argument("--as-of-year", type=int, default=2018)
    ap.add_argument("--top", type=int, default=10)
    ap.add_argument("--format", choices=["auto", "tables", "csv"], default="auto", help="kind of SOURCE")
    ap.add_argument("--rows", type=int, default=200, help="rows shown per table")
    args = ap.parse_args(argv)

    from .operators import models
    from .operators.cohort import clean_cohort
    from .plans.suite import questions
    from .schema import CORRUPT_COLUMN, TRIP_COLUMNS
    from .session import build_session, path_exists, remove_staged
    from .sources.files import read_trip_csv, reject_summary
    from .sources.tables import trips_from_tables

    spark = build_session(args.master)
    first = args.source[0]
    kind = args.format
    if kind == "auto":
        tables = len(args.source) == 1 and path_exists(spark, f"{first.rstrip('/')}/lineitem.parquet")
        kind = "tables" if tables else "csv"
    if kind == "tables":
        trips = trips_from_tables(spark, first)
    else:
        read = read_trip_csv(spark, args.source, rejects=True)
        print("\n== rejected lines")
        reject_summary(read).show(vertical=True, truncate=False)
        trips = read.filter(F.col(CORRUPT_COLUMN).isNull()).select(*TRIP_COLUMNS)
    cohort = clean_cohort(trips, args.as_of_year).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        for name, df in questions(cohort, args.top).items():
            print(f"\n== {name}")
            df.show(args.rows, truncate=False)
            total = df.count()
            if total > args.rows:
                print(f"(the first {args.rows} of {total} rows)")
        model, (r2, rmse, n) = models.fit_duration_ridge(cohort)
        w = float(model.coefficients[0])
        print(
            f"\n== duration_ridge\nhours = {model.intercept:.4f} {'-' if w < 0 else '+'} "
            f"{abs(w):.4f} * km   (R2 {r2:.3f}, RMSE {rmse:.3f} h, {n} trips)"
        )
    finally:
        cohort.unpersist()
        remove_staged(spark)
        spark.stop()


if __name__ == "__main__":
    main()
