"""Trip files (CSV) in, extracts out."""

from __future__ import annotations

import datetime as dt
import glob
import gzip
import os
import tempfile

from pyspark.sql import functions as F

from ridelens.plans.inspect import plan_text
from ridelens.schema import TRIP_COLUMNS
from ridelens.sources import files
from ridelens.sources.tables import trips_from_tables

from .conftest import SF0001, trip

HEADER = ",".join(f'"{c}"' for c in TRIP_COLUMNS)


def _line(bike, name="A", start="2018-06-01 08:00:00.0000", birth="1980"):
    vals = [
        "600", start, "2018-06-01 08:10:00.0000", "1", name, "40.75", "-73.99", "2", "B",
        "40.76", "-73.98", str(bike), "Subscriber", birth, "1",
    ]
    return ",".join(f'"{v}"' for v in vals)


def _scratch() -> str:
    return tempfile.mkdtemp(prefix="ridelens-test-")


def test_csv_edge_cases(spark):
    d = _scratch()
    with open(os.path.join(d, "201806-trips.csv"), "w") as f:
        f.write("\n".join([
            HEADER,
            _line(11, name="Broadway & W 60 St, North"),  # quoted comma
            _line(12, birth=""),  # empty field
            _line(13, start="not a time"),  # malformed time
        ]) + "\n")
    with open(os.path.join(d, "201807-trips.csv"), "w") as f:
        f.write("\n".join([HEADER, _line(14)]) + "\n")  # second file, own header

    rows = {r.bikeID: r for r in files.read_trip_csv(spark, d, rejects=True).collect()}
    assert sorted(rows) == [11, 12, 13, 14]
    assert rows[11].startStationName == "Broadway & W 60 St, North"
    assert rows[11].startTime == dt.datetime(2018, 6, 1, 8, 0) and rows[11]._corrupt_record is None
    assert rows[12].birthYear is None and rows[12]._corrupt_record is None
    assert rows[13].startTime is None and rows[13]._corrupt_record is not None
    assert rows[14].duration == 600

    s = files.reject_summary(files.read_trip_csv(spark, d, rejects=True)).first()
    assert (s.parsedRows, s.rejectedRows, s.null_startTime, s.null_duration) == (3, 1, 1, 0)

    text = files.parse_trip_text(files.read_trip_text(spark, d))
    parsed = {r.bikeID: r for r in text.collect()}
    assert parsed[13].startTime is None
    assert parsed[11].startTime == dt.datetime(2018, 6, 1, 8, 0)
    assert parsed[12].birthYear is None and parsed[14].startStationLat == 40.75


def test_every_field_can_reject_a_line(spark):
    d = _scratch()
    good = _line(1).split(",")
    lines = [",".join(good)]
    for at in (0, 1, 2, 11, 13, 14):  # duration, times, bike, birth year, gender
        lines.append(",".join([*good[:at], '"bad"', *good[at + 1 :]]))
    lines.append(",".join(good[:9]))
    with open(os.path.join(d, "x.csv"), "w") as f:
        f.write("\n".join([HEADER, *lines]) + "\n")
    rows = files.read_trip_csv(spark, d, rejects=True)
    s = files.reject_summary(rows).first()
    assert (s.parsedRows, s.rejectedRows) == (1, 7)
    assert (s.null_duration, s.null_gender, s.null_birthYear, s.null_bikeID, s.null_startStationID) == (1, 2, 2, 2, 0)
    kept = files.rejected_lines(rows).collect()
    assert sorted(r.line for r in kept) == sorted(lines[1:])


def test_trip_files_round_trip_and_pruning(spark, trips_small):
    root = _scratch() + "/trips"
    files.write_trip_files(trips_small, root)
    back = files.read_trip_csv(spark, root).select(*TRIP_COLUMNS)
    assert back.exceptAll(trips_small).count() == 0 and trips_small.exceptAll(back).count() == 0

    months = sorted({os.path.basename(p) for p in glob.glob(root + "/month=*")})
    listed = files.month_paths(root, [m.split("=")[1] for m in months[:3]])
    part = files.read_trip_csv(spark, listed)
    want = trips_small.filter(
        F.date_format("startTime", "yyyyMM").isin([m.split("=")[1] for m in months[:3]])
    ).count()
    assert part.count() == want

    one = files.read_trip_csv(spark, root).filter(F.col("month") == 199710)
    plan = plan_text(one)
    assert "PartitionFilters: [isnotnull(month" in plan and "= 199710" in plan


def test_export_single_file(spark, cohort_small):
    from ridelens.operators import fleet

    path = _scratch() + "/mostUsedBikes"
    top = fleet.most_used_bikes(cohort_small, 10)
    files.export_csv(top, path, single_file=True, quote="\u0000")
    assert len(glob.glob(path + "/part-*.csv")) == 1
    back = files.read_extract(spark, path)
    assert back.columns == ["bikeID", "Num"]
    assert [tuple(r) for r in files.column_types(back).collect()] == [(0, "bikeID", "int"), (1, "Num", "int")]
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, top.collect()))
    # an existing extract is replaced only on request
    files.export_csv(top, path, mode="overwrite", single_file=True)


def test_staged_months_are_compressed_bounded_and_shuffled_narrow(spark, monkeypatch):
    d = tempfile.mkdtemp(prefix="ridelens-test-")
    whole, moved = trips_from_tables(spark, SF0001), trips_from_tables(spark, SF0001, by_month=True)
    # The exchange by month comes before the record is derived: stations are numbers there.
    exchanged = plan_text(moved).split("REBALANCE_PARTITIONS_BY_COL")[0].rsplit("Input [", 1)[1]
    assert "inMonth" in exchanged and "Station" not in exchanged
    monkeypatch.setattr(files, "MAX_FILE_ROWS", 50)
    files.write_trip_files(moved, d, by_month=True)
    made = glob.glob(f"{d}/month=*/part-*")
    assert made and all(p.endswith(".csv.gz") for p in made)
    assert {len(gzip.open(p, "rt").readlines()) <= 51 for p in made} == {True}
    back = files.read_trip_csv(spark, d)
    assert back.drop("month").exceptAll(whole).count() == 0 and back.count() == whole.count()
    assert back.filter(F.col("month").cast("string") != F.date_format("startTime", "yyyyMM")).count() == 0


def test_trips_without_a_start_are_staged(spark, make_trips):
    d = tempfile.mkdtemp(prefix="ridelens-test-")
    files.write_trip_files(make_trips([trip(bikeID=1), trip(bikeID=2, startTime=None)]), d)
    assert {(r.bikeID, r.month) for r in files.read_trip_csv(spark, d).collect()} == {(1, 201806), (2, None)}
