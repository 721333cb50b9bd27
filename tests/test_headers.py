"""Trip files read by header names; extracts published in one step; staging once; cohort refreshed by month."""

from __future__ import annotations

import glob
import gzip
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from ridelens import session
from ridelens.operators import fleet
from ridelens.operators.cohort import clean_cohort
from ridelens.plans import catalog
from ridelens.plans.suite import refresh_cohort
from ridelens.schema import TRIP_COLUMNS
from ridelens.sources import files, headers

from .conftest import SF0001
from .test_files import HEADER, _line, _scratch


def _swapped(line: str) -> str:
    """Start and end station id in each other's place."""
    f = line.split(",")
    f[3], f[7] = f[7], f[3]
    return ",".join(f)


def _write(path, lines, opener=open):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with opener(path, "wt") as f:
        f.write("\n".join(lines) + "\n")


def test_swapped_columns_are_read_by_name(spark):
    d = _scratch()
    _write(f"{d}/a.csv", [HEADER, _line(1)])
    _write(f"{d}/b.csv", [_swapped(HEADER), _swapped(_line(2))])
    _write(f"{d}/c.csv.gz", ["﻿" + _swapped(HEADER).replace("duration", "Trip Duration").replace("endTime", "Stop Time"), _swapped(_line(3))], gzip.open)
    _write(f"{d}/d.csv", [HEADER + ',"colour"', _line(4) + ',"blue"'])
    _write(f"{d}/e.csv", [HEADER.replace("gender", "colour"), _line(5)])
    _write(f"{d}/f.csv", [HEADER.replace("gender", "duration"), _line(6)])
    _write(f"{d}/_hidden.csv", [_line(7)])
    open(f"{d}/g.csv", "w").close()
    rows = {r.bikeID: r for r in files.read_trip_csv(spark, d).collect()}
    assert sorted(rows) == [1, 2, 3, 4]
    assert all((r.startStationID, r.endStationID, r.duration, r.gender) == ("1", "2", 600, 1) for r in rows.values())
    ledger = {os.path.basename(r.file): r.status for r in headers.file_ledger(spark, d).collect()}
    assert ledger == {"a.csv": "standard", "b.csv": "by name", "c.csv.gz": "by name", "d.csv": "by name", "e.csv": "unknown header", "f.csv": "unknown header", "g.csv": "empty"}
    assert files.read_trip_csv(spark, [f"{d}/b.csv", f"{d}/a.csv"]).count() == 2
    assert files.read_trip_csv(spark, f"{d}/[ab].csv").count() == 2
    assert files.read_trip_csv(spark, f"{d}/e.csv").collect() == [] and files.read_trip_csv(spark, f"{d}/e.csv").columns == TRIP_COLUMNS


def test_rejects_and_months_by_name(spark):
    d = _scratch()
    _write(f"{d}/month=201806/a.csv", [_swapped(HEADER), _swapped(_line(1)), _swapped(_line(2, start="not a time"))])
    _write(f"{d}/month=201807/b.csv", [HEADER, _line(3)])
    read = files.read_trip_csv(spark, d, rejects=True)
    assert {(r.bikeID, r.month, r._corrupt_record is None) for r in read.collect()} == {(1, 201806, True), (2, 201806, False), (3, 201807, True)}
    assert [r.bikeID for r in read.filter("month = 201807").collect()] == [3]


def test_extract_is_published_whole_or_not_at_all(spark):
    path = f"{_scratch()}/extract"
    one, bad = spark.range(3), spark.range(3).select(F.raise_error(F.lit("stop")).cast("long").alias("id"))
    files.export_csv(one, path)
    with pytest.raises(FileExistsError):
        files.export_csv(one, path)
    files.export_csv(spark.range(9), path, mode="ignore")
    with pytest.raises(Exception, match="stop"):
        files.export_csv(bad, path, mode="overwrite")
    assert files.read_extract(spark, path).count() == 3
    assert [n for n in os.listdir(os.path.dirname(path)) if n != "extract"] == []
    files.export_csv(spark.range(5), path, mode="overwrite", single_file=True)
    assert files.read_extract(spark, path).count() == 5 and len(glob.glob(f"{path}/part-*")) == 1
    with pytest.raises(ValueError):
        files.export_csv(one, path, mode="append")


def test_a_publication_that_was_cut_off_is_undone(spark, monkeypatch):
    path = f"{_scratch()}/extract"
    files.export_csv(spark.range(3), path)
    renamed = []

    def dies(spark, at, to):
        if renamed:
            raise KeyboardInterrupt
        renamed.append(at)
        return session.rename(spark, at, to)

    monkeypatch.setattr(files, "rename", dies)
    with pytest.raises(KeyboardInterrupt):
        files.export_csv(spark.range(8), path, mode="overwrite")
    monkeypatch.undo()
    assert not os.path.exists(path)
    assert files.read_extract(spark, path).count() == 3


def test_files_are_staged_once_for_a_state_of_the_tables(spark, tmp_path):
    first = catalog.staged_trip_files(spark, SF0001)
    made = os.path.getmtime(first)
    assert catalog.staged_trip_files(spark, SF0001) == first and os.path.getmtime(first) == made
    source, calls = tmp_path / "source", []
    source.mkdir()
    (source / "a").write_text("1")

    def make(path):
        calls.append(path)
        spark.range(2).write.parquet(path)

    one = session.made_once(spark, "t", [str(source)], make)
    assert session.made_once(spark, "t", [str(source)], make) == one and len(calls) == 1
    (source / "b").write_text("2")
    assert session.made_once(spark, "t", [str(source)], make) != one and len(calls) == 2

    def fails(path):
        spark.range(2).write.parquet(path)
        raise RuntimeError

    (source / "c").write_text("3")
    with pytest.raises(RuntimeError):
        session.made_once(spark, "t", [str(source)], fails)
    assert not [n for n in os.listdir(os.path.dirname(one)) if n.startswith(".t-")]


def test_a_changed_month_rewrites_its_partition_only(spark, trips_small):
    d = tempfile.mkdtemp(prefix="ridelens-refresh-")
    landing, table = f"{d}/landing", f"{d}/table"
    some = trips_small.filter(F.year("startTime") == 1995)
    files.write_trip_files(some, landing)
    months = refresh_cohort(spark, landing, table)
    assert len(months) > 6 and refresh_cohort(spark, landing, table) == []
    written = {p: os.path.getmtime(p) for p in glob.glob(f"{table}/month=*/part-*")}
    month = months[3]
    files.write_trip_files(some.filter(F.date_format("startTime", "yyyyMM") == month).limit(40), landing, mode="append")
    assert refresh_cohort(spark, landing, table) == [month]
    after = {p: os.path.getmtime(p) for p in glob.glob(f"{table}/month=*/part-*")}
    assert {p for p in written if after.get(p) != written[p]} == {p for p in written if f"month={month}/" in p}
    full = clean_cohort(files.read_trip_csv(spark, landing).select(*TRIP_COLUMNS))
    got = spark.read.parquet(table).select(*full.columns)
    assert got.count() == full.count() and got.exceptAll(full).count() == 0
    # a month that goes, and another rule, which concerns all of them
    for file in glob.glob(f"{landing}/month={months[0]}/*"):
        os.remove(file)
    assert refresh_cohort(spark, landing, table) == [months[0]] and not glob.glob(f"{table}/month={months[0]}")
    assert refresh_cohort(spark, landing, table, as_of_year=2010) == months[1:]


def test_sketches_merge(spark, cohort_small):
    sketches = fleet.bike_sketches(cohort_small)
    exact = fleet.distinct_bikes(cohort_small).first()[0]
    assert abs(fleet.distinct_bikes_of(sketches).first()[0] - exact) <= 0.03 * exact + 1
    some = sketches.filter("month >= '1996'")
    want = fleet.distinct_bikes(cohort_small.filter("startTime >= '1996-01-01'")).first()[0]
    assert abs(fleet.distinct_bikes_of(some).first()[0] - want) <= 0.03 * want + 1
    assert fleet.distinct_bikes_of(sketches.limit(0)).first()[0] == 0


def test_layouts_are_compressed_and_hold_all_trips(spark):
    root = catalog.files_in_layouts(spark, SF0001)
    parts = [p for p in headers.data_files(spark, root) if "part-" in p]
    assert parts and all(p.endswith(".csv.gz") for p in parts)
    ledger = {r.status: r.Num for r in catalog.QUERIES["file_ledger"](spark, SF0001).collect()}
    assert sum(ledger.values()) == catalog.trips(spark, SF0001).count() and set(ledger) == {"standard", "by name", "unknown header"}
