"""Incremental ingest: new monthly files are appended exactly once."""

from __future__ import annotations

import glob
import tempfile

from pyspark.sql import functions as F

from ridelens.operators.cohort import clean_cohort
from ridelens.sources.files import read_trip_csv, read_trip_text, write_trip_files
from ridelens.streaming.ingest import start_cohort_ingest


def _run(spark, landing, table, ckpt, max_files=None):
    q = start_cohort_ingest(spark, landing, table, ckpt, f"{table}-rejects", max_files_per_trigger=max_files)
    q.awaitTermination()
    assert q.exception() is None
    return spark.read.parquet(table).count()


def test_ingest_is_incremental_and_exactly_once(spark, trips_small):
    d = tempfile.mkdtemp(prefix="ridelens-stream-")
    landing, table, ckpt = f"{d}/landing", f"{d}/table", f"{d}/ckpt"
    year = F.year("startTime")
    first = trips_small.filter(year == 1995)
    second = trips_small.filter(year == 1996)

    write_trip_files(first, f"{landing}/drop1")
    n1 = _run(spark, landing, table, ckpt)
    assert n1 == clean_cohort(first).count()

    write_trip_files(second, f"{landing}/drop2")
    n2 = _run(spark, landing, table, ckpt, max_files=2)  # bounded micro-batches
    assert n2 == n1 + clean_cohort(second).count()

    assert _run(spark, landing, table, ckpt) == n2  # nothing new -> nothing appended
    months = {r.month for r in spark.read.parquet(table).select("month").distinct().collect()}
    assert all(str(m).startswith(("1995", "1996")) for m in months)
    assert spark.read.parquet(f"{table}-rejects").count() == 0
    # Rebalanced: a batch writes a file or two for a month, not one from every task.
    for month in glob.glob(f"{table}/batch=*/month=*"):
        assert len(glob.glob(f"{month}/part-*.parquet")) <= 2

    with open(f"{landing}/drop3.csv", "w") as f:
        f.write("h\n" + '"ten","1995-01-01 00:00:00.0000"\n')
    assert _run(spark, landing, table, ckpt) == n2
    bad = spark.read.parquet(f"{table}-rejects").collect()
    assert len(bad) == 1 and bad[0].line.startswith('"ten"') and not bad[0].duration_ok


def test_ingest_reads_by_header_names(spark, trips_small):
    d = tempfile.mkdtemp(prefix="ridelens-stream-")
    write_trip_files(trips_small.filter(F.year("startTime") == 1995), f"{d}/plain")
    plain = read_trip_text(spark, f"{d}/plain")
    names = plain.columns[:15]
    turned = names[::-1]
    plain.select(*turned).write.option("header", True).option("quoteAll", True).csv(f"{d}/landing/turned")
    with open(f"{d}/landing/other.csv", "w") as f:
        f.write("a,b\n1,\u0001x\n2,y\n")
    q = start_cohort_ingest(spark, f"{d}/landing", f"{d}/table", f"{d}/ckpt", f"{d}/rejects", ledger_dir=f"{d}/ledger")
    q.awaitTermination()
    assert q.exception() is None
    want = clean_cohort(read_trip_csv(spark, f"{d}/plain"))
    got = spark.read.parquet(f"{d}/table").select(*want.columns)
    assert got.count() == want.count() > 0 == got.exceptAll(want).count()
    assert {r.line for r in spark.read.parquet(f"{d}/rejects").collect()} == {"1,\u0001x", "2,y"}
    status = {r.status for r in spark.read.parquet(f"{d}/ledger").collect()}
    assert status - {"empty"} == {"by name", "unknown header"}
