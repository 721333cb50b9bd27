"""Order of reports, null times, fresh file listings, and where intermediate files may go."""

from __future__ import annotations

import shutil
import tempfile

import pytest
from pyspark.sql import functions as F

from ridelens import session
from ridelens.operators import demand, distance, fleet, riders
from ridelens.operators.cohort import derive
from ridelens.plans import catalog

from .conftest import SF0001, trip

ORDERED = {
    "top_destinations_by_band": (demand.top_destinations_by_band, ["Time", "rank"]),
    "hourly_usage": (demand.hourly_usage, ["gender", "DayType", "Type", "Hour"]),
    "age_band_share": (riders.age_band_share, ["userType", "ageGroup"]),
    "usertype_share_by_age": (riders.usertype_share_by_age, ["ageS"]),
    "distance_stats": (distance.distance_stats, ["Age", "gender"]),
    "avg_speed": (distance.avg_speed, ["Age", "gender"]),
}


@pytest.mark.parametrize("name", ORDERED)
def test_reports_are_ordered(cohort_small, name):
    report, keys = ORDERED[name]
    rows = [tuple(r[k] for k in keys) for r in report(cohort_small).collect()]
    assert rows == sorted(rows)


@pytest.mark.parametrize("report", [fleet.most_used_bikes, fleet.most_hours_bikes])
def test_top_lists_are_ordered(cohort_small, report):
    rows = [(-(r["HoursUsed"] if "HoursUsed" in r else r["Num"]), r["bikeID"]) for r in report(cohort_small).collect()]
    assert rows == sorted(rows)


def test_null_times_have_no_day_type_and_no_hour(make_trips):
    rows = [trip(bikeID=i) for i in range(4)] + [trip(startTime=None), trip(endTime=None)]
    cohort = derive(make_trips(rows))
    used = demand.hourly_usage(cohort).collect()
    assert all(r.Hour is not None and r.Num > 0 and r.DayType for r in used)
    peak = {r.Type: (r.lowNum, r.lowHighRatio) for r in demand.peak_hours(cohort).collect()}
    assert peak == {"Leaving": (5, 1.0), "Arriving": (5, 1.0)}
    assert sum(r.Num for r in demand.day_type_counts(cohort).collect()) == 5
    assert sum(r.Num for r in demand.hourly_usage_union(cohort).collect()) == 10


def test_appended_files_are_seen(spark):
    d = tempfile.mkdtemp(prefix="ridelens-test-")
    for t in ("orders", "customer"):
        shutil.copy(f"{SF0001}/{t}.parquet", f"{d}/{t}.parquet")
    spark.read.parquet(f"{SF0001}/lineitem.parquet").write.parquet(f"{d}/lineitem.parquet")
    count = lambda: catalog.QUERIES["row_counts"](spark, d).first().rawRows
    n = count()
    spark.read.parquet(f"{SF0001}/lineitem.parquet").write.mode("append").parquet(f"{d}/lineitem.parquet")
    assert count() == 2 * n
    staged = catalog.QUERIES["union_months"](spark, d).agg(F.sum("Num")).first()[0]
    assert staged == 2 * n


class _Cluster:
    """What the checkpoint rule reads of a session."""

    def __init__(self, master, folder=None):
        self.master, self.folder, self.conf, self.sparkContext = master, folder, self, self

    def get(self, key, default=None):
        return self.folder if key == "spark.checkpoint.dir" else default

    def set(self, key, value):
        self.folder = value

    def getConf(self):
        return self

    def getCheckpointDir(self):
        return None

    def setCheckpointDir(self, path):
        self.folder = path


@pytest.mark.parametrize("master", ["yarn", "spark://host:7077", "local-cluster[3,2,1024]", "k8s://https://x"])
def test_a_cluster_without_a_shared_folder_is_refused(master):
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.ensure_checkpoint_dir(_Cluster(master))
    assert session.ensure_checkpoint_dir(_Cluster(master, "hdfs:///x")) == "hdfs:///x"


def test_a_local_master_gets_a_folder():
    assert "ridelens-ckpt-" in session.ensure_checkpoint_dir(_Cluster("local[4]"))


def test_staged_folders_can_be_removed(spark):
    path = session.shared_path(spark, "x")
    spark.range(3).write.parquet(path)
    assert session.path_exists(spark, path) and "_SUCCESS" in session.child_names(spark, path)
    kept = [p for p in session._MADE if p != path]
    session._MADE[:] = [path]
    assert session.remove_staged(spark) == 1 and not session.path_exists(spark, path)
    session._MADE[:] = kept
