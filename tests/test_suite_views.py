"""All questions from one materialised cohort; SQL views over trips."""

from __future__ import annotations

import pytest

from ridelens.functions.sql import register_sql_functions, register_views
from ridelens.operators import demand
from ridelens.plans import suite
from ridelens.plans.inspect import count_scans

from .conftest import SF0001


@pytest.mark.parametrize("mode", ["table", "persist"])
def test_suite_modes_agree(spark, trips_small, cohort_small, mode):
    seen = []
    c = suite.run_all(spark, SF0001, sink=lambda df: seen.append(df.count()), mode=mode, with_model=False)
    assert len(seen) == len(suite.questions(cohort_small))
    if mode == "table":
        # lineage cut: questions read the written cohort, not the three tables
        q = demand.top_destinations_by_band(c)
        assert count_scans(q, "lineitem") == 0
        cols = [x for x in c.columns if x != "month"]
        assert c.select(*cols).exceptAll(cohort_small).count() == 0
        assert cohort_small.exceptAll(c.select(*cols)).count() == 0
    want = sorted(map(tuple, demand.top_destinations_by_band(cohort_small).collect()))
    got = sorted(map(tuple, demand.top_destinations_by_band(c).collect()))
    assert got == want


def test_views_and_sql(spark, trips_small, cohort_small):
    register_sql_functions(spark)
    register_views(spark, trips_small)
    n = spark.sql("SELECT count(*) FROM trips").first()[0]
    assert n == cohort_small.count()
    raw = spark.sql("SELECT count(*) FROM trips_raw WHERE to_gender(gender) <> 'Unknown'").first()[0]
    assert raw == trips_small.filter("gender IN (1, 2)").count()
    bands = spark.sql(
        "SELECT time_band(hour(endTime)) AS band, count(*) AS n FROM trips GROUP BY 1"
    ).collect()
    assert sum(r.n for r in bands) == n
