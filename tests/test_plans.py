"""Plan properties that matter at scale, asserted on the physical plans."""

from __future__ import annotations

import pytest

from ridelens.plans import inspect as I
from ridelens.plans.catalog import QUERIES

from .conftest import SF0001

# Queries whose work is pure DataFrame/SQL (no files staged, no model fitted).
PLAN_QUERIES = [
    "top_destinations_by_band", "hourly_usage", "usertype_share_by_age", "age_band_share",
    "most_used_bikes", "most_hours_bikes", "bike_daily_rate", "distance_stats", "avg_speed",
    "speed_gender_gap", "peak_hours", "cleaning_funnel", "gender_share", "trip_speed",
    "bikes_in_both_top10",
]


@pytest.mark.parametrize("name", PLAN_QUERIES)
def test_no_python_no_cartesian_one_scan_per_table(spark, name):
    df = QUERIES[name](spark, SF0001)
    assert not I.has_python_eval(df), name
    assert not I.has_cartesian(df), name
    scans = {t: I.count_scans(df, t) for t in ("lineitem", "orders", "customer")}
    if name in ("bikes_in_both_top10", "bike_daily_rate"):
        # two top-k lists / a scalar subquery: at most one scan per consumer
        assert all(1 <= v <= 2 for v in scans.values()), scans
    else:
        assert scans == {"lineitem": 1, "orders": 1, "customer": 1}, scans


def test_column_pruning(spark):
    df = QUERIES["top_destinations_by_band"](spark, SF0001)
    schemas = I.read_schemas(df)
    li = [s for s in schemas if "l_orderkey" in s][0]
    assert li.count(":") == 5  # 5 of lineitem's 11 columns
    assert not any("c_name" in s or "o_totalprice" in s for s in schemas)


def test_conditional_aggregate_has_no_extra_join(spark):
    share = QUERIES["usertype_share_by_age"](spark, SF0001)
    joins = I.count_operator(share, "BroadcastHashJoin") + I.count_operator(share, "SortMergeJoin")
    assert joins == 2  # only the two joins of the table adapter


def test_hourly_usage_single_aggregate(spark):
    df = QUERIES["hourly_usage"](spark, SF0001)
    assert I.count_operator(df, "HashAggregate") == 2  # partial + final
    assert I.count_operator(df, "Union") == 0


def test_at_scale_join_shape(spark):
    """With no side broadcastable (large tables), lineitem is exchanged once, on orderkey."""
    import re

    from ridelens.operators.cohort import clean_cohort
    from ridelens.operators.demand import top_destinations_by_band
    from ridelens.sources.tables import trips_from_tables

    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = top_destinations_by_band(clean_cohort(trips_from_tables(spark, SF0001)))
        text = I.plan_text(df)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert I.count_operator(df, "SortMergeJoin") == 2
    keys = re.findall(r"hashpartitioning\(([a-z_]+)#", text)
    assert keys.count("l_orderkey") == 1  # the big table moves once
    assert keys.count("o_custkey") == 1 and keys.count("c_custkey") == 1
    assert keys.count("o_orderkey") == 1  # riders re-keyed by order, not lineitem by customer
    assert "BroadcastExchange" not in text
