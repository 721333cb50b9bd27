"""A hot key (one customer owning a third of all orders) is split, not funnelled.

Small tables with the driver tables' schemas are written to a scratch folder; the
trip adapter runs on them with broadcasting disabled (as for tables far above any
broadcast threshold) and AQE's skew thresholds lowered to this data size.
"""

from __future__ import annotations

import datetime as dt
import re
import tempfile

import pytest
from pyspark.sql import functions as F

from ridelens.operators import fleet
from ridelens.operators.cohort import clean_cohort
from ridelens.plans.inspect import plan_text
from ridelens.sources.tables import trips_from_tables

N_ORDERS = 30000
HOT_CUSTOMER = 1  # birth year 1962 under the mapping, so its orders survive the age rule


@pytest.fixture(scope="module")
def skewed_dir(spark):
    d = tempfile.mkdtemp(prefix="ridelens-skew-")
    orders = spark.range(1, N_ORDERS + 1).select(
        F.col("id").alias("o_orderkey"),
        # every third order belongs to the hot customer
        F.when(F.col("id") % 3 == 0, F.lit(HOT_CUSTOMER)).otherwise(F.col("id") % 997 + 1000)
        .cast("long").alias("o_custkey"),
    )
    customer = spark.range(1000, 1997).union(spark.createDataFrame([(HOT_CUSTOMER,)], "id long"))
    customer = customer.select(
        F.col("id").alias("c_custkey"),
        F.lit(1).cast("int").alias("c_nationkey"),
        F.lit("BUILDING").alias("c_mktsegment"),
    )
    lineitem = spark.range(1, N_ORDERS + 1).select(
        F.col("id").alias("l_orderkey"),
        (F.col("id") % 500).alias("l_partkey"),
        F.lit(1).cast("int").alias("l_linenumber"),
        F.lit(10.0).alias("l_quantity"),
        F.lit(dt.datetime(1996, 3, 1)).cast("timestamp_ntz").alias("l_shipdate"),
    )
    for name, df in [("orders", orders), ("customer", customer), ("lineitem", lineitem)]:
        df.repartition(4).write.parquet(f"{d}/{name}.parquet")
    return d


def test_hot_customer_join_is_split(spark, skewed_dir):
    conf = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1k",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    old = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        trips = trips_from_tables(spark, skewed_dir)
        usage = fleet.bike_usage(clean_cohort(trips))
        rows = usage.collect()
        final = plan_text(usage, "simple")
    finally:
        for k, v in old.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)
    assert re.search(r"SortMergeJoin.*isSkewJoin=true|SortMergeJoin\(skew=true\)", final)
    # results stay whole: every trip of the cohort is counted exactly once
    assert sum(r.Num for r in rows) == clean_cohort(trips_from_tables(spark, skewed_dir)).count()
