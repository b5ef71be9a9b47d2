"""Address statistics where a few addresses are busy: routed in one plan, nothing run before an action."""

import random

import pytest

from test_order import replay, requests
from tidewatch.operators.ip_stats import ip_statistics

SCHEMA = "line_no bigint, ip string, path string, event_us bigint"


def statistics(df, **options):
    rows = ip_statistics(df, **options).collect()
    return {r["line_no"]: (r["ip_frequency"], r["ip_path_diversity"], round(r["ip_request_rate"], 9)) for r in rows}


@pytest.mark.parametrize("chunk, cap, minutes", [(1, 50, 60), (7, 50, 60), (40, 50, 1), (500, 1000, 60), (100, 1, 60)])
def test_busy_addresses_cut_by_time_equal_replay(spark, chunk, cap, minutes):
    rows = requests(2500, seed=chunk)
    # a burst in one second, and rows inside a second out of line order
    rows += [(10_000 + i, "unknown", f"/b{i % 9}", 1_704_067_200_000_000 + 30_000_000 + (i * 7919) % 1_000_000) for i in range(300)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    found = statistics(df, max_group_rows=200, chunk_rows=chunk, max_requests=cap, window_minutes=minutes)
    assert found == replay(rows, minutes, cap)


def test_one_busy_address_among_many(spark):
    rng = random.Random(5)
    rows = [(i, "busy" if i % 3 == 0 else f"a{rng.randrange(4000)}", f"/{rng.randrange(60)}", 10**15 + i * 400_000) for i in range(9000)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert statistics(df, max_group_rows=1000, chunk_rows=250, max_requests=100) == replay(rows, 60, 100)
    # the quiet ones are placed by address, the busy one by chunk as well
    plan = ip_statistics(df, max_group_rows=1000)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(_chunk" in plan and "hashpartitioning(ip" in plan


def test_no_job_before_an_action(spark):
    df = spark.createDataFrame(requests(300), SCHEMA)
    spark.sparkContext.setJobGroup("routing", "statistics")
    try:
        found = ip_statistics(df, max_group_rows=50, chunk_rows=20)
        assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("routing")) == 0
        assert found.count() == 300
        assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("routing")) > 0
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_other_columns_pass_and_empty_tables_stay_empty(spark):
    df = spark.createDataFrame(requests(60), SCHEMA).selectExpr("*", "line_no * 2 as extra")
    for options in ({}, {"max_group_rows": 10, "chunk_rows": 5}):
        found = ip_statistics(df, **options)
        assert sorted(found.columns) == sorted([*df.columns, "ip_frequency", "ip_path_diversity", "ip_request_rate"])
        assert found.filter("extra != line_no * 2").isEmpty() and found.count() == 60
        assert ip_statistics(df.limit(0), **options).count() == 0
