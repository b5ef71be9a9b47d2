"""Busy addresses: the running count of their seconds is split, and rows without a time stay."""

import re

from tidewatch.operators.ip_stats import STATISTICS, ip_statistics

SCHEMA = "line_no bigint, ip string, path string, event_us bigint"
SMALL = {"max_group_rows": 50, "chunk_rows": 30, "max_requests": 20}


def found(df, **options):
    rows = ip_statistics(df, window_minutes=5, **options).collect()
    return sorted((r.line_no, *(r[c] for c in STATISTICS)) for r in rows)


def test_no_window_over_all_seconds_of_an_address(spark):
    df = spark.createDataFrame([(i, "a", f"/{i % 7}", 10**15 + i * 10**9) for i in range(300)], SCHEMA)
    plan = ip_statistics(df, **SMALL)._jdf.queryExecution().optimizedPlan().toString()
    # windows of an address alone run over its hours or chunks; those over seconds have the hour beside it
    whole = re.findall(r"\[ip#\d+\], \[(\w+)#\d+L? ASC", plan)
    assert whole and not {"_second", "_upto"} & set(whole) and "_hour#" in plan
    assert found(df, **SMALL) == found(df, strategy="hash", max_requests=20)


def test_rows_without_a_time_stay(spark):
    rows = [(i, "a", f"/{i % 7}", None if i % 9 == 0 else 10**15 + i * 700_000) for i in range(400)]
    rows += [(1000 + i, None, "/n", 10**15 + i) for i in range(100)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert len(found(df, **SMALL)) == len(rows)
    assert found(df, **SMALL) == found(df, strategy="hash", max_requests=20)
