"""Pattern automaton, live counters, parse errors, windows with late rows."""

import random

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from tidewatch.functions import scalars as S
from tidewatch.functions.patterns import PatternTable
from tidewatch.operators import stats
from tidewatch.operators.parse import error_report, parse_logs, with_parse_error
from tidewatch.session import scratch_path
from tidewatch.streaming import jobs

# --- patterns ----------------------------------------------------------------------------------


def words(rng, n, letters="abcé /."):
    return ["".join(rng.choices(letters, k=rng.randint(0, 9))) for _ in range(n)]


def test_automaton_equals_one_search_for_each_pattern():
    rng = random.Random(3)
    patterns = tuple(dict.fromkeys([*words(rng, 400), "aa", "a", "aab", "ab", "b", "é", "日本"]))
    texts = ["".join(rng.choices("abcé /.", k=rng.choice([0, 1, 5, 40, 300]))) for _ in range(200)] + ["日本語", "", "a\x00b"]
    rows, which = PatternTable(patterns).find([t.encode() for t in texts])
    want = [(i, k) for i, t in enumerate(texts) for k, p in enumerate(patterns) if p in t]
    assert list(zip(rows.tolist(), which.tolist())) == want
    assert PatternTable(()).find([b"x"])[0].tolist() == [] and PatternTable(("x",)).find([])[0].tolist() == []


def test_five_thousand_patterns_give_the_plain_counts(spark):
    rng = random.Random(5)
    patterns = [f"{a}{i}" for i, a in enumerate(words(rng, 5000, "aBc/"))]
    lines = [(i, f"/{rng.choice(patterns).upper()}", f"{rng.choice(patterns)} {i}") for i in range(300)] + [(300, None, None), (301, "", None)]
    df = spark.createDataFrame(lines, "line_no bigint, path string, raw string")
    found = df.select("line_no", S.count_tokens(F.col("path"), F.col("raw"), patterns).alias("n"), S.first_token(F.col("path"), patterns).alias("first"))
    low = [p.lower() for p in patterns]
    for r, (_, path, raw) in zip(found.orderBy("line_no").collect(), lines):
        own = [p for p, q in zip(patterns, low) if q in (path or "").lower()]
        both = sum(q in (path or "").lower() or q in (raw or "").lower() for q in low)
        assert (r.n, r.first) == (both, own[0] if own else None)


def test_work_does_not_grow_with_the_patterns():
    texts = [f"/a/{i} get x{i * 7}".encode() for i in range(2000)]
    few, many = (PatternTable(tuple(f"q{i}z" for i in range(n))) for n in (100, 10_000))
    assert [x.tolist() for x in few.find(texts)] == [x.tolist() for x in many.find(texts)] == [[], []]
    # one look-up for each byte, whatever the number of patterns: same columns, larger table only
    assert many.table.shape[0] > few.table.shape[0] and many.table.shape[1] == few.table.shape[1]


# --- counters ----------------------------------------------------------------------------------


def flags(spark, n=30):
    return spark.range(n).selectExpr("id", "case when id = 7 then null else id % 5 = 0 end as anomaly")


def test_counters_fill_while_rows_are_written(spark):
    counters = Observation("rows")
    spark.sparkContext.setJobGroup("observed", "one job")
    stats.observed(flags(spark), counters).write.parquet(scratch_path(spark, "observed"))
    jobs_run = len(spark.sparkContext.statusTracker().getJobIdsForGroup("observed"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert counters.get == {"total": 30, "anomalies": 6} and jobs_run == 1


def source(spark, df, files, key="id"):
    path = scratch_path(spark, "source")
    for i in range(files):
        df.filter(F.col(key) % files == i).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_counters_of_a_stream_add_up_and_repeated_batches_count_once(spark):
    counters = stats.LiveCounters("rows")
    spark.streams.addListener(counters)
    try:
        jobs.run_available(stats.observed(source(spark, flags(spark), 3), "rows"), "observed")
        assert jobs.settled(counters) == {"total": 30, "anomalies": 6, "anomaly_rate": 0.2}
        assert len(counters.batches) == 3
    finally:
        spark.streams.removeListener(counters)
    event = type("E", (), {})()
    event.progress = type("P", (), {"id": "q", "batchId": 0, "observedMetrics": {"rows": {"total": 4, "anomalies": 1}}})()
    again = stats.LiveCounters("rows")
    for _ in range(2):
        again.onQueryProgress(event)
    assert again.counts() == {"total": 4, "anomalies": 1, "anomaly_rate": 0.25}
    assert stats.LiveCounters("other").counts() == {"total": 0, "anomalies": 0, "anomaly_rate": 0.0}


# --- parse errors ------------------------------------------------------------------------------


def test_parse_errors_name_the_reason(spark, logs_of):
    good = '1.2.3.4 - - [02/Mar/2024:10:00:00 +0000] "GET /a HTTP/1.1" 200 5 "-" "x"'
    lines = [good, "", "  ", "no request", good.replace(" 200 ", " 999 "), good.replace(" 200 ", " 5000 ")]
    parsed = parse_logs(logs_of(lines), format="nginx")
    found = {r.line_no: r.parse_error for r in with_parse_error(parsed).collect()}
    assert found == {0: None, 1: "blank line", 2: "blank line", 3: "format does not fit", 4: "status out of range", 5: "status out of range"}
    report = sorted(map(tuple, error_report(parsed).collect()))
    assert report == [("blank line", 2, 1), ("format does not fit", 1, 3), ("status out of range", 2, 4)]
    assert error_report(parsed.limit(0)).count() == 0


# --- late rows ---------------------------------------------------------------------------------


def test_windows_take_late_rows_inside_the_delay_only(spark):
    path = scratch_path(spark, "late")
    schema = "ip string, event_ts timestamp"
    # minutes of the rows of four micro-batches; the delay is an hour
    batches = [[0, 10, 130], [125, 75, 90], [300], [45, 250, 600]]
    for minutes in batches:
        rows = spark.createDataFrame([("a", m) for m in minutes], "ip string, m int")
        rows.selectExpr("ip", "timestamp_micros(1704067200000000 + m * 60000000L) as event_ts").coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    found = jobs.run_available(jobs.stream_ip_window(stream, minutes=30, slide=30, lateness="60 minutes"), "windows")
    counts = {(r.window_start.timestamp() - 1704067200) / 60: r.requests for r in found.collect()}
    # after 130 the mark is at 70: 75 and 90 come late but inside, 45 comes when its window is closed
    assert counts == {0: 2, 60: 1, 90: 1, 120: 2, 240: 1, 300: 1}
    assert len(found.collect()) == len(counts)  # each window is written once


@pytest.mark.parametrize("minutes, slide, lateness", [(60, 5, "2 hours"), (25, 10, "45 minutes")])
def test_stored_windows_equal_those_of_the_streaming_plan(spark, minutes, slide, lateness):
    path, rng = scratch_path(spark, "late"), random.Random(minutes)
    for k in range(4):
        rows = [(rng.choice(["a", "b", None]), None if rng.random() < 0.1 else k * 70 + rng.randint(-150, 150)) for _ in range(40)]
        made = spark.createDataFrame(rows, "ip string, m int")
        made.selectExpr("ip", "timestamp_micros(1704067200123456 + m * 60000000L) as event_ts").coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema("ip string, event_ts timestamp").option("maxFilesPerTrigger", 1).parquet(path)
    plan = jobs.stream_ip_window(stream, minutes, slide, lateness)
    for mode in ("append", "complete"):
        want = jobs.run_available(plan, "plan", mode).collect()
        found = jobs.run_ip_windows(stream, "stored", minutes, slide, lateness, mode).collect()
        assert want and sorted(map(str, found)) == sorted(map(str, want))


def test_window_state_has_a_row_for_each_slice_and_not_for_each_window(spark):
    from tidewatch.streaming.store import WindowStore

    rows = spark.range(500).selectExpr("cast(id % 100 as string) as ip", "timestamp_micros(1704067200000000 + id * 60000000) as event_ts")
    store = WindowStore(spark, scratch_path(spark, "windows"))
    store.add(rows, 0)
    store.add(rows, 0)  # a repeated micro-batch is added once
    assert store.slices().count() == 500 and store.windows(store.slices()).count() == 500 * 12


@pytest.mark.parametrize("delay, kept", [("2 hours", ["a", "b"]), ("1 minute", ["a", "a", "b"])])
def test_copies_are_recognised_within_the_delay(spark, delay, kept):
    path = scratch_path(spark, "copies")
    for line, minute in (("a", 0), ("b", 50), ("a", 60)):
        row = spark.createDataFrame([(line, minute)], "line string, m int")
        row.selectExpr("line", "timestamp_micros(1704067200000000 + m * 60000000L) as event_ts").write.mode("append").parquet(path)
    stream = spark.readStream.schema("line string, event_ts timestamp").option("maxFilesPerTrigger", 1).parquet(path)
    found = jobs.run_available(jobs.stream_dedup(stream, delay=delay), "dedup")
    assert sorted(r.line for r in found.collect()) == kept


# --- running cutoff ----------------------------------------------------------------------------


@pytest.mark.parametrize("size", [64, 4096])
def test_running_cutoff_stays_inside_its_bound_after_every_batch(spark, size):
    rng = random.Random(size)
    batches = [[rng.gauss(k, 1 + k) for _ in range(4000)] for k in range(4)]
    path, found, state = (scratch_path(spark, x) for x in ("scores", "cutoffs", "state"))
    for values in batches:
        odd = [None, float("nan")]
        spark.createDataFrame([(v,) for v in values + odd], "score double").coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema("score double").option("maxFilesPerTrigger", 1).parquet(path)
    jobs.write_cutoffs(stream, 95.0, found, state, size=size).awaitTermination()
    cutoffs = {r.batch: r for r in spark.read.parquet(found).collect()}
    seen = []
    for k, values in enumerate(batches):
        seen += values
        below = sum(v <= cutoffs[k].cutoff for v in seen) / len(seen)
        assert cutoffs[k].n == len(seen) and abs(below - 0.95) <= 2 * jobs.rank_error(size)
    # the state that goes on from batch to batch is the sketch alone
    jobs.write_cutoffs(stream, 95.0, found, state, size=size).awaitTermination()
    assert spark.read.parquet(found).count() == len(batches)
