"""Windows, global order, selection and quantiles against plain Python."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.operators import ordering, prep, quantiles, stats
from tidewatch.operators.ip_stats import ip_statistics, moving_average
from tidewatch.session import freeze


def replay(rows, minutes=60, cap=1000):
    """One request at a time with the last ``cap`` times and the set of paths per address."""
    times, paths, out = {}, {}, {}
    for line_no, ip, path, us in sorted(rows, key=lambda r: (r[3], r[0])):
        seen = times.setdefault(ip, [])
        seen.append(us)
        del seen[:-cap]
        paths.setdefault(ip, set()).add(path)
        recent = [t for t in seen if t > us - minutes * 60_000_000]
        rate = len(recent) / max((recent[-1] - recent[0]) / 60e6, 1) if len(recent) > 1 else 0
        out[line_no] = (len(recent), len(paths[ip]), round(rate, 9))
    return out


def requests(n, seed=1):
    """One address holds most rows, with many equal times and quiet gaps."""
    rng = random.Random(seed)
    base = 1_704_067_200_000_000
    rows, clock = [], 0
    for i in range(n):
        clock += rng.choice([0, 0, 0, 1, 7, 2000 if i % 97 == 0 else 3]) * 1_000_000
        ip = "unknown" if rng.random() < 0.7 else f"10.0.0.{rng.randrange(5)}"
        rows.append((i, ip, f"/p{int(rng.paretovariate(0.7)) % 500}", base + clock))
    return rows


@pytest.mark.parametrize(
    "options",
    [
        {"strategy": "hash"},
        {"strategy": "chunked", "chunk_rows": 60, "max_requests": 50},
        {"strategy": "chunked", "chunk_rows": 333, "max_requests": 50},
        {"strategy": "auto", "max_group_rows": 100, "max_requests": 50, "chunk_rows": 100},
        {"strategy": "chunked", "max_requests": 50, "window_minutes": 1, "chunk_rows": 49},
    ],
)
def test_ip_statistics_equals_replay(spark, options):
    rows = requests(3000)
    df = spark.createDataFrame(rows, "line_no bigint, ip string, path string, event_us bigint")
    found = {
        r["line_no"]: (r["ip_frequency"], r["ip_path_diversity"], round(r["ip_request_rate"], 9))
        for r in ip_statistics(df.repartition(3), **options).collect()
    }
    assert found == replay(rows, options.get("window_minutes", 60), options.get("max_requests", 1000))


def test_ip_statistics_uses_one_shuffle(spark):
    df = spark.createDataFrame(requests(10), "line_no bigint, ip string, path string, event_us bigint")
    plan = ip_statistics(df, strategy="hash")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


@pytest.mark.parametrize("n, window, chunk", [(50, 5, 7), (4, 5, 1000), (5, 5, 5), (30, 1, 4)])
def test_moving_average(spark, n, window, chunk):
    values = [random.Random(n).random() * i for i in range(n)]
    df = spark.createDataFrame(list(enumerate(values)), "i bigint, v double").repartition(3)
    found = [r["moving_average"] for r in moving_average(df, "v", ["i"], window, chunk_rows=chunk).orderBy("i").collect()]
    wanted = values
    if n >= window:
        wanted = [np.mean(values[max(0, i - window + 1) : i + 1]) for i in range(n)]
    assert found == pytest.approx(wanted)


def test_number_rows_is_dense(spark):
    df = spark.range(1000).selectExpr("id", "id % 3 as third").repartition(5)
    found = ordering.number_rows(df, ["third", "id"], "pos").collect()
    wanted = sorted(((r["third"], r["id"]) for r in found))
    assert [(r["third"], r["id"]) for r in sorted(found, key=lambda r: r["pos"])] == wanted
    assert sorted(r["pos"] for r in found) == list(range(1000))


def key(seed, i):
    return hashlib.md5(f"{seed}:{i}".encode()).hexdigest()


@pytest.mark.parametrize("n", [0, 1, 7, 499, 500, 800])
def test_sample_is_exact(spark, n):
    df = spark.range(500).selectExpr("id as line_no", "concat('line ', id) as line")
    found = {r["line_no"] for r in prep.sample(df, n, seed=9).collect()}
    assert found == set(sorted(range(500), key=lambda i: key(9, i))[:n])


@pytest.mark.parametrize("share", [0.0, 0.2, 0.5, 1.0])
def test_split_is_exact(spark, share):
    df = spark.range(333).selectExpr("id as line_no", "'same line' as line").repartition(4)
    found = {r["line_no"]: r["split"] for r in prep.split(df, share, seed=3).collect()}
    order = sorted(range(333), key=lambda i: key(3, i))
    train = set(order[: int(333 * (1 - share))])
    assert found == {i: "train" if i in train else "validation" for i in range(333)}


def test_split_moves_no_rows(spark):
    plan = prep.split(spark.range(9).selectExpr("id as line_no", "'x' as line"))
    text = plan._jdf.queryExecution().optimizedPlan().toString()
    assert "Repartition" not in text and "Sort" not in text


def test_prepare_order(spark):
    lines = ["short"] * 20 + [f"a line that is long enough {i % 40}" for i in range(300)]
    df = spark.createDataFrame(list(enumerate(lines)), "line_no bigint, line string")
    found = prep.prepare_training_data(df, max_samples=25).collect()
    train = [r for r in found if r["split"] == "train"]
    assert len(train) == 25 and len({r["line"] for r in train}) == 25
    validation = [r["line"] for r in found if r["split"] == "validation"]
    assert len(validation) == len(set(validation)) and all(len(x) >= 20 for x in validation)
    once = prep.prepare_training_data(df, dedup_first=True).collect()
    assert len({r["line"] for r in once}) == len(once) == 40


def test_guard(spark):
    with pytest.raises(ValueError):
        prep.require_samples(spark.range(10), 11)
    assert prep.require_samples(spark.range(11), 11).count() == 11


def test_lookup_beyond_the_broadcast_bound(spark, monkeypatch):
    rows = spark.range(2000).selectExpr("id", "if(id % 3 = 0, 'hot', concat('k', id % 50)) as k")
    words = spark.range(40).selectExpr("concat('k', id) as k", "id as v").union(
        spark.sql("select 'hot' as k, 999L as v")
    )
    small = sorted(map(tuple, ordering.lookup(rows, words, "k").collect()), key=str)
    monkeypatch.setattr(ordering, "BROADCAST_ROWS", 3)
    salted = ordering.lookup(rows, words, "k")
    assert sorted(map(tuple, salted.collect()), key=str) == small
    per_salt = ordering.lookup(rows.withColumn("p", F.lit(0)), words, "k", "left_semi")
    assert per_salt.count() == sum(1 for r in small if r[2] is not None)


@pytest.mark.parametrize("shape", ["uniform", "heavy", "ties", "two values"])
def test_quantiles_beyond_one_task(spark, shape):
    rng = np.random.default_rng(5)
    values = {
        "uniform": rng.random(4000),
        "heavy": np.exp(rng.normal(0, 30, 4000)),
        "ties": np.where(rng.random(4000) < 0.4, 7.0, rng.normal(size=4000)),
        "two values": (rng.random(4000) < 0.5).astype(float),
    }[shape]
    df = spark.createDataFrame([(float(v),) for v in values], "x double").repartition(4)
    asked = [0.0, 0.05, 0.25, 0.5, 0.733, 0.95, 1.0]
    found = quantiles.quantiles(df, "x", asked, gather=60).first()[0]
    assert found == pytest.approx(list(np.percentile(values, [100 * p for p in asked])), rel=1e-12)
    assert quantiles.quantiles(df, "x", asked).first()[0] == pytest.approx(found, rel=1e-9)


def test_thresholds(spark):
    values = np.random.default_rng(3).gamma(2.0, 5.0, 2000)
    df = spark.createDataFrame([(float(v),) for v in values], "score double")
    median = np.median(values)
    q1, q3 = np.percentile(values, [25, 75])
    wanted = {
        "percentile": np.percentile(values, 95),
        "mad": median + 3.5 * np.median(np.abs(values - median)),
        "iqr": q3 + 1.5 * (q3 - q1),
    }
    for method, value in wanted.items():
        for limit in (100, 10**6):
            assert quantiles.threshold(df, method, gather=limit).first()[0] == pytest.approx(value)
    assert quantiles.threshold(df, "static", value=4.0).first()[0] == 4.0
    with pytest.raises(ValueError):
        quantiles.threshold(df, "static")


def test_entropy(spark):
    df = spark.createDataFrame([("a",)] * 4 + [("b",)] * 2 + [("c",)] * 2, "v string")
    assert stats.entropy(df, "v").first()[0] == pytest.approx(1.5)
    assert stats.entropy(df.filter("false"), "v").first()[0] == 0.0

def test_stored_tables_leave_no_shuffle_files(spark):
    """Files of a stored job's shuffles go with the job, and a setting of the session stays as it was."""
    files = lambda: set(re.findall(r"shuffle_\d+_\d+_\d+\.data", spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString(" ")))
    before = files()
    stored = freeze(spark.range(10_000).groupBy((F.col("id") % 97).alias("k")).agg(F.count("*").alias("n")))
    assert not files() - before
    assert stored.agg(F.sum("n")).first()[0] == 10_000
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"
