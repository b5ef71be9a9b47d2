"""Address statistics of a stream through the store, beside the batch operator."""

import shutil

import pytest
from pyspark.sql import functions as F

from tidewatch.operators.ip_stats import ip_statistics
from tidewatch.operators.ordering import number_rows
from tidewatch.session import scratch_path
from tidewatch.streaming import store as store_module
from tidewatch.streaming.ip_stats import write_ip_statistics
from tidewatch.streaming.store import AddressStore


def events(spark, sf_dir):
    """Two hot addresses, many cold ones, gaps longer than the look-back."""
    return spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr(
        "event_id as line_no",
        "case when event_id % 3 < 2 then concat('hot', event_id % 3) else concat('cold', user_id % 40) end as ip",
        "1704067200000000 + (cast(floor(event_id * 0.6) as bigint) + event_id div 300 * 5000) * 1000000 as event_us",
        "concat('/', event_type, '/', event_id % 37 + event_id div 400) as path",
    )


def source(spark, df, files):
    path, total = scratch_path(spark, "source"), df.count()
    numbered = number_rows(df, ["event_us", "line_no"], "_pos")
    for i in range(files):
        part = numbered.filter(F.floor(F.col("_pos") * files / total) == i).select(*df.columns)
        part.coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def rounded(df):
    rows = df.select("line_no", "ip", "path", "event_us", "ip_frequency", "ip_path_diversity", F.round("ip_request_rate", 9))
    return sorted(map(tuple, rows.collect()))


@pytest.mark.parametrize("whole, options", [(32, {}), (2, {"chunk_rows": 60, "max_group_rows": 20})])
def test_stored_statistics_equal_batch(spark, sf_dir, monkeypatch, whole, options):
    monkeypatch.setattr(store_module, "WHOLE", whole)
    df = events(spark, sf_dir)
    store = AddressStore(spark, scratch_path(spark, "addresses"), max_requests=50)
    path, state = scratch_path(spark, "found"), scratch_path(spark, "state")
    stream = source(spark, df, 4)
    write_ip_statistics(stream, store, path, state, **options).awaitTermination()
    found = spark.read.parquet(f"{path}/batch=*")
    assert rounded(found) == rounded(ip_statistics(df, max_requests=50))
    # the state of an address is bounded by its last requests and one count
    tail = store._last("tail", store_module._TAIL, None).groupBy("ip").count()
    assert tail.agg(F.max("count")).first()[0] <= 50
    counts = {r.ip: r.paths for r in store._last("counts", store_module._PATHS, None).collect()}
    paths = df.groupBy("ip").agg(F.countDistinct("path").alias("n")).collect()
    assert counts == {r.ip: r.n for r in paths}
    if whole == 2:
        assert store._complete("whole") == [2]


def test_a_repeated_batch_gives_the_same(spark, sf_dir):
    df = events(spark, sf_dir).filter("line_no < 300")
    first = df.withColumn("_debut", F.lit(False))
    new = df.select("ip", "path").distinct()
    new = new.select(F.lit(0).cast("bigint").alias("line_no"), "ip", F.lit(0).cast("bigint").alias("event_us"), "path", F.lit(True).alias("_debut"))
    both = first.unionByName(new)
    store = AddressStore(spark, scratch_path(spark, "addresses"))
    one = rounded(store.statistics(both, 0))
    kept = sorted(map(tuple, store._last("counts", store_module._PATHS, None).collect()))
    assert rounded(store.statistics(both, 0)) == one == rounded(ip_statistics(df))
    shutil.rmtree(f"{store.path}/version=0/counts")  # cut short before its marker
    assert store.latest() == -1 and rounded(store.statistics(both, 0)) == one
    assert sorted(map(tuple, store._last("counts", store_module._PATHS, None).collect())) == kept
    assert store.statistics(both.limit(0), 1).count() == 0 and store.latest() == 1
