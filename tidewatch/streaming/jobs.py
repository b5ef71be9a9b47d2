"""Streaming forms of detection, counters, windows, deduplication and template learning."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.operators.features import row_features
from tidewatch.operators.ordering import number_rows
from tidewatch.operators.parse import parse_logs
from tidewatch.operators.templates import signatures
from tidewatch.plans.detector import DetectorModel, record_fields
from tidewatch.session import freeze, scratch_path
from tidewatch.streaming.ip_stats import stream_ip_statistics, with_debuts
from tidewatch.streaming.store import AddressStore, TemplateStore, WindowStore


def stream_detect(model: DetectorModel, lines: DataFrame) -> DataFrame:
    """Scored and explained records of a stream of lines (``line_no``, ``line``, ``ingest_ts``).

    Parsing, lookups, scaling and scoring are the batch expressions; only the address statistics
    keep state.
    """
    cfg = model.config
    parsed = model.parse(lines).withColumn("parsed_log", record_fields())
    values = {c: x for c, x in row_features(cfg.patterns).items() if c in cfg.names}
    slim = parsed.select(
        "line_no",
        "event_us",
        "ip",
        "path",
        *[F.col(f"parsed_log.{c}").alias(f"log_{c}") for c in RECORD],
        *[x.cast("float").alias(f"x_{c}") for c, x in values.items()],
    )
    if "ip_statistics" in cfg.features:
        slim = stream_ip_statistics(slim, cfg.ip_window_minutes)
    features = slim.select(
        "line_no",
        F.struct(*[F.col(f"log_{c}").alias(c) for c in RECORD]).alias("parsed_log"),
        *[
            (F.col(f"x_{c}") if c in values else F.col(c).cast("float")).alias(c) for c in cfg.names
        ],
    )
    return model.score(features)


RECORD = ("timestamp", "ip", "method", "path", "status", "template_id")


def learn_clusters(lines: DataFrame, store: TemplateStore, checkpoint: str):
    """Start a query that adds the clusters of a stream of lines to a store. Returns the query.

    Micro-batch k writes version k + 1; version 0 may hold the clusters of a fitted model.
    """

    def add(batch: DataFrame, batch_id: int) -> None:
        store.learn(freeze(batch.select("line_no", "line"), "batch"), batch_id + 1)

    return (
        lines.writeStream.foreachBatch(add)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def stream_detect_learning(
    model: DetectorModel, lines: DataFrame, store: TemplateStore, path: str, checkpoint: str, learn: bool = True
):
    """Start a query that scores a stream with the clusters of a store. Returns the query.

    Records of micro-batch k go to ``path/batch=k``. With ``learn`` the batch is added to the store
    as version k + 1 and scored with the versions before it, so a line that is new in one batch is
    a rare template there and has its id from the next batch on. Without it another query may
    write to the store; a batch then takes the last complete version, which is noted first, so a
    batch that is repeated after a failure takes the same one. Address statistics keep their state
    under ``path/_addresses``. The model must be fitted with ``mining="similarity"``.
    """
    cfg = model.config
    if cfg.mining != "similarity":
        raise ValueError('the model must be fitted with mining="similarity"')
    spark = lines.sparkSession
    values = {c: x for c, x in row_features(cfg.patterns).items() if c in cfg.names and c != "template_id"}
    parsed = parse_logs(lines, cfg.format, cfg.pattern)
    unnamed = parsed.withColumn("template_id", F.lit(-1).cast("bigint")).withColumn("parsed_log", record_fields())
    slim = unnamed.select(
        "line_no", "event_us", "ip", "path", "raw",
        *[F.col(f"parsed_log.{c}").alias(f"log_{c}") for c in RECORD if c != "template_id"],
        *[x.cast("float").alias(f"x_{c}") for c, x in values.items()],
    )
    addresses = None
    if "ip_statistics" in cfg.features:
        slim, addresses = with_debuts(slim), AddressStore(spark, f"{path}/_addresses", cfg.ip_window_minutes)

    def version(batch_id: int) -> int:
        noted = f"{path}/_versions/batch={batch_id}"
        folder = spark._jvm.org.apache.hadoop.fs.Path(f"{noted}/_SUCCESS")
        if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
            spark.createDataFrame([(store.latest() + 1,)], "version bigint").coalesce(1).write.mode("overwrite").parquet(noted)
        return spark.read.schema("version bigint").parquet(noted).first()["version"]

    def finish(batch: DataFrame, batch_id: int) -> None:
        rows = freeze(batch, "batch")
        if addresses is not None:
            rows = addresses.statistics(rows, batch_id)
        if learn:
            store.learn(rows.select("line_no", F.col("raw").alias("line")), batch_id + 1)
        members = store.members(batch_id + 1 if learn else version(batch_id))
        named = cfg.match(rows, members)
        features = named.select(
            "line_no",
            F.struct(*[(F.col("template_id") if c == "template_id" else F.col(f"log_{c}")).alias(c) for c in RECORD]).alias(
                "parsed_log"
            ),
            *[
                (F.col(f"x_{c}") if c in values else F.col(c)).cast("float").alias(c) for c in cfg.names
            ],
        )
        model.score(features).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return (
        slim.writeStream.foreachBatch(finish)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def stream_stats(records: DataFrame, flag: str = "anomaly") -> DataFrame:
    """Running total, anomalies and rate; write with output mode ``complete``."""
    return records.groupBy().agg(
        F.count("*").alias("total"),
        F.count_if(F.col(flag)).alias("anomalies"),
        F.coalesce(F.try_divide(F.count_if(F.col(flag)).cast("double"), F.count("*")), F.lit(0.0)).alias(
            "anomaly_rate"
        ),
    )


# Size of the quantile sketch; its rank error follows from it.
SKETCH = 4096


def rank_error(size: int = SKETCH) -> float:
    """Rank error of a sketch of ``size`` as a share of the rows, held with 99 % confidence."""
    return 2.296 / size**0.9021


def stream_cutoff(scores: DataFrame, percentile: float, score: str = "score", size: int = SKETCH) -> DataFrame:
    """Running cutoff of all scores so far: n and cutoff; write with output mode ``complete``.

    The state is one mergeable quantile sketch of bounded size, partial sketches being merged before
    the shuffle. The share of scores up to the cutoff differs from ``percentile`` by
    ``rank_error(size)`` at most, with 99 % confidence. Null scores and NaN count nowhere.
    """
    value = F.col(score).cast("double")
    held = scores.filter(value.isNotNull() & ~F.isnan(value))
    sketch = F.kll_sketch_agg_double(value, F.lit(size))
    found = held.groupBy().agg(F.count("*").alias("n"), sketch.alias("s"))
    return found.select("n", F.kll_sketch_get_quantile_double("s", F.lit(percentile / 100.0)).alias("cutoff"))


def write_cutoffs(scores: DataFrame, percentile: float, path: str, checkpoint: str, score: str = "score", size: int = SKETCH):
    """Start a query that writes the running cutoff after micro-batch k to ``path/batch=k``."""

    def add(batch: DataFrame, batch_id: int) -> None:
        batch.coalesce(1).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return (
        stream_cutoff(scores, percentile, score, size)
        .writeStream.foreachBatch(add)
        .outputMode("complete")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def stream_ip_window(
    parsed: DataFrame, minutes: int = 60, slide: int = 5, lateness: str = "1 day"
) -> DataFrame:
    """Requests per address in sliding event-time windows; rows later than the watermark drop."""
    return (
        parsed.withWatermark("event_ts", lateness)
        .groupBy(F.window("event_ts", f"{minutes} minutes", f"{slide} minutes").alias("w"), "ip")
        .agg(F.count("*").alias("requests"))
        .select(F.col("w.start").alias("window_start"), "ip", "requests")
    )


def run_ip_windows(
    parsed: DataFrame, label: str, minutes: int = 60, slide: int = 5, lateness: str = "1 day", mode: str = "append"
) -> DataFrame:
    """Run ``stream_ip_window`` over what is available, with its state in a ``WindowStore``.

    The results are those of the streaming plan. Its state has a row for every window of an address
    and lies in memory; the store has one for every slice of time and lies in files, and windows are
    made of slices by a batch plan. ``append`` writes a window once, when the watermark has passed
    its end; ``complete`` gives all of them.
    """
    spark = parsed.sparkSession
    store = WindowStore(spark, scratch_path(spark, label), minutes, slide, lateness)
    (
        parsed.select("event_ts", "ip")
        .writeStream.foreachBatch(lambda batch, batch_id: store.add(batch, batch_id, mode == "append"))
        .option("checkpointLocation", scratch_path(spark, f"{label}-state"))
        .trigger(availableNow=True)
        .start()
        .awaitTermination()
    )
    if mode == "complete":
        return store.windows(store.slices())
    store.close()
    return store.closed()


def stream_dedup(lines: DataFrame, time: str = "event_ts", delay: str = "1 day") -> DataFrame:
    """Distinct lines; a copy is recognised within ``delay`` of the first one's event time."""
    return lines.select("line", time).withWatermark(time, delay).dropDuplicatesWithinWatermark(["line"])


def learn_templates(lines: DataFrame, path: str, checkpoint: str):
    """Start a query that adds unseen signatures to a template table as they arrive.

    Every micro-batch writes its own folder ``batch=<id>``, replaced whole when the batch is
    retried; ids continue after those of earlier batches. Returns the streaming query.
    """

    def add(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        known = known_templates(spark, path).filter(F.col("batch") < batch_id)
        top = known.agg(F.coalesce(F.max("template_id"), F.lit(0)).alias("top")).first()["top"]
        new = signatures(batch, "line").join(known.select("signature"), "signature", "left_anti")
        numbered = number_rows(new, ["first_line_no"], "_pos").select(
            (F.col("_pos") + 1 + F.lit(top)).cast("bigint").alias("template_id"),
            "signature",
            "first_line_no",
        )
        numbered.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return (
        lines.writeStream.foreachBatch(add)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


_TEMPLATE_SCHEMA = "template_id bigint, signature string, first_line_no bigint, batch bigint"


def known_templates(spark: SparkSession, path: str) -> DataFrame:
    """Template table written so far; empty before the first batch."""
    reader = spark.read.schema(_TEMPLATE_SCHEMA).option("basePath", path)
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return spark.createDataFrame([], _TEMPLATE_SCHEMA)
    return reader.parquet(path)


def settled(counters, seconds: float = 30.0) -> dict:
    """Counts of ``LiveCounters`` once the progress of a finished query has arrived: when they have
    not moved for a second, after ``seconds`` at most."""
    end, last, since = time.monotonic() + seconds, None, time.monotonic()
    while time.monotonic() < end:
        now = counters.counts()
        if now != last:
            last, since = now, time.monotonic()
        elif counters.batches and time.monotonic() - since > 1.0:
            break
        time.sleep(0.1)
    return counters.counts()


def run_available(df: DataFrame, label: str, mode: str = "append") -> DataFrame:
    """Run a streaming plan over what is available and return its output as a batch table.

    ``append`` goes to Parquet; ``complete`` keeps the last full result, one folder per batch.
    """
    spark = df.sparkSession
    path, checkpoint = scratch_path(spark, label), scratch_path(spark, f"{label}-state")
    writer = df.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)
    if mode == "append":
        writer.format("parquet").outputMode("append").start(path).awaitTermination()
        return spark.read.schema(df.schema).parquet(path)
    last: dict[str, int] = {}

    def keep(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/{batch_id}")
        last["id"] = batch_id

    writer.foreachBatch(keep).outputMode(mode).start().awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{path}/{last['id']}")
