"""Counters, entropy and the per-address and attack reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from tidewatch.functions import scalars as S
from tidewatch.schema import ATTACK_CATEGORIES


def entropy(df: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """Shannon entropy in bits of a column, per group if asked; 0 for an empty table."""
    by = list(by or [])
    counts = df.groupBy(*by, value).agg(F.count("*").cast("double").alias("_n"))
    # -sum(p log p) = log N - sum(n log n) / N, which needs one pass over the counts
    total = F.sum("_n")
    bits = F.log2(total) - F.sum(F.col("_n") * F.log2("_n")) / total
    return counts.groupBy(*by).agg(F.abs(F.coalesce(bits, F.lit(0.0))).alias("entropy"))


def _rate(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def detection_stats(df: DataFrame, flag: str = "anomaly") -> DataFrame:
    anomalies = F.count_if(F.col(flag))
    return df.agg(F.count("*").alias("total"), anomalies.alias("anomalies")).withColumn(
        "anomaly_rate", _rate(F.col("anomalies"), F.col("total"))
    )


def observed(df: DataFrame, counters: Observation | str, flag: str = "anomaly") -> DataFrame:
    """``df`` with counters of its rows that fill while whatever is done with it runs.

    In batch ``counters`` is an ``Observation`` whose ``get`` waits for the action; in a stream it
    is a name, and ``LiveCounters`` of that name adds the micro-batches up. No second job runs.
    """
    return df.observe(
        counters, F.count(F.lit(1)).alias("total"), F.count_if(F.coalesce(F.col(flag), F.lit(False))).alias("anomalies")
    )


class LiveCounters(StreamingQueryListener):
    """Totals of the streams that are observed under ``name``; register with ``spark.streams``.

    A micro-batch counts once, also when it is run again after a failure.
    """

    def __init__(self, name: str):
        self.name, self.batches = name, {}

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        row = event.progress.observedMetrics.get(self.name)
        if row is not None:
            self.batches[str(event.progress.id), event.progress.batchId] = (row["total"], row["anomalies"])

    def onQueryTerminated(self, event) -> None:
        pass

    def counts(self) -> dict:
        """total, anomalies and anomaly_rate so far."""
        total = sum(t for t, _ in self.batches.values())
        anomalies = sum(a for _, a in self.batches.values())
        return {"total": total, "anomalies": anomalies, "anomaly_rate": anomalies / total if total else 0.0}


def training_stats(parsed: DataFrame, n_features: int, model: str) -> DataFrame:
    return parsed.agg(
        F.count("*").alias("total_logs"), F.count_if(F.col("status") > 0).alias("parsed_logs")
    ).select(
        "total_logs",
        "parsed_logs",
        F.col("parsed_logs").alias("feature_rows"),
        F.lit(n_features).alias("feature_columns"),
        F.lit(model).alias("model_type"),
        F.lit("trained").alias("status"),
    )


def distinct_paths(parsed: DataFrame, approximate: bool = False) -> DataFrame:
    """Distinct paths per address; copies of (ip, path) collapse before they meet."""
    count = F.approx_count_distinct("path") if approximate else F.count_distinct("path")
    return parsed.groupBy("ip").agg(count.alias("paths"))


def attack_categories(parsed: DataFrame, categories=None) -> DataFrame:
    """Requests per attack family; a request counts once in every family it shows."""
    families = []
    for name, tokens in (categories or ATTACK_CATEGORIES).items():
        hit = reduce(
            lambda a, b: a | b,
            [S.has_token(F.col("path"), t) | S.has_token(F.col("raw"), t) for t in tokens],
        )
        families.append(F.struct(F.lit(name).alias("category"), F.count_if(hit).alias("requests")))
    return parsed.agg(F.array(*families).alias("f")).select(F.inline("f"))


def over_limit(with_frequency: DataFrame, limit: int) -> DataFrame:
    """Requests whose address exceeds ``limit`` requests in the look-back window."""
    return with_frequency.filter(F.col("ip_frequency") > limit)


def brute_force(
    parsed: DataFrame, minutes: int = 10, failures: int = 5, statuses=(401, 403)
) -> DataFrame:
    """Addresses with more than ``failures`` refused requests in a fixed window."""
    return (
        parsed.filter(F.col("status").isin(*statuses))
        .groupBy("ip", F.window("event_ts", f"{minutes} minutes").alias("w"))
        .agg(F.count("*").alias("failures"))
        .filter(F.col("failures") > failures)
        .select("ip", F.col("w.start").alias("window_start"), "failures")
    )
