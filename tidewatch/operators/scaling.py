"""Standardisation: population mean and deviation per feature."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _moments(features: DataFrame, names: list[str]) -> DataFrame:
    """One row: the count and, per feature, mean and scale (1 for a constant feature)."""
    stats = [F.count("*").alias("n")]
    for c in names:
        deviation = F.stddev_pop(F.col(c).cast("double"))
        stats.append(
            F.struct(
                F.avg(F.col(c).cast("double")).alias("mean"),
                F.when(deviation == 0.0, F.lit(1.0)).otherwise(deviation).alias("scale"),
            ).alias(c)
        )
    return features.agg(*stats)


def fit_scaler(features: DataFrame, names: list[str]) -> DataFrame:
    """Table (idx, feature, mean, scale, n) from a single pass over the features."""
    rows = F.array(
        *[
            F.struct(
                F.lit(i).alias("idx"),
                F.lit(c).alias("feature"),
                F.col(c)["mean"].alias("mean"),
                F.col(c)["scale"].alias("scale"),
                F.col("n"),
            )
            for i, c in enumerate(names)
        ]
    )
    return _moments(features, names).select(F.inline(rows))


def scale(features: DataFrame, scaler: DataFrame | None, names: list[str]) -> DataFrame:
    """Replace each named column by (x - mean) / scale; unchanged without a scaler."""
    if scaler is None:
        return features
    # a one-row lookup by feature name, evaluated once as a scalar subquery
    state = scaler.agg(
        F.map_from_entries(
            F.collect_list(F.struct("feature", F.struct("mean", "scale").alias("s")))
        ).alias("state")
    ).scalar()
    with_state = features.withColumn("_state", state)
    scaled = {
        c: (F.col(c).cast("double") - F.col("_state")[c]["mean"]) / F.col("_state")[c]["scale"]
        for c in names
    }
    return with_state.withColumns(scaled).drop("_state")


def scaled_columns(state: dict[str, tuple[float, float]], names: list[str]) -> list:
    """The same projection with the fitted numbers as literals, for a fitted model."""
    return [
        ((F.col(c).cast("double") - F.lit(state[c][0])) / F.lit(state[c][1])).alias(c) for c in names
    ]
