"""Training-data preparation over a table of (line_no, line)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.operators.ordering import keep_lowest, number_rows, seeded_key


def filter_valid(df: DataFrame, min_length: int = 20) -> DataFrame:
    return df.filter(F.char_length("line") >= min_length)


def deduplicate(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """One row per distinct line with its first ``line_no``; copies collapse before the shuffle."""
    return df.groupBy(*(by or []), "line").agg(F.min("line_no").alias("line_no"))


def split(df: DataFrame, validation_split: float = 0.2, seed: int = 42) -> DataFrame:
    """Add ``split`` (train / validation): exactly floor(n * (1 - v)) rows go to train."""
    marked = keep_lowest(
        df, seeded_key(seed), lambda n: F.floor(n * F.lit(1.0 - validation_split)), name="_train"
    )
    return marked.withColumn("split", F.when(F.col("_train"), "train").otherwise("validation")).drop("_train")


def sample(df: DataFrame, n_samples: int, seed: int = 42) -> DataFrame:
    """Exactly ``n_samples`` rows without replacement; every row when there are no more."""
    marked = keep_lowest(
        df, seeded_key(seed), lambda n: F.least(n, F.lit(n_samples).cast("bigint")), name="_kept"
    )
    return marked.filter("_kept").drop("_kept")


def prepare_training_data(
    df: DataFrame,
    max_samples: int | None = None,
    validation_split: float = 0.2,
    dedup: bool = True,
    min_length: int = 20,
    seed: int = 42,
    dedup_first: bool = False,
) -> DataFrame:
    """Split, drop short lines, deduplicate each side, then sample the train side.

    A line can end up on both sides, as the split comes first; ``dedup_first`` avoids that.
    """
    lines = df.select("line_no", "line")
    if dedup_first:
        lines = deduplicate(lines)
    sides = filter_valid(split(lines, validation_split, seed), min_length)
    if dedup:
        sides = deduplicate(sides, by=["split"])
    sides = sides.select("split", "line_no", "line")
    if not max_samples:
        return sides
    train = sample(sides.filter("split = 'train'"), max_samples, seed)
    return train.unionByName(sides.filter("split = 'validation'"))


def require_samples(df: DataFrame, min_samples: int = 1000) -> DataFrame:
    """Return ``df``, or raise when it has fewer than ``min_samples`` rows."""
    found = df.count()
    if found < min_samples:
        raise ValueError(f"need at least {min_samples} lines, got {found}")
    return df


def sample_guard(df: DataFrame, min_samples: int = 1000) -> DataFrame:
    """The same check as one row: ``total`` and ``enough``."""
    return df.agg(F.count("*").alias("total")).withColumn("enough", F.col("total") >= min_samples)


def assign_batches(df: DataFrame, batch_size: int = 100, order: str = "line_no") -> DataFrame:
    """Add ``batch_id``: consecutive runs of ``batch_size`` rows in the order of ``order``."""
    numbered = number_rows(df, [order], "_pos")
    return numbered.withColumn("batch_id", F.floor(F.col("_pos") / batch_size)).drop("_pos")
