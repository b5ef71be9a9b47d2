"""Parsed rows to the numeric feature columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions import scalars as S
from tidewatch.operators.ip_stats import STATISTICS, ip_statistics
from tidewatch.schema import DEFAULT_FEATURES, METHODS, SUSPICIOUS_PATTERNS, feature_names
from tidewatch.session import freeze


def row_features(patterns=SUSPICIOUS_PATTERNS) -> dict[str, Column]:
    """Features that depend on one parsed row only, by column name."""
    status = F.col("status")
    columns = {
        "template_id": F.coalesce(F.col("template_id"), F.lit(-1)),
        "status_2xx": status.between(200, 299).cast("int"),
        "status_4xx": status.between(400, 499).cast("int"),
        "status_5xx": status.between(500, 599).cast("int"),
        "path_length": F.char_length("path"),
        "suspicious_score": S.count_tokens(F.col("path"), F.col("raw"), patterns),
        "hour": F.hour("wall_ts"),
        "weekday": F.weekday("wall_ts"),
        "user_agent_hash": S.user_agent_bucket(F.col("user_agent")),
    }
    for m in METHODS:
        columns[f"method_{m}"] = (F.upper("method") == m).cast("int")
    return columns


def extract_features(
    parsed: DataFrame,
    enabled=DEFAULT_FEATURES,
    patterns=SUSPICIOUS_PATTERNS,
    window_minutes: int = 60,
    keep: list[str] | None = None,
    stored: bool = False,
    **ip_options,
) -> DataFrame:
    """``keep`` columns followed by the enabled features as FLOAT, in vector order.

    Row features are computed first, so the shuffle for the address statistics carries numbers
    and not the raw line. Disabled groups are never computed. The address statistics read their rows
    more than once; with ``stored`` the row features are written first, so lines are parsed once.
    """
    slim = row_table(parsed, enabled, patterns, keep)
    if stored and "ip_statistics" in enabled:
        slim = freeze(slim, "slim")
    return with_statistics(slim, enabled, window_minutes, keep, **ip_options)


def row_table(parsed: DataFrame, enabled=DEFAULT_FEATURES, patterns=SUSPICIOUS_PATTERNS, keep: list[str] | None = None) -> DataFrame:
    """First half of ``extract_features``: what depends on one row, and what the address statistics read."""
    names = feature_names(enabled)
    keep = ["line_no"] if keep is None else list(keep)
    computed = row_features(patterns)
    if "template_id" in names and "template_id" not in parsed.columns:
        parsed = parsed.withColumn("template_id", F.lit(-1))
    return parsed.select(
        *[F.col(c).alias(f"keep_{c}") for c in keep],
        *[computed[c].cast("float").alias(f"x_{c}") for c in names if c not in STATISTICS],
        *(["line_no", "ip", "path", "event_us"] if "ip_statistics" in enabled else []),
    )


def with_statistics(
    slim: DataFrame, enabled=DEFAULT_FEATURES, window_minutes: int = 60, keep: list[str] | None = None, **ip_options
) -> DataFrame:
    """Second half of ``extract_features``: address statistics, and the columns in their order."""
    names = feature_names(enabled)
    keep = ["line_no"] if keep is None else list(keep)
    if "ip_statistics" in enabled:
        slim = ip_statistics(slim, window_minutes, **ip_options)
    return slim.select(
        *[F.col(f"keep_{c}").alias(c) for c in keep if c not in names],
        *[
            F.col(c).cast("float").alias(c) if c in STATISTICS else F.col(f"x_{c}").alias(c)
            for c in names
        ],
    )
