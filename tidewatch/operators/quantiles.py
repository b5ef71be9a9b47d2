"""Exact order statistics and the score thresholds built on them."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.session import freeze

# Values of one bracket that are sorted in one place at the end of the search.
GATHER = 100_000
_ACCURACY = 10_000


def quantiles(
    df: DataFrame, value: Column | str, probabilities: list[float], gather: int = GATHER
) -> DataFrame:
    """One row with ``quantiles``: exact, linearly interpolated, in the order asked for; null without values.

    The built-in exact percentile merges every distinct value in one task. Here the values are
    stored once as a slim column, and all needed ranks are located together by narrowing brackets:
    a sketch proposes two values for each rank, an exact count says on which side the rank lies,
    and the search goes on inside until a bracket is small enough to be sorted. One job a sketch,
    one a count, one at the end, whatever the number of ranks.
    """
    values = df.select((F.col(value) if isinstance(value, str) else value).cast("double").alias("v"))
    values = freeze(values.filter(F.col("v").isNotNull()), "values")
    total = values.count()
    if not total:
        return df.sparkSession.range(1).select(F.lit(None).cast("array<double>").alias("quantiles"))
    places = [p * (total - 1) for p in probabilities]
    ranks = {math.floor(x) for x in places} | {math.ceil(x) for x in places}
    at = values_at_ranks(values, sorted(ranks), total, gather)
    exact = []
    for place in places:
        low, part = math.floor(place), place - math.floor(place)
        exact.append(at[low] if part == 0 else at[low] + (at[low + 1] - at[low]) * part)
    literal = F.array(*[F.lit(float(x)) for x in exact])
    return df.sparkSession.range(1).select(literal.alias("quantiles"))


def values_at_ranks(
    values: DataFrame, ranks: list[int], total: int, gather: int = GATHER
) -> dict[int, float]:
    """The values with the 0-based ``ranks`` in the sorted non-null column ``v`` of ``total`` rows."""
    v = F.col("v")
    # rank -> (bracket condition or None, rank inside the bracket, values inside)
    open_: dict[int, tuple[Column | None, int, int]] = {r: (None, r, total) for r in ranks}
    found: dict[int, float] = {}

    def inside(r: int) -> Column:
        return v if open_[r][0] is None else F.when(open_[r][0], v)

    while wide := [r for r in open_ if open_[r][2] > gather]:
        slack, asked = 2.0 / _ACCURACY, []
        for r in wide:
            middle = (open_[r][1] + 0.5) / open_[r][2]
            pair = [F.lit(max(0.0, middle - slack)), F.lit(min(1.0, middle + slack))]
            asked.append(F.percentile_approx(inside(r), F.array(*pair), F.lit(_ACCURACY)))
        brackets = dict(zip(wide, values.agg(*[c.alias(f"b{i}") for i, c in enumerate(asked)]).first()))
        sizes = []
        for r in wide:
            low, high = brackets[r]
            own = inside(r)
            sizes += [F.count_if(own < low), F.count_if(own == low), F.count_if((own > low) & (own < high))]
            sizes.append(F.count_if((own == high) & (own > low)))
        counts = values.agg(*[c.alias(f"n{i}") for i, c in enumerate(sizes)]).first()
        for i, r in enumerate(wide):
            low, high = brackets[r]
            condition, rank, size = open_.pop(r)
            below, at_low, between, at_high = counts[4 * i : 4 * i + 4]
            edges = [
                (below, None, v < low),
                (at_low, low, None),
                (between, None, (v > low) & (v < high)),
                (at_high, high, None),
                (size - below - at_low - between - at_high, None, v > high),
            ]
            for n, answer, keep in edges:
                if rank < n:
                    break
                rank -= n
            if answer is not None:
                found[r] = answer
            else:
                open_[r] = (keep if condition is None else condition & keep, rank, n)
    if open_:
        rest = list(open_)
        sorted_ = [F.get(F.array_sort(F.collect_list(inside(r))), F.lit(open_[r][1])) for r in rest]
        row = values.agg(*[c.alias(f"q{i}") for i, c in enumerate(sorted_)]).first()
        found |= dict(zip(rest, row))
    return found


def threshold(
    scores: DataFrame,
    method: str = "percentile",
    score: str = "score",
    percentile: float = 95.0,
    n_mad: float = 3.5,
    multiplier: float = 1.5,
    value: float | None = None,
    gather: int = GATHER,
) -> DataFrame:
    """One row with ``threshold`` by percentile, mad, iqr or a static value."""
    if method == "percentile":
        q = quantiles(scores, score, [percentile / 100.0], gather)
        return q.select(F.col("quantiles")[0].alias("threshold"))
    if method == "mad":
        centre = quantiles(scores, score, [0.5], gather).select(F.col("quantiles")[0].alias("m"))
        if scores.isEmpty():
            return centre.select(F.col("m").alias("threshold"))
        middle = F.lit(centre.first()[0])
        spread = quantiles(scores, F.abs(F.col(score) - middle), [0.5], gather)
        return spread.select((middle + n_mad * F.col("quantiles")[0]).alias("threshold"))
    if method == "iqr":
        q = quantiles(scores, score, [0.25, 0.75], gather)
        q1, q3 = F.col("quantiles")[0], F.col("quantiles")[1]
        return q.select((q3 + multiplier * (q3 - q1)).alias("threshold"))
    if method == "static":
        if value is None:
            raise ValueError("a static threshold needs a value")
        return scores.sparkSession.range(1).select(F.lit(float(value)).alias("threshold"))
    raise ValueError(f"unknown threshold method: {method}")
