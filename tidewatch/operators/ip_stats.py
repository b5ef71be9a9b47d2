"""Sliding per-address statistics: frequency, path diversity and request rate.

For each request, in the order (event time, line number) of its address:

* ``ip_frequency``: requests of the address in the look-back window, itself included, counted
  over its last 1000 requests only;
* ``ip_path_diversity``: distinct paths of the address so far;
* ``ip_request_rate``: those requests per minute of their time span (at least one minute),
  0 for a single request.

The counts use growing frames (``unbounded preceding`` up to the start of the look-back window)
and positions, never a sliding frame, so a task is linear in its rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.operators.ordering import in_chunks, lookup, number_rows
from tidewatch.session import freeze

MAX_REQUESTS = 1000
CHUNK_ROWS = 250_000
MAX_GROUP_ROWS = 1_000_000
# Stands for the second of a row without a time; under all seconds of 64-bit microseconds.
NO_SECOND = -(10**13)

STATISTICS = ("ip_frequency", "ip_path_diversity", "ip_request_rate")


def ip_statistics(
    df: DataFrame,
    window_minutes: int = 60,
    max_requests: int = MAX_REQUESTS,
    strategy: str = "auto",
    chunk_rows: int = CHUNK_ROWS,
    max_group_rows: int = MAX_GROUP_ROWS,
) -> DataFrame:
    """Add the three statistics to rows with ``ip``, ``path``, ``event_us`` and ``line_no``.

    ``hash`` sends each address to one task: one shuffle. ``chunked`` holds for any skew: the rows
    are stored in range order, cut into chunks of ``chunk_rows`` and given a look-back margin, so
    one address can fill many tasks. ``auto`` routes in one plan and runs nothing before an action:
    addresses of more than ``max_group_rows`` rows are cut by time, all others go the ``hash`` way.
    """
    if strategy == "auto":
        # at most one row for each max_group_rows rows of the table
        busy = df.groupBy("ip").count().filter(F.col("count") > max_group_rows).select("ip", F.lit(True).alias("_busy"))
        named = df.join(F.broadcast(busy), "ip", "left")
        quiet = named.filter("_busy is null").select(*df.columns)
        crowded = df.join(F.broadcast(busy.select("ip")), "ip").select(*df.columns)
        cut = _cut_by_time(crowded, window_minutes, max_requests, chunk_rows)
        return ip_statistics(quiet, window_minutes, max_requests, "hash").unionByName(cut)
    if strategy == "hash":
        keys = ["ip"]
        # placed by address once; every window below accepts that placement
        flagged = df.repartition("ip").withColumn("_new", _first_in(["ip", "path"]).cast("bigint")).withColumn(
            "_seen", F.lit(0).cast("bigint")
        )
        return _windowed(flagged, keys, window_minutes, max_requests)
    if strategy == "chunked":
        return _chunked(df, window_minutes, max_requests, max(chunk_rows, max_requests))
    raise ValueError(f"unknown strategy: {strategy}")


def _order():
    return ["event_us", "line_no"]


def _first_in(keys: list[str]):
    return F.row_number().over(Window.partitionBy(*keys).orderBy(*_order())) == 1


def _windowed(df: DataFrame, keys: list[str], window_minutes: int, max_requests: int) -> DataFrame:
    by_row = Window.partitionBy(*keys).orderBy(*_order())
    so_far = by_row.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # rows at or before the cutoff; the look-back itself is the open interval after it
    expired = (
        Window.partitionBy(*keys)
        .orderBy("event_us")
        .rangeBetween(Window.unboundedPreceding, -window_minutes * 60_000_000)
    )
    staged = df.select(
        "*",
        F.row_number().over(by_row).alias("_row"),
        F.lead("event_us").over(by_row).alias("_next_us"),
        F.lag("event_us", max_requests - 1).over(by_row).alias("_cap_us"),
        F.first("event_us").over(so_far).alias("_first_us"),
        (F.sum("_new").over(so_far) + F.col("_seen")).alias("ip_path_diversity"),
    )
    # the successor of the last expired row is the first row inside the look-back
    staged = staged.select(
        "*",
        F.count("*").over(expired).alias("_expired"),
        F.max("_next_us").over(expired).alias("_after_cutoff_us"),
    )
    frequency = F.least(F.col("_row") - F.col("_expired"), F.lit(max_requests)).cast("bigint")
    start = F.greatest(F.coalesce("_after_cutoff_us", "_first_us"), F.col("_cap_us"))
    minutes = (F.col("event_us") - start) / F.lit(60_000_000.0)
    rate = F.when(
        F.col("ip_frequency") > 1, F.col("ip_frequency") / F.greatest(minutes, F.lit(1.0))
    ).otherwise(F.lit(0.0))
    return (
        staged.withColumn("ip_frequency", frequency)
        .withColumn("ip_request_rate", rate)
        .drop("_row", "_next_us", "_cap_us", "_first_us", "_expired", "_after_cutoff_us", "_new", "_seen")
    )


def _chunked(df: DataFrame, window_minutes: int, max_requests: int, chunk_rows: int) -> DataFrame:
    numbered = number_rows(df, ["ip", *_order()], "_pos").withColumn(
        "_home", F.floor(F.col("_pos") / chunk_rows).cast("bigint")
    )
    # Addresses that cross a chunk border: at most one per chunk, because chunks follow the order.
    crossing = freeze(
        numbered.groupBy("ip")
        .agg(F.min("_home").alias("_from"), F.max("_home").alias("_to"))
        .filter("_from < _to")
        .select("ip"),
        "crossing",
    )
    marked = _path_marks(lookup(numbered.select("ip", "path", "_home"), crossing, "ip", "left_semi"))
    rows = in_chunks(numbered.drop("_home"), "_pos", chunk_rows, max_requests - 1).withColumn(
        "_seen", F.lit(0).cast("bigint")
    )
    marks = marked.withColumn("_pos", F.lit(-1).cast("bigint"))
    merged = rows.unionByName(marks, allowMissingColumns=True).repartition("_chunk", "ip")
    # A mark sorts ahead of the rows with its path, so it takes the "first" place; both windows
    # share one exchange on (_chunk, ip).
    by_path = Window.partitionBy("_chunk", "ip", "path").orderBy("_pos")
    flagged = (
        merged.withColumn("_new", (F.row_number().over(by_path) == 1).cast("bigint"))
        .withColumn("_seen", F.max("_seen").over(Window.partitionBy("_chunk", "ip")))
        .filter("_pos >= 0")
        .withColumn("_new", F.when(F.col("_margin"), F.lit(0)).otherwise(F.col("_new")).cast("bigint"))
    )
    result = _windowed(flagged, ["_chunk", "ip"], window_minutes, max_requests)
    return result.filter(~F.col("_margin")).drop("_pos", "_chunk", "_margin")


def _cut_by_time(df: DataFrame, window_minutes: int, max_requests: int, chunk_rows: int) -> DataFrame:
    """Statistics of busy addresses, cut into chunks of about ``chunk_rows`` rows, lazily.

    Requests are counted by second. The running count gives the chunk of a second, and the later
    chunks whose look-back of ``max_requests`` - 1 rows reaches into it get a copy of its rows. So
    a chunk is a range of seconds and an address fills as many tasks as it has chunks. The running
    count is that of the hours before and that inside the hour, so no task holds all seconds of an
    address.
    """
    # rows without a time come first in every window, so they are one second before all others
    second = F.coalesce(F.floor(F.col("event_us") / 1_000_000), F.lit(NO_SECOND))
    timed = df.withColumn("_second", second)
    numbered = _running(timed.groupBy("ip", "_second").agg(F.count("*").alias("_rows")))
    numbered = numbered.withColumn("_home", F.floor(F.col("_before") / chunk_rows))
    # a chunk that starts after b rows looks back into seconds that end after b - max_requests + 1 rows
    last_start = F.col("_upto") + max_requests - 2
    starts = numbered.groupBy("ip", F.col("_home").alias("_chunk")).agg(F.min("_before").alias("_start"))
    reach = F.sequence("_home", F.greatest("_home", F.floor(last_start / chunk_rows)))
    places = (
        numbered.withColumn("_chunk", F.explode(reach))
        .join(starts, ["ip", "_chunk"])
        .filter((F.col("_chunk") == F.col("_home")) | (F.col("_start") <= last_start))
        .select("ip", "_second", "_chunk", (F.col("_chunk") != F.col("_home")).alias("_margin"))
    )
    placed = timed.join(places, ["ip", "_second"]).drop("_second")
    own = placed.filter(~F.col("_margin")).select("ip", "path", F.col("_chunk").alias("_home"))
    marks = _path_marks(own).withColumn("_mark", F.lit(0))
    rows = placed.withColumns({"_mark": F.lit(1), "_seen": F.lit(0).cast("bigint")})
    merged = rows.unionByName(marks, allowMissingColumns=True).repartition("_chunk", "ip")
    by_path = Window.partitionBy("_chunk", "ip", "path").orderBy("_mark", *_order())
    new = (F.row_number().over(by_path) == 1) & ~F.col("_margin")
    flagged = (
        merged.withColumns({"_new": new.cast("bigint"), "_seen": F.max("_seen").over(Window.partitionBy("_chunk", "ip"))})
        .filter("_mark = 1")
        .drop("_mark")
    )
    result = _windowed(flagged, ["_chunk", "ip"], window_minutes, max_requests)
    return result.filter(~F.col("_margin")).select(*df.columns, *STATISTICS)


def _running(seconds: DataFrame) -> DataFrame:
    """Add the requests of the address before each second (``_before``) and up to it (``_upto``)."""
    seconds = seconds.withColumn("_hour", F.floor(F.col("_second") / 3600))
    earlier = Window.partitionBy("ip").orderBy("_hour").rowsBetween(Window.unboundedPreceding, -1)
    hours = (
        seconds.groupBy("ip", "_hour")
        .agg(F.sum("_rows").alias("_rows"))
        .select("ip", "_hour", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_hours_before"))
    )
    inside = Window.partitionBy("ip", "_hour").orderBy("_second")
    counted = seconds.join(hours, ["ip", "_hour"]).withColumn(
        "_upto", F.col("_hours_before") + F.sum("_rows").over(inside)
    )
    return counted.select("ip", "_second", "_upto", (F.col("_upto") - F.col("_rows")).alias("_before"))


def _path_marks(rows: DataFrame) -> DataFrame:
    """Rows (ip, path, _chunk) of paths that an earlier chunk has, and (ip, _chunk, _seen), the
    paths of the address before the chunk, from rows with their chunk ``_home``."""
    paths = rows.groupBy("ip", "path", "_home").agg(F.lit(1).alias("_one")).withColumn(
        "_debut", F.min("_home").over(Window.partitionBy("ip", "path"))
    )
    repeated = paths.filter("_home > _debut").select("ip", "path", F.col("_home").alias("_chunk"))
    before = Window.partitionBy("ip").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        paths.groupBy("ip", F.col("_home").alias("_chunk"))
        .agg(F.sum((F.col("_home") == F.col("_debut")).cast("bigint")).alias("_debuts"))
        .select("ip", "_chunk", F.coalesce(F.sum("_debuts").over(before), F.lit(0)).alias("_seen"))
    )
    return repeated.unionByName(carried, allowMissingColumns=True)


def moving_average(
    df: DataFrame,
    value: str,
    order: list[str],
    window: int = 5,
    name: str = "moving_average",
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Trailing mean over ``window`` rows of the whole series, partial at its head.

    A series shorter than the window comes back unchanged. The order columns must be unique
    together; the series is cut into chunks with ``window - 1`` rows of look-back.
    """
    if window < 1:
        raise ValueError("window must be at least 1")
    numbered = number_rows(df, order, "_pos")
    length = numbered.agg(F.count("*")).scalar()
    chunked = in_chunks(numbered, "_pos", max(chunk_rows, window), window - 1)
    trailing = Window.partitionBy("_chunk").orderBy("_pos").rowsBetween(1 - window, Window.currentRow)
    mean = F.avg(F.col(value).cast("double")).over(trailing)
    return (
        chunked.withColumn(name, mean)
        .filter(~F.col("_margin"))
        .withColumn(name, F.when(length < window, F.col(value).cast("double")).otherwise(F.col(name)))
        .drop("_pos", "_chunk", "_margin")
    )
