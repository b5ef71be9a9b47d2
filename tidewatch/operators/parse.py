"""Raw lines to typed rows, as one projection over the whole table."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions import scalars as S
from tidewatch.schema import PARSED_COLUMNS

STRICT_FORMATS = ("apache_combined", "nginx", "common", "custom")
FORMATS = ("auto", "apache_combined", "nginx", "common", "simple", "custom")

_MARK = "\x01"
_NS = S.NO_SPACE

# One pattern serves all access-log formats: every group before the tail is delimited
# unambiguously, so "combined, else common" equals "common with an optional tail".
# The grammar of the access-log formats, of the path and of the status in any line.
_ACCESS = (
    rf"([0-9{S.DIGIT}.]+) - ({_NS}+) \[([^\]]+)\] "
    rf'"({_NS}+) ({_NS}+) ({_NS}+)" '
    rf'([0-9{S.DIGIT}]+) ({_NS}+)( "([^"]*)" "([^"]*)")?'
)
_ACCESS_FIELDS = {
    "ip": 1,
    "user": 2,
    "timestamp": 3,
    "method": 4,
    "path": 5,
    "protocol": 6,
    "status": 7,
    "size": 8,
    "tail": 9,
    "referrer": 10,
    "user_agent": 11,
}

_DEFAULTS = {
    "ip": "unknown",
    "user": "-",
    "method": "GET",
    "path": "/",
    "protocol": "HTTP/1.1",
    "referrer": "-",
    "user_agent": "-",
}


def _captures(line: Column, pattern: str, groups: int) -> Column:
    """Array of the pattern's groups (index 1..groups) from a single match at line start.

    A line without a match gives a one-element array. Lines that already hold the mark
    character take the slower extract-per-group way.
    """
    anchored = f"(?s)^(?:{pattern}).*$"
    packed = F.regexp_replace(line, anchored, _MARK + _MARK.join(f"${i + 1}" for i in range(groups)))
    singly = F.array(
        F.lit(""), *[F.regexp_extract(line, anchored, i + 1) for i in range(groups)]
    )
    return F.when(
        line.contains(_MARK), F.when(line.rlike(anchored), singly).otherwise(F.array(line))
    ).otherwise(F.split(packed, _MARK))


def _named_groups(pattern: str) -> tuple[str, dict[str, int], int]:
    """Python-style named pattern as a positional one, with the group index of each name."""
    compiled = re.compile(pattern)
    positional = re.sub(r"\(\?P<\w+>", "(", pattern)
    return S.unicode_pattern(positional), dict(compiled.groupindex), compiled.groups


def parse_logs(
    df: DataFrame,
    format: str = "auto",
    pattern: str | None = None,
    line: str = "line",
    ingest: str | None = "ingest_ts",
) -> DataFrame:
    """Add the parsed columns to every row of ``df``.

    ``auto`` tries combined, then common, then the lenient fallback. A named format whose
    pattern does not fit, and a blank line, give the empty row (status 0). ``custom`` takes a
    pattern with named groups. Any other name parses with the fallback only. Lines without a
    readable time take ``ingest`` (the current time when that column is absent).
    """
    if format == "custom":
        if not pattern:
            raise ValueError("format='custom' needs a pattern with named groups")
        regex, fields, groups = _named_groups(pattern)
    else:
        regex, fields, groups = _ACCESS, _ACCESS_FIELDS, len(_ACCESS_FIELDS)

    text = F.coalesce(F.col(line), F.lit(""))
    arrival = F.col(ingest) if ingest and ingest in df.columns else F.current_timestamp()
    # Generating the match keeps it in one place: a filter on a parsed column stops above it
    # instead of repeating the match. The steps after it stay separate projections, so that each
    # generated method is small enough for the JIT compiler.
    match = F.struct(
        _captures(text, regex, groups).alias("_m"), S.is_blank(F.col(line)).alias("_blank")
    )

    def group(name: str) -> Column:
        return F.get("_m", F.lit(fields[name])) if name in fields else F.lit(None).cast("string")

    kind = F.col("_kind")
    staged = (
        df.select("*", arrival.alias("_arrival"), F.inline(F.array(match)))
        .withColumn("_kind", _kind_code(format, F.size("_m") == groups + 1, group))
        .withColumn("_word", F.when(kind == SIMPLE, F.regexp_extract(text, _FIRST_WORD, 1)))
    )

    def field(name: str, lenient: Column | None = None, least: int = COMMON) -> Column:
        value = F.when(kind >= least, group(name))
        if lenient is not None:
            value = value.when(kind == SIMPLE, lenient)
        return F.coalesce(value, F.lit(_DEFAULTS[name])).alias(name)

    status = (
        F.when(kind >= COMMON, S.to_int(group("status")))
        .when(kind == SIMPLE, S.to_int(F.coalesce(_found(text, _STATUS), F.lit("200"))))
    )
    # without a strict pattern only a blank line is empty, so ``raw`` alone needs no match
    empty = kind == EMPTY if format in STRICT_FORMATS else F.col("_blank")
    names = F.array(*[F.lit(n) for n in ("empty", "simple", "common")], F.lit(
        "custom" if format == "custom" else "combined"
    ))
    zero = F.lit(0).cast("bigint")
    kept = [c for c in df.columns if c not in PARSED_COLUMNS]
    staged = staged.select(
        *kept,
        "_arrival",
        F.get(names, kind).alias("parse_kind"),
        field("ip", F.when(S.is_ipv4(F.col("_word")), F.col("_word"))),
        field("user"),
        field("method", S.first_method(text)),
        field("path", _found(text, _PATH)),
        field("protocol"),
        F.coalesce(status, zero).alias("status"),
        F.coalesce(F.when(kind >= COMMON, S.to_int(group("size"))), zero).alias("size"),
        field("referrer", least=FULL),
        field("user_agent", least=FULL),
        F.when(empty, F.lit("")).otherwise(text).alias("raw"),
        F.when(kind >= COMMON, S.plain_digits(group("timestamp"))).alias("_time"),
    )
    return _with_times(staged).select(*kept, *PARSED_COLUMNS)


EMPTY, SIMPLE, COMMON, FULL = range(4)

_FIRST_WORD = f"^[{S.SPACE}]*([^{S.SPACE}]+)"
_PATH = rf'"[{S.WORD}]+ ({_NS}+) '
_STATUS = rf'" ([0-9{S.DIGIT}]{{3}}) '


def _found(text: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))


def _kind_code(format: str, hit: Column, group) -> Column:
    """Which parse applies to a row, as one of EMPTY, SIMPLE, COMMON, FULL."""
    blank = F.when(F.col("_blank"), F.lit(EMPTY))
    if format == "auto":
        return blank.when(~hit, F.lit(SIMPLE)).when(group("tail") == "", F.lit(COMMON)).otherwise(F.lit(FULL))
    if format == "apache_combined":
        return blank.when(hit & (group("tail") != ""), F.lit(FULL)).otherwise(F.lit(EMPTY))
    if format == "nginx":
        digits = group("size").rlike(rf"^[0-9{S.DIGIT}]+$")
        return blank.when(hit & (group("tail") != "") & digits, F.lit(FULL)).otherwise(F.lit(EMPTY))
    if format == "common":
        return blank.when(hit, F.lit(COMMON)).otherwise(F.lit(EMPTY))
    if format == "custom":
        return blank.when(hit, F.lit(FULL)).otherwise(F.lit(EMPTY))
    return blank.otherwise(F.lit(SIMPLE))


def _with_times(df: DataFrame) -> DataFrame:
    """Instant, wall clock and zone from ``_time`` and ``_arrival``."""
    time, arrival = F.col("_time"), F.col("_arrival").cast("timestamp")
    staged = df.withColumns({"_access": S.access_clock(time), "_zone": S.access_zone(time)})
    staged = staged.withColumns(
        {"_clock": S.wall_clock(time, F.col("_access")), "_offset": S.zone_offset_seconds(F.col("_zone"))}
    )
    instant = F.unix_micros(F.col("_clock").cast("timestamp")) - F.col("_offset").cast("bigint") * 1000000
    zone = F.when(F.col("_clock").isNotNull(), S.zone_text(F.col("_zone")))
    staged = staged.withColumns(
        {
            "event_us": F.coalesce(instant, F.unix_micros(arrival)),
            "wall_ts": F.coalesce(F.col("_clock"), arrival.cast("timestamp_ntz")),
            "zone": F.coalesce(zone, F.lit("")),
        }
    )
    return staged.withColumn("event_ts", F.timestamp_micros("event_us")).drop(
        "_time", "_access", "_zone", "_clock", "_offset", "_arrival"
    )


def parse_timestamps(df: DataFrame, text: str = "timestamp", ingest: str = "ingest_ts") -> DataFrame:
    """Add ``event_us``, ``event_ts``, ``wall_ts`` and ``zone`` from a column of time texts."""
    return _with_times(df.withColumns({"_time": F.col(text), "_arrival": F.col(ingest)}))


def parse_error() -> Column:
    """Why a parsed row is not a request, null if it is one: the line is blank, does not fit the
    format that was asked for, or its status is none of HTTP's."""
    return (
        F.when(S.is_blank(F.col("line")), F.lit("blank line"))
        .when(F.col("parse_kind") == "empty", F.lit("format does not fit"))
        .when(~F.col("status").between(100, 599), F.lit("status out of range"))
    )


def with_parse_error(parsed: DataFrame) -> DataFrame:
    """Add ``parse_error``; rows that are skipped are those where it is not null."""
    return parsed.withColumn("parse_error", parse_error())


def error_report(parsed: DataFrame) -> DataFrame:
    """parse_error, rows and the first line of every reason."""
    failed = with_parse_error(parsed).filter("parse_error is not null")
    return failed.groupBy("parse_error").agg(F.count("*").alias("rows"), F.min("line_no").alias("first_line_no"))
