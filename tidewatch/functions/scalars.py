"""Column expressions. Everything here is JVM-side and stays in generated code."""

from __future__ import annotations

import sys
import unicodedata
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewatch.functions.patterns import MANY, count_patterns, first_pattern
from tidewatch.schema import METHODS, SUSPICIOUS_PATTERNS

# The characters a Python string treats as white space.
SPACE = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
SPACE_CHARACTERS = "".join(
    chr(c)
    for low, high in (
        (0x09, 0x0D),
        (0x1C, 0x20),
        (0x85, 0x85),
        (0xA0, 0xA0),
        (0x1680, 0x1680),
        (0x2000, 0x200A),
        (0x2028, 0x2029),
        (0x202F, 0x202F),
        (0x205F, 0x205F),
        (0x3000, 0x3000),
    )
    for c in range(low, high + 1)
)

# One character that is white space, and one that is none. Printable ASCII is told apart first: a
# character of an ordinary line then takes one comparison and not one for each range.
SPACES = rf"[[^!-~]&&[{SPACE}]]"
NO_SPACE = rf"[!-~[^{SPACE}]]"

# What a pattern of the reference's kind takes as a digit and as a word character, beyond ASCII.
DIGIT, WORD = r"\p{Nd}", r"\p{L}\p{N}_"
_DIGITS = [chr(c) for c in range(128, sys.maxunicode + 1) if unicodedata.category(chr(c)) == "Nd"]
_ASCII_DIGITS = "".join(str(unicodedata.decimal(c)) for c in _DIGITS)

_INTEGER = r"^[+-]?\d+(_\d+)*$"
_OCTET = r"(?:\+?0*(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)|-0+)"
_IPV4 = rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"
_CLOCK = r"\d{1,2}/[A-Za-z]{3}/\d{4}:\d{1,2}:\d{1,2}:\d{1,2}"
_ZONE = r"Z|[+-]\d{2}:?[0-5]\d(?::?[0-5]\d)?"
_ACCESS_TIME = rf"^({_CLOCK})(?:[{SPACE}]+({_ZONE}))?$"
_ISO_TIME = rf"^\d{{4}}-\d{{1,2}}-\d{{1,2}}[{SPACE}]+\d{{1,2}}:\d{{1,2}}:\d{{1,2}}$"


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACE_CHARACTERS))


def is_blank(text: Column) -> Column:
    return strip(F.coalesce(text, F.lit(""))) == ""


def plain_digits(text: Column) -> Column:
    """Decimal digits of any script as ASCII digits."""
    plain = F.translate(text, "".join(_DIGITS), _ASCII_DIGITS)
    return F.when(text.rlike(r"[^\x00-\x7f]"), plain).otherwise(text)


def unicode_pattern(pattern: str) -> str:
    """A Python pattern whose classes cover Unicode, in the syntax of Spark's patterns."""
    classes = {"d": DIGIT, "w": WORD, "s": SPACE}
    out, at, inside = [], 0, False
    while at < len(pattern):
        c = pattern[at]
        if c == "\\" and at + 1 < len(pattern):
            own = classes.get(pattern[at + 1].lower())
            if own is None:
                out.append(pattern[at : at + 2])
            elif pattern[at + 1].isupper():
                out.append(f"[^{own}]")
            else:
                out.append(own if inside else f"[{own}]")
            at += 2
            continue
        if c == "[" and not inside:
            inside = True
            # a bracket right behind the opening one is an ordinary character
            if pattern[at + 1 : at + 2] == "]":
                out.append("[\\]")
                at += 2
                continue
        elif c == "]":
            inside = False
        out.append(c)
        at += 1
    return "".join(out)


def to_int(text: Column) -> Column:
    """Whole number written in text (sign, separators and any script's digits allowed), else null.

    Numbers beyond 64 bits saturate, so that comparisons with small constants still hold.
    """
    text = plain_digits(text)
    widest = F.when(text.startswith("-"), F.lit(-(2**63))).otherwise(F.lit(2**63 - 1))
    value = F.replace(text, F.lit("_"), F.lit("")).try_cast("bigint")
    return F.when(text.rlike(_INTEGER), F.coalesce(value, widest))


def is_ipv4(text: Column) -> Column:
    """Four dot-separated whole numbers, each 0..255 (sign, leading zeros, separators allowed)."""
    return F.regexp_replace(plain_digits(text), r"(?<=\d)_(?=\d)", "").rlike(_IPV4)


def first_method(text: Column) -> Column:
    """First method of the fixed list that occurs anywhere in the text, else GET."""
    return F.coalesce(*[F.when(F.contains(text, F.lit(m)), F.lit(m)) for m in METHODS], F.lit("GET"))


def access_clock(text: Column) -> Column:
    """The ``d/Mon/yyyy:h:m:s`` part of an access-log time; empty for any other text."""
    return F.regexp_extract(text, _ACCESS_TIME, 1)


def access_zone(text: Column) -> Column:
    """The zone written after the clock; empty when there is none."""
    return F.regexp_extract(text, _ACCESS_TIME, 2)


def wall_clock(text: Column, access: Column) -> Column:
    """The line's own clock as TIMESTAMP_NTZ; null when no known format fits.

    Conversions run only on text of the right shape: a failed conversion costs far more than
    the check. Month names match in any case.
    """
    iso = F.regexp_replace(text, f"[{SPACE}]+", " ")
    parsed = F.when(access != "", F.try_to_timestamp(access, F.lit("d/MMM/yyyy:H:m:s"))).when(
        text.rlike(_ISO_TIME), F.try_to_timestamp(iso, F.lit("yyyy-M-d H:m:s"))
    )
    return parsed.cast("timestamp_ntz")


def zone_offset_seconds(zone: Column) -> Column:
    """Seconds east of UTC of a written zone; 0 for ``Z`` or none."""
    digits = F.rpad(F.replace(zone, F.lit(":"), F.lit("")), 7, "0")
    hms = F.when(zone.rlike(r"^[+-]"), digits.substr(2, 6).cast("int")).otherwise(F.lit(0))
    sign = F.when(zone.startswith("-"), F.lit(-1)).otherwise(F.lit(1))
    hours, minutes = F.floor(hms / 10000), F.floor(hms / 100) % 100
    return (sign * (hours * 3600 + minutes * 60 + hms % 100)).cast("int")


def zone_text(zone: Column) -> Column:
    """The zone as ``+hh:mm``; empty when there is none."""
    digits = F.replace(zone, F.lit(":"), F.lit(""))
    shown = F.concat(digits.substr(1, 3), F.lit(":"), digits.substr(4, 2))
    east = F.replace(shown, F.lit("-00:00"), F.lit("+00:00"))
    return F.when(zone == "", F.lit("")).when(zone == "Z", F.lit("+00:00")).otherwise(east)


def timestamp_text(wall: Column, zone: Column) -> Column:
    """Wall clock with its offset; the fraction only when there is one."""
    whole = F.date_format(wall, "yyyy-MM-dd HH:mm:ss")
    precise = F.date_format(wall, "yyyy-MM-dd HH:mm:ss.SSSSSS")
    clock = F.when(precise.endswith(".000000"), whole).otherwise(precise)
    return F.concat(clock, zone)


def count_tokens(path: Column, raw: Column, patterns=SUSPICIOUS_PATTERNS) -> Column:
    """How many patterns occur in the path or the raw line, ignoring case.

    A short list is searched pattern by pattern, a long one by one automaton.
    """
    if len(patterns) > MANY:
        return count_patterns(path, raw, patterns)
    hits = [(has_token(path, p) | has_token(raw, p)).cast("int") for p in patterns]
    return reduce(lambda a, b: a + b, hits, F.lit(0))


def has_token(text: Column, pattern: str) -> Column:
    return F.contains(F.lower(text), F.lit(pattern.lower()))


def first_token(text: Column, patterns=SUSPICIOUS_PATTERNS) -> Column:
    """First pattern in list order that occurs in the text, else null."""
    if len(patterns) > MANY:
        return first_pattern(text, patterns)
    return F.coalesce(*[F.when(has_token(text, p), F.lit(p)) for p in patterns], F.lit(None).cast("string"))


def user_agent_bucket(agent: Column) -> Column:
    code = F.conv(F.substring(F.md5(agent), 1, 8), 16, 10).cast("bigint") % 10000
    return F.when(F.coalesce(agent, F.lit("")).isin("-", ""), F.lit(0)).otherwise(code)


def mask_line(line: Column) -> Column:
    """Signature of a line: addresses, bracketed times, hex and digit runs become wildcards."""
    for pattern, name in MASKS:
        line = F.regexp_replace(line, pattern, name)
    return line


# Masking rules in the order they apply.
MASKS = (
    (r"\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}", "<ip>"),
    (r"\[[^\]]*\]", "<ts>"),
    (r"0x[0-9A-Fa-f]+", "<hex>"),
    (r"\d+", "<*>"),
)


def format_timestamp(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss")


def safe_divide(numerator: Column, denominator: Column, default: float = 0.0) -> Column:
    """Quotient as double; ``default`` on a zero divisor or a missing operand."""
    return F.coalesce(
        F.try_divide(numerator.cast("double"), denominator.cast("double")), F.lit(float(default))
    )
