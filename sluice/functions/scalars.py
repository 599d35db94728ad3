"""Text parsers of the change-log formats, and scalar functions with the meaning that the SQL subset gives them."""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

TRUE, FALSE = ("t", "true", "T", "TRUE", "1"), ("f", "false", "F", "FALSE", "0")


def _strict(value: Column, text: Column, what: str, on_bad: str) -> Column:
    """Null or an error where text is there but has no value."""
    if on_bad == "null":
        return value
    bad = text.isNotNull() & value.isNull()
    return F.when(bad, F.raise_error(F.concat(F.lit(f"not a {what}: "), text))).otherwise(value)


def parse_bool(text: Column, on_bad: str = "error") -> Column:
    return _strict(F.when(text.isin(*TRUE), True).when(text.isin(*FALSE), False), text, "boolean", on_bad)


def parse_number(text: Column, kind: str, on_bad: str = "error") -> Column:
    return _strict(text.try_cast(kind), text, kind, on_bad)


def parse_date(text: Column, on_bad: str = "error") -> Column:
    return _strict(F.when(F.rlike(text, F.lit(r"^\d{4}-\d{2}-\d{2}$")), text.try_cast("date")), text, "date", on_bad)


def parse_time_us(text: Column, on_bad: str = "error") -> Column:
    """A time of day as microseconds; a leading minus gives negative ones, a day or more is bad."""
    part = lambda i: F.regexp_extract(text, r"^-?(\d{2}):(\d{2}):(\d{2})(?:\.(\d{1,6}))?$", i)
    micros = F.rpad(part(4), 6, "0").cast("long")
    total = (part(1).try_cast("long") * 3600 + part(2).try_cast("long") * 60 + part(3).try_cast("long")) * 1_000_000 + micros
    valid = F.rlike(text, F.lit(r"^-?([01]\d|2[0-3]):[0-5]\d:[0-5]\d(\.\d{1,6})?$"))
    return _strict(F.when(valid, F.when(F.startswith(text, F.lit("-")), -total).otherwise(total)), text, "time", on_bad)


def parse_bytes(text: Column, prefix: str = "\\x", on_bad: str = "error") -> Column:
    """Hex, after the prefix, with an even number of digits."""
    rest = F.substring(text, len(prefix) + 1, 2**30) if prefix else text
    valid = F.startswith(text, F.lit(prefix)) & F.rlike(rest, F.lit("^([0-9A-Fa-f]{2})*$"))
    return _strict(F.when(valid, F.unhex(rest)), text, "byte string", on_bad)


def parse_timestamp(text: Column, on_bad: str = "error") -> Column:
    """A timestamp; text without an offset is UTC (the session's zone)."""
    return _strict(text.try_cast("timestamp"), text, "timestamp", on_bad)


def parse_timestamp_ntz(text: Column, on_bad: str = "error") -> Column:
    return _strict(text.try_cast("timestamp_ntz"), text, "timestamp", on_bad)


def concat_skipping_nulls(*columns: Column) -> Column:
    return F.concat_ws("", *columns)


def split_part(text: Column, by: str, n: int) -> Column:
    return F.split_part(text, F.lit(by), F.lit(n))


def regexp_matches(text: Column, pattern: str) -> Column:
    """Groups of the first match, or the whole match; null without one."""
    groups = re.compile(pattern).groups
    found = F.array(*[F.regexp_extract(text, pattern, i) for i in (range(1, groups + 1) if groups else [0])])
    return F.when(F.rlike(text, F.lit(pattern)), found)


def json_text(text: Column, *path: str) -> Column:
    """``->>``: the value at a path, as text."""
    return F.get_json_object(text, "$" + "".join(f"['{p}']" for p in path))


def tokenized(text: Column, key: str) -> Column:
    """A keyed deterministic token (HMAC-SHA256, hex); null stays null."""
    secret = key.encode()
    block = (hashlib.sha256(secret).digest() if len(secret) > 64 else secret).ljust(64, b"\0")
    inner, outer = (F.lit(bytes(b ^ pad for b in block)) for pad in (0x36, 0x5C))
    within = F.sha2(F.concat(inner, F.encode(text, "UTF-8")), 256)
    return F.sha2(F.concat(outer, F.unhex(within)), 256)
