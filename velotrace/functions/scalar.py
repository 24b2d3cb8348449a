"""Scalar functions as Column expressions; all of them stay inside generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import EARTH_M, FIT_EPOCH

SEMI = 2147483648.0 / 180.0


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = EARTH_M) -> Column:
    """Great-circle metres."""
    dy, dx = F.sin(F.radians(lat2 - lat1) / 2), F.sin(F.radians(lon2 - lon1) / 2)
    a = dy * dy + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * dx * dx
    return F.lit(2 * radius) * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def scaled_round(x: Column, places: int) -> Column:
    """Half away from zero on the scaled value, as C rounds; the built-in round works on the decimal text instead."""
    s = float(10**places)
    y = x * F.lit(s)
    return F.signum(y) * F.floor(F.abs(y) + 0.5) / F.lit(s)


def unix_time(text: Column) -> Column:
    """Unix seconds of the first 19 characters, with T or a space, read as UTC whatever follows; null for other text."""
    head = F.substring(F.ltrim(text), 1, 19)
    return F.unix_timestamp(F.coalesce(F.try_to_timestamp(head, F.lit("yyyy-MM-dd'T'HH:mm:ss")), F.try_to_timestamp(head, F.lit("yyyy-MM-dd HH:mm:ss"))))


def since_fit_epoch(unix: Column) -> Column:
    """FIT seconds of unix seconds; 0 for none, and for those before the FIT epoch."""
    return F.coalesce(F.when(unix >= FIT_EPOCH, unix - FIT_EPOCH), F.lit(0)).cast("long")


def fit_time(text: Column) -> Column:
    """Seconds since the FIT epoch of a text as unix_time reads it; else 0."""
    return since_fit_epoch(unix_time(text))


def fit_instant(t: Column) -> Column:
    """The timestamp of FIT seconds; null for 0, which stands for a missing time."""
    return F.when(t > 0, F.timestamp_seconds(t + FIT_EPOCH))


def iso_time(t: Column) -> Column:
    """Text of FIT seconds in UTC; 0 reads as the epoch; the sum wraps at 32 bits."""
    return F.date_format(F.timestamp_seconds(F.pmod(F.coalesce(t, F.lit(0)) + FIT_EPOCH, F.lit(4294967296))), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def degrees(semicircles: Column) -> Column:
    return semicircles * F.lit(180.0 / 2147483648.0)


def semicircles(deg: Column) -> Column:
    """Truncates toward zero."""
    return (deg * F.lit(SEMI)).cast("int")


def ascii_only(s: Column) -> Column:
    return F.regexp_replace(s, r"[^\x00-\x7F]", "?")


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^.]*)$", 1))


def number_text(s: Column) -> Column:
    """The number that a text begins with, as text; empty for other text, null for none."""
    return F.regexp_extract(s, r"^\s*([+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)", 1)


def integer_text(s: Column) -> Column:
    """number_text of integers."""
    return F.regexp_extract(s, r"^\s*([+-]?[0-9]+)", 1)


def parsed(text: Column, kind: str) -> Column:
    """The value of number_text or integer_text; 0 for what the type can't hold. Empty text isn't cast, since each such cast makes an exception."""
    return F.when(text.isNotNull(), F.coalesce(F.when(text != "", text.try_cast(kind)), F.lit(0).cast(kind)))


def number(s: Column) -> Column:
    """The number that a text begins with; 0 for other text, null for none."""
    return parsed(number_text(s), "double")


def integer(s: Column) -> Column:
    """The integer that a text begins with; 0 for other text, null for none."""
    return parsed(integer_text(s), "int")


def in_range(x: Column, most: int) -> Column:
    """x from 1 to most; what is outside counts as absent."""
    return F.when(x.between(1, most), x)


def is_indoor(sub_sport: Column, manufacturer: Column) -> Column:
    return F.coalesce(sub_sport.isin(6, 58), F.lit(False)) | F.coalesce(manufacturer.isin(260, 144, 331, 67), F.lit(False))


def kmh(ms: Column) -> Column:
    return ms * 3.6
