"""Epoch numbers: conversion, UTC text and detection of plausible formats.

Conversions truncate toward zero and yield null on overflow; calendar text is built from the
day number, so it does not depend on the session time zone.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from lingotally.functions.binding import let
from lingotally.refdata import EPOCH_ALIASES

# ---- fixed values: seconds between epochs, and the supported calendar range -------------------
SECONDS_1970_TO_2001 = 978_307_200
SECONDS_1601_TO_1970 = 11_644_473_600
SECONDS_1904_TO_1970 = 2_082_844_800
YEAR_1 = -62_135_596_800
YEAR_9999 = 253_402_300_799

# ---- fixed values: magnitude bands (lower bound, interpretations by rank) ---------------------
BANDS = [
    (10**18, [("unix-nanoseconds", "High"), ("apple-nanoseconds", "Low")]),
    (10**17, [("windows-filetime", "High"), ("unix-nanoseconds", "Low")]),
    (10**15, [("unix-microseconds", "High"), ("webkit", "Medium")]),
    (10**12, [("unix-milliseconds", "High"), ("webkit", "Low")]),
    (10**9, [("unix-seconds", "High"), ("hfs-plus", "Medium"), ("apple-coredata", "Low")]),
    (10**8, [("unix-seconds", "High"), ("apple-coredata", "Medium")]),
    (0, [("apple-coredata", "Medium"), ("unix-seconds", "Low")]),
]


def parse_format(name: Column) -> Column:
    """Canonical format name of a name or alias, else null."""
    expr = None
    for canonical in dict.fromkeys(EPOCH_ALIASES.values()):
        aliases = [a for a, c in EPOCH_ALIASES.items() if c == canonical]
        cond = name.isin(aliases)
        expr = F.when(cond, canonical) if expr is None else expr.when(cond, canonical)
    return expr


def _whole(value: Column, by: int) -> Column:
    """Integer division that truncates toward zero (exact: the remainder is removed first)."""
    return F.call_function("div", value, F.lit(by))


def to_unix_seconds(value: Column, fmt: Column) -> Column:
    """Seconds since 1970 of ``value`` in format ``fmt``; null on overflow or unknown format."""
    after_2001 = F.lit(SECONDS_1970_TO_2001).cast("bigint")
    return (
        F.when(fmt == "unix-seconds", value)
        .when(fmt == "unix-milliseconds", _whole(value, 10**3))
        .when(fmt == "unix-microseconds", _whole(value, 10**6))
        .when(fmt == "unix-nanoseconds", _whole(value, 10**9))
        .when(fmt.isin("apple-coredata", "cocoa-date"), F.try_add(value, after_2001))
        .when(fmt == "apple-nanoseconds", _whole(value, 10**9) + after_2001)
        .when(fmt == "windows-filetime", _whole(value, 10**7) - SECONDS_1601_TO_1970)
        .when(fmt == "webkit", _whole(value, 10**6) - SECONDS_1601_TO_1970)
        .when(
            fmt == "hfs-plus",
            F.try_subtract(value, F.lit(SECONDS_1904_TO_1970).cast("bigint")),
        )
    )


def _day(seconds: Column, clock: Column) -> Column:
    return F.call_function("div", seconds - clock, F.lit(86_400)).cast("int")


def format_utc(seconds: Column) -> Column:
    """``YYYY-MM-DDTHH:MM:SSZ`` for years 1 to 9999, else the empty string."""
    in_range = seconds.between(YEAR_1, YEAR_9999)
    guarded = F.when(in_range, seconds)
    clock = F.pmod(guarded, F.lit(86_400))
    day = _day(guarded, clock)

    def two(c: Column) -> Column:
        return F.lpad(c.cast("int").cast("string"), 2, "0")

    text = F.concat(
        F.date_from_unix_date(day).cast("string"), F.lit("T"),
        two(F.floor(clock / 3600)), F.lit(":"),
        two(F.floor(clock % 3600 / 60)), F.lit(":"),
        two(clock % 60), F.lit("Z"),
    )
    return F.coalesce(text, F.lit(""))


def civil_fields(seconds: Column) -> Column:
    """Year, month, day, hour, minute, second of a Unix time; nulls outside years 1 to 9999."""
    guarded = F.when(seconds.between(YEAR_1, YEAR_9999), seconds)
    clock = F.pmod(guarded, F.lit(86_400))
    date = F.date_from_unix_date(_day(guarded, clock))
    return F.struct(
        F.year(date).alias("year"), F.month(date).alias("month"), F.dayofmonth(date).alias("day"),
        F.floor(clock / 3600).cast("int").alias("hour"),
        F.floor(clock % 3600 / 60).cast("int").alias("minute"),
        (clock % 60).cast("int").alias("second"),
    )


def _dated(seconds: Column) -> Column:
    return let(seconds, lambda s: F.struct(s.alias("secs"), format_utc(s).alias("utc")))


def convert(value: Column, fmt: Column) -> Column:
    """Struct of utc, unix_seconds and confidence for one value in a known format."""
    return let(_dated(to_unix_seconds(value, fmt)), lambda d: F.struct(
        d["utc"].alias("utc"),
        F.when(d["utc"] != "", d["secs"]).otherwise(F.lit(0)).cast("bigint").alias("unix_seconds"),
        F.when(d["utc"] != "", "High").otherwise("Low").alias("confidence"),
    ))


def detect_formats(value: Column) -> Column:
    """All plausible readings of a number, best first; readings out of the calendar are dropped."""
    bands = None
    for low, readings in BANDS:
        row = F.array(
            *[F.struct(F.lit(f).alias("format"), F.lit(c).alias("confidence")) for f, c in readings]
        )
        # Both signs are compared: abs() of the smallest bigint overflows.
        cond = (value >= low) | (value <= -low)
        bands = F.when(cond, row) if bands is None else bands.when(cond, row)

    def read(r: Column) -> Column:
        return let(_dated(to_unix_seconds(value, r["format"])), lambda d: F.struct(
            r["format"].alias("format"), r["confidence"].alias("confidence"),
            d["secs"].alias("unix_seconds"), d["utc"].alias("utc"),
        ))

    return F.filter(F.transform(bands, read), lambda r: r["utc"] != "")
