"""Epoch numbers and clock texts."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from lingotally import refdata as R
from lingotally.functions import cues as C, epochs as E
from lingotally.plans.catalogue.registry import SQL_SEGMENTS, conversation_segments, query, table, values_sql

# Per format: multiplier and shift that turn Unix seconds into a raw number of that format.
RAW = [
    ("unix", 1, 0), ("unix-ms", 10**3, 0), ("unix-us", 10**6, 0), ("unix-ns", 10**9, 0),
    ("core-data", 1, -E.SECONDS_1970_TO_2001), ("apple-ns", 10**9, -E.SECONDS_1970_TO_2001),
    ("filetime", 10**7, E.SECONDS_1601_TO_1970), ("webkit", 10**6, E.SECONDS_1601_TO_1970),
    ("hfs+", 1, E.SECONDS_1904_TO_1970), ("ns-date", 1, -E.SECONDS_1970_TO_2001),
]
MAX_LONG = 2**63 - 1


def _raw(spark, sf):
    """Raw numbers in all formats from event times, with extreme and negative ones among them."""
    e = table(spark, sf, "events")
    secs = F.unix_seconds(F.col("ts").cast("timestamp"))
    kind = F.col("event_id") % 10
    value: Column | None = None
    name: Column | None = None
    for i, (alias, by, shift) in enumerate(RAW):
        v = (secs + F.lit(shift)) * F.lit(by)
        value = F.when(kind == i, v) if value is None else value.when(kind == i, v)
        name = F.when(kind == i, alias) if name is None else name.when(kind == i, alias)
    edge = F.when(F.col("event_id") % 97 == 0, F.lit(MAX_LONG)).when(
        F.col("event_id") % 89 == 0, F.lit(-MAX_LONG - 1)).when(
        F.col("event_id") % 83 == 0, -value).when(
        F.col("event_id") % 79 == 0, F.col("event_id"))
    return e.select("event_id", F.coalesce(edge, value).alias("value"), name.alias("alias"))


SQL_RAW = (
    "raw AS (SELECT event_id, CASE WHEN event_id % 97 = 0 THEN 9223372036854775807 "
    "WHEN event_id % 89 = 0 THEN CAST(-9223372036854775808 AS BIGINT) "
    "WHEN event_id % 83 = 0 THEN -v WHEN event_id % 79 = 0 THEN event_id ELSE v END AS value, alias "
    "FROM (SELECT event_id, CASE event_id % 10 "
    + " ".join(f"WHEN {i} THEN (s + ({sh})) * {by}" for i, (_, by, sh) in enumerate(RAW))
    + " END AS v, CASE event_id % 10 "
    + " ".join(f"WHEN {i} THEN '{a}'" for i, (a, _, _) in enumerate(RAW))
    + " END AS alias FROM (SELECT event_id, CAST(floor(epoch(ts)) AS BIGINT) AS s FROM events)))"
)


def sql_seconds(value: str, fmt: str) -> str:
    """Seconds as HUGEINT, so the sums below cannot overflow; the range test comes after."""
    v = f"CAST({value} AS HUGEINT)"
    return f"""CASE {fmt} WHEN 'unix-seconds' THEN {v} WHEN 'unix-milliseconds' THEN {v} // 1000
 WHEN 'unix-microseconds' THEN {v} // 1000000 WHEN 'unix-nanoseconds' THEN {v} // 1000000000
 WHEN 'apple-coredata' THEN {v} + 978307200 WHEN 'cocoa-date' THEN {v} + 978307200
 WHEN 'apple-nanoseconds' THEN {v} // 1000000000 + 978307200
 WHEN 'windows-filetime' THEN {v} // 10000000 - 11644473600
 WHEN 'webkit' THEN {v} // 1000000 - 11644473600 WHEN 'hfs-plus' THEN {v} - 2082844800 END"""


def sql_utc(s: str) -> str:
    return (f"CASE WHEN {s} BETWEEN -62135596800 AND 253402300799 THEN strftime(make_timestamp("
            f"CAST({s} AS BIGINT) * 1000000), '%Y-%m-%dT%H:%M:%SZ') ELSE '' END")


ALIASES = values_sql(list(R.EPOCH_ALIASES.items()), "alias, format")


@query("epoch_convert", f"""WITH {SQL_RAW}, s AS (SELECT event_id, value, format,
 {sql_seconds('value', 'format')} AS secs FROM raw JOIN {ALIASES} USING (alias)),
 u AS (SELECT *, {sql_utc('secs')} AS utc FROM s)
 SELECT event_id, value, format, utc, CAST(CASE WHEN utc = '' THEN 0 ELSE secs END AS BIGINT)
 AS unix_seconds, CASE WHEN utc = '' THEN 'Low' ELSE 'High' END AS confidence FROM u""")
def epoch_convert(spark, sf):
    named = _raw(spark, sf).withColumn("format", E.parse_format(F.col("alias")))
    done = named.withColumn("c", E.convert(F.col("value"), F.col("format")))
    return done.select("event_id", "value", "format", "c.*")


def _sql_bands() -> str:
    rows, upper = [], None
    for low, readings in E.BANDS:
        for pos, (fmt, conf) in enumerate(readings):
            rows.append((low, upper if upper is not None else 10**19, pos, fmt, conf))
        upper = low
    return values_sql(rows, "low, high, pos, format, confidence")


@query("epoch_detect", f"""WITH {SQL_RAW}, c AS (SELECT event_id, v.pos, v.format, v.confidence,
 {sql_seconds('value', 'format')} AS secs FROM raw JOIN {_sql_bands()}
 ON abs(CAST(value AS HUGEINT)) >= low AND abs(CAST(value AS HUGEINT)) < high),
 u AS (SELECT *, {sql_utc('secs')} AS utc FROM c)
 SELECT event_id, CAST(row_number() OVER (PARTITION BY event_id ORDER BY pos) - 1 AS INTEGER) AS rank,
 format, confidence, CAST(secs AS BIGINT) AS unix_seconds, utc FROM u WHERE utc <> ''""")
def epoch_detect(spark, sf):
    found = _raw(spark, sf).select(
        "event_id", F.posexplode(E.detect_formats(F.col("value"))).alias("rank", "d")
    )
    return found.select("event_id", "rank", "d.*")


@query("civil_fields", """SELECT event_id, CAST(year(ts) AS INTEGER) AS year,
 CAST(month(ts) AS INTEGER) AS month, CAST(day(ts) AS INTEGER) AS day,
 CAST(hour(ts) AS INTEGER) AS hour, CAST(minute(ts) AS INTEGER) AS minute,
 CAST(second(ts) AS INTEGER) AS second FROM events""")
def civil_fields(spark, sf):
    secs = F.unix_seconds(F.col("ts").cast("timestamp"))
    return table(spark, sf, "events").select("event_id", E.civil_fields(secs).alias("c")).select(
        "event_id", "c.*"
    )


@query("clock_texts", f"""WITH {SQL_SEGMENTS} SELECT doc_id, seg_idx,
 printf('%02d:%02d:%02d,%03d', ms // 3600000, ms % 3600000 // 60000, ms % 60000 // 1000, ms % 1000)
  AS srt_clock, printf('%d:%02d', ms // 60000, ms % 60000 // 1000) AS short_clock,
 printf('%02d:%02d', ms // 60000, ms % 60000 // 1000) AS mmss
 FROM (SELECT doc_id, seg_idx, end_ms * (1 + doc_id % 40) AS ms FROM segs)""")
def clock_texts(spark, sf):
    ms = F.col("end_ms") * (1 + F.col("doc_id") % 40)
    return conversation_segments(spark, sf).select(
        "doc_id", "seg_idx", C.format_ms(ms).alias("srt_clock"), C.short_ms(ms).alias("short_clock"),
        C.mmss(ms).alias("mmss"),
    )
