"""Decoder output: timed segments from tokens and markers, and attempt acceptance, row-local."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from lingotally.functions.text import strip

# ---- fixed values: marker resolution in seconds, acceptance thresholds ------------------------
MARKER_SECONDS = 0.02
NO_SPEECH = 0.6
MIN_UNIQUE_RATIO = 0.3


def marker_ms(marker: Column, offset_seconds: Column) -> Column:
    """Marker k is k times 0.02 s in single precision; milliseconds are truncated."""
    seconds = (marker.cast("float") * F.lit(MARKER_SECONDS).cast("float")).cast("double")
    return ((offset_seconds + seconds) * 1000.0).cast("bigint")


def markers(tokens: Column) -> Column:
    """Places and numbers of the time markers in a token array."""
    placed = F.transform(
        tokens, lambda t, i: F.struct((i + 1).alias("at"), t["marker"].alias("k"))
    )
    return F.filter(placed, lambda m: m["k"].isNotNull())


def islands(marks: Column, n_tokens: Column) -> Column:
    """Token ranges between markers, with the marker numbers that bound them.

    Island k runs from marker k to the next one; the first also takes the text before its marker,
    the last runs to the end. Without markers the whole chunk is one island.
    """
    n = F.size(marks)
    nothing = F.struct(F.lit(None).cast("int").alias("at"), F.lit(None).cast("int").alias("k"))
    left = F.when(n > 0, marks).otherwise(F.array(nothing))
    right = F.concat(F.slice(marks, 2, F.greatest(n - 1, F.lit(0))), F.array(nothing))
    pairs = F.zip_with(left, right, lambda a, b: F.struct(a.alias("a"), b.alias("b")))

    def bounds(p: Column, i: Column) -> Column:
        first = F.when(i == 0, 1).otherwise(p["a"]["at"] + 1)
        last = F.coalesce(p["b"]["at"] - 1, n_tokens)
        return F.struct(
            first.alias("first"), F.greatest(last - first + 1, F.lit(0)).alias("n"),
            p["a"]["k"].alias("k0"), p["b"]["k"].alias("k1"),
        )

    return F.transform(pairs, bounds)


def island_segments(ranges: Column, tokens: Column, offset: Column, duration: Column) -> Column:
    """Timed segment per island that holds text; times are truncated to milliseconds."""
    begin = (offset * 1000.0).cast("bigint")
    finish = ((offset + duration) * 1000.0).cast("bigint")

    def segment(r: Column) -> Column:
        inside = F.slice(tokens, r["first"], r["n"])
        return F.struct(
            F.coalesce(marker_ms(r["k0"], offset), begin).alias("start_ms"),
            F.coalesce(marker_ms(r["k1"], offset), finish).alias("end_ms"),
            strip(F.array_join(F.transform(inside, lambda t: t["text"]), "")).alias("text"),
        )

    return F.filter(F.transform(ranges, segment), lambda s: s["text"] != "")


def acceptable(no_speech: Column, unique_ratio: Column) -> Column:
    return (no_speech > NO_SPEECH) | (unique_ratio >= MIN_UNIQUE_RATIO)
