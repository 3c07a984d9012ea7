"""Byte offsets of pattern matches, row-local."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from lingotally.functions.binding import let

# Folds copy their array at every step, so they run over blocks of this many hits.
BLOCK = 128
OFFSETS = "array<struct<offset:bigint,data:string>>"


def _pattern(pattern: str | Column) -> Column:
    return pattern if isinstance(pattern, Column) else F.lit(pattern)


def matches(text: Column, pattern: str | Column) -> Column:
    return F.regexp_extract_all(text, _pattern(pattern), F.lit(0))


def match_offsets(text: Column, pattern: str | Column) -> Column:
    """Array of (offset, data) of every match; offsets count bytes from 0.

    The text between matches comes from splitting at the same pattern, so offset k is the bytes of
    all pieces up to k plus the bytes of all earlier hits. Blocks of hits are summed first; each
    block then counts on from the total before it, so the work is linear in the number of hits
    (up to some million hits of one row).
    """
    def build(hits: Column) -> Column:
        gaps = F.transform(F.split(text, _pattern(pattern), -1), F.octet_length)
        # Each step carries its own gap: nothing outside the lambda is evaluated again per hit.
        steps = F.zip_with(
            hits, F.slice(gaps, 1, F.size(hits)),
            lambda h, g: F.struct(h.alias("hit"), g.cast("bigint").alias("gap")),
        )
        return let(_blocks(steps), lambda b: F.flatten(F.zip_with(b, _starts(b), _within)))

    return let(matches(text, pattern), lambda hits: F.when(
        F.size(hits) > 0, build(hits)).otherwise(F.array().cast(OFFSETS)))


def _blocks(steps: Column) -> Column:
    return let(steps, lambda s: F.transform(
        F.sequence(F.lit(0), F.floor((F.size(s) - 1) / BLOCK).cast("int")),
        lambda b: F.slice(s, b * BLOCK + 1, BLOCK)))


def _bytes(s: Column) -> Column:
    return s["gap"] + F.octet_length(s["hit"])


def _starts(blocks: Column) -> Column:
    """Bytes before every block."""
    sums = F.transform(blocks, lambda b: F.aggregate(
        b, F.lit(0).cast("bigint"), lambda n, s: n + _bytes(s)))
    zero = F.struct(F.lit(0).cast("bigint").alias("next"), F.array().cast("array<bigint>").alias("out"))
    return F.aggregate(sums, zero, lambda acc, n: F.struct(
        (acc["next"] + n).alias("next"), F.concat(acc["out"], F.array(acc["next"])).alias("out"),
    ), lambda acc: acc["out"])


def _within(block: Column, start: Column) -> Column:
    def step(acc: Column, s: Column) -> Column:
        found = F.struct((acc["next"] + s["gap"]).alias("offset"), s["hit"].alias("data"))
        return F.struct((acc["next"] + _bytes(s)).alias("next"),
                        F.concat(acc["out"], F.array(found)).alias("out"))

    zero = F.struct(start.alias("next"), F.array().cast(OFFSETS).alias("out"))
    return F.aggregate(block, zero, step, lambda acc: acc["out"])
