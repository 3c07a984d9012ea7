"""Confidence tiers, advisories, foreign tests and the machine-translation notice."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from lingotally.refdata import ALT_ENGINE_NOTICE, FA_NOTICE, MT_NOTICE

SHORT_INPUT_WORDS = 10
HIGH_SCORE = 0.85
MEDIUM_SCORE = 0.60


def _short(words: Column) -> Column:
    return (words > 0) & (words < SHORT_INPUT_WORDS)


def confidence_tier(score: Column, words: Column) -> Column:
    return (
        F.when(_short(words), "LOW")
        .when(score >= HIGH_SCORE, "HIGH")
        .when(score >= MEDIUM_SCORE, "MEDIUM")
        .otherwise("LOW")
    )


def confidence_advisory(tier: Column, words: Column) -> Column:
    plural = F.when(words == 1, "").otherwise("s")
    short = F.concat(
        F.lit("Only "), words.cast("string"), F.lit(" word"), plural,
        F.lit(": the detected language may be wrong, have a linguist confirm it."),
    )
    return (
        F.when(tier == "MEDIUM", "Medium confidence: have a linguist confirm important text.")
        .when((tier == "LOW") & _short(words), short)
        .when(tier == "LOW", "Low confidence: the detected language may be wrong.")
    )


def resolve_language(detected: Column, upstream: Column) -> Column:
    return F.coalesce(F.nullif(detected, F.lit("")), upstream)


def is_foreign_strict(language: Column, target: str) -> Column:
    """Classifier form: a missing language is not foreign."""
    return F.coalesce((language != "") & (language != target), F.lit(False))


def is_foreign_plain(language: Column, target: str) -> Column:
    """Batch form: anything that differs from the target, the empty code included."""
    return F.coalesce(language, F.lit("")) != target


def notice(language: Column, engine: Column | None = None, base: str = MT_NOTICE) -> Column:
    parts = [F.lit(base), F.when(language == "fa", FA_NOTICE)]
    if engine is not None:
        parts.append(F.when(engine == "Seamless", ALT_ENGINE_NOTICE))
    return F.concat_ws(" ", *parts)
