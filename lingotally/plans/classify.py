"""Classification of texts as one narrow projection per step."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from lingotally import refdata as R
from lingotally.functions import dialect as D, script as S, text as X, tiers as T
from lingotally.functions.binding import let
from lingotally.operators import langid
from lingotally.operators.calibration import probability

CLASSIFIED = [
    "language", "confidence", "is_foreign", "target_language", "confidence_tier",
    "input_word_count", "advisory", "disambiguation_note", "dialect", "dialect_confidence",
    "dialect_indicators", "dialect_note",
]


def classify(df: DataFrame, detect, target: str, text: str = "text",
             model_label: str | None = None,
             lexicon: Mapping[str, Sequence[str]] = R.DIALECT_LEXICON,
             calibration: Sequence[float] | None = None) -> DataFrame:
    """Language, confidence, tier, advisory and dialect of every text.

    ``detect`` maps the text column to (language, score, runner_up), see ``langid.detector``. Rows keep
    their place: nothing is shuffled. Confidence is the margin of the two best languages, or with
    ``calibration`` (see ``calibration.fit``) the probability that the language is right. ``model_label`` names a column with external dialect labels, which win
    over the lexicon where present.
    """
    t = F.col(text)
    found = df.withColumns({
        "_d": detect(t), "_blank": X.is_blank(t), "input_word_count": X.word_count(t),
    })
    margin = langid.margin_confidence(F.col("_d.score"), F.col("_d.runner_up"))
    judged = F.struct(
        F.when(F.col("_blank"), "").otherwise(F.coalesce("_d.language", F.lit(""))).alias("lang"),
        F.when(F.col("_blank"), 0.0).otherwise(
            margin if calibration is None else probability(margin, calibration)
        ).alias("conf"),
    )
    found = found.withColumn("_j", judged)
    # Glyphs are counted only for the one ambiguous code, dialect markers only for Arabic.
    found = found.withColumn("_f", F.when(
        F.col("_j.lang") == "fa", let(S.glyph_profile(t), lambda g: let(
            S.script_verdict(g["n_a"], g["n_b"]), lambda v: S.disambiguate(
                F.col("_j.lang"), v["recommendation"], v["confidence"], g["glyphs_a"])))
    ))
    language = F.coalesce("_f.language", "_j.lang")
    found = found.withColumn("language", language).withColumn(
        "_dia", F.when(F.col("language") == "ar", D.detect_dialect(t, lexicon))
    )
    dialect = F.col("_dia.dialect")
    if model_label is not None:
        labelled = F.when(F.col(model_label).isNotNull(), D.family_of_label(F.col(model_label)))
        dialect = F.when(F.col("language") == "ar", F.coalesce(labelled, dialect))
    words = F.col("input_word_count")
    found = found.withColumn("confidence_tier", F.when(F.col("_blank"), "").otherwise(
        T.confidence_tier(F.col("_j.conf"), words)))
    return found.select(
        *df.columns, "language", F.col("_j.conf").alias("confidence"),
        T.is_foreign_strict(F.col("language"), target).alias("is_foreign"),
        F.lit(target).alias("target_language"), "confidence_tier", "input_word_count",
        T.confidence_advisory(F.col("confidence_tier"), words).alias("advisory"),
        F.col("_f.note").alias("disambiguation_note"),
        dialect.alias("dialect"),
        F.col("_dia.confidence").alias("dialect_confidence"),
        F.col("_dia.indicators").alias("dialect_indicators"),
        F.when(dialect.isNotNull(), R.DIALECT_NOTICE).alias("dialect_note"),
    )


def with_route(classified: DataFrame, alt_available: bool = False, text: str = "text") -> DataFrame:
    """Engine of every row and, for Arabic, the dialect route and source token."""
    ar = F.col("language") == "ar"
    decision = F.when(ar, D.route(F.coalesce("dialect", F.lit("Unknown")),
                                  F.coalesce("dialect_confidence", F.lit(0.0)), alt_available))
    engine: Column = S.select_engine(
        F.col(text), F.col("language"), F.col("confidence"), alt_available
    )
    return classified.withColumn("_r", decision).withColumn(
        "engine", F.when(F.col("_r.route") == "SeamlessM4T", "Seamless").otherwise(engine)
    ).withColumn("route", F.col("_r.route")).withColumn(
        "source_token", F.coalesce("_r.source_token", "language")
    ).drop("_r")
