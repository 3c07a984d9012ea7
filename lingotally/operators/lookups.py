"""Equi-joins with code tables and availability tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lingotally import refdata as R
from lingotally.operators.sizes import broadcast_if_small


def code_lookup(df: DataFrame, codes: DataFrame, key: str, value: str,
                language: str = "language") -> DataFrame:
    """Attach ``value``; a language without an entry gets an error instead of failing the job."""
    side = broadcast_if_small(codes.withColumnRenamed(key, language))
    unmatched = F.concat(F.lit("no code for language "), F.coalesce(language, F.lit("")))
    return df.join(side, language, "left").withColumn(
        f"{value}_error", F.when(F.col(value).isNull(), unmatched)
    )


def choose_installed(requests: DataFrame, installed: DataFrame, key: str,
                     language: str = "language") -> DataFrame:
    """Best available model per request: the language's own, then by size, else the default.

    ``installed`` lists model names and is bounded by the catalogue; ranking is a minimum over
    candidate rows, so it needs no window.
    """
    spark = requests.sparkSession
    own = R.inline_table(
        spark, [(lang, model, 1) for lang, model in R.LANGUAGE_MODELS],
        f"{language} string, model string, priority int",
    )
    general = R.inline_table(spark, R.MODEL_PREFERENCE, "model string, priority int")
    present = installed.select("model").distinct()
    best = general.join(present, "model", "left_semi").agg(
        F.min_by("model", "priority").alias("_general")
    )
    special = own.join(present, "model", "left_semi").select(
        language, F.col("model").alias("_own")
    )
    picked = requests.join(F.broadcast(special), language, "left")  # at most 3 fixed rows
    return picked.select(
        key, language,
        F.coalesce(F.col("_own"), best.scalar(), F.lit(R.DEFAULT_MODEL)).alias("model"),
    )


def missing_components(required: DataFrame, present: DataFrame, key: str = "component") -> DataFrame:
    return required.join(present.select(key).distinct(), key, "left_anti")


def switch_points_to_segments(segments: DataFrame, points: DataFrame, keys: list[str],
                              idx: str = "seg_idx", order: str = "position") -> DataFrame:
    """First switch point whose offset is the segment number, if any."""
    rest = [c for c in points.columns if c not in (*keys, "offset")]
    first = points.groupBy(*keys, F.col("offset").alias(idx)).agg(
        F.min_by(F.struct(*rest), order).alias("_p")
    ).select(*keys, idx, "_p.*")
    return segments.join(first, [*keys, idx], "left")
