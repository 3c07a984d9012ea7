"""Row filters and per-row decisions over documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lingotally import refdata as R
from lingotally.functions import text as X, tiers


def filter_kinds(df: DataFrame, kinds: list[str] | None, kind: str = "kind") -> DataFrame:
    """Allow-list on the kind column; without a list every row stays."""
    return df if kinds is None else df.filter(F.col(kind).isin([k.lower() for k in kinds]))


def mark_blank(df: DataFrame, text: str = "text") -> DataFrame:
    """Keep blank rows, but without text; ``is_blank`` tells them apart."""
    blank = X.is_blank(F.col(text))
    return df.withColumn("is_blank", blank).withColumn(text, F.when(~blank, F.col(text)))


def non_blank(df: DataFrame, text: str = "text") -> DataFrame:
    return df.filter(~X.is_blank(F.col(text)))


def foreign_only(df: DataFrame, target: str, language: str = "language") -> DataFrame:
    """Rows that need translation; plain comparisons, so the filter reaches the scan."""
    return df.filter((F.col(language) != "") & (F.col(language) != target))


def with_notice(df: DataFrame, language: str = "language", engine: str | None = None,
                base: str = R.MT_NOTICE) -> DataFrame:
    chosen = F.col(engine) if engine else None
    return df.withColumn("notice", tiers.notice(F.col(language), chosen, base))


def to_artifact(df: DataFrame, path: str = "file_path") -> DataFrame:
    """One artifact record per translated row; the raw record stays a struct."""
    name = X.base_name(F.col(path))
    return df.filter(F.col("translated_text").isNotNull()).select(
        F.concat(F.lit(R.TITLE_PREFIX + "Translation: "), name).alias("title"),
        F.col("translated_text").alias("detail"),
        F.col(path).alias("source_path"),
        F.lit(50).alias("confidence"),
        F.lit("High").alias("forensic_value"),
        F.lit(True).alias("is_machine_translation"),
        F.coalesce(X.missing_if_empty(F.col("notice")), F.lit(R.MT_NOTICE)).alias("notice"),
        F.struct("source_text", "translated_text", "detected_language").alias("raw_data"),
    )


def notice_violations(df: DataFrame) -> DataFrame:
    """Translated rows without a notice; must be empty before anything is written."""
    return df.filter(
        F.col("translated_text").isNotNull() & X.is_blank(F.col("notice"))
    )


def artifact_violations(df: DataFrame) -> DataFrame:
    good = (
        F.col("title").startswith(R.TITLE_PREFIX)
        & ~X.is_blank(F.col("notice"))
        & F.col("is_machine_translation")
    )
    return df.filter(~F.coalesce(good, F.lit(False)))


def assert_notice(df: DataFrame) -> DataFrame:
    """Fail the job on the first translated row without a notice; rows pass unchanged."""
    ok = F.col("translated_text").isNull() | ~X.is_blank(F.col("notice"))
    checked = F.when(
        F.assert_true(ok, "translated row without a notice").isNull(), F.col("notice")
    )
    return df.withColumn("notice", checked)


def search_languages(catalogue: DataFrame, query: str) -> DataFrame:
    """Case-insensitive substring search over code, name and note, in tier order."""
    needle = F.lit(query.lower())
    hit = F.lit(False)
    for column in ("code", "name", "note"):
        hit = hit | F.lower(F.col(column)).contains(needle)
    return catalogue.filter(hit).orderBy("tier_rank", "position")


def is_rtl(df: DataFrame, language: str = "language") -> DataFrame:
    return df.withColumn("is_rtl", F.coalesce(F.col(language).isin(R.RTL_CODES), F.lit(False)))
