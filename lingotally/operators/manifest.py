"""Manifest rows and header."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lingotally import refdata as R
from lingotally.functions import text as X

MANIFEST_VERSION = "1.0"


def file_digests(files: DataFrame, content: Column, path: str = "path") -> DataFrame:
    """Path, digest and size; the content itself stays in the scan stage."""
    return files.select(
        F.col(path).alias("file_path"), F.sha2(content, 256).alias("sha256"),
        F.octet_length(content).cast("bigint").alias("size_bytes"),
    )


def artefact_name(path: Column, target: str) -> Column:
    """Name of the translation artefact of a file within its package."""
    return F.concat(F.lit("translations/"), X.base_name(path), F.lit("."),
                    F.substring(F.sha2(path, 256), 1, 8), F.lit(f".{target}.txt"))


def manifest_rows(results: DataFrame, digests: DataFrame, target: str) -> DataFrame:
    """One manifest row per result; a missing original has an empty digest and size 0.

    Artefact names carry a short path hash, since base names repeat across folders.
    """
    name = X.base_name(F.col("file_path"))
    translated = F.col("translated_text").isNotNull()
    artefact = artefact_name(F.col("file_path"), target)
    slim = results.select(
        "file_path", F.col("detected_language").alias("language"), translated.alias("translated")
    )
    return slim.join(digests, "file_path", "left").select(
        name.alias("original_name"), F.col("file_path").alias("original_path"),
        F.coalesce("sha256", F.lit("")).alias("sha256"),
        F.coalesce("size_bytes", F.lit(0)).alias("size_bytes"),
        "language", "translated",
        F.when(F.col("translated"), artefact).otherwise("").alias("translation_file"),
    )


def manifest_header(rows: DataFrame, source: str, notice: str = R.MT_NOTICE,
                    facts: dict[str, str] | None = None) -> DataFrame:
    """One header row; translated files without a notice fail the job."""
    facts = facts or {}
    counts = rows.agg(
        F.count("*").alias("file_count"), F.count_if("translated").alias("translated_count")
    )
    legal = (F.col("translated_count") == 0) | (F.lit(notice) != "")
    checked = F.when(
        F.assert_true(legal, "manifest with translations lacks a notice").isNull(), F.lit(notice)
    )
    extra = [F.lit(facts.get(k)).cast("string").alias(k)
             for k in ("examiner", "agency", "case_number", "created_at")]
    return counts.select(
        F.lit(MANIFEST_VERSION).alias("package_version"), *extra,
        F.lit(source).alias("source_directory"), "file_count", "translated_count",
        checked.alias("machine_translation_notice"),
    )


def custody_facts(counters: DataFrame, facts: dict[str, str]) -> DataFrame:
    """Key / value rows of the custody record: given facts first, then the batch counters."""
    given = R.inline_table(
        counters.sparkSession, [(i, k, v) for i, (k, v) in enumerate(facts.items())],
        "position int, key string, value string",
    )
    names = ["processed", "foreign_language", "translated", "errors"]
    pairs = F.array(*[
        F.struct(F.lit(len(facts) + i).alias("position"), F.lit(n).alias("key"),
                 F.col(n).cast("string").alias("value"))
        for i, n in enumerate(names)
    ])
    return given.unionByName(counters.select(F.inline(pairs)))
