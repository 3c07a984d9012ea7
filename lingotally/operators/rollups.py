"""Batch rollups: counts, language groups, checks, regressions and checksum verification."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lingotally import refdata as R
from lingotally.functions import text as X

REGRESSION_RATIO = 1.2


def kind_counts(df: DataFrame, kind: str = "kind") -> DataFrame:
    return df.groupBy(kind).agg(F.count("*").alias("n_files"))


def batch_counters(results: DataFrame, total_found: DataFrame | None = None) -> DataFrame:
    """One row of counters; ``total_found`` counts every file, the filtered-out ones included."""
    ok = F.col("error").isNull()
    counters = results.agg(
        F.count("*").alias("_rows"),
        F.count_if(ok).alias("processed"),
        F.count_if(~ok).alias("errors"),
        F.count_if(ok & F.col("is_foreign")).alias("foreign_language"),
        F.count_if(ok & F.col("translated_text").isNotNull()).alias("translated"),
    )
    if total_found is None:
        return counters.withColumnRenamed("_rows", "total_files")
    found = total_found.agg(F.count("*"))
    return counters.drop("_rows").withColumn("total_files", found.scalar())


def language_counts(results: DataFrame, language: str = "detected_language") -> DataFrame:
    return (
        results.filter(F.col(language) != "")
        .groupBy(F.col(language).alias("language_code")).agg(F.count("*").alias("n_files"))
    )


def languages_detected(results: DataFrame, language: str = "detected_language") -> DataFrame:
    """Key-sorted map of language to file count (one entry per language code)."""
    pairs = F.collect_list(F.struct("language_code", "n_files"))
    return language_counts(results, language).agg(
        F.map_from_entries(F.array_sort(pairs)).alias("languages_detected")
    )


def with_language_name(df: DataFrame, code: str = "language_code") -> DataFrame:
    names = F.broadcast(R.language_names(df.sparkSession))  # 32 fixed rows
    return df.join(names.withColumnRenamed("language_code", code), code, "left").withColumn(
        "language_name", F.coalesce("language_name", F.lit(R.UNKNOWN_NAME))
    )


def language_groups(results: DataFrame, language: str = "detected_language",
                    text: str = "source_text") -> DataFrame:
    """Files and words per language, largest first; members stay rows of the results table."""
    groups = (
        results.filter(F.col(language) != "")
        .groupBy(F.col(language).alias("language_code"))
        .agg(F.count("*").alias("file_count"),
             F.sum(X.word_count(F.col(text))).cast("bigint").alias("total_words"))
    )
    return with_language_name(groups).select(
        "language_code", "language_name", "file_count", "total_words"
    ).orderBy(F.desc("file_count"), "language_code")


def dominant_language(groups: DataFrame, target: str, code: str = "language_code",
                      n: str = "file_count") -> DataFrame:
    """Most frequent language apart from the target; ties go to the largest code."""
    rank = F.when(F.col(code) != target, F.struct(n, code))
    return groups.agg(F.max_by(code, rank).alias("dominant_language"))


def summary(results: DataFrame, target: str, elapsed_seconds: float, notice: str = R.MT_NOTICE,
            total_found: DataFrame | None = None) -> DataFrame:
    """Counters, language map, elapsed time and notice in one row (scalar subqueries)."""
    return (
        batch_counters(results, total_found)
        .withColumn("languages_detected", languages_detected(results).scalar())
        .withColumn("dominant_language",
                    dominant_language(language_groups(results), target).scalar())
        .withColumn("processing_time_seconds", F.lit(float(elapsed_seconds)))
        .withColumn("machine_translation_notice", F.lit(notice))
    )


def check_rollup(checks: DataFrame, status: str = "status") -> DataFrame:
    s = F.col(status)
    return checks.agg(
        F.count_if(s == "pass").alias("passed"), F.count_if(s == "fail").alias("failed"),
        F.count_if(s == "skip").alias("skipped"), F.count_if(s == "warn").alias("warned"),
    ).withColumn("ready", F.col("failed") == 0)


def regressions(fresh: DataFrame, baseline: DataFrame, ratio: float = REGRESSION_RATIO,
                order: str = "position") -> DataFrame:
    """Tests slower than ``ratio`` times their first baseline entry; a zero baseline is skipped."""
    first = baseline.groupBy("test_name").agg(
        F.min_by("duration_ms", order).alias("baseline_ms")
    )
    joined = fresh.join(first, "test_name").filter("baseline_ms <> 0")
    return joined.withColumn("ratio", F.col("duration_ms") / F.col("baseline_ms")).filter(
        F.col("ratio") > ratio
    )


def verify_checksums(files: DataFrame, expected: DataFrame, key: str = "path") -> DataFrame:
    """``ok``, ``mismatch`` or ``skipped`` per expected file, with both hashes."""
    exp = expected.select(key, F.col("sha256").alias("expected_sha256"))
    got = files.select(key, F.col("sha256").alias("computed_sha256"))
    status = (
        F.when(F.coalesce("expected_sha256", F.lit("")) == "", "skipped")
        .when(F.col("computed_sha256").isNull(), "skipped")
        .when(F.col("expected_sha256") == F.col("computed_sha256"), "ok")
        .otherwise("mismatch")
    )
    return exp.join(got, key, "left").withColumn("status", status)


def text_metrics(df: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    t = F.col(text)
    return df.select(*keys, F.octet_length(t).cast("bigint").alias("n_bytes"),
                     X.word_count(t).cast("bigint").alias("n_words"))
