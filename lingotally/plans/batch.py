"""Batch run: files -> one results table -> rollups and report."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from lingotally.functions import kinds as K, tiers as T
from lingotally.operators import filters, infer, rollups
from lingotally.plans.classify import classify
from lingotally.session import stored
from lingotally.sources import writers

RESULT_COLUMNS = [
    "file_path", "input_type", "detected_language", "is_foreign", "confidence_tier",
    "confidence_advisory", "source_text", "translated_text", "notice", "error",
]


@dataclass
class BatchPlan:
    """Lazy tables of one run; ``results`` feeds all the others."""

    files: DataFrame
    results: DataFrame
    target: str

    def counters(self) -> DataFrame:
        return rollups.batch_counters(self.results, self.files)

    def groups(self) -> DataFrame:
        return rollups.language_groups(self.results)

    def summary(self, elapsed_seconds: float = 0.0) -> DataFrame:
        return rollups.summary(self.results, self.target, elapsed_seconds,
                               total_found=self.files)


def run_batch(files: DataFrame, detect, factory: infer.Factory, target: str,
              allowed: list[str] | None = None, partitions: int | None = None) -> BatchPlan:
    """Results table of a run over files (file_path, kind, length, text, upstream_language, error).

    Text extraction is upstream: a file whose text could not be read arrives with ``error``.
    Failing files become rows with ``error``; blank ones stay as rows without text. The gates and
    the classification are one narrow pass, stored once; all branches read the stored rows, and only
    foreign texts go through the model step.
    """
    eligible = filters.filter_kinds(files, allowed)
    gate = K.size_gate(F.col("length"), F.col("text"))
    checked = eligible.withColumn("error", F.coalesce("error", gate)).withColumn(
        "text", F.when(F.col("error").isNull(), F.col("text"))
    )
    judged = classify(checked, detect, target).drop("is_foreign").withColumns({
        "language": T.resolve_language(F.col("language"), F.col("upstream_language")),
        "has_text": F.col("error").isNull() & (F.col("confidence_tier") != ""),
    })
    # A missing language differs from the target, so it counts as foreign here.
    judged = judged.withColumn(
        "is_foreign", F.col("has_text") & T.is_foreign_plain(F.col("language"), target)
    )
    judged = stored(judged, "judged")
    return BatchPlan(files, _translated(judged, factory, partitions), target)


def _translated(judged: DataFrame, factory: infer.Factory, partitions: int | None) -> DataFrame:
    """Attach translations of the foreign rows; the others pass by the model step untouched."""
    rest = judged.filter(~F.col("is_foreign")).select(
        *_base(), F.lit(None).cast("string").alias("translated_text"),
        F.lit(None).cast("string").alias("notice"), "error",
    )
    todo = judged.filter(F.col("is_foreign")).drop("error")
    done = infer.infer_distinct(
        todo, factory, F.col("file_path"), "text", "translated_text", partitions
    )
    notice = F.when(F.col("translated_text").isNotNull(), T.notice(F.col("language")))
    rows = done.select(*_base(), "translated_text", notice.alias("notice"), "error")
    # A file whose translation failed is an error row without language, text or tier.
    bad = F.col("error").isNotNull()
    rows = rows.withColumns({
        "detected_language": F.when(bad, "").otherwise(F.col("detected_language")),
        "is_foreign": F.col("is_foreign") & ~bad,
        "confidence_tier": F.when(bad, "").otherwise(F.col("confidence_tier")),
        "confidence_advisory": F.when(~bad, F.col("confidence_advisory")),
        "source_text": F.when(~bad, F.col("source_text")),
    })
    return rest.unionByName(rows).select(*RESULT_COLUMNS)


def _base() -> list:
    has_text = F.col("has_text")
    return [
        F.col("file_path"), F.col("kind").alias("input_type"),
        F.when(F.col("error").isNull(), F.coalesce("language", F.lit(""))).otherwise("")
        .alias("detected_language"),
        F.col("is_foreign"),
        F.when(has_text, F.col("confidence_tier")).otherwise("").alias("confidence_tier"),
        F.when(has_text, F.col("advisory")).alias("confidence_advisory"),
        F.when(has_text, F.col("text")).alias("source_text"),
    ]


def write_batch(plan: BatchPlan, out: str, elapsed_seconds: float = 0.0,
                metadata: dict[str, str] | None = None) -> BatchPlan:
    """Write the results once as a table, then derive every rollup and report from that table.

    The written table cuts the lineage: a lost executor cannot cause another model run.
    """
    filters.assert_notice(plan.results).write.mode("overwrite").parquet(f"{out}/table")
    written = BatchPlan(
        plan.files, plan.results.sparkSession.read.parquet(f"{out}/table"), plan.target
    )
    writers.write_results_json(
        written.results, written.summary(elapsed_seconds), written.groups(), f"{out}/json", metadata
    )
    writers.write_results_csv(written.results, f"{out}/csv")
    writers.write_html_fragments(written.results, f"{out}/html")
    return written
