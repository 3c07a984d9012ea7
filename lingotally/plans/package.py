"""Package of a finished batch: manifest, artefacts, review list, custody facts."""

from __future__ import annotations

from pyspark.sql import DataFrame

from lingotally import refdata as R
from lingotally.operators import manifest as M, review
from lingotally.plans.batch import BatchPlan
from lingotally.sources import writers


def build_package(batch: BatchPlan, digests: DataFrame, out: str, source: str,
                  flags: DataFrame | None = None, segments: DataFrame | None = None,
                  facts: dict[str, str] | None = None, notice: str = R.MT_NOTICE) -> None:
    """Write every part of a package below ``out``. ``batch.results`` should be a stored table.

    Translations are files under the manifest's names; ``translation_rows`` has the same as a table.
    """
    facts = facts or {}
    rows = M.manifest_rows(batch.results, digests, batch.target)
    writers.write_manifest(rows, f"{out}/manifest", source, notice, facts)
    artefacts = writers.translation_text(batch.results, segments, notice)
    writers.write_translation_text(artefacts, f"{out}/translation_rows", batch.target)
    writers.write_translation_files(writers.translation_parts(batch.results, segments, notice), out, batch.target)
    writers.write_html_fragments(batch.results, f"{out}/report")
    M.custody_facts(batch.counters(), facts).write.mode("overwrite").json(f"{out}/custody")
    if flags is not None:
        segs = segments if segments is not None else empty_segments(batch.results)
        shown = review.flags_to_results(flags, batch.results, segs)
        shown.orderBy("file_path", "segment_index").write.mode("overwrite").json(f"{out}/review")


def empty_segments(results: DataFrame) -> DataFrame:
    return results.sparkSession.createDataFrame(
        [], "file_path string, segment_index bigint, start_ms bigint, end_ms bigint, "
            "source_text string, translated_text string"
    )
