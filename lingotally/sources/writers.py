"""Writers. Order exists only here: files are range-partitioned and sorted, never one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lingotally import refdata as R
from lingotally.functions import text as X
from lingotally.operators.filters import assert_notice
from lingotally.operators.manifest import artefact_name, manifest_header
from lingotally.operators.segments import ordered_concat, ordered_parts
from lingotally.sources.artefacts import write_artefacts

CSV_COLUMNS = ["file_path", "input_type", "detected_language", "is_foreign", "transcript",
               "translation", "error"]


def write_results_json(results: DataFrame, summary: DataFrame, groups: DataFrame, out: str,
                       metadata: dict[str, str] | None = None) -> None:
    """Results, summary, groups and metadata as separate JSON folders below ``out``."""
    assert_notice(results).orderBy("file_path").write.mode("overwrite").json(f"{out}/results")
    summary.write.mode("overwrite").json(f"{out}/summary")
    groups.write.mode("overwrite").json(f"{out}/groups")
    spark = results.sparkSession
    facts = list((metadata or {}).items())
    R.inline_table(spark, facts, "key string, value string").write.mode("overwrite").json(
        f"{out}/metadata"
    )


def csv_rows(results: DataFrame) -> DataFrame:
    """RFC 4180 text of each result row, columns in report order."""
    def text(c: str) -> Column:
        return X.csv_field(F.coalesce(F.col(c), F.lit("")))

    line = F.concat_ws(
        ",", text("file_path"), text("input_type"), text("detected_language"),
        F.col("is_foreign").cast("string"), text("source_text"), text("translated_text"),
        text("error"),
    )
    return results.select("file_path", line.alias("csv_row"))


def write_results_csv(results: DataFrame, out: str, notice: str = R.MT_NOTICE) -> None:
    """Seven report columns and the notice; part files cannot share one comment line."""
    checked = assert_notice(results)
    checked.select(
        "file_path", "input_type", "detected_language", "is_foreign",
        F.col("source_text").alias("transcript"), F.col("translated_text").alias("translation"),
        "error", F.coalesce("notice", F.lit(notice)).alias("notice"),
    ).orderBy("file_path").write.mode("overwrite").option("header", True).option(
        "escape", '"'
    ).csv(out)


def html_fragments(results: DataFrame, tiers: bool = True) -> DataFrame:
    """Escaped HTML table row per result. Rows of a language are a sort range, not one cell."""
    def cell(c: Column) -> Column:
        return F.concat(F.lit("<td>"), X.html_escape(F.coalesce(c, F.lit(""))), F.lit("</td>"))

    row_class = F.when(F.col("error").isNotNull(), "errored").when(
        F.col("is_foreign"), "foreign"
    ).otherwise("")
    shown = F.coalesce("translated_text", "error")
    tier = [cell(F.col("confidence_tier"))] if tiers else []
    return results.select(
        F.coalesce("detected_language", F.lit("")).alias("language_code"), "file_path",
        F.concat(
            F.lit('<tr class="'), row_class, F.lit('">'), cell(F.col("file_path")),
            cell(F.col("input_type")), cell(F.col("detected_language")), *tier,
            cell(F.when(F.col("is_foreign"), "yes").otherwise("no")), cell(F.col("source_text")),
            cell(shown), F.lit("</tr>"),
        ).alias("fragment"),
    )


def write_html_fragments(results: DataFrame, out: str) -> None:
    """Fragments in (language, path) order; a large language spans several sorted files."""
    rows = html_fragments(results).repartitionByRange("language_code", "file_path")
    ordered = rows.sortWithinPartitions("language_code", "file_path")
    ordered.select("language_code", F.col("fragment").alias("value")).write.mode(
        "overwrite"
    ).partitionBy("language_code").text(out)


def _segment_line() -> Column:
    return F.concat(
        F.lit("["), F.col("start_ms").cast("string"), F.lit(" - "),
        F.col("end_ms").cast("string"), F.lit(" ms] "), F.col("source_text"), F.lit(" → "),
        F.col("translated_text"), F.lit("\n"),
    )


SEGMENT_HEAD = "\n--- SEGMENTS ---\n"


def _artefact_head(done: DataFrame, notice: str) -> tuple[Column, Column]:
    """Language shown, and head lines, source and translation of an artefact."""
    language = F.coalesce(X.missing_if_empty(F.col("detected_language")), F.lit("(unknown)"))
    return language, F.concat(
        F.lit("# Machine translation\n# Source file: "), F.col("file_path"),
        F.lit("\n# Detected language: "), language,
        F.coalesce(F.concat(F.lit("\n# Confidence advisory: "), F.col("confidence_advisory")),
                   F.lit("")),
        F.lit(f"\n# {notice}\n\n--- SOURCE ---\n"),
        F.coalesce("source_text", F.lit("(no source text)")),
        F.lit("\n\n--- TRANSLATION ---\n"), F.col("translated_text"), F.lit("\n"),
    )


def translation_text(results: DataFrame, segments: DataFrame | None = None,
                     notice: str = R.MT_NOTICE) -> DataFrame:
    """Text artefact per translated file: head lines, source, translation, segment lines."""
    done = results.filter("translated_text is not null")
    if segments is not None:
        lines = ordered_concat(segments, ["file_path"], "segment_index", _segment_line(), "")
        done = done.join(lines.withColumnRenamed("text", "_lines"), "file_path", "left")
    else:
        done = done.withColumn("_lines", F.lit(None).cast("string"))
    language, head = _artefact_head(done, notice)
    body = F.concat(head, F.coalesce(F.concat(F.lit(SEGMENT_HEAD), F.col("_lines")), F.lit("")))
    return done.select("file_path", language.alias("language"), body.alias("body"))


def translation_parts(results: DataFrame, segments: DataFrame | None = None,
                      notice: str = R.MT_NOTICE) -> DataFrame:
    """``translation_text`` in parts (file_path, part, body): head, source and translation first, then the segment
    lines by thousands, so that no cell grows with the segments of a file."""
    done = results.filter("translated_text is not null")
    first = done.select("file_path", F.lit(-2).cast("bigint").alias("part"), _artefact_head(done, notice)[1].alias("body"))
    if segments is None:
        return first
    lines = ordered_parts(segments, ["file_path"], "segment_index", _segment_line(), "").select(
        "file_path", F.col("part").cast("bigint"), F.col("text").alias("body"))
    lines = lines.join(done.select("file_path"), "file_path", "left_semi")
    title = lines.select("file_path").distinct().select(
        "file_path", F.lit(-1).cast("bigint").alias("part"), F.lit(SEGMENT_HEAD).alias("body"))
    return first.unionByName(title).unionByName(lines)


def write_translation_files(parts: DataFrame, out: str, target: str) -> None:
    """One text file per artefact below ``out``, under the manifest's ``translation_file``."""
    write_artefacts(parts.select(artefact_name(F.col("file_path"), target).alias("name"), "part", "body"), out)


def write_translation_text(artefacts: DataFrame, out: str, target: str) -> None:
    """JSON rows (translation_file, file_path, body), addressed by the manifest's ``translation_file``.

    A row holds a whole artefact, line breaks included: the form for millions of them, beside
    ``write_translation_files``.
    """
    named = artefacts.withColumn("translation_file", artefact_name(F.col("file_path"), target))
    named.select("language", "translation_file", "file_path", "body").write.mode(
        "overwrite").partitionBy("language").json(out)


def write_manifest(rows: DataFrame, out: str, source: str, notice: str = R.MT_NOTICE,
                   facts: dict[str, str] | None = None) -> None:
    """Header first: it refuses translated files without a notice."""
    manifest_header(rows, source, notice, facts).write.mode("overwrite").json(f"{out}/header")
    rows.orderBy("original_path").write.mode("overwrite").json(f"{out}/files")


def write_metrics(metrics: DataFrame, out: str) -> None:
    metrics.write.mode("overwrite").json(out)


def event_lines(events: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One JSON object per event; null fields are left out."""
    return events.select(F.to_json(F.struct(*(columns or events.columns))).alias("value"))
