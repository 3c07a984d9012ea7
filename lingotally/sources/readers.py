"""Readers: file trees, text corpora, lists, subtitles, flags, event logs, reference tables.

``scan_tree`` lists every file; the readers of texts are Spark's own, which leave out names that start with ``_``
or ``.``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from lingotally.functions import kinds, net, text as X
from lingotally.operators.sizes import broadcast_if_small
from lingotally.sources import tree

EVENT_TYPES = ["segment", "dialect", "code_switch", "complete", "error"]
EVENT_SCHEMA = (
    "type string, run_id string, seq bigint, index bigint, start_ms bigint, end_ms bigint, "
    "original string, translated string, is_complete boolean, dialect string, "
    "confidence double, source string, indicators array<string>, offset bigint, `from` string, "
    "`to` string, total_segments bigint, duration_ms bigint, message string, "
    "machine_translation_notice string"
)
SUBTITLE_GLOB = "*.{[sS][rR][tT],[vV][tT][tT]}"
FLAG_SCHEMA = (
    "flags array<struct<filePath:string,file_path:string,segmentIndex:bigint,segment_index:bigint,"
    "examinerNote:string,examiner_note:string,reviewStatus:string,review_status:string,"
    "flaggedAt:string,flagged_at:string>>, _corrupt_record string"
)


def scan_tree(spark: SparkSession, root: str, head: int = 0) -> DataFrame:
    """Every file below ``root``, hidden ones too, symbolic links left out: path, length, modificationTime, and with
    ``head`` the first bytes of each. Filters on path and length are made before a file is opened."""
    return tree.load_tree(spark, root, head)


def read_heads(files: DataFrame, n: int = 16) -> DataFrame:
    """The first ``n`` bytes of every file, whatever its length; only these are read. Null if it cannot be opened."""
    if "head" in files.columns:
        return files.withColumn("head", F.substring("head", 1, n))
    return tree.with_heads(files, n)


def sniff_kinds(files: DataFrame) -> DataFrame:
    """``kind`` by leading bytes, else by extension."""
    heads = files if "head" in files.columns else read_heads(files)
    return heads.withColumn("kind", kinds.kind_robust(F.col("path"), F.col("head")))


def scan_text_corpus(spark: SparkSession, root: str) -> DataFrame:
    """One row per ``.txt`` file with its whole text."""
    return (
        spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.txt")
        .text(root, wholetext=True)
        .select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    )


def content_lines(df: DataFrame, line: str = "value") -> DataFrame:
    """Trimmed lines without blank ones and ``#`` comments."""
    t = X.strip(F.col(line))
    return df.withColumn(line, t).filter((t != "") & ~t.startswith("#"))


def parse_labelled_values(df: DataFrame, line: str = "value") -> DataFrame:
    """``<int> [label]`` lines to raw, value, label; a bad number goes to ``error``."""
    pattern = rf"^([^{X.WS_CLASS}]+)(?:[{X.WS_CLASS}](?s:(.*)))?$"
    raw = F.regexp_extract(line, pattern, 1)
    label = F.regexp_extract(line, pattern, 2)
    has_label = F.col(line).rlike(rf"[{X.WS_CLASS}]")
    value = F.when(raw.rlike(r"^[+-]?[0-9]+$"), raw.try_cast("bigint"))
    rest = [c for c in df.columns if c != line]
    return content_lines(df, line).select(
        *rest, raw.alias("raw"), value.alias("value"),
        F.when(has_label, X.strip(label)).alias("label"),
        F.when(value.isNull(), F.concat(F.lit("not an integer: "), raw)).alias("error"),
    )


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """path, line_no, value of every line of list files of any size.

    Files are read in splits. A first pass counts the lines of every split, running sums over a file's splits give
    the number each begins with, and the second pass adds a line's place in its split: no file is ever one row, and
    only one row per split is shuffled.
    """
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_id"), F.regexp_replace("value", "\r$", "").alias("value"))
    splits = lines.groupBy("path", "_block").agg(F.count("*").alias("_n"), F.min("_id").alias("_first"))
    before = Window.partitionBy("path").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    begins = splits.select(F.col("path").alias("_p"), F.col("_block").alias("_b"), "_first",
                           F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    numbered = lines.join(broadcast_if_small(begins), (F.col("path") == F.col("_p")) & (F.col("_block") == F.col("_b")))
    return numbered.select("path", (F.col("_before") + F.col("_id") - F.col("_first") + 1).alias("line_no"), "value")


def scan_labelled_values(spark: SparkSession, path: str, numbered: bool = True) -> DataFrame:
    lines = numbered_lines(spark, path) if numbered else spark.read.text(path)
    return parse_labelled_values(lines)


def scan_ip_list(spark: SparkSession, path: str, numbered: bool = True) -> DataFrame:
    """One address per line; a malformed one carries ``error`` and the scan goes on."""
    lines = content_lines(numbered_lines(spark, path) if numbered else spark.read.text(path))
    return lines.withColumnRenamed("value", "ip").withColumn(
        "error", F.when(~net.ip_valid(F.col("ip")), "not a valid IP address")
    )


def scan_subtitles(spark: SparkSession, root: str) -> DataFrame:
    """Bodies of ``.srt`` and ``.vtt`` files; other names carry ``error`` and are never opened."""
    deep = spark.read.option("recursiveFileLookup", "true")
    body = deep.option("pathGlobFilter", SUBTITLE_GLOB).text(root, wholetext=True).select(
        F.col("_metadata.file_path").alias("path"), F.col("value").alias("body"))
    ext = kinds.extension(F.col("path"))
    is_cue = F.coalesce(ext.isin("srt", "vtt"), F.lit(False))
    body = body.filter(is_cue).select("*", ext.alias("kind"), F.lit(None).cast("string").alias("error"))
    other = scan_tree(spark, root).filter(~is_cue).select(
        F.col("path"), *[F.lit(None).cast("string").alias(c) for c in ("body", "kind")],
        F.lit("not a subtitle file").alias("error"))
    return body.unionByName(other)


def flag_rows(raw: DataFrame) -> DataFrame:
    """Flags of parsed documents; each field in either spelling, missing ones empty or 0."""
    f = raw.filter("flags is not null").select(F.inline("flags"))

    def pick(a: str, b: str, default: str | int) -> Column:
        return F.coalesce(F.col(a), F.col(b), F.lit(default))

    return f.select(
        pick("filePath", "file_path", "").alias("file_path"),
        pick("segmentIndex", "segment_index", 0).cast("bigint").alias("segment_index"),
        pick("examinerNote", "examiner_note", "").alias("examiner_note"),
        pick("reviewStatus", "review_status", "").alias("review_status"),
        pick("flaggedAt", "flagged_at", "").alias("flagged_at"),
    )


def scan_review_flags(spark: SparkSession, path: str) -> DataFrame:
    """Review flags of JSON documents; unreadable documents are skipped."""
    raw = spark.read.option("multiLine", "true").option("mode", "PERMISSIVE").schema(
        FLAG_SCHEMA
    ).json(path)
    return flag_rows(raw)


def parse_events(lines: DataFrame, types: list[str] = EVENT_TYPES, line: str = "value",
                 schema: str = EVENT_SCHEMA) -> DataFrame:
    """Known events of NDJSON lines; blank, malformed and unknown lines drop out."""
    rest = [c for c in lines.columns if c != line]
    parsed = lines.filter(~X.is_blank(F.col(line))).select(
        *rest, F.from_json(line, schema, {"mode": "PERMISSIVE"}).alias("_e")
    )
    return parsed.filter(F.col("_e.type").isin(types)).select(*rest, "_e.*")


def scan_event_log(spark: SparkSession, path: str, streaming: bool = False) -> DataFrame:
    reader = spark.readStream if streaming else spark.read
    return parse_events(reader.text(path))


def range_table(spark: SparkSession, path: str) -> DataFrame:
    """Address ranges (lo, hi, country_code, country_name, city, latitude, longitude)."""
    return spark.read.parquet(path)


def rule_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def baseline_metrics(spark: SparkSession, path: str) -> DataFrame:
    """Saved metrics: test_name, duration_ms, position."""
    return spark.read.schema("test_name string, duration_ms bigint, position int").json(path)
