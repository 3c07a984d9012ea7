"""Query registry and the derived tables several queries share.

The given tables hold Latin text only and no paths, addresses or timed segments, so the inputs of
many operators are derived from them by expressions that Spark and the oracle SQL share.

Codes, names, thresholds and notices in the SQL of this package are fixed values: those of ``refdata`` and the
functions, which must come out of both engines alike.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lingotally import session
from lingotally.functions import text as X

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn: Callable[[SparkSession, str], DataFrame]):
        def run(spark: SparkSession, sf: str) -> DataFrame:
            return fn(session.tune(spark), sf)

        run.__name__, run.__doc__ = name, fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql.strip()
        return fn

    return register


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def documents(spark: SparkSession, sf: str, *columns: str) -> DataFrame:
    """Document columns."""
    cols = columns or ("doc_id", "text", "lang", "source", "n_chars")
    return table(spark, sf, "documents").select(*dict.fromkeys(("doc_id", *cols)))


def pages(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages")


def values_sql(rows: list[tuple], names: str) -> str:
    """Inline table for the oracle."""
    def lit(v) -> str:
        if v is None:
            return "NULL"
        if isinstance(v, bool):
            return "TRUE" if v else "FALSE"
        if isinstance(v, (int, float)):
            return repr(v)
        return "'" + str(v).replace("'", "''") + "'"

    body = ", ".join("(" + ", ".join(lit(v) for v in row) + ")" for row in rows)
    return f"(VALUES {body}) AS v({names})"


# ---- SQL fragments ------------------------------------------------------------------------
WORD_RE = r"[^\s\x0b\x{85}\p{Z}]+"
SQL_WS = "chr(9)||chr(10)||chr(11)||chr(12)||chr(13)||' '||chr(133)||chr(160)||chr(12288)"


def sql_words(text: str) -> str:
    return f"regexp_extract_all({text}, '{WORD_RE}')"


def sql_word_count(text: str) -> str:
    return f"CAST(len({sql_words(text)}) AS BIGINT)"


# ---- derived columns ----------------------------------------------------------------------
EXTENSIONS = ["mp4", "wav", "PDF", "jpg", "srt", "txt", "vtt", "MOV", "png", "mp3", "", "tif"]


def file_path(doc_id: Column, source: Column) -> Column:
    """``/ev/<source>/<doc_id>[.<ext>]`` with one of twelve endings by number."""
    ext = F.element_at(F.array(*[F.lit("." + e if e else "") for e in EXTENSIONS]),
                       (doc_id % 12 + 1).cast("int"))
    return F.concat(F.lit("/ev/"), source, F.lit("/"), doc_id.cast("string"), ext)


SQL_PATH = (
    "('/ev/' || source || '/' || doc_id || CASE doc_id % 12 "
    + " ".join(f"WHEN {i} THEN '{'.' + e if e else ''}'" for i, e in enumerate(EXTENSIONS))
    + " END)"
)
SQL_EXT = "lower(regexp_extract(p, '[^/]\\.([^./]+)$', 1))"
SQL_KIND = f"""CASE WHEN {SQL_EXT} IN ('mp4','mov','avi','mkv','m4v','wmv','webm','3gp') THEN 'video'
 WHEN {SQL_EXT} IN ('png','jpg','jpeg','tiff','tif','bmp','gif') THEN 'image'
 WHEN {SQL_EXT} = 'pdf' THEN 'pdf' WHEN {SQL_EXT} IN ('srt','vtt') THEN 'subtitle'
 ELSE 'audio' END"""

TARGET = "en"


def results(spark: SparkSession, sf: str) -> DataFrame:
    """Results table of a batch whose language is given and whose model is the tagging stand-in."""
    from lingotally import refdata as R
    from lingotally.functions import kinds as K, tiers as T

    d = documents(spark, sf)
    path = file_path(F.col("doc_id"), F.col("source"))
    bad = F.col("n_chars") < 20
    foreign = ~bad & T.is_foreign_plain(F.col("lang"), TARGET)
    d = d.withColumn("_w", X.word_count(F.col("text")))
    words = F.col("_w")
    return d.select(
        "doc_id", path.alias("file_path"), K.kind_from_ext(path).alias("input_type"),
        F.when(bad, "").otherwise(F.col("lang")).alias("detected_language"),
        foreign.alias("is_foreign"),
        F.when(bad, "").otherwise(
            T.confidence_tier((F.col("doc_id") % 100) / 100.0, words)).alias("confidence_tier"),
        F.when(~bad, F.col("text")).alias("source_text"),
        F.when(foreign, F.concat(F.lit(f"[{TARGET}] "), F.col("text"))).alias("translated_text"),
        F.when(foreign, F.lit(R.MT_NOTICE)).alias("notice"),
        F.when(bad, "text too short").alias("error"),
        F.lit(None).cast("string").alias("confidence_advisory"),
    )


SQL_RESULTS = f"""results AS (
 SELECT doc_id, p AS file_path, {SQL_KIND} AS input_type,
  CASE WHEN n_chars < 20 THEN '' ELSE lang END AS detected_language,
  n_chars >= 20 AND lang <> '{TARGET}' AS is_foreign,
  CASE WHEN n_chars < 20 THEN '' WHEN nw BETWEEN 1 AND 9 THEN 'LOW'
   WHEN (doc_id % 100)/100.0 >= 0.85 THEN 'HIGH' WHEN (doc_id % 100)/100.0 >= 0.60 THEN 'MEDIUM'
   ELSE 'LOW' END AS confidence_tier,
  CASE WHEN n_chars >= 20 THEN text END AS source_text,
  CASE WHEN n_chars >= 20 AND lang <> '{TARGET}' THEN '[{TARGET}] ' || text END AS translated_text,
  CASE WHEN n_chars < 20 THEN 'text too short' END AS error
 FROM (SELECT *, {SQL_PATH} AS p, {sql_word_count('text')} AS nw FROM documents))"""


def sql_advisory(tier: str, words: str) -> str:
    return f"""CASE WHEN {tier} = 'MEDIUM' THEN 'Medium confidence: have a linguist confirm important text.'
 WHEN {tier} = 'LOW' AND {words} BETWEEN 1 AND 9 THEN 'Only ' || {words} || ' word' ||
  CASE WHEN {words} = 1 THEN '' ELSE 's' END ||
  ': the detected language may be wrong, have a linguist confirm it.'
 WHEN {tier} = 'LOW' THEN 'Low confidence: the detected language may be wrong.' END"""


# ---- timed segments of conversations --------------------------------------------------------
MS_PER_CHAR = 50


def conversation_segments(spark: SparkSession, sf: str) -> DataFrame:
    """Turns as timed segments: 50 ms per character, one after the other."""
    from lingotally.operators.running import running_sums

    c = table(spark, sf, "conversations")
    timed = running_sums(
        c, ["conv_id"], "turn", {"end_ms": F.length("text") * MS_PER_CHAR}
    )
    return timed.select(
        F.col("conv_id").alias("doc_id"), F.col("turn").alias("seg_idx"),
        (F.col("end_ms") - F.length("text") * MS_PER_CHAR).cast("bigint").alias("start_ms"),
        "end_ms", "text", "role",
    )


SQL_SEGMENTS = f"""segs AS (
 SELECT conv_id AS doc_id, turn AS seg_idx, text, role,
  CAST(sum(length(text) * {MS_PER_CHAR}) OVER w - length(text) * {MS_PER_CHAR} AS BIGINT) AS start_ms,
  CAST(sum(length(text) * {MS_PER_CHAR}) OVER w AS BIGINT) AS end_ms
 FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))"""


def review_segments(spark: SparkSession, sf: str) -> DataFrame:
    s = conversation_segments(spark, sf)
    return s.select(
        F.concat(F.lit("/c/"), F.col("doc_id").cast("string")).alias("file_path"),
        F.col("seg_idx").alias("segment_index"), "start_ms", "end_ms",
        F.col("text").alias("source_text"),
        F.concat(F.lit(f"[{TARGET}] "), F.col("text")).alias("translated_text"),
    )


SQL_REVIEW_SEGMENTS = f"""{SQL_SEGMENTS}, rsegs AS (
 SELECT '/c/' || doc_id AS file_path, seg_idx AS segment_index, start_ms, end_ms,
  text AS source_text, '[{TARGET}] ' || text AS translated_text FROM segs)"""
