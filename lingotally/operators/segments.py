"""Timed segments: numbering, transcripts, rendering, decoder output, chunk statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lingotally.functions import cues, decoded, text as X

PART_ROWS = 4_096


def segment_index(df: DataFrame, items: Column, keys: list[str], start: int = 0) -> DataFrame:
    """One row per array item, numbered in order from ``start``."""
    return df.select(*keys, F.posexplode(items).alias("_p", "text")).select(
        *keys, (F.col("_p") + start).alias("seg_idx"), "text"
    )


def ordered_parts(df: DataFrame, keys: list[str], idx: str, text: Column, sep: str,
                  rows: int = PART_ROWS) -> DataFrame:
    """Text of each key in order, in parts of at most ``rows`` segments.

    A part covers a fixed range of segment numbers, so no task holds more than that at once however
    many rows one document has. This is the form to write when documents are unbounded.
    """
    item = F.struct(F.col(idx).alias("i"), text.alias("t"))
    ordered = F.array_sort(F.collect_list(item))
    joined = F.array_join(F.transform(ordered, lambda s: s["t"]), sep)
    return df.groupBy(*keys, F.floor(F.col(idx) / rows).alias("part")).agg(joined.alias("text"))


def ordered_concat(df: DataFrame, keys: list[str], idx: str, text: Column, sep: str,
                   rows: int = PART_ROWS) -> DataFrame:
    """One cell per key: the parts of ``ordered_parts`` joined in order."""
    parts = ordered_parts(df, keys, idx, text, sep, rows)
    ordered = F.array_sort(F.collect_list(F.struct("part", "text")))
    return parts.groupBy(*keys).agg(
        F.array_join(F.transform(ordered, lambda s: s["text"]), sep).alias("text")
    )


def transcript(segments: DataFrame, keys: list[str], idx: str = "seg_idx",
               text: str = "text") -> DataFrame:
    """Trimmed, non-empty segment texts joined by one space; empty where all segments are blank."""
    kept = segments.withColumn("_t", X.strip(F.col(text))).filter("_t <> ''")
    joined = ordered_concat(kept, keys, idx, F.col("_t"), " ")
    every = segments.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).distinct()
    same = [F.col(f"_k{i}").eqNullSafe(F.col(k)) for i, k in enumerate(keys)]
    return every.join(joined, same, "left").select(
        *[F.col(f"_k{i}").alias(k) for i, k in enumerate(keys)], F.coalesce("text", F.lit("")).alias("transcript"))


def cue_concat(segments: DataFrame, keys: list[str], idx: str = "cue_idx",
               text: str = "text") -> DataFrame:
    """Cue texts joined by one space, neither trimmed nor filtered."""
    return ordered_concat(segments, keys, idx, F.coalesce(F.col(text), F.lit("")), " ")


def render_srt(segments: DataFrame, keys: list[str], idx: str = "seg_idx",
               text: str = "text") -> DataFrame:
    """SRT body per key; segment numbers are dense from 0, cue numbers from 1."""
    cue = cues.srt_cue(F.col(idx) + 1, F.col("start_ms"), F.col("end_ms"), F.col(text))
    return ordered_concat(segments, keys, idx, cue, "").withColumnRenamed("text", "body")


def render_vtt(segments: DataFrame, keys: list[str], idx: str = "seg_idx",
               text: str = "text") -> DataFrame:
    cue = cues.vtt_cue(F.col("start_ms"), F.col("end_ms"), F.col(text))
    bodies = ordered_concat(segments, keys, idx, cue, "")
    return bodies.select(*keys, F.concat(F.lit(cues.VTT_HEADER), "text").alias("body"))


def translated_cue_text(text: Column, translation: Column) -> Column:
    """Cue text of a translated subtitle: blank cues stay as they are."""
    return F.when(X.is_blank(text), text).otherwise(F.coalesce(translation, text))


def parse_subtitles(files: DataFrame, body: str = "body", kind: str = "kind",
                    keys: list[str] = ["path"]) -> DataFrame:
    parsed = files.select(*keys, F.posexplode_outer(
        cues.parse_cues(F.col(body), F.col(kind))).alias("_p", "c"))
    return parsed.filter("c is not null").select(*keys, "c.*")


def marker_segments(chunks: DataFrame, keys: list[str]) -> DataFrame:
    """Timed segments of decoded chunks, numbered per chunk; row-local.

    ``tokens`` is an ordered array of (text, marker): a time marker has ``marker`` set, any other
    token has ``text``. Chunks also carry ``offset_s`` and ``duration_s``. The steps are separate
    projections because lambdas evaluate whatever expression they capture once per element.
    """
    staged = chunks.withColumn("_m", decoded.markers(F.col("tokens"))).withColumn(
        "_i", decoded.islands(F.col("_m"), F.size("tokens"))
    )
    found = decoded.island_segments(
        F.col("_i"), F.col("tokens"), F.col("offset_s"), F.col("duration_s")
    )
    return staged.select(*keys, F.posexplode(found).alias("seg_idx", "s")).select(
        *keys, "seg_idx", "s.*"
    )


def select_attempt(attempts: DataFrame, keys: list[str], attempt: str = "attempt",
                   text: str = "text", no_speech: str = "no_speech") -> DataFrame:
    """First acceptable attempt per chunk, else the last one; partial aggregation, no window."""
    rest = [c for c in attempts.columns if c not in keys]
    good = decoded.acceptable(F.col(no_speech), X.unique_char_ratio(F.col(text)))
    order = F.struct(
        (~F.coalesce(good, F.lit(False))).alias("rejected"),
        F.when(good, F.col(attempt)).otherwise(-F.col(attempt)).alias("n"),
    )
    return attempts.groupBy(*keys).agg(
        F.min_by(F.struct(*rest, good.alias("accepted")), order).alias("_a")
    ).select(*keys, "_a.*")


def chunk_rms(samples: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    v = F.col(value)
    return samples.groupBy(*keys).agg(F.sqrt(F.avg(v * v)).alias("rms"), F.count("*").alias("n"))


def chunk_clock(idx: Column, length_ms: int) -> Column:
    """[start, end) of chunk ``idx``; silent chunks advance the clock as well."""
    return F.struct((idx * length_ms).alias("start_ms"), ((idx + 1) * length_ms).alias("end_ms"))


def source_words(segments: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    return segments.groupBy(*keys).agg(
        F.sum(X.word_count(F.col(text))).cast("bigint").alias("n_words")
    )


def completion_ratio(segments: DataFrame, keys: list[str]) -> DataFrame:
    return segments.groupBy(*keys).agg(
        F.avg(F.col("is_complete").cast("int")).alias("completion_ratio")
    )
