"""Translation of whole texts, of segments, and the event stream of one run."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lingotally import refdata as R
from lingotally.functions import tiers as T, text as X
from lingotally.operators import filters, infer, segments as G
from lingotally.plans.classify import with_route


def translate_documents(classified: DataFrame, factory: infer.Factory, target: str,
                        key: str = "doc_id", text: str = "text", alt_available: bool = False,
                        partitions: int | None = None) -> DataFrame:
    """Foreign rows with ``translated_text``, ``error`` and ``notice``; each distinct text once.

    The language filter runs before the model, and only key and text go through it. The foreign
    rows are stored once, so each text is classified once.
    """
    foreign = with_route(filters.foreign_only(classified, target), alt_available, text)
    done = infer.infer_distinct(
        foreign, factory, F.col(key), text, "translated_text", partitions, store=True
    )
    return done.withColumn(
        "notice",
        F.when(F.col("translated_text").isNotNull(),
               T.notice(F.col("language"), F.col("engine"))),
    )


def sentence_units(docs: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """Sentences of texts that have no timed segments, numbered from 0."""
    return G.segment_index(docs, X.split_sentences(F.col(text)), keys)


def translate_segments(segments: DataFrame, factory: infer.Factory, keys: list[str],
                       idx: str = "seg_idx", text: str = "text",
                       partitions: int | None = None) -> DataFrame:
    """Segments with ``translated_text``; blank ones keep an empty translation."""
    key = F.concat_ws("/", *[F.col(c).cast("string") for c in (*keys, idx)])
    done = infer.infer_distinct(segments, factory, key, text, "translated_text", partitions)
    blank = X.is_blank(F.col(text))
    return done.withColumn(
        "translated_text", F.when(blank, "").otherwise(F.col("translated_text"))
    )


def joined_translation(translated: DataFrame, keys: list[str], idx: str = "seg_idx") -> DataFrame:
    """Translation of a document: trimmed, non-empty segment translations joined by a space."""
    return G.transcript(translated, keys, idx, "translated_text").withColumnRenamed(
        "transcript", "translated_text"
    )


def run_events(classified: DataFrame, segments: DataFrame, target: str, key: str = "doc_id",
               idx: str = "seg_idx", alt_available: bool = False,
               units: DataFrame | None = None) -> DataFrame:
    """Events of a translation run: dialect, dialect_routing, segment, error, complete.

    ``segments`` are translated segments of all documents, ``units`` the same before translation
    (totals then need no model run). Blank segments are skipped, but the complete event carries the
    unskipped total. ``stage`` and ``index`` order the events of a
    document; documents already in the target language only complete, with zero segments.
    """
    routed = with_route(classified, alt_available)
    foreign = routed.filter(T.is_foreign_plain(F.col("language"), target))
    dialect = routed.filter(
        F.col("dialect").isNotNull() & (F.col("dialect") != "Unknown")
    ).select(key, F.lit(0).alias("stage"), F.lit(0).alias("index"),
             F.lit("dialect").alias("type"), "dialect",
             F.col("dialect_confidence").alias("confidence"))
    routing = foreign.filter(F.col("route").isNotNull()).select(
        key, F.lit(1).alias("stage"), F.lit(0).alias("index"),
        F.lit("dialect_routing").alias("type"), "dialect", "route",
        F.col("dialect_confidence").alias("confidence"))
    mine = segments.join(foreign.select(key), key, "left_semi")
    spoken = mine.filter(~X.is_blank(F.col("text")))
    failed = F.col("error").isNotNull()
    segment = spoken.select(
        key, F.lit(2).alias("stage"), F.col(idx).alias("index"),
        F.when(failed, "error").otherwise("segment").alias("type"),
        F.when(~failed, F.col("text")).alias("original"),
        F.when(~failed, F.col("translated_text")).alias("translated"),
        F.when(failed, F.col("error")).alias("message"),
        F.when(~failed, F.lit(True)).alias("is_complete"),
    )
    counted = units if units is not None else segments
    totals = counted.groupBy(key).agg(F.count("*").alias("_n"))
    is_foreign = T.is_foreign_plain(F.col("language"), target)
    complete = routed.select(key, "language").join(totals, key, "left").select(
        key, F.lit(3).alias("stage"), F.lit(0).alias("index"), F.lit("complete").alias("type"),
        F.when(is_foreign, F.coalesce("_n", F.lit(0))).otherwise(F.lit(0)).alias("total_segments"),
        F.lit(R.MT_NOTICE).alias("machine_translation_notice"),
    )
    out = dialect
    for part in (routing, segment, complete):
        out = out.unionByName(part, allowMissingColumns=True)
    return out
