"""Live chunks: fixed windows over samples, silence, enrichment, error isolation, sessions."""

from __future__ import annotations

import sys
from collections.abc import Callable

from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F

from lingotally.functions import text as X, tiers as T
from lingotally.operators import infer
from lingotally.plans.classify import classify

# Functions of this module travel to Python workers by value: executors need no install.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

SILENCE_RMS = 0.01
WATERMARK = "10 minutes"


def live_chunks(samples: DataFrame, length: str = "3 seconds", watermark: str = WATERMARK,
                source: str = "source_id", value: str = "value", ts: str = "ts",
                full: int | None = None) -> DataFrame:
    """RMS and sample count per source and fixed window; works on streams and on tables.

    ``full`` is the number of samples of a whole chunk: chunks with fewer, such as the last one of
    a recording that stopped, are left out.

    Samples combine before the shuffle, so a source with most of the rows sends one row per
    window and task. Event time is cast to a UTC timestamp, as a watermark requires.
    """
    timed = samples.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, watermark)
    v = F.col(value)
    chunks = timed.groupBy(F.window(ts, length), F.col(source)).agg(
        F.sqrt(F.avg(v * v)).alias("rms"), F.count("*").alias("n_samples")
    ).select(source, F.col("window.start").alias("chunk_start"),
             F.col("window.end").alias("chunk_end"), "rms", "n_samples")
    return chunks if full is None else chunks.filter(F.col("n_samples") >= full)


def drop_silence(chunks: DataFrame, threshold: float = SILENCE_RMS) -> DataFrame:
    """Loud chunks; window times already advance over the silent ones."""
    return chunks.filter(F.coalesce(F.col("rms"), F.lit(0.0)) >= threshold)


def enrich_stream(chunks: DataFrame, detect, factory: infer.Factory, target: str,
                  text: str = "text", upstream: str = "upstream_language") -> DataFrame:
    """Language and translation per chunk; stateless, hence the same for streams and tables.

    A chunk in the target language, or whose translation fails, shows its original text.
    """
    judged = classify(chunks.filter(~X.is_blank(F.col(text))), detect, target, text)
    lang = T.resolve_language(F.col("language"), F.col(upstream))
    judged = judged.withColumn("language", F.coalesce(lang, F.lit("")))
    foreign = T.is_foreign_strict(F.col("language"), target)
    todo = judged.withColumn("_todo", F.when(foreign, F.col(text)).otherwise(""))
    keep = [c for c in todo.columns if c != "_todo"]
    done = infer.map_model(todo, _skipping_blank(factory), "_todo", "translated", keep)
    shown = F.coalesce(F.when(F.col("translated") != "", F.col("translated")), F.col(text))
    return done.withColumn("translated", shown).withColumnRenamed("error", "translation_error")


def _skipping_blank(factory: infer.Factory) -> infer.Factory:
    def build() -> infer.Model:
        model = factory()

        def run(texts: list[str]) -> list[str | None]:
            todo = [t for t in texts if t]
            out = iter(model(todo) if todo else [])
            return [next(out) if t else "" for t in texts]

        return run

    return build


def isolate_errors(chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Good chunks and error events of one table or micro-batch."""
    bad = F.col("error").isNotNull()
    return chunks.filter(~bad), chunks.filter(bad).select("session_id", "chunk_idx", "error")


def split_sink(good_path: str, error_path: str) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` writer: chunks to one table, error events to another; the stream goes on.

    Files of a batch live in a folder named by its number, so a repeated batch replaces itself.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        kept = batch.persist()  # both outputs come from one run of the stream and its model
        good, bad = isolate_errors(kept)
        try:
            good.write.mode("overwrite").parquet(f"{good_path}/batch={batch_id}")
            bad.write.mode("overwrite").parquet(f"{error_path}/batch={batch_id}")
        finally:
            kept.unpersist()

    return write


def session_summary(chunks: DataFrame, session: str = "session_id",
                    chunk_ms: int = 3000) -> DataFrame:
    """Totals per session; use it in complete or update mode.

    Silent and failed chunks count, because the clock and the total advance over them.
    """
    idx = F.col("chunk_idx")
    return chunks.groupBy(session).agg(
        F.count("*").alias("n_chunks"),
        (F.max(idx) + 1).cast("bigint").alias("total_chunks"),
        ((F.max(idx) + 1) * chunk_ms).cast("bigint").alias("duration_ms"),
        F.count_if(F.col("error").isNotNull()).alias("n_errors"),
        F.coalesce(F.max_by("language", F.when(F.col("error").isNull(), idx)),
                   F.lit("—")).alias("last_language"),
    )
