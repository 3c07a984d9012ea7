"""Event logs as streams: progress snapshots, ordered segment output, runs until their end."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, Window, functions as F

from lingotally.operators import running
from lingotally.operators.sizes import broadcast_if_small
from lingotally.sources.writers import event_lines

TERMINAL = ["complete", "error"]


def batch_progress(events: DataFrame, run: str = "run_id") -> DataFrame:
    """Counters per run; in update mode a stream emits them again after each micro-batch."""
    done = F.col("type") == "done"
    failed = F.coalesce(F.col("error"), F.lit("")) != ""
    return events.groupBy(run).agg(
        F.count_if(done & ~failed).alias("processed"),
        F.count_if(done & failed).alias("errors"),
        F.count_if(done & ~failed & F.col("is_foreign")).alias("foreign_files"),
        F.count_if(done & ~failed & F.col("translated")).alias("translated_files"),
    )


def progress_snapshot(path: str, run: str = "run_id", seq: str = "seq", keep: int = 8,
                      started: float | None = None, target: str | None = None,
                      total: int | None = None) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` writer of progress: counters so far and the last paths of every run.

    ``started`` (Unix time), ``target`` and ``total`` are facts of the run that every snapshot repeats.

    A snapshot is the one of the batch before plus this batch, so the work follows the batch, not
    the length of the run. Each batch has its own folder: a repeated batch replaces its own output,
    and a restarted query goes on from the last snapshot.
    """
    counters = ["processed", "errors", "foreign_files", "translated_files"]

    def write(batch: DataFrame, batch_id: int) -> None:
        done = batch.filter("type = 'done'").persist()  # read for the counters and for the paths
        paths = last_paths(done, run, seq, keep).withColumnRenamed(run, "_run")
        fresh = batch_progress(done, run)
        fresh = fresh.join(paths, F.col(run).eqNullSafe(F.col("_run"))).drop("_run")
        if batch_id > 0:
            before = batch.sparkSession.read.parquet(f"{path}/batch={batch_id - 1}")
            fresh = fresh.unionByName(before.select(*fresh.columns))
        tagged = F.flatten(F.array_sort(F.collect_list("recent")))  # two short arrays per run
        newest = F.slice(
            F.array_sort(tagged), -F.least(F.size(tagged), F.lit(keep)),
            F.least(F.size(tagged), F.lit(keep)),
        )
        merged = fresh.groupBy(run).agg(
            *[F.sum(c).cast("bigint").alias(c) for c in counters], newest.alias("recent")
        )
        elapsed = None if started is None else time.time() - started
        merged.withColumns({
            "target_language": F.lit(target).cast("string"),
            "total_files": F.lit(total).cast("bigint"),
            "elapsed_seconds": F.lit(elapsed).cast("double"),
            "complete": F.lit(False),
        }).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
        done.unpersist()

    return write


def last_paths(events: DataFrame, run: str, seq: str, keep: int = 8) -> DataFrame:
    """Last ``keep`` (number, path) pairs per run, oldest first.

    The rank filter is a group limit: each task sends at most ``keep`` rows per run.
    """
    w = Window.partitionBy(run).orderBy(F.desc(seq))
    top = events.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= keep)
    return top.groupBy(run).agg(
        F.array_sort(F.collect_list(F.struct(seq, "path"))).alias("recent")
    )


def progress_log(events: DataFrame, run: str = "run_id", seq: str = "seq") -> DataFrame:
    """Counters and last paths at every completion, as a table over the whole log."""
    done = events.filter("type = 'done'")
    failed = F.coalesce(F.col("error"), F.lit("")) != ""
    counted = running.running_sums(done, [run], seq, {
        "processed": (~failed).cast("int"), "errors": failed.cast("int"),
        "foreign_files": (~failed & F.coalesce("is_foreign", F.lit(False))).cast("int"),
    })
    return running.rolling_recent(counted, [run], seq, "path")


def until_end(events: DataFrame, run: str = "run_id", seq: str = "seq") -> DataFrame:
    """Events of each run up to and including its first terminal event."""
    ends = events.filter(F.col("type").isin(TERMINAL)).groupBy(run).agg(
        F.min(seq).alias("_end")
    )
    ends = ends.withColumnRenamed(run, "_run")
    # adaptive execution knows how many runs have ended; a null run is a run of its own
    cut = events.join(ends, F.col(run).eqNullSafe(F.col("_run")), "left")
    return cut.filter(F.col("_end").isNull() | (F.col(seq) <= F.col("_end"))).drop("_end", "_run")


def follow_sink(path: str, run: str = "run_id", seq: str = "seq") -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` form of ``until_end``: one row per ended run is carried in ``path``."""
    def write(batch: DataFrame, batch_id: int) -> None:
        kept = batch.persist()  # read for its ends and for its events
        try:
            ends = kept.filter(F.col("type").isin(TERMINAL)).select(run, F.col(seq).alias("_end"))
            if batch_id > 0:
                before = batch.sparkSession.read.parquet(f"{path}/ends/batch={batch_id - 1}")
                ends = ends.unionByName(before)
            first = ends.groupBy(run).agg(F.min("_end").alias("_end"))
            first.write.mode("overwrite").parquet(f"{path}/ends/batch={batch_id}")
            stored = batch.sparkSession.read.parquet(f"{path}/ends/batch={batch_id}")
            stored = stored.withColumnRenamed(run, "_run")
            cut = kept.join(broadcast_if_small(stored), F.col(run).eqNullSafe(F.col("_run")), "left")
            open_yet = F.col("_end").isNull() | (F.col(seq) <= F.col("_end"))
            cut.filter(open_yet).drop("_end", "_run").write.mode("overwrite").parquet(
                f"{path}/events/batch={batch_id}"
            )
        finally:
            kept.unpersist()

    return write


def ordered_event_sink(path: str, order: list[str]) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` writer of event lines in ``order``; files of a batch form sorted ranges."""
    def write(batch: DataFrame, batch_id: int) -> None:
        event_lines(batch.orderBy(*order), batch.columns).write.mode("overwrite").text(
            f"{path}/batch={batch_id}"
        )

    return write
