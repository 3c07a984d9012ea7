"""Review flags: joins with segments and results, upserts, action replay, recent files."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lingotally.functions import text as X
from lingotally.operators.sizes import restrict_to

RECENT_CAP = 10
KEYS = ["file_path", "segment_index"]


def flags_to_segments(flags: DataFrame, segments: DataFrame) -> DataFrame:
    """Flag rows with segment times and texts; an unmatched flag keeps null times, empty texts.

    The segment table is first reduced to flagged keys, so the outer join moves only those rows.
    """
    side = restrict_to(segments, flags, KEYS).select(
        *KEYS, "start_ms", "end_ms", "source_text", "translated_text"
    )
    return flags.join(side, KEYS, "left").select(
        *KEYS, "start_ms", "end_ms",
        F.coalesce("source_text", F.lit("")).alias("original"),
        F.coalesce("translated_text", F.lit("")).alias("translation"),
        F.coalesce(X.missing_if_empty(F.col("review_status")), F.lit("needs_review"))
        .alias("review_status"),
        F.coalesce("examiner_note", F.lit("")).alias("examiner_note"),
        F.coalesce("flagged_at", F.lit("")).alias("flagged_at"),
    )


def flags_to_results(flags: DataFrame, results: DataFrame, segments: DataFrame) -> DataFrame:
    """Texts behind every flag: its segment, else the whole file; a blank path takes the first
    file (by path) that has the segment number, else the first translated file."""
    blank = F.coalesce("file_path", F.lit("")) == ""
    named, unnamed = flags.filter(~blank), flags.filter(blank)
    texts = ["source_text", "translated_text"]

    seg = restrict_to(segments, named, KEYS).select(
        *KEYS, F.struct(*texts).alias("_s")
    )
    whole = restrict_to(results, named, ["file_path"]).select(
        "file_path", F.struct(*texts).alias("_r")
    )
    by_file = named.join(seg, KEYS, "left").join(whole, "file_path", "left")

    # Grouped first, then joined: one row per number and task is shuffled, not all texts of a number.
    first_seg = segments.groupBy("segment_index").agg(F.min_by(F.struct(*texts), "file_path").alias("_s"))
    first_whole = results.filter("translated_text is not null").agg(
        F.min_by(F.struct(*texts), "file_path").alias("_r")
    )
    anywhere = unnamed.join(first_seg, "segment_index", "left").withColumn(
        "_r", first_whole.scalar()
    )

    both = by_file.unionByName(anywhere)
    chosen = F.coalesce("_s", "_r")
    return both.select(
        F.coalesce(X.missing_if_empty(F.col("file_path")), F.lit("(unknown)")).alias("file_path"),
        "segment_index",
        F.coalesce(chosen["source_text"], F.lit("")).alias("original"),
        F.coalesce(chosen["translated_text"], F.lit("")).alias("translation"),
        F.coalesce("examiner_note", F.lit("")).alias("examiner_note"),
        X.status_label(F.col("review_status")).alias("status"),
    )


def upsert_flags(state: DataFrame, updates: DataFrame, new_flags: DataFrame,
                 key: str = "file_path") -> DataFrame:
    """Replace all flags of every updated file; an update without flags removes the file."""
    kept = state.join(updates.select(key).distinct(), key, "left_anti")
    return kept.unionByName(new_flags.join(updates.select(key).distinct(), key, "left_semi"))


def fold_review_actions(actions: DataFrame, keys: list[str] = KEYS, seq: str = "seq") -> DataFrame:
    """State after replaying flag / unflag / set_status actions; one partial aggregation.

    The last flag or unflag decides whether the segment is flagged; a later set_status overrides
    the status a flag resets to.
    """
    toggle = F.col("action").isin("flag", "unflag")
    setting = F.col("action") == "set_status"
    state = actions.groupBy(*keys).agg(
        F.max_by(F.struct(seq, "action", "note", "at"),
                 F.when(toggle, F.col(seq))).alias("_t"),
        F.max_by(F.struct(seq, "status"), F.when(setting, F.col(seq))).alias("_s"),
    ).filter("_t.action = 'flag'")
    later = F.col(f"_s.{seq}") > F.col(f"_t.{seq}")
    return state.select(
        *keys, F.col("_t.note").alias("examiner_note"), F.col("_t.at").alias("flagged_at"),
        F.when(later, F.col("_s.status")).otherwise("needs_review").alias("review_status"),
    )


def hydrate_flags(flags: DataFrame, keys: list[str] = KEYS, position: str = "position") -> DataFrame:
    """Stored flags as state: the last one per segment wins."""
    rest = [c for c in flags.columns if c not in (*keys, position)]
    return flags.groupBy(*keys).agg(F.max_by(F.struct(*rest), position).alias("_f")).select(
        *keys, "_f.*"
    )


def recent_files(opens: DataFrame, cap: int = RECENT_CAP, seq: str = "seq") -> DataFrame:
    """Last ``cap`` distinct paths by latest opening, newest last: a top-k over one aggregate."""
    latest = opens.groupBy("path").agg(F.max(seq).alias(seq))
    return latest.orderBy(F.desc(seq)).limit(cap).orderBy(seq)


def flag_counts(flags: DataFrame, key: str = "file_path") -> DataFrame:
    return flags.groupBy(key).agg(F.count("*").alias("n_flags"))


def pending_translations(segments: DataFrame, flags: DataFrame, mark: str) -> DataFrame:
    """Translations with the pending mark in front of flagged segments."""
    keys = flags.select(*KEYS).distinct().withColumn("_f", F.lit(True))
    joined = segments.join(keys, KEYS, "left")
    flagged = F.coalesce("_f", F.lit(False))
    return joined.withColumn(
        "translated_text", X.pending_mask(flagged, F.col("translated_text"), mark)
    ).withColumn("is_flagged", flagged).drop("_f")
