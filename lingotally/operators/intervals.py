"""Interval join of timed segments with speaker turns."""

from __future__ import annotations

import sys
from bisect import bisect_left, bisect_right

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F

from lingotally.operators.sizes import broadcast_if_small
from lingotally.session import durable

cloudpickle.register_pickle_by_value(sys.modules[__name__])

BUCKET_MS = 10_000
# Widths grow by this factor per level; an interval takes the first level where it meets at most
# FACTOR + 1 buckets, whatever its length.
FACTOR = 64
LEVELS = 9
# Pairs of one bucket up to which it is joined; more crowded ones are swept.
CROWD = 1 << 20
UNKNOWN_SPEAKER = "UNKNOWN"


def _width(width: int, level: int) -> int:
    return min(width * FACTOR ** level, 2**62)


def _level(start: Column, end: Column, width: int) -> Column:
    """Level of [start, end); the last one takes any length."""
    length = F.try_subtract(end, start)
    out = None
    for level in range(LEVELS - 1):
        fits = length <= _width(width, level + 1)
        out = F.when(fits, level) if out is None else out.when(fits, level)
    return out.otherwise(LEVELS - 1)


def _bucket(ms: Column, width: Column) -> Column:
    """Floor of ``ms / width`` in whole numbers."""
    below = F.when((ms < 0) & (ms % width != 0), 1).otherwise(0)
    return F.call_function("div", ms, width) - below


def _buckets(start: Column, end: Column, width: Column) -> Column:
    """Time buckets of [start, end); empty intervals get none."""
    return F.when(start < end, F.sequence(_bucket(start, width), _bucket(end - 1, width)))


def _levelled(segments: DataFrame, turns: DataFrame, key: str, width: int) -> tuple[DataFrame, DataFrame]:
    """Keys and times of both sides, stored once, each row at the levels and buckets where it can meet another.

    Rows of ordinary length stay at level 0. Documents that hold a longer one are flagged; only their rows are
    copied to the wider levels as well, so that no row becomes more than ``FACTOR`` + 1 copies at its own level
    and two at each wider one.
    """
    def level() -> Column:
        return _level(F.col("start_ms"), F.col("end_ms"), width).alias("_l")

    s = durable(segments.filter(F.col(key).isNotNull() & (F.col("start_ms") < F.col("end_ms"))).select("*", level()))
    t = durable(turns.filter(F.col(key).isNotNull() & (F.col("start_ms") < F.col("end_ms"))).select(
        F.col(key).alias("_k"), F.col("start_ms").alias("_ts"), F.col("end_ms").alias("_te"), "turn_idx", "speaker_id", level()))
    long = durable(s.filter("_l > 0").select(F.col(key).alias("_long")).union(
        t.filter("_l > 0").select("_k")).distinct())
    long = broadcast_if_small(long)
    widths = F.array(*[F.lit(_width(width, k)).cast("bigint") for k in range(LEVELS)])

    def cut(df: DataFrame, own: str, start: str, end: str) -> DataFrame:
        wider = F.sequence(F.greatest(F.col("_l"), F.lit(1)), F.lit(LEVELS - 1))
        none = F.array().cast("array<int>")
        levels = F.concat(F.when(F.col("_l") == 0, F.array(F.lit(0))).otherwise(none),
                          F.when(F.col("_long").isNotNull(), wider).otherwise(none))
        at = df.join(long, F.col(own) == F.col("_long"), "left").withColumn("_at", F.explode(levels)).drop("_long")
        return at.withColumn("_w", widths[F.col("_at")]).withColumn(
            "_b", F.explode(_buckets(F.col(start), F.col(end), F.col("_w"))))

    return (cut(s, key, "start_ms", "end_ms").withColumnRenamed("_l", "_sl"),
            cut(t, "_k", "_ts", "_te").drop("_w").withColumnsRenamed({"_l": "_tl", "_at": "_ta", "_b": "_tb"}))


def _pairs(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Overlapping pairs, each once: a pair meets at the coarser of its two levels; sharing several buckets there,
    it is kept in its first common one."""
    first = F.greatest(F.col("start_ms"), F.col("_ts"))
    cond = (
        (F.col(key) == F.col("_k")) & (F.col("_b") == F.col("_tb")) & (F.col("_at") == F.col("_ta"))
        & (F.greatest("_sl", "_tl") == F.col("_at"))
        & (F.col("start_ms") < F.col("_te")) & (F.col("_ts") < F.col("end_ms"))
        & (_bucket(first, F.col("_w")) == F.col("_b"))
    )
    found = a.join(b, cond).drop("_k", "_tb", "_b", "_at", "_ta", "_w", "_sl", "_tl")
    return found.withColumn("overlap_ms", F.try_subtract(
        F.least(F.col("end_ms"), F.col("_te")), F.greatest(F.col("start_ms"), F.col("_ts"))))


def overlaps(segments: DataFrame, turns: DataFrame, key: str = "doc_id",
             width: int = BUCKET_MS) -> DataFrame:
    """Overlapping pairs with their overlap in ms, each pair once.

    Both sides are cut into time buckets, so the equi-join key is (document, level, bucket): a document that
    holds a large share of all rows spreads over its buckets, and AQE splits what is left.
    """
    return _pairs(*_levelled(segments, turns, key, width), key)


class _Least:
    """Fenwick tree: least value put at a place up to the asked one."""

    def __init__(self, n: int):
        self.tree: list = [None] * (n + 1)

    def put(self, i: int, value) -> None:
        i += 1
        while i < len(self.tree):
            if self.tree[i] is None or value < self.tree[i]:
                self.tree[i] = value
            i += i & -i

    def upto(self, i: int):
        """Over the places 0 to ``i`` - 1."""
        best = None
        while i > 0:
            if self.tree[i] is not None and (best is None or self.tree[i] < best):
                best = self.tree[i]
            i -= i & -i
        return best


def best_turns(spans: list[tuple[int, int]], turns: list[tuple[int, int, int]]) -> list[tuple[int, int] | None]:
    """Overlap and number of the turn (start, end, number) that overlaps each span most, ties to the least number.

    Two sweeps over the starts, in n log n. Upwards, of turns that began by then: the one that ends last, from the
    running maximum, and if it reaches the span's end, the least number among all that do. Downwards, of turns
    that begin later: the longest that ends inside, and the first to begin among those that end beyond.
    """
    ends = sorted({t[1] for t in turns})
    n = len(ends)
    place = {e: i for i, e in enumerate(ends)}
    out: list[tuple[int, int] | None] = [None] * len(spans)

    def offer(i: int, overlap: int, number: int) -> None:
        if overlap > 0 and (out[i] is None or (overlap, -number) > (out[i][0], -out[i][1])):
            out[i] = (overlap, number)

    order = sorted(range(len(spans)), key=lambda i: spans[i][0])
    up = sorted(turns)
    covering, last, at = _Least(n), None, 0  # ends from the last to the first
    for i in order:
        start, end = spans[i]
        while at < len(up) and up[at][0] <= start:
            ts, te, number = up[at]
            covering.put(n - 1 - place[te], number)
            if last is None or (te, -number) > (last[0], -last[1]):
                last = (te, number)
            at += 1
        if last is not None:
            if last[0] >= end:
                offer(i, end - start, covering.upto(n - bisect_left(ends, end)))
            else:
                offer(i, last[0] - start, last[1])
    inside, beyond, at = _Least(n), _Least(n), len(up) - 1
    for i in reversed(order):
        start, end = spans[i]
        while at >= 0 and up[at][0] > start:
            ts, te, number = up[at]
            inside.put(place[te], (ts - te, number))  # the longest first
            beyond.put(n - 1 - place[te], (ts, number))
            at -= 1
        cut = bisect_right(ends, end)
        found = inside.upto(cut)
        if found is not None:
            offer(i, -found[0], found[1])
        found = beyond.upto(n - cut)
        if found is not None:
            offer(i, end - found[0], found[1])
    return out


def _swept(a: DataFrame, b: DataFrame, key: str, idx: str) -> DataFrame:
    """Best turn of every segment within each bucket, by a sweep instead of all pairs."""
    kinds = f"`{key}` {a.schema[key].dataType.simpleString()}, `{idx}` {a.schema[idx].dataType.simpleString()}"
    out = f"{kinds}, overlap_ms bigint, turn_idx {b.schema['turn_idx'].dataType.simpleString()}, speaker_id string"

    def sweep(segments: pd.DataFrame, turns: pd.DataFrame) -> pd.DataFrame:
        if not len(segments) or not len(turns):
            return pd.DataFrame(columns=[key, idx, "overlap_ms", "turn_idx", "speaker_id"])
        turns = turns.sort_values("turn_idx", kind="stable").reset_index(drop=True)
        level = segments["_at"].iloc[0]
        best: list = [None] * len(segments)
        # pairs whose coarser level is this one: wide segments with all turns, the others with wide turns
        wide = (segments["_sl"] == level).to_numpy()
        for own, of in ((wide, turns.index), (~wide, turns.index[turns["_tl"] == level])):
            rows = own.nonzero()[0].tolist()
            picked = turns.loc[of]
            spans = list(zip(segments["start_ms"].iloc[rows].tolist(), segments["end_ms"].iloc[rows].tolist()))
            found = best_turns(spans, list(zip(picked["_ts"].tolist(), picked["_te"].tolist(), of.tolist())))
            for i, f in zip(rows, found):
                best[i] = f
        hit = [i for i, f in enumerate(best) if f is not None]
        which = [best[i][1] for i in hit]
        return pd.DataFrame({
            key: segments[key].iloc[hit].to_numpy(), idx: segments[idx].iloc[hit].to_numpy(),
            "overlap_ms": [min(best[i][0], 2**63 - 1) for i in hit],
            "turn_idx": turns["turn_idx"].iloc[which].to_numpy(), "speaker_id": turns["speaker_id"].iloc[which].to_numpy()})

    left = a.groupBy(F.col(key), F.col("_at"), F.col("_b"))
    return left.cogroup(b.groupBy(F.col("_k"), F.col("_ta"), F.col("_tb"))).applyInPandas(sweep, out)


def attach_speaker(segments: DataFrame, turns: DataFrame, key: str = "doc_id",
                   idx: str = "seg_idx", width: int = BUCKET_MS, crowd: int = CROWD) -> DataFrame:
    """Speaker with the largest overlap per segment; ties go to the earlier turn.

    Equal intervals of a document are reduced to their earliest turn first. Buckets with up to ``crowd`` pairs are
    joined, where every pair costs next to nothing; in crowded ones a sweep finds each segment's best turn in
    n log n. Only keys and times go through this; texts move once, in the join back on the unique segment key,
    which also keeps segments that overlap nothing.
    """
    earliest = turns.groupBy(key, "start_ms", "end_ms").agg(
        F.min(F.struct("turn_idx", "speaker_id")).alias("_t")
    ).select(key, "start_ms", "end_ms", "_t.turn_idx", "_t.speaker_id")
    a, b = _levelled(segments.select(key, idx, "start_ms", "end_ms"), earliest, key, width)
    n_a = a.groupBy(F.col(key).alias("_ck"), F.col("_at").alias("_ca"), F.col("_b").alias("_cb")).agg(F.count("*").alias("_na"))
    n_b = b.groupBy("_k", "_ta", "_tb").agg(F.count("*").alias("_nb"))
    crowded = durable(n_a.join(n_b, (F.col("_ck") == F.col("_k")) & (F.col("_ca") == F.col("_ta")) & (
        F.col("_cb") == F.col("_tb"))).filter(F.col("_na") * F.col("_nb") > crowd).select("_ck", "_ca", "_cb"))
    best = None
    if crowded.isEmpty():
        best = _pairs(a, b, key).select(key, idx, "overlap_ms", "turn_idx", "speaker_id")
    else:
        few = broadcast_if_small(crowded)
        in_a = (F.col(key) == F.col("_ck")) & (F.col("_at") == F.col("_ca")) & (F.col("_b") == F.col("_cb"))
        in_b = (F.col("_k") == F.col("_ck")) & (F.col("_ta") == F.col("_ca")) & (F.col("_tb") == F.col("_cb"))
        rest = _pairs(a.join(few, in_a, "left_anti"), b, key).select(key, idx, "overlap_ms", "turn_idx", "speaker_id")
        swept = _swept(a.join(few, in_a, "left_semi"), b.join(few, in_b, "left_semi"), key, idx)
        # a pair that the join would keep in a crowded bucket, its first common one, is found there by the sweep
        best = rest.unionByName(swept)
    rank = F.struct(F.col("overlap_ms"), -F.col("turn_idx"))
    found = best.groupBy(key, idx).agg(F.max_by("speaker_id", rank).alias("speaker_id"))
    return segments.join(found, [key, idx], "left").withColumn(
        "speaker_id", F.coalesce("speaker_id", F.lit(UNKNOWN_SPEAKER))
    )


def speaker_count(enriched: DataFrame, key: str = "doc_id") -> DataFrame:
    return enriched.groupBy(key).agg(F.count_distinct("speaker_id").alias("n_speakers"))


def talk_time(segments: DataFrame, turns: DataFrame, key: str = "doc_id") -> DataFrame:
    """Overlapped milliseconds per document and speaker."""
    return overlaps(segments, turns, key).groupBy(key, "speaker_id").agg(
        F.sum("overlap_ms").cast("bigint").alias("talk_ms"),
        F.count("*").alias("n_pairs"),
    )
