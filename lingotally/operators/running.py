"""Running state over an ordered log without a single-task window.

``seq`` is a unique integer per log (an event number). Rows are cut into number ranges, each range
is totalled, the totals of earlier ranges are added to a window inside the range: no task sees
more than ``width`` rows of a log, even if one log holds most of the table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

WIDTH = 1 << 18


def running_sums(df: DataFrame, keys: list[str], seq: str, measures: dict[str, Column],
                 width: int = WIDTH, levels: int = 1) -> DataFrame:
    """Cumulative sums of ``measures`` up to and including each row.

    Totals of the ranges are accumulated the same way (``levels`` times), so sparse numbers such as
    microseconds, which spread over very many ranges, do not end in one task either.
    """
    at = f"_b{levels}"
    cut = df.withColumns({f"_m{levels}_{n}": c for n, c in measures.items()}).withColumn(
        at, F.floor(F.col(seq) / width)
    )
    totals = cut.groupBy(*keys, at).agg(
        *[F.sum(f"_m{levels}_{n}").alias(f"_t{levels}_{n}") for n in measures]
    )
    own = {n: F.col(f"_t{levels}_{n}") for n in measures}
    if levels > 0:
        upto = running_sums(totals, keys, at, {f"_u_{n}": c for n, c in own.items()}, width,
                            levels - 1)
        carried = {n: F.col(f"_u_{n}") - c for n, c in own.items()}
    else:
        upto = totals
        earlier = Window.partitionBy(*keys).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
        carried = {n: F.coalesce(F.sum(c).over(earlier), F.lit(0)) for n, c in own.items()}
    # joined null-safely: rows with a null key are a group of their own
    before = upto.select(*[F.col(k).alias(f"_k{levels}_{i}") for i, k in enumerate([*keys, at])],
                         *[c.alias(f"_p{levels}_{n}") for n, c in carried.items()])
    same = [F.col(k).eqNullSafe(F.col(f"_k{levels}_{i}")) for i, k in enumerate([*keys, at])]
    inside = Window.partitionBy(*keys, at).orderBy(seq).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    sums = {
        n: (F.sum(f"_m{levels}_{n}").over(inside) + F.col(f"_p{levels}_{n}")).cast("bigint")
        for n in measures
    }
    return cut.join(before, same).select(
        *df.columns, *[c.alias(n) for n, c in sums.items()]
    )


def rolling_recent(df: DataFrame, keys: list[str], seq: str, value: str, n: int = 8,
                   width: int = WIDTH) -> DataFrame:
    """The last ``n`` values at each row, oldest first.

    Rows get dense numbers from ``running_sums``; the last rows of each number range are copied
    into the next one, so every window is complete inside its range.
    """
    numbered = running_sums(df, keys, seq, {"_rn": F.lit(1)}, width)
    block = F.floor((F.col("_rn") - 1) / width)
    tail = (F.col("_rn") - 1) % width >= width - (n - 1)
    spread = numbered.withColumn("_home", block).withColumn(
        "_b", F.explode(F.when(tail, F.array(block, block + 1)).otherwise(F.array(block)))
    )
    w = Window.partitionBy(*keys, "_b").orderBy("_rn").rowsBetween(-(n - 1), Window.currentRow)
    return (
        spread.withColumn("recent", F.collect_list(value).over(w))
        .filter("_b = _home").select(*df.columns, "recent")
    )


def latest_state(events: DataFrame, key: str = "path", seq: str = "seq") -> DataFrame:
    """State per file after all start / done events, by partial aggregation.

    The last event sets the status; details come from the last done event. Done events before the
    first start of a file are ignored, and so is a file that never started.
    """
    start, done = F.col("type") == "start", F.col("type") == "done"
    details = F.struct(seq, "is_foreign", "translated", "error")
    agg = events.groupBy(key).agg(
        F.min(F.when(start, F.col(seq))).alias("_first"),
        F.max(F.when(start, F.col(seq))).alias("_start"),
        F.max_by(details, F.when(done, F.col(seq))).alias("_d"),
    ).filter("_first is not null")
    valid = F.col(f"_d.{seq}") > F.col("_first")
    finished = F.coalesce(valid & (F.col(f"_d.{seq}") > F.col("_start")), F.lit(False))
    bad = F.coalesce(F.col("_d.error"), F.lit("")) != ""
    return agg.select(
        key,
        F.when(~finished, "active").when(bad, "error").otherwise("done").alias("status"),
        F.coalesce(valid & F.col("_d.is_foreign"), F.lit(False)).alias("is_foreign"),
        F.coalesce(valid & F.col("_d.translated"), F.lit(False)).alias("translated"),
        F.when(valid, F.col("_d.error")).alias("error"),
    )


def file_state_counts(states: DataFrame) -> DataFrame:
    s = F.col("status")
    return states.agg(
        F.count("*").alias("files"),
        F.count_if(s.isin("done", "error")).alias("processed"),
        F.count_if(F.col("is_foreign")).alias("foreign_files"),
        F.count_if(F.col("translated")).alias("translated_files"),
        F.count_if(s == "error").alias("errors"),
    )


def last_language(segments: DataFrame, keys: list[str], idx: str = "chunk_idx",
                  language: str = "language", placeholder: str = "—") -> DataFrame:
    """Language of the last segment that has one; keys without any show ``placeholder``."""
    known = F.when(F.col(language).isNotNull(), F.col(idx))
    return segments.groupBy(*keys).agg(
        F.coalesce(F.max_by(language, known), F.lit(placeholder)).alias("last_language")
    )
