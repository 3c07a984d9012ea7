"""Probabilities from scores: seeded splits, isotonic calibration on bins, and its error on rows held out.

Scores in [0, 1] are counted in ``bins`` equal bins: one aggregate, at most ``bins`` rows whatever the table. The
calibrated probability of a bin is the monotone least-squares fit to the shares of right answers (pool adjacent
violators). Fit it on rows that trained nothing, and judge it on others again: ``split`` deals rows to such parts
by a hash of their key, so the same key always falls in the same part.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

BINS = 20
SEED = 11
PARTS = (0.6, 0.2, 0.2)  # training, calibration, held out


def split(key: Column, parts: Sequence[float] = PARTS, seed: int = SEED) -> Column:
    """Number of the part of a row, from the first 32 bits of md5("seed:key"); a null key counts as ''."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("")))
    u = F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / 4294967296.0
    edges, total = [], 0.0
    for p in parts[:-1]:
        total += p
        edges.append(total)
    out = F.lit(len(parts) - 1)
    for i in reversed(range(len(edges))):
        out = F.when(u < edges[i], i).otherwise(out)
    return out


def bin_of(score: Column, bins: int = BINS) -> Column:
    """Bin of a score, 0 to ``bins`` - 1; 1 falls in the last one. Null and NaN count as 0."""
    clean = F.when(score.isNull() | F.isnan(score), 0.0).otherwise(score)
    return F.least(F.greatest(F.floor(clean * bins), F.lit(0)), F.lit(bins - 1)).cast("int")


def bin_counts(judged: DataFrame, score: str, right: str, bins: int = BINS) -> DataFrame:
    """bin, n, n_right of the bins that hold rows."""
    return judged.groupBy(bin_of(F.col(score), bins).alias("bin")).agg(
        F.count("*").alias("n"), F.count_if(F.col(right)).alias("n_right"))


def pool(counts: Sequence[tuple[int, int]]) -> list[float | None]:
    """Monotone shares from (n, n_right) per bin: neighbours that fall are pooled. None where no row is."""
    blocks: list[list] = []  # rows, right ones, bins
    for i, (n, right) in enumerate(counts):
        if not n:
            continue
        blocks.append([n, right, [i]])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][0] >= blocks[-1][1] * blocks[-2][0]:
            n2, right2, bins2 = blocks.pop()
            blocks[-1][0] += n2
            blocks[-1][1] += right2
            blocks[-1][2] += bins2
    out: list[float | None] = [None] * len(counts)
    for n, right, own in blocks:
        for i in own:
            out[i] = right / n
    return out


def fit(judged: DataFrame, score: str, right: str, bins: int = BINS) -> list[float]:
    """Probability of every bin. Bins without rows lie between their neighbours (ends: as the nearest); without any
    row a bin keeps its middle."""
    rows = {r["bin"]: (r["n"], r["n_right"]) for r in bin_counts(judged, score, right, bins).collect()}
    pooled = pool([rows.get(i, (0, 0)) for i in range(bins)])
    known = [i for i, p in enumerate(pooled) if p is not None]
    if not known:
        return [(i + 0.5) / bins for i in range(bins)]
    out = []
    for i in range(bins):
        below = max((k for k in known if k <= i), default=known[0])
        above = min((k for k in known if k >= i), default=known[-1])
        share = (i - below) / (above - below) if above > below else 0.0
        out.append(pooled[below] + (pooled[above] - pooled[below]) * min(max(share, 0.0), 1.0))
    return out


def probability(score: Column, table: Sequence[float]) -> Column:
    """Calibrated probability of a score."""
    return F.get(F.array(*[F.lit(float(p)) for p in table]), bin_of(score, len(table)))


def reliability(judged: DataFrame, score: str, right: str, bins: int = BINS) -> DataFrame:
    """bin, n, mean score, share of right answers, and their distance."""
    mean, share = F.avg(score), F.avg(F.col(right).cast("double"))
    return judged.groupBy(bin_of(F.col(score), bins).alias("bin")).agg(
        F.count("*").alias("n"), mean.alias("mean_score"), share.alias("accuracy"),
        F.abs(mean - share).alias("gap"))


def expected_error(judged: DataFrame, score: str, right: str, bins: int = BINS) -> DataFrame:
    """Expected calibration error: the gaps of the bins, weighed by their rows."""
    r = reliability(judged, score, right, bins)
    return r.agg((F.sum(F.col("n") * F.col("gap")) / F.sum("n")).alias("calibration_error"), F.sum("n").alias("n"))
