"""Size-checked broadcasts."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 64 * 1024 * 1024


def is_small(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> bool:
    """True if the table has at most ``rows`` rows and ``size`` bytes (measured, not estimated).

    The probe reads ``rows + 1`` rows at most, whatever the table holds.
    """
    width = F.octet_length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])))
    seen = df.limit(rows + 1).agg(F.count("*").alias("n"), F.sum(width).alias("b")).first()
    return seen["n"] <= rows and (seen["b"] or 0) <= size


def broadcast_if_small(
    df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES
) -> DataFrame:
    """Hint a broadcast below the measured bound, otherwise leave the join to shuffle."""
    return F.broadcast(df) if is_small(df, rows, size) else df


def restrict_to(big: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """Rows of ``big`` whose key occurs in ``keys``: shrinks it before any outer join.

    Adaptive execution knows the size of the distinct keys and broadcasts a small set by itself.
    """
    return big.join(keys.select(*on).distinct(), on, "left_semi")
