"""Importance resampling towards a target distribution over hashed n-grams (after Xie et al., 2023).

Features of a text are all runs of 1 to ``max_words`` consecutive words, joined by one space; a feature's bucket
is the CRC-32 of its UTF-8 bytes modulo ``buckets``. A document weighs the sum of its features' log odds, target
against raw corpus; a Gumbel number seeded by its id is added, and the highest sums are drawn: sampling without
replacement in proportion to the weights.

CRC-32 by position table: for messages of one length the checksum is affine in the bytes, so it is the exclusive
or of one precomputed number per byte, by its value and its distance from the end, and of a constant per length.
All words of a batch lie in one buffer; features are stretches of it, and ``bitwise_xor.reduceat`` folds the
numbers of each. Features longer than the table are folded in blocks of its width: the state after a block is
moved on over the next one by four lookups.

Passes: both corpora once for the bucket counts (each task sends at most ``buckets`` rows), the documents once
more for their weights. Only (id, features, weight, score) is shuffled after that, dealt by ranges of score; the
rank is the place in the range plus the rows of the ranges before. On the driver: ``buckets`` counts and one
number per range.

Defined results: null and empty texts have no words, no features and weight 0; texts below ``least_words`` words
are never drawn; ties go to the smaller id, null ids last; repeated rows count and rank each; an empty corpus or
target gives finite gains by add-one smoothing; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F, types as T

cloudpickle.register_pickle_by_value(sys.modules[__name__])

BUCKETS = 10_000
MAX_WORDS = 1
LEAST_WORDS = 20
PERCENT = 10
SEED = 2024
WIDTH = 64  # bytes that the position table reaches back from the end
PIECE = 1 << 22  # bytes of text looked at together
POLYNOMIAL = 0xEDB88320  # CRC-32, reflected (fixed value)
COUNTS = "n_words bigint, n_features bigint, weight bigint"


@lru_cache(maxsize=1)
def byte_table() -> np.ndarray:
    """CRC-32 of one byte from state zero, without the final inversion."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> np.uint32(1)) ^ np.uint32(POLYNOMIAL), table >> np.uint32(1))
    return table


def _zero_byte(state: np.ndarray) -> np.ndarray:
    return byte_table()[state & np.uint32(0xFF)] ^ (state >> np.uint32(8))


@lru_cache(maxsize=4)
def position_table(width: int = WIDTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Contribution of byte b at distance d from the end, flat as d * 256 + b; constant of every length up to
    ``width``; and what each byte of a state becomes after ``width`` more bytes, flat as place * 256 + b."""
    rows = [byte_table()]
    for _ in range(width - 1):
        rows.append(_zero_byte(rows[-1]))
    start, constants = np.array([0xFFFFFFFF], dtype=np.uint32), []
    for _ in range(width + 1):
        constants.append(start[0])
        start = _zero_byte(start)
    moved = [np.arange(256, dtype=np.uint32) << np.uint32(8 * p) for p in range(4)]
    for _ in range(width):
        moved = [_zero_byte(m) for m in moved]
    return np.concatenate(rows), np.array(constants, dtype=np.uint32), np.concatenate(moved)


def span_crc(data: np.ndarray, start: np.ndarray, end: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """CRC-32 of the stretches [start, end) of a byte array; stretches may overlap."""
    table, constants, moved = position_table(width)
    size = end - start
    head = np.where(size > width, size % width, size)  # what is left over after whole blocks comes first
    state = constants[head] ^ _fold(data, start, start + head, table)
    at = start + head
    busy = np.flatnonzero(at < end)
    while len(busy):
        s = state[busy]
        s = (moved[s & np.uint32(255)] ^ moved[256 + ((s >> np.uint32(8)) & np.uint32(255))]
             ^ moved[512 + ((s >> np.uint32(16)) & np.uint32(255))] ^ moved[768 + (s >> np.uint32(24))])
        state[busy] = s ^ _fold(data, at[busy], at[busy] + width, table)
        at[busy] += width
        busy = busy[at[busy] < end[busy]]
    return ~state


def _fold(data: np.ndarray, start: np.ndarray, end: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Exclusive or of the contributions of each stretch; stretches reach at most the table's width."""
    size = end - start
    out = np.zeros(len(start), dtype=np.uint32)
    some = np.flatnonzero(size > 0)
    if len(some):
        size = size[some]
        first = np.cumsum(size) - size
        place = np.arange(int(size.sum())) - np.repeat(first, size)
        far = np.repeat(size - 1, size) - place
        part = table[far * 256 + data[np.repeat(start[some], size) + place]]
        out[some] = np.bitwise_xor.reduceat(part, first)
    return out


def _table_of_bytes() -> np.ndarray:
    """Lower-cased byte, or 0 for bytes outside words: words are made of 0-9, a-z and what is beyond ASCII."""
    b = np.arange(256, dtype=np.uint8)
    b[65:91] += 32
    inside = (b >= 128) | ((b >= 48) & (b <= 57)) | ((b >= 97) & (b <= 122))
    return np.where(inside, b, 0).astype(np.uint8)


def features(texts: list[bytes], max_words: int = MAX_WORDS) -> tuple[np.ndarray, ...]:
    """Buffer of lower-cased words one space apart; start, end and text number of every feature; words of every text."""
    raw = _table_of_bytes()[np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)]
    stops = np.cumsum(np.array([len(t) + 1 for t in texts], dtype=np.int64))
    inside = raw > 0
    keep = inside.copy()
    keep[1:] |= inside[:-1]  # one byte after every word is its space
    edge = np.flatnonzero(np.diff(np.concatenate(([False], inside)).view(np.int8)))
    first, after = edge[0::2], edge[1::2]
    owner = np.searchsorted(stops, first, side="right")
    place = np.cumsum(keep) - 1
    data = np.where(inside[keep], raw[keep], 32).astype(np.uint8)
    first, after = place[first], place[after]
    starts, ends, owners = [], [], []
    for n in range(1, max_words + 1):
        m = max(0, len(first) - n + 1)
        same = owner[:m] == owner[n - 1:] if m else np.zeros(0, dtype=bool)
        starts.append(first[:m][same])
        ends.append(after[n - 1:][same])
        owners.append(owner[:m][same])
    return (data, np.concatenate(starts), np.concatenate(ends), np.concatenate(owners),
            np.bincount(owner, minlength=len(texts)))


def _pieces(texts: pd.Series) -> Iterator[tuple[int, list[bytes]]]:
    """Texts of a batch as bytes, ``PIECE`` bytes or one text at a time, with the place of the first."""
    own, room, at = [], 0, 0
    for t in texts:
        raw = (t or "").encode("utf-8", "replace")
        if own and room + len(raw) > PIECE:
            yield at, own
            own, room, at = [], 0, at + len(own)
        own.append(raw)
        room += len(raw)
    if own:
        yield at, own


def bucket_counts(docs: DataFrame, text: str = "text", buckets: int = BUCKETS, max_words: int = MAX_WORDS) -> DataFrame:
    """bucket, n: features of all texts. Every task counts in one array before the shuffle."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(buckets, dtype=np.int64)
        for pdf in batches:
            for _, raw in _pieces(pdf["text"]):
                data, start, end, _, _ = features(raw, max_words)
                total += np.bincount(span_crc(data, start, end) % np.uint32(buckets), minlength=buckets)
        some = np.flatnonzero(total)
        yield pd.DataFrame({"bucket": some, "n": total[some]})

    part = docs.select(F.col(f"`{text}`").alias("text")).mapInPandas(count, "bucket bigint, n bigint")
    return part.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, text: str = "text", target_text: str = "text",
          buckets: int = BUCKETS, max_words: int = MAX_WORDS) -> list[int]:
    """Gain of every bucket: thousandths of its log odds, target against corpus, with one added to every bucket."""
    spark = docs.sparkSession
    s = bucket_counts(docs, text, buckets, max_words).withColumnRenamed("n", "s")
    t = bucket_counts(target, target_text, buckets, max_words).withColumnRenamed("n", "t")
    rows = spark.range(buckets).withColumnRenamed("id", "bucket").join(s, "bucket", "left").join(
        t, "bucket", "left").fillna(0, ["s", "t"]).withColumns({c: F.col(c).cast("double") for c in "st"})
    counted = rows.checkpoint(eager=True)
    total = counted.agg(F.sum("s").alias("s"), F.sum("t").alias("t")).first()
    odds = (F.col("t") + 1.0) * (total.s + float(buckets)) / ((F.col("s") + 1.0) * (total.t + float(buckets)))
    found = counted.select("bucket", F.floor(F.lit(1000.0) * F.ln(odds)).cast("bigint").alias("gain")).collect()
    out = [0] * buckets  # ``buckets`` numbers, whatever the corpus
    for r in found:
        out[r.bucket] = r.gain
    return out


def weigher(gain: list[int], max_words: int = MAX_WORDS):
    """Function from a text column to a struct of n_words, n_features and weight."""
    value = np.array(gain, dtype=np.int64)

    @F.pandas_udf(COUNTS)
    def weigh(texts: pd.Series) -> pd.DataFrame:
        out = np.zeros((len(texts), 3), dtype=np.int64)
        for at, raw in _pieces(texts):
            data, start, end, owner, n_words = features(raw, max_words)
            part = out[at:at + len(raw)]
            part[:, 0] = n_words
            part[:, 1] = np.bincount(owner, minlength=len(raw))
            np.add.at(part[:, 2], owner, value[span_crc(data, start, end) % np.uint32(len(value))])
        return pd.DataFrame(out, columns=["n_words", "n_features", "weight"])

    return weigh


def gumbel(doc_id: Column, seed: int = SEED) -> Column:
    """Seeded Gumbel number in thousandths, from the first 32 bits of sha256("seed:id")."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.ln(-F.ln((h + 0.5) / 4294967296.0))).cast("bigint")


def ranked(scored: DataFrame, percent: int, parts: int) -> DataFrame:
    """Add ``rank`` to the first floor(percent * eligible rows / 100) by score, ties to the smaller doc_id.

    ``scored``: doc_id, eligible, score and more. Rows go to ranges of (eligible, score, doc_id), so no task holds
    more than its range; a row's rank is its number in the range plus the rows of all ranges before.
    """
    order = [F.col("eligible").desc(), F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    dealt = scored.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn(
        "_at", F.monotonically_increasing_id())  # range number in the upper 31 bits, place in the lower 33
    dealt = dealt.withColumn("_range", F.shiftright("_at", 33)).checkpoint(eager=True)
    sizes = sorted((r["_range"], r["n"], r["e"] or 0) for r in dealt.groupBy("_range").agg(
        F.count("*").alias("n"), F.sum(F.col("eligible").cast("bigint")).alias("e")).collect())
    before, seen = [], 0
    for part, n, _ in sizes:
        before.append((part, seen))
        seen += n
    draw = percent * sum(e for _, _, e in sizes) // 100
    spark = scored.sparkSession
    offsets = F.broadcast(spark.createDataFrame(before, "_range bigint, _before bigint"))  # one row per range
    place = F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return dealt.join(offsets, "_range").withColumn(
        "rank", F.when(F.col("eligible") & (place <= draw), place)).drop("_range", "_at", "_before")


def resample(docs: DataFrame, target: DataFrame, doc_id: str = "doc_id", text: str = "text",
             target_text: str = "text", buckets: int = BUCKETS, max_words: int = MAX_WORDS, seed: int = SEED,
             least_words: int = LEAST_WORDS, percent: int = PERCENT, rows_per_range: int = 2_000_000) -> DataFrame:
    """doc_id, n_words, n_features, weight, score, rank (1, 2, ... for drawn rows, null for the others)."""
    gain = gains(docs, target, text, target_text, buckets, max_words)
    d = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), weigher(gain, max_words)(F.col(f"`{text}`")).alias("f"))
    d = d.select("doc_id", "f.*").withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed)).withColumn(
        "eligible", F.col("n_words") >= least_words).checkpoint(eager=True)
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-d.count() // rows_per_range))
    return ranked(d, percent, parts).drop("eligible")
