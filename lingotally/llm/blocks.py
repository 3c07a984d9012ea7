"""Exchange of packed keys between blocks of documents and buckets of keys.

Counting every window of a corpus row by row would shuffle many times the corpus. Here documents are
dealt to blocks of a few MB by hash, a block reports its distinct keys once (sorted, as differences laid
out byte plane by byte plane, which the shuffle's codec squeezes), and buckets of keys answer every block
with one value per key. A key held by a third of all documents reaches its bucket once per block. Blocks
and buckets both grow in number, not in size, with the input. Nothing passes the driver.
"""

from __future__ import annotations

import math
import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F, types as T

from lingotally.llm.common import input_bytes

cloudpickle.register_pickle_by_value(sys.modules[__name__])

BLOCK_BYTES = 3 << 20
NEVER = (1 << 63) - 1  # stands for a null id inside blocks
BASE = 0x9E3779B97F4A7C15  # odd, so powers have inverses modulo 2^64
INVERSE = pow(BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads 64-bit values (Stafford's variant 13)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(BASE))


class Rolling:
    """Polynomial hash modulo 2^64 of any stretch of a byte string, from prefix sums."""

    def __init__(self, data: np.ndarray):
        n = len(data) + 1
        powers = np.full(n, BASE, dtype=np.uint64)
        powers[0] = 1
        np.cumprod(powers, out=powers)
        self.sums = np.zeros(n, dtype=np.uint64)
        np.cumsum(BYTE[data] * powers[:-1], out=self.sums[1:])
        back = np.full(n, INVERSE, dtype=np.uint64)
        back[0] = 1
        self.back = np.cumprod(back)

    def between(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.back[start])


def word_table(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hash and document number of every word (runs without space and \\t to \\r) of a block."""
    data = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
    space = (data == 32) | ((data >= 9) & (data <= 13))
    edge = np.flatnonzero(np.diff(np.concatenate(([True], space)).astype(np.int8)))
    start, end = edge[0::2], edge[1::2]
    bounds = np.cumsum(np.array([len(t) + 1 for t in texts], dtype=np.int64))
    hashes = mix(Rolling(data).between(start, end) + (end - start).astype(np.uint64))
    return hashes, np.searchsorted(bounds, start, side="right")


def squeeze(texts: pd.Series) -> pd.Series:
    """UTF-8 bytes, compressed for the exchange that several steps share."""
    from zstandard import ZstdCompressor

    z = ZstdCompressor(level=3)
    return pd.Series([z.compress((t or "").encode("utf-8", "replace")) for t in texts], dtype=object)


def unsqueeze(raws: pd.Series) -> list[bytes]:
    from zstandard import ZstdDecompressor

    z = ZstdDecompressor()
    return [z.decompress(raw) for raw in raws]


def blocked(docs: DataFrame, doc_id: str, text: str, block_bytes: int = BLOCK_BYTES,
            carry: tuple[str, ...] = ()) -> tuple[DataFrame, int]:
    """doc_id (bigint), raw (squeezed text), the columns of ``carry``, block; and the number of blocks, in proportion to the bytes of text."""
    n = max(1, math.ceil(input_bytes(docs, text) / block_bytes))
    key = F.pmod(F.xxhash64(F.col(doc_id), F.col(text)), F.lit(n)).cast("int")
    more = [F.col(f"`{c}`") for c in carry]
    return docs.select(F.coalesce(F.col(doc_id).cast("bigint"), F.lit(NEVER)).alias("doc_id"),
                       F.pandas_udf(squeeze, T.BinaryType())(F.col(text)).alias("raw"), *more, key.alias("block")), n


def null_ids(df: DataFrame) -> DataFrame:
    """Null ids back in place."""
    return df.withColumn("doc_id", F.nullif(F.col("doc_id"), F.lit(NEVER)))


def planes(x: np.ndarray) -> bytes:
    """Bytes of an array, all first bytes first."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes()


def unplanes(raw: bytes, dtype) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    flat = np.frombuffer(raw, dtype=np.uint8).reshape(size, -1)
    return np.ascontiguousarray(flat.T).view(dtype).ravel()


def pack(keys: np.ndarray) -> bytes:
    """Sorted keys as differences."""
    return planes(np.diff(keys, prepend=np.uint64(0)))


def unpack(raw: bytes) -> np.ndarray:
    return np.cumsum(unplanes(raw, np.uint64), dtype=np.uint64)


def distinct(keys: np.ndarray) -> np.ndarray:
    """Sorted distinct keys. Sorted, because ``np.unique`` hashes values, at many times the cost."""
    k = np.sort(keys)
    return k[np.append(True, k[1:] != k[:-1])] if len(k) else k


def slices(keys: np.ndarray, n: int, bits: int = 64) -> list[tuple[int, int, int]]:
    """(bucket, from, to) of sorted keys of ``bits`` bits cut to ``n`` equal ranges; empty ones left out."""
    top = (keys >> np.uint64(bits - 32)) if bits > 32 else keys << np.uint64(32 - bits)
    bucket = (top * np.uint64(n)) >> np.uint64(32)
    cut = np.flatnonzero(np.diff(bucket)) + 1
    at = [0, *cut.tolist(), len(keys)]
    return [(int(bucket[a]), a, b) for a, b in zip(at, at[1:]) if b > a]
