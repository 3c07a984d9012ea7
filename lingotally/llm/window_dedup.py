"""Substring dedup over token windows: Rabin-Karp hashes counted in Spark, runs merged.

Every window of ``window`` words gets a rolling hash of its words' hashes. Each block of documents
reports its distinct windows with the least document that holds each; buckets of windows find the least
document of the whole corpus and answer which windows start in a smaller document outside the block.
Blocks then merge the repeated windows to maximal removal intervals.

Hashes have 64 bits: among n windows, about n^2 / 2^65 pairs agree by chance.

Defined results: null and empty texts have no words; texts shorter than a window lose nothing; rows
with the same id never count against each other; rows with a null id neither lose words nor cost
others any; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import sys
from itertools import compress

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F

from lingotally.llm import blocks as B

cloudpickle.register_pickle_by_value(sys.modules[__name__])

WINDOW = 13
NEVER = B.NEVER
KEYS = "bucket int, block int, keys binary, owner binary, docs binary"
ANSWERS = "block int, step int, bucket int, n int, bits binary"


def read_block(pdf: pd.DataFrame) -> tuple[list[bytes], np.ndarray]:
    """Texts and ids of a block in an order that does not depend on the shuffle."""
    texts = B.unsqueeze(pdf["raw"])
    ids = pdf["doc_id"].to_numpy(dtype=np.int64)
    order = sorted(range(len(ids)), key=lambda i: (ids[i], texts[i]))
    return [texts[i] for i in order], ids[order]


def places(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct keys, where each stands first, and every key's place among them. The least of a key's places
    is looked for after the sort, which so need not be a stable one."""
    if not len(keys):
        return keys, np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    order = np.argsort(keys)
    k = keys[order]
    new = np.append(True, k[1:] != k[:-1])
    place = np.empty(len(keys), dtype=np.int64)
    place[order] = np.cumsum(new) - 1
    starts = np.flatnonzero(new)
    return k[starts], np.minimum.reduceat(order, starts), place


def least_owner(keys: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct keys, the first owner of each (owners ascend), and every key's place among them."""
    found, first, place = places(keys)
    return found, owner[first], place


def report(block: int, keys: np.ndarray, owner: np.ndarray, ids: np.ndarray, n: int) -> pd.DataFrame:
    """Rows for the buckets: keys, and owners as places in a short list of ids."""
    rows = []
    for bucket, a, b in B.slices(keys, n):
        used, at = np.unique(owner[a:b], return_inverse=True)
        kind = np.uint16 if len(used) < 65536 else np.uint32
        rows.append((bucket, block, B.pack(keys[a:b]), B.planes(at.astype(kind)), ids[used].tobytes()))
    return pd.DataFrame(rows, columns=["bucket", "block", "keys", "owner", "docs"])


def answer(pdf: pd.DataFrame, step: int) -> pd.DataFrame:
    """Which keys of every block have a smaller owner in another block."""
    keys, owners = [], []
    for raw, own, docs in zip(pdf["keys"], pdf["owner"], pdf["docs"]):
        k = B.unpack(raw)
        kind = np.uint16 if len(own) == 2 * len(k) else np.uint32
        keys.append(k)
        owners.append(np.frombuffer(docs, dtype=np.int64)[B.unplanes(own, kind)])
    size = [len(k) for k in keys]
    k, d = np.concatenate(keys), np.concatenate(owners)
    order = np.argsort(k)
    k = k[order]
    starts = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1])))
    least = np.minimum.reduceat(d[order], starts)
    flag = np.empty(len(k), dtype=bool)
    flag[order] = d[order] > np.repeat(least, np.diff(np.append(starts, len(k))))
    ends = np.cumsum(size)
    return pd.DataFrame({
        "block": pdf["block"].to_numpy(), "step": step, "bucket": pdf["bucket"].to_numpy(), "n": size,
        "bits": [np.packbits(flag[e - s:e]).tobytes() for s, e in zip(size, ends)]})


def flags(answers: pd.DataFrame, step: int) -> np.ndarray:
    """Answers of one step in key order."""
    own = answers[answers["step"] == step].sort_values("bucket")
    parts = [np.unpackbits(np.frombuffer(b, dtype=np.uint8), count=n) for b, n in zip(own["bits"], own["n"])]
    return np.concatenate(parts).astype(bool) if parts else np.zeros(0, dtype=bool)


def covered(starts: np.ndarray, width: int, size: int) -> np.ndarray:
    """Places inside any of the stretches of ``width`` that begin at ``starts``."""
    step = np.zeros(size + 1, dtype=np.int64)
    np.add.at(step, starts, 1)
    np.add.at(step, starts + width, -1)
    return np.cumsum(step[:-1]) > 0


def windows(texts: list[bytes], ids: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start place, hash and owner of every window of documents with an id; and the owner of each word."""
    word, owner = B.word_table(texts)
    n = len(word) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64), owner
    start = np.flatnonzero((owner[:n] == owner[width - 1:]) & (ids[owner[:n]] != NEVER))
    h = np.zeros(n, dtype=np.uint64)
    for j in range(width):
        h = h * np.uint64(B.BASE) + word[j:j + n]
    return start, B.mix(h[start]), owner


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW,
          block_bytes: int = B.BLOCK_BYTES, keep_text: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed, intervals (first word, end), kept_sha256, kept (words, one space)."""
    d, n = B.blocked(docs, doc_id, text, block_bytes)

    def keys_of(key, pdf: pd.DataFrame) -> pd.DataFrame:
        texts, ids = read_block(pdf)
        start, h, owner = windows(texts, ids, window)
        found, own, _ = least_owner(h, owner[start])
        return report(int(key[0]), found, own, ids, n)

    def remove(pdf: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        if not len(pdf):
            return pd.DataFrame(columns=["doc_id", "n_words", "n_removed", "intervals", "kept_sha256", "kept"])
        texts, ids = read_block(pdf)
        start, h, owner = windows(texts, ids, window)
        found, own, place = least_owner(h, owner[start])
        out = flags(answers, 0) if len(found) else np.zeros(0, dtype=bool)
        gone = out[place] | (ids[owner[start]] > ids[own[place]])
        drop = covered(start[gone], window, len(owner))
        bounds = np.searchsorted(owner, np.arange(len(texts) + 1))
        rows = []
        for i, t in enumerate(texts):
            own_drop = drop[bounds[i]:bounds[i + 1]]
            words = t.split()
            cut = int(own_drop.sum())
            edge = np.flatnonzero(np.diff(np.concatenate(([0], own_drop, [0])))).reshape(-1, 2) if cut else []
            kept = b" ".join(compress(words, (~own_drop).tolist()) if cut else words)
            rows.append((int(ids[i]), len(words), cut,
                         [{"start": int(a), "end": int(b)} for a, b in edge],
                         hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "replace") if keep_text else None))
        return pd.DataFrame(rows, columns=["doc_id", "n_words", "n_removed", "intervals", "kept_sha256", "kept"])

    groups = d.groupBy("block")
    told = groups.applyInPandas(keys_of, KEYS).groupBy("bucket").applyInPandas(lambda p: answer(p, 0), ANSWERS)
    return B.null_ids(groups.cogroup(told.groupBy("block")).applyInPandas(
        remove, "doc_id bigint, n_words bigint, n_removed bigint, intervals array<struct<start:int,`end`:int>>, "
                "kept_sha256 string, kept string"))
