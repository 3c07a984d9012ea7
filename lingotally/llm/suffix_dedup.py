"""Suffix dedup of byte strings, blockwise with a difference cover (after Karkkainen, 2007).

A removed byte lies in a string of ``length`` bytes that starts earlier in the corpus, so only the
first ``length`` bytes of a suffix matter, and the corpus is sorted one bucket of suffixes at a time:

1. Cover sample. The places of a document that are in the difference cover modulo ``period`` report the
   ``length - period + 1`` bytes that follow. Two equal strings always have, at some common distance
   below ``period``, a sample place each; so a suffix may tie with another over ``length`` bytes only
   if a sample place inside it ties. Buckets of samples answer which ones do (narrow hashes whose width
   grows with the corpus; a chance agreement costs work, never a wrong result).
2. Suffix buckets. Suffixes near a tied sample enter the bucket of their first ``length`` bytes (64-bit
   fingerprints, of which about n^2 / 2^65 pairs agree by chance), each bucket is sorted on its own,
   and ties are settled by document, then place. Memory is bounded by one block or one bucket.

Between the two, stretches: suffixes whose fingerprint is a multiple of ``STRIDE`` cut runs of tied
suffixes at places that depend on content alone. A whole stretch that also lies in an earlier document,
or earlier in its own, is removed without sending its suffixes; the first holder of it still sends its own.

Only equality is asked of the order, so buckets are ranges of fingerprints, not of the alphabet.

Defined results: null and empty texts have no bytes; texts shorter than ``length`` lose nothing;
overlapping repeats inside one text count; rows with the same id never count against each other; rows
with a null id neither lose bytes nor cost others any; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame

from lingotally.llm import blocks as B
from lingotally.llm.window_dedup import (
    ANSWERS, KEYS, NEVER, answer, covered, flags, least_owner, places, read_block, report)

cloudpickle.register_pickle_by_value(sys.modules[__name__])

LENGTH = 100
PERIOD, COVER_SIZE = 57, 8
STRIDE = 32
SAMPLES = "bucket int, block int, keys binary"


def difference_cover(period: int, size: int) -> list[int]:
    """First set of ``size`` places whose differences give every distance modulo ``period``."""
    def grow(chosen: list[int], seen: set[int]) -> list[int] | None:
        if len(chosen) == size:
            return chosen if len(seen) == period - 1 else None
        for x in range(chosen[-1] + 1, period):
            new = {(x - c) % period for c in chosen} | {(c - x) % period for c in chosen}
            if len(new) == 2 * len(chosen) and not new & seen:
                found = grow([*chosen, x], seen | new)
                if found:
                    return found
        return None

    found = grow([0], set())
    if found is None:
        raise ValueError(f"no perfect difference cover of {size} modulo {period}")
    return found


class Block:
    """Bytes of a block: rolling hashes, owners and places."""

    def __init__(self, pdf: pd.DataFrame, length: int):
        self.texts, self.ids = read_block(pdf)
        self.size = np.array([len(t) for t in self.texts], dtype=np.int64)
        self.first = np.cumsum(self.size) - self.size
        self.data = np.frombuffer(b"".join(self.texts), dtype=np.uint8)
        self.length = length
        self.roll = B.Rolling(self.data)
        self.fit = [i for i in range(len(self.texts)) if self.size[i] >= length and self.ids[i] != NEVER]

    def samples(self, cover: np.ndarray, period: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """Places (in the block) and narrow keys of the cover sample."""
        k = self.length - period + 1
        parts = []
        for i in self.fit:
            rounds = np.arange(0, self.size[i] - k + 1, period)
            at = (rounds[:, None] + cover[None, :]).ravel()
            parts.append(self.first[i] + at[at <= self.size[i] - k])
        at = np.concatenate(parts) if parts else np.zeros(0, dtype=np.int64)
        return at, self.roll.between(at, at + k) >> np.uint64(64 - bits)

    def near(self, places: np.ndarray, period: int) -> tuple[np.ndarray, np.ndarray]:
        """Suffixes that hold one of the places in their first ``period`` bytes, and their owners."""
        n = len(self.data)
        step = np.zeros(n + 1, dtype=np.int32)
        owner = np.searchsorted(self.first, places, side="right") - 1
        lo = np.maximum(places - period + 1, self.first[owner])
        np.add.at(step, lo, 1)
        np.add.at(step, places + 1, -1)
        at = np.flatnonzero(np.cumsum(step[:-1]) > 0)
        owner = np.searchsorted(self.first, at, side="right") - 1
        ok = at + self.length <= self.first[owner] + self.size[owner]
        return at[ok], owner[ok]


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH,
          period: int = PERIOD, cover_size: int = COVER_SIZE, block_bytes: int = B.BLOCK_BYTES,
          keep_bytes: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, spans (byte start, end), kept_sha256, kept (binary)."""
    d, n = B.blocked(docs, doc_id, text, block_bytes)
    cover = np.array(difference_cover(period, cover_size), dtype=np.int64)
    # nine bits more than the corpus needs: one sample in 500 is taken further by chance at most
    bits = min(64, max(34, math.ceil(math.log2(n * block_bytes + 1)) + 9))

    def sample_keys(key, pdf: pd.DataFrame) -> pd.DataFrame:
        b = Block(pdf, length)
        keys = B.distinct(b.samples(cover, period, bits)[1])
        return pd.DataFrame([(s, int(key[0]), B.pack(keys[x:y])) for s, x, y in B.slices(keys, n, bits)],
                            columns=["bucket", "block", "keys"])

    def tied(pdf: pd.DataFrame) -> pd.DataFrame:
        keys = [B.unpack(raw) for raw in pdf["keys"]]
        size = [len(k) for k in keys]
        _, place, count = np.unique(np.concatenate(keys), return_inverse=True, return_counts=True)
        flag, ends = count[place] > 1, np.cumsum(size)
        return pd.DataFrame({
            "block": pdf["block"].to_numpy(), "step": 0, "bucket": pdf["bucket"].to_numpy(), "n": size,
            "bits": [np.packbits(flag[e - s:e]).tobytes() for s, e in zip(size, ends)]})

    def candidates(b: Block, answers: pd.DataFrame) -> dict:
        """Suffixes that may tie (start, owner, fingerprint) and the stretches between their anchors."""
        at, keys = b.samples(cover, period, bits)
        _, place, count = np.unique(keys, return_inverse=True, return_counts=True)
        ties = flags(answers, 0)[place] | (count[place] > 1) if len(at) else np.zeros(0, dtype=bool)
        start, owner = b.near(at[ties], period)
        print_ = b.roll.between(start, start + length)
        anchor = np.flatnonzero(print_ % np.uint64(STRIDE) == 0)
        one, two = anchor[:-1], anchor[1:]
        # all suffixes between the anchors are there, so they lie in one text
        whole = (start[two] - start[one] == two - one) & (owner[two] == owner[one])
        one, two = one[whole], two[whole]
        key = b.roll.between(start[one], start[two] + length)
        return {"start": start, "owner": owner, "print": print_, "from": one, "to": two, "key": key}

    def earlier(b: Block, key: np.ndarray, owner: np.ndarray, start: np.ndarray, told: np.ndarray) -> np.ndarray:
        """Keys that a smaller document holds (told, or in the block), or the same one before."""
        if not len(key):
            return np.zeros(0, dtype=bool)
        _, first, place = places(key)
        first = first[place]
        least = owner[first]
        gone = told[place] | (b.ids[owner] > b.ids[least]) | ((owner == least) & (first != np.arange(len(key))))
        twin = np.flatnonzero(~gone & (owner != least))  # other rows with the id of the least owner
        if len(twin):
            twin = twin[np.lexsort((start[twin], owner[twin], place[twin]))]
            gone[twin[1:]] = (place[twin[1:]] == place[twin[:-1]]) & (owner[twin[1:]] == owner[twin[:-1]])
        return gone

    def left(b: Block, c: dict, answers: pd.DataFrame) -> np.ndarray:
        """Suffixes that no removed stretch settles."""
        gone = earlier(b, c["key"], c["owner"][c["from"]], c["start"][c["from"]], flags(answers, 1))
        step = np.zeros(len(c["start"]) + 1, dtype=np.int64)
        np.add.at(step, c["from"][gone], 1)
        np.add.at(step, c["to"][gone], -1)
        return np.cumsum(step[:-1]) == 0

    def stretch_keys(key, pdf: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        if not len(pdf):
            return pd.DataFrame(columns=["bucket", "block", "keys", "owner", "docs"])
        b = Block(pdf, length)
        c = candidates(b, answers)
        found, own, _ = least_owner(c["key"], c["owner"][c["from"]])
        return report(int(key[0]), found, own, b.ids, n)

    def suffix_keys(key, pdf: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        if not len(pdf):
            return pd.DataFrame(columns=["bucket", "block", "keys", "owner", "docs"])
        b = Block(pdf, length)
        c = candidates(b, answers)
        rest = left(b, c, answers)
        found, own, _ = least_owner(c["print"][rest], c["owner"][rest])
        return report(int(key[0]), found, own, b.ids, n)

    names = ["doc_id", "n_bytes", "n_removed", "spans", "kept_sha256", "kept"]

    def remove(pdf: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        if not len(pdf):
            return pd.DataFrame(columns=names)
        b = Block(pdf, length)
        c = candidates(b, answers)
        rest = left(b, c, answers)
        gone = ~rest
        gone[rest] = earlier(b, c["print"][rest], c["owner"][rest], c["start"][rest], flags(answers, 2))
        drop = covered(c["start"][gone], length, len(b.data))
        rows = []
        for i, t in enumerate(b.texts):
            x = b.first[i]
            cut = drop[x:x + len(t)]
            removed = int(cut.sum())
            edge = np.flatnonzero(np.diff(np.concatenate(([0], cut, [0])))).reshape(-1, 2) if removed else []
            kept = b.data[x:x + len(t)][~cut].tobytes() if removed else t
            rows.append((int(b.ids[i]), len(t), removed,
                         [{"start": int(p), "end": int(q)} for p, q in edge],
                         hashlib.sha256(kept).hexdigest(), kept if keep_bytes else None))
        return pd.DataFrame(rows, columns=names)

    groups = d.groupBy("block")
    ties = groups.applyInPandas(sample_keys, SAMPLES).groupBy("bucket").applyInPandas(tied, ANSWERS)
    stretches = groups.cogroup(ties.groupBy("block")).applyInPandas(stretch_keys, KEYS).groupBy("bucket").applyInPandas(
        lambda p: answer(p, 1), ANSWERS)
    known = ties.unionByName(stretches)
    told = groups.cogroup(known.groupBy("block")).applyInPandas(suffix_keys, KEYS).groupBy("bucket").applyInPandas(
        lambda p: answer(p, 2), ANSWERS)
    return B.null_ids(groups.cogroup(known.unionByName(told).groupBy("block")).applyInPandas(
        remove, "doc_id bigint, n_bytes bigint, n_removed bigint, spans array<struct<start:int,`end`:int>>, "
                "kept_sha256 string, kept binary"))
