"""Runs of words that repeat with a period, found with string synchronising sets (after Kempa and Kociumaka, 2019).

A run is a stretch of consecutive words with smallest period q, at least max(24, 3 q) words long, that no
neighbouring word extends keeping the period.

1. Periods below 8 are found directly, by comparing the words with themselves q places on. This also gives
   every highly periodic region that the scales below leave out.
2. At every scale t = 4, 8, 16, ... a position is *synchronising* if the least hash among the windows of t
   words that start at it or at one of the t places after it is the first or the last of these. Windows with a
   period of t / 3 or less count for nothing: they lie in runs already known. Whether a position is chosen
   depends on the 2 t words that follow it only (its context), so equal contexts are chosen alike.
3. Positions with equal contexts that lie 2 t to 4 t - 1 apart propose that distance as a period. A run of
   period q in this range always holds such a pair: its window of least hash in the first q words, and the
   same one period on, both with contexts inside the run. Equal contexts lie more than t / 3 apart, otherwise
   their windows would be highly periodic, so a position proposes at most a dozen periods.
4. A proposal is extended both ways by descending window hashes; the stretch is then compared word by word.
   Of equal stretches the smallest period stays.

Windows are named by 64-bit hashes, built by doubling. Agreement by chance can only make a proposal look
longer than it is, which step 4 sees; the words themselves are compared exactly.

Texts are independent: one pass, no shuffle. Memory is that of an Arrow batch, cut to ``CHUNK`` words, or
of the longest single text (about 8 log2(words) bytes a word).

Defined results: null and empty texts have no words and no runs; repeated rows are reported each; a null
id passes through; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F, types as T

from lingotally.llm.blocks import mix

cloudpickle.register_pickle_by_value(sys.modules[__name__])
cloudpickle.register_pickle_by_value(sys.modules[mix.__module__])

LEAST = 24  # words of the shortest run
TIMES = 3  # a run holds its period so often at least
SMALL = 8  # periods below are found directly
CHUNK = 500_000
ODD = np.uint64(0x9E3779B97F4A7C15)

RESULT = T.StructType([
    T.StructField("n_words", T.LongType()),
    T.StructField("runs", T.ArrayType(T.StructType([
        T.StructField("start", T.LongType()), T.StructField("length", T.LongType()),
        T.StructField("period", T.LongType())]))),
    T.StructField("collapsed", T.StringType()),
])


def stretches(words: np.ndarray, lag: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of the maximal stretches with that period, ``lag`` words or more beyond their first."""
    if len(words) <= lag:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    same = np.zeros(len(words) - lag + 2, dtype=np.int8)
    same[1:-1] = words[:-lag] == words[lag:]
    edge = np.flatnonzero(np.diff(same))
    return edge[0::2], edge[1::2] + lag


def window_names(words: np.ndarray, top: int) -> list[np.ndarray]:
    """Hashes of all windows of 1, 2, 4, ... 2 ** top words; windows beyond the end have names of their own."""
    n = len(words)
    names = [mix(words.astype(np.uint64) + np.uint64(1))]
    for k in range(min(top, n.bit_length())):
        w, last = 1 << k, names[-1]
        longer = mix(np.arange(n, dtype=np.uint64) * ODD + np.uint64(k + 1))
        if w < n:
            longer[:n - w] = mix(last[:n - w] * ODD + (last[w:] ^ np.uint64(k + 1)))
        names.append(longer)
    return names


def common_after(names: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How many words from ``i`` equal those from ``j`` (j > i)."""
    n, far = len(names[0]), np.zeros(len(i), dtype=np.int64)
    for k in range(len(names) - 1, -1, -1):
        fits = j + far + (1 << k) <= n
        a, b = np.where(fits, i + far, 0), np.where(fits, j + far, 0)
        far += np.where(fits & (names[k][a] == names[k][b]), 1 << k, 0)
    return far


def common_before(names: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How many words before ``i`` equal those before ``j`` (j > i)."""
    far = np.zeros(len(i), dtype=np.int64)
    for k in range(len(names) - 1, -1, -1):
        a = i - far - (1 << k)
        fits = a >= 0
        b = np.where(fits, j - far - (1 << k), 0)
        far += np.where(fits & (names[k][np.where(fits, a, 0)] == names[k][b]), 1 << k, 0)
    return far


def synchronising(names: list[np.ndarray], k: int, regions: list[tuple[np.ndarray, np.ndarray, int]]) -> np.ndarray:
    """Positions chosen at scale 2 ** k; ``regions``: start, end and period of what is known to repeat."""
    t, n = 1 << k, len(names[0])
    if n < 2 * t:
        return np.zeros(0, dtype=np.int64)
    never = np.uint64(0xFFFFFFFFFFFFFFFF)
    step = np.zeros(n + 1, dtype=np.int32)
    for start, end, period in regions:
        if 3 * period <= t:
            long = end - start >= t
            np.add.at(step, start[long], 1)
            np.add.at(step, end[long] - t + 1, -1)
    own = np.where(np.cumsum(step[:-1]) > 0, never, names[k])
    least = own
    for j in range(k):
        least = np.minimum(least[:len(least) - (1 << j)], least[1 << j:])
    least = np.minimum(least[:-1], least[1:])  # over t + 1 places
    m = len(least)
    return np.flatnonzero((least != never) & ((least == own[:m]) | (least == own[t:t + m])))


def proposals(names: list[np.ndarray], k: int, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions and distances of chosen positions with equal contexts, 2 t to 4 t - 1 apart."""
    t = 1 << k
    context = names[k + 1][chosen]
    order = np.argsort(context, kind="stable")
    place, context = chosen[order], context[order]
    at, lag, skip = [], [], 1
    while skip < len(place):
        gap = np.where(context[skip:] == context[:-skip], place[skip:] - place[:-skip], 4 * t)
        near = np.flatnonzero(gap < 4 * t)
        if not len(near):
            break
        far = near[gap[near] >= 2 * t]
        at.append(place[far])
        lag.append(gap[far])
        skip += 1
    none = np.zeros(0, dtype=np.int64)
    return (np.concatenate(at), np.concatenate(lag)) if at else (none, none)


def find(words: np.ndarray, longest: int) -> np.ndarray:
    """(start, end, period) of all runs of texts laid end to end, a number of its own after each of them.

    ``longest``: words of the longest text. Sorted by start, then period.
    """
    regions = []
    for q in range(1, SMALL):
        start, end = stretches(words, q)
        long = end - start >= TIMES * q
        regions.append((start[long], end[long], q))
    names = window_names(words, max(longest, 1).bit_length())
    k = 2
    while 2 * TIMES * (1 << k) <= longest:
        at, lag = proposals(names, k, synchronising(names, k, regions))
        if len(at):
            start = at - common_before(names, at, at + lag)
            end = at + lag + common_after(names, at, at + lag)
            long = end - start >= np.maximum(TIMES * lag, LEAST)
            found = np.unique(np.stack([start[long], end[long], lag[long]], axis=1), axis=0)
            for q in np.unique(found[:, 2]).tolist():
                own = found[found[:, 2] == q]
                if not all((words[a:b - q] == words[a + q:b]).all() for a, b, _ in own.tolist()):
                    a, b = stretches(words, q)  # two different windows had the same name
                    long = b - a >= max(TIMES * q, LEAST)
                    own = np.stack([a[long], b[long], np.full(int(long.sum()), q)], axis=1)
                regions.append((own[:, 0], own[:, 1], q))
        k += 1
    all_of = np.concatenate([np.stack([a, b, np.full(len(a), q, dtype=np.int64)], axis=1) for a, b, q in regions])
    all_of = all_of[all_of[:, 1] - all_of[:, 0] >= np.maximum(TIMES * all_of[:, 2], LEAST)]
    all_of = all_of[np.lexsort((all_of[:, 2], all_of[:, 1], all_of[:, 0]))]
    first = np.ones(len(all_of), dtype=bool)
    first[1:] = (all_of[1:, :2] != all_of[:-1, :2]).any(axis=1)  # a multiple of the period gives the same stretch
    runs = all_of[first]
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def _chunks(sizes: list[int]) -> list[list[int]]:
    """Numbers of the texts that can hold a run, together by length, ``CHUNK`` words or one text at a time."""
    out, room, kind = [], 0, None
    for i in sorted((i for i, n in enumerate(sizes) if n >= LEAST), key=lambda i: sizes[i]):
        if not out or room + sizes[i] > CHUNK or sizes[i].bit_length() != kind:
            out.append([])
            room, kind = 0, sizes[i].bit_length()
        out[-1].append(i)
        room += sizes[i]
    return out


def text_runs(texts: list[bytes]) -> list[tuple[list[bytes], np.ndarray]]:
    """Words and runs (start, end, period) of every text."""
    split = [t.split() for t in texts]  # bytes: space and \\t to \\r
    sizes = [len(w) for w in split]
    found: list[np.ndarray] = [np.zeros((0, 3), dtype=np.int64)] * len(texts)
    for chunk in _chunks(sizes):
        flat = np.empty(sum(sizes[i] for i in chunk), dtype=object)
        flat[:] = [w for i in chunk for w in split[i]]
        codes = pd.factorize(flat)[0]
        own = np.array([sizes[i] for i in chunk], dtype=np.int64)
        bounds = np.concatenate(([0], np.cumsum(own + 1)))
        words = np.empty(bounds[-1], dtype=np.int64)
        inside = np.ones(len(words), dtype=bool)
        inside[bounds[1:] - 1] = False
        words[inside] = codes
        words[~inside] = len(flat) + np.arange(len(chunk))
        runs = find(words, int(own.max()))
        cut = np.searchsorted(runs[:, 0], bounds)
        for i, start, a, b in zip(chunk, bounds[:-1], cut[:-1], cut[1:]):
            found[i] = runs[a:b] - np.array([start, start, 0])
    return list(zip(split, found))


def collapse(words: list[bytes], runs: np.ndarray) -> bytes:
    """Words that no run holds after its first period, joined by one space."""
    if len(runs):
        step = np.zeros(len(words) + 1, dtype=np.int64)
        np.add.at(step, runs[:, 0] + runs[:, 2], 1)
        np.add.at(step, runs[:, 1], -1)
        words = [words[i] for i in np.flatnonzero(np.cumsum(step[:-1]) == 0)]
    return b" ".join(words)


def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of (doc_id, text) to (doc_id, n_words, runs, collapsed)."""
    kind = pa.struct([(c, pa.int64()) for c in ("start", "length", "period")])
    for batch in batches:
        found = text_runs([(t or "").encode("utf-8", "replace") for t in batch.column(1).to_pylist()])
        table = np.concatenate([np.zeros((0, 3), dtype=np.int64), *[runs for _, runs in found]])
        ends = np.cumsum([0, *[len(runs) for _, runs in found]], dtype=np.int32)
        runs = pa.StructArray.from_arrays(
            [pa.array(table[:, 0]), pa.array(table[:, 1] - table[:, 0]), pa.array(table[:, 2])], fields=list(kind))
        yield pa.RecordBatch.from_arrays([
            batch.column(0), pa.array([len(words) for words, _ in found], type=pa.int64()),
            pa.ListArray.from_arrays(pa.array(ends), runs),
            pa.array([collapse(words, runs).decode("utf-8") for words, runs in found], type=pa.string()),
        ], names=["doc_id", *RESULT.names])


def periodic_runs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, runs (start, length, period; by start, then period), collapsed (words that no run holds
    after its first period)."""
    d = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    return d.mapInArrow(scan, T.StructType([d.schema["doc_id"], *RESULT]))


def strongest(runs: Column) -> Column:
    """The run with the greatest exact length / period; ties to the smaller start, then period."""
    def better(a: Column, b: Column) -> Column:
        left, right = a["length"] * b["period"], b["length"] * a["period"]
        return F.when(left != right, left > right).when(
            a["start"] != b["start"], a["start"] < b["start"]).otherwise(a["period"] < b["period"])

    return F.get(F.array_sort(runs, lambda a, b: F.when(better(a, b), -1).when(better(b, a), 1).otherwise(0)), 0)
