"""Language identification from ranked character trigrams (after Cavnar & Trenkle, 1994).

A profile holds the K most frequent trigrams of every language. A trigram of rank r is worth
K + 1 - r; a text scores, per language, the worth of all its trigrams. Scores are integers, so
results do not depend on the order of rows. Training reads whole texts, and so does scoring unless
``sample_chars`` asks for the head of a text only.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window, functions as F

from lingotally.functions import text as X
from lingotally.operators.sizes import broadcast_if_small

# Functions of this module travel to Python workers by value: executors need no install.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

TOP_K = 300
MAX_PROFILE_ROWS = 500_000
BATCH_CHARS = 500_000  # characters scored at once in a worker


def sample(text: Column, n: int | None = None) -> Column:
    """Lower-cased text (its first ``n`` characters, if given) with single spaces."""
    head = F.lower(text if n is None else X.head_sample(text, n))
    return F.regexp_replace(head, rf"[{X.WS_CLASS}]+", " ")


def grams(sampled: Column) -> Column:
    """All overlapping trigrams of code points in one regex pass."""
    return F.regexp_extract_all(sampled, F.lit("(?s)(?=(...))."), F.lit(1))


def train_profile(df: DataFrame, language: str = "lang", text: str = "text",
                  k: int = TOP_K) -> DataFrame:
    """Top-k trigrams per language with rank and worth.

    Arrow batches are counted with numpy, so a batch sends one row per language and distinct trigram to the
    partial aggregate; the rank filter is pushed below the last shuffle as a group limit, so each task sends
    at most k rows per language to the final ranking.
    """
    kind = df.schema[language].dataType.simpleString()
    counts = (
        df.select(F.col(language).alias("language"), sample(F.col(text)).alias("text"))
        .mapInArrow(_count_grams, f"language {kind}, key bigint, n bigint")
        .groupBy("language", "key").agg(F.sum("n").alias("n"))
    )
    order = Window.partitionBy("language").orderBy(F.desc("n"), "key")  # keys sort as the trigrams do
    ranked = counts.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    points = F.array(*[F.shiftrightunsigned("key", s).bitwiseAND(F.lit(0x1FFFFF)) for s in (42, 21, 0)])
    # a code point as text: four bytes, most significant first (as without a mark)
    letters = F.transform(points, lambda c: F.decode(F.unhex(F.lpad(F.hex(c), 8, "0")), "UTF-32"))
    return ranked.select("language", F.array_join(letters, "").alias("gram"), "n", "rank",
                         (F.lit(k + 1) - F.col("rank")).alias("weight"))


def _count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Trigrams of (language, text) by language: (language, key, n)."""
    for batch in batches:
        rows: dict = {}
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if text:
                rows.setdefault(lang, []).append(text)
        for lang, texts in rows.items():
            at = 0
            while at < len(texts):
                room, start = 0, at
                while at < len(texts) and (at == start or room + len(texts[at]) <= BATCH_CHARS):
                    room += len(texts[at])
                    at += 1
                part = texts[start:at]
                points = np.frombuffer("".join(part).encode("utf-32-le", "replace"), dtype=np.uint32).astype(np.int64)
                if len(points) < 3:
                    continue
                owner = np.repeat(np.arange(len(part)), [len(t) for t in part])
                key = (points[:-2] << 42) | (points[1:-1] << 21) | points[2:]
                found, n = np.unique(key[owner[:-2] == owner[2:]], return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(found), type=batch.schema.field(0).type), pa.array(found), pa.array(n)],
                    names=["language", "key", "n"])


def language_scores(df: DataFrame, profile: DataFrame, key: str, text: str = "text",
                    sample_chars: int | None = None) -> DataFrame:
    """Score per key and language, for any number of languages; a key without any known trigram keeps
    one null language row.

    The profile is bounded by languages times K. Trigrams never leave the map side: the partial
    aggregation sends one row per key and language.
    """
    exploded = df.select(key, F.explode(grams(sample(F.col(text), sample_chars))).alias("gram"))
    side = broadcast_if_small(profile.select("language", "gram", "weight"))
    scored = exploded.join(side, "gram").groupBy(key, "language").agg(
        F.sum("weight").cast("bigint").alias("score"))
    keys = df.select(F.col(key).alias("_key")).distinct()
    return keys.join(scored, F.col("_key").eqNullSafe(F.col(key)), "left").select(
        F.col("_key").alias(key), "language", "score")


def best_language(scores: DataFrame, key: str) -> DataFrame:
    """Winner, its score and the runner-up's per key; ties go to the smaller code."""
    entry = F.when(F.col("language").isNotNull(), F.struct((-F.col("score")).alias("s"), "language"))
    ranked = F.array_sort(F.collect_list(entry))  # at most one entry per language
    top = scores.groupBy(key).agg(ranked.alias("_r"))
    first, second = F.get("_r", F.lit(0)), F.get("_r", F.lit(1))
    return top.select(
        key,
        F.coalesce(first["language"], F.lit("")).alias("language"),
        F.coalesce(-first["s"], F.lit(0)).alias("score"),
        F.coalesce(-second["s"], F.lit(0)).alias("runner_up"),
    )


def margin_confidence(score: Column, runner_up: Column) -> Column:
    """1 when the winner scores twice the runner-up or more, falling to 0 at a tie."""
    return F.when(
        score > 0, F.least((score - runner_up) * 2.0 / score, F.lit(1.0))
    ).otherwise(0.0)


def detector(profile: DataFrame, sample_chars: int | None = None, max_rows: int = MAX_PROFILE_ROWS):
    """Column function text -> struct(language, score, runner_up) for use inside one projection.

    Same scores as ``language_scores`` but row-local: nothing is shuffled, and Arrow batches are
    scored with numpy, ``BATCH_CHARS`` characters at a time. The profile (at most ``max_rows`` rows) travels
    with the function.
    """
    rows = profile.select("language", "gram", "weight").limit(max_rows + 1).collect()
    if len(rows) > max_rows:
        raise ValueError("language profile is too large")
    languages = sorted({r["language"] for r in rows})
    keyed = {g: i for i, g in enumerate(sorted({r["gram"] for r in rows}, key=_gram_key))}
    codes = np.array([_gram_key(g) for g in keyed], dtype=np.int64)
    weights = np.zeros((len(keyed), len(languages)))
    for r in rows:
        weights[keyed[r["gram"]], languages.index(r["language"])] = r["weight"]

    @F.pandas_udf("language string, score bigint, runner_up bigint")
    def score(samples: pd.Series) -> pd.DataFrame:
        samples = samples.fillna("")
        part = (samples.str.len().cumsum() // BATCH_CHARS).to_numpy()
        parts = [_score_batch(samples[part == i], languages, codes, weights) for i in pd.unique(part)]
        return pd.concat(parts, ignore_index=True) if parts else _score_batch(samples, languages, codes, weights)

    # Declared non-deterministic only to keep filters on its result above it: pushed below, they
    # would run the function a second time.
    score = score.asNondeterministic()
    return lambda text: score(sample(text, sample_chars))


def _gram_key(gram: str) -> int:
    a, b, c = (ord(ch) for ch in gram)
    return (a << 42) | (b << 21) | c


def _score_batch(samples: pd.Series, languages: list[str], codes: np.ndarray,
                 weights: np.ndarray) -> pd.DataFrame:
    n = len(samples)
    points = np.frombuffer("".join(samples).encode("utf-32-le"), dtype=np.uint32).astype(np.int64)
    row = np.repeat(np.arange(n), samples.str.len().to_numpy(dtype=np.int64))
    scores = np.zeros((n, max(len(languages), 2)))
    if len(points) > 2 and len(codes):
        key = (points[:-2] << 42) | (points[1:-1] << 21) | points[2:]
        at = np.minimum(np.searchsorted(codes, key), len(codes) - 1)
        hit = (row[:-2] == row[2:]) & (codes[at] == key)
        owner, at = row[:-2][hit], at[hit]
        for i in range(len(languages)):
            scores[:, i] = np.bincount(owner, weights=weights[at, i], minlength=n)
    best = scores.argmax(axis=1)
    top = np.sort(scores, axis=1)[:, ::-1]
    names = np.array([*languages, "", ""], dtype=object)
    return pd.DataFrame({
        "language": np.where(top[:, 0] > 0, names[best], ""),
        "score": top[:, 0].astype(np.int64),
        "runner_up": top[:, 1].astype(np.int64),
    })
