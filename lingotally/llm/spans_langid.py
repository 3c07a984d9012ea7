"""Language of documents and of spans inside them: script ranges, word scores, Viterbi.

Training counts hashed character trigrams of words per language over all labelled texts. A word scores,
per language, the sum of its trigrams' log chances. Scripts narrow the choice: a language stays a
candidate for a word only if it was trained on words of that script. Viterbi over the words of a text,
with ``SWITCH`` taken off for every change of language, gives each word its language; equal neighbours
merge to spans. The document's language is the one with most letters in its spans, the score its share.

Counting emits (language, gram, count) per task and combines before the shuffle; the model (languages
x 65 536 cells) is all that reaches the driver. Scoring is row-local over whole texts.

Defined results: null texts and texts without a letter are ``und`` with score 0; words without letters
take no side; rows with a null language are not learned from; repeated rows count and are scored each;
an empty table gives an empty result, an empty training set ``und`` everywhere; ties go to the language
first in code point order; other columns are ignored.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])

CELLS = 1 << 16
SWITCH = 9.0
LEAST_SHARE = 0.001  # of a language's words in a script, to be its candidate there
# Script ranges of code points (Unicode block bounds; fixed values). 0: letters of any other script.
SCRIPTS = [
    (0x0041, 0x024F, 1), (0x0370, 0x03FF, 2), (0x0400, 0x052F, 3), (0x0530, 0x058F, 4), (0x0590, 0x05FF, 5),
    (0x0600, 0x06FF, 6), (0x0700, 0x074F, 7), (0x0750, 0x077F, 6), (0x08A0, 0x08FF, 6), (0x0900, 0x097F, 8),
    (0x0980, 0x09FF, 9), (0x0A00, 0x0A7F, 10), (0x0B80, 0x0BFF, 11), (0x0E00, 0x0E7F, 12), (0x10A0, 0x10FF, 13),
    (0x1100, 0x11FF, 14), (0x1E00, 0x1EFF, 1), (0x1F00, 0x1FFF, 2), (0x3040, 0x30FF, 15), (0x3400, 0x4DBF, 16),
    (0x4E00, 0x9FFF, 16), (0xAC00, 0xD7AF, 14), (0xF900, 0xFAFF, 16), (0x20000, 0x2FA1F, 16),
    (0x30000, 0x323AF, 16),
]
N_SCRIPTS = 17
POINTS = 0x32400  # code points beyond hold no letter
_TABLE: dict = {}


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Code point -> is a letter, -> script; built once per worker."""
    if not _TABLE:
        alpha = np.fromiter((chr(i).isalpha() for i in range(POINTS)), dtype=bool, count=POINTS)
        script = np.zeros(POINTS, dtype=np.int64)
        for lo, hi, s in SCRIPTS:
            script[lo:hi + 1] = s
        _TABLE["t"] = alpha, script
    return _TABLE["t"]


def _lower(text: str) -> str:
    """Lower case without a change of length, so that offsets stay those of the text."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def _words(texts: list[str]) -> dict[str, np.ndarray]:
    """Words of a batch: code points, word bounds, owners, letters and script of each word."""
    joined = " ".join(map(_lower, texts)) + " "
    points = np.frombuffer(joined.encode("utf-32-le", "replace"), dtype=np.uint32).astype(np.int64)
    lengths = np.array([len(t) + 1 for t in texts], dtype=np.int64)
    alpha, script = _tables()
    safe = np.minimum(points, POINTS - 1)
    space = (points == 32) | ((points >= 9) & (points <= 13))
    letter = alpha[safe]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], space)).astype(np.int8)))
    start, end = edge[0::2], edge[1::2]
    bounds = np.cumsum(lengths)
    owner = np.searchsorted(bounds, start, side="right")
    count = np.concatenate(([0], np.cumsum(letter)))
    letters = count[end] - count[start]
    first = np.flatnonzero(letter)
    at = np.searchsorted(first, start)
    kind = np.zeros(len(start), dtype=np.int64)
    has = letters > 0
    kind[has] = script[safe[first[at[has]]]]
    return {"points": np.where(letter, points, 32), "start": start, "end": end, "owner": owner,
            "letters": letters, "script": kind, "offset": bounds - lengths}


def _grams(points: np.ndarray) -> np.ndarray:
    """Cell of the trigram around every place."""
    p = np.concatenate(([32], points, [32])).astype(np.uint64)
    x = p[:-2] * np.uint64(0x9E3779B97F4A7C15) + p[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + p[2:] * np.uint64(0x165667B19E3779F9)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return (x >> np.uint64(48)).astype(np.int64)


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    grams: dict[str, np.ndarray] = {}
    scripts: dict[str, np.ndarray] = {}
    for pdf in batches:
        for lang, part in pdf.groupby("lang"):
            w = _words([t or "" for t in part["text"]])
            g = grams.setdefault(lang, np.zeros(CELLS, dtype=np.int64))
            s = scripts.setdefault(lang, np.zeros(N_SCRIPTS, dtype=np.int64))
            if len(w["start"]):
                g += np.bincount(_grams(w["points"])[w["points"] != 32], minlength=CELLS)
                s += np.bincount(w["script"][w["letters"] > 0], minlength=N_SCRIPTS)
    for lang, g in grams.items():
        both = np.concatenate((g, scripts[lang]))
        cell = np.flatnonzero(both)
        yield pd.DataFrame({"lang": lang, "cell": cell, "n": both[cell]})


def train(docs: DataFrame, lang: str = "lang", text: str = "text") -> dict:
    """Log chances and script candidates per language, from all rows with a language."""
    rows = docs.filter(F.col(lang).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).alias("text"))
    counts = rows.mapInPandas(_count, "lang string, cell int, n bigint").groupBy("lang", "cell").agg(
        F.sum("n").alias("n")).toPandas()  # languages x cells at most
    langs = sorted(counts["lang"].unique())
    n = np.zeros((len(langs), CELLS + N_SCRIPTS))
    place = {name: i for i, name in enumerate(langs)}
    n[counts["lang"].map(place).to_numpy(dtype=int), counts["cell"].to_numpy(dtype=int)] = counts["n"]
    g, s = n[:, :CELLS] + 0.5, n[:, CELLS:]
    chance = np.log(g / g.sum(axis=1, keepdims=True)).astype(np.float32)
    share = s / np.maximum(s.sum(axis=1, keepdims=True), 1)
    return {"langs": langs, "chance": chance, "script": share >= LEAST_SHARE}


def _viterbi(scores: np.ndarray, owner: np.ndarray, n_docs: int, switch: float) -> np.ndarray:
    """Best language per word. All texts of a batch advance together, longest first."""
    n, k = scores.shape
    label = np.zeros(n, dtype=np.int64)
    if not n or k < 2:
        return label
    size = np.bincount(owner, minlength=n_docs)
    first = np.cumsum(size) - size
    order = np.argsort(-size, kind="stable")
    first, size = first[order], size[order]
    stay = np.zeros((n, k), dtype=np.int8)
    active = int((size > 0).sum())
    best = scores[first[:active]].astype(np.float64)
    live = [active]
    for t in range(1, int(size[0])):
        while size[active - 1] <= t:
            active -= 1
        at = first[:active] + t
        now = best[:active]
        top = now.argmax(axis=1)
        lead = now[np.arange(active), top] - switch
        change = lead[:, None] > now
        stay[at] = np.where(change, top[:, None], np.arange(k))
        best[:active] = np.where(change, lead[:, None], now) + scores[at]
        live.append(active)
    state = best.argmax(axis=1)
    for t in range(int(size[0]) - 1, -1, -1):
        a = live[t]
        at = first[:a] + t
        label[at] = state[:a]
        if t:
            state[:a] = stay[at, state[:a]]
    return label


def label_batch(texts: list[str | None], model: dict, switch: float = SWITCH):
    """Words of a batch with the language number of each (-1: no candidate) and their place in the text."""
    texts = [t or "" for t in texts]
    w = _words(texts)
    k = len(model["langs"])
    n = len(w["start"])
    if not n or not k:
        return w, np.full(n, -1, dtype=np.int64)
    cells = _grams(w["points"])
    inside = w["points"] != 32
    scores = np.zeros((n, k), dtype=np.float32)
    for j in range(k):
        total = np.concatenate(([0.0], np.cumsum(np.where(inside, model["chance"][j][cells], 0.0), dtype=np.float64)))
        scores[:, j] = total[w["end"]] - total[w["start"]]
    allowed = model["script"][:, w["script"]].T
    none = ~allowed.any(axis=1) | (w["letters"] == 0)
    scores = np.where(allowed, scores, -1e4).astype(np.float32)
    scores[none] = 0.0
    label = _viterbi(scores, w["owner"], len(texts), switch)
    label[none & (w["letters"] > 0)] = -1
    return w, label


def detector(model: dict, switch: float = SWITCH):
    """Column function text -> struct(lang, score)."""
    names = np.array([*model["langs"], "und"], dtype=object)

    @F.pandas_udf("lang string, score double")
    def detect(texts: pd.Series) -> pd.DataFrame:
        k = len(model["langs"])
        w, label = label_batch(list(texts), model, switch)
        got = label >= 0
        mass = np.bincount(w["owner"][got] * (k + 1) + label[got], w["letters"][got],
                           len(texts) * (k + 1)).reshape(len(texts), k + 1)
        total = np.bincount(w["owner"], w["letters"], len(texts))
        # a text in scripts that no language was learned in: all languages compete for it
        lone = np.flatnonzero((mass.max(axis=1) == 0) & (total > 0))
        if len(lone) and k:
            w, label = label_batch([texts.iloc[i] for i in lone], {**model, "script": np.ones_like(model["script"])}, switch)
            got = label >= 0
            mass[lone] = np.bincount(w["owner"][got] * (k + 1) + label[got], w["letters"][got],
                                     len(lone) * (k + 1)).reshape(len(lone), k + 1)
        best = mass.argmax(axis=1)
        some = mass.max(axis=1) > 0
        score = np.where(some, mass.max(axis=1) / np.maximum(total, 1), 0.0)
        return pd.DataFrame({"lang": names[np.where(some, best, k)], "score": score})

    return detect


def spanner(model: dict, switch: float = SWITCH):
    """Column function text -> array of (start, end, lang): code points of runs of one language."""
    @F.pandas_udf("array<struct<start:int,`end`:int,lang:string>>")
    def spans(texts: pd.Series) -> pd.Series:
        w, label = label_batch(list(texts), model, switch)
        out: list[list] = [[] for _ in texts]
        for o, a, b, lab, n in zip(w["owner"], w["start"] - w["offset"][w["owner"]],
                                   w["end"] - w["offset"][w["owner"]], label, w["letters"]):
            lang = model["langs"][lab] if lab >= 0 else "und"
            if out[o] and (out[o][-1]["lang"] == lang or not n):
                out[o][-1]["end"] = int(b)
            elif n:
                out[o].append({"start": int(a), "end": int(b), "lang": lang})
        return pd.Series(out)

    return spans
