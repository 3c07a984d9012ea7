"""Hierarchical Pitman-Yor language model over words (after Teh, 2006).

A restaurant per preceding word seats that word's followers; all of them share one parent, whose
customers are their tables; the parent's base is uniform over the vocabulary and one unknown word.
Seating is sampled by Gibbs sweeps of the Chinese restaurant process (a customer opens a table with
chance (strength + discount * tables) * parent chance against count - discount * own tables), the table
counts of several sweeps are averaged, and a text scores the sum of log10 predictive probabilities of its
tokens under these averages (not the average of one prediction per sweep).

Counts and restaurants never become rows. Blocks of documents report their distinct words and pairs
with training counts as packed keys. Pairs meet in the cells of a grid (preceding word x word), so that
neither a frequent context nor a frequent word fills one cell; a cell of one of ``cols`` columns sees
that share of a context's followers, and its parent is normalised over these words alone, so the share's
tables, and the same share of the strength, weigh against it. Sums per context and per word go on to the buckets of words, which seat the parent and answer the blocks. Contexts and words of
pairs are 32-bit hashes, word counts use 64 bits. The model grows with the corpus; the driver holds none.

Normalisation is exact whatever was sampled: what a context's followers do not hold goes to the parent.

Defined results: null and empty texts hold only the end token; tokens unseen in training get the
parent's share; no training rows give the uniform base; repeated rows count and are scored each; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F, types as T

from lingotally.llm import blocks as B

cloudpickle.register_pickle_by_value(sys.modules[__name__])

STRENGTH = 1.0
SWEEPS, BURN_IN = 4, 1
SEED = 11
END = np.uint64(0x5851F42D4C957F2D)  # hash of the end token, which no word's text gives
EXACT_SEATS = 16
WORDS_KIND, PAIRS_KIND, SUMS_KIND, TOTALS_KIND = 0, 1, 2, 3
EMIT = "kind int, bucket int, block int, keys binary, a binary, b binary"
COLUMNS = ["kind", "bucket", "block", "keys", "a", "b"]
TOTALS = ["tokens", "types", "tables", "held"]


def read_block(pdf: pd.DataFrame) -> dict:
    """Tokens of a block: hash, pair of preceding word and word, document, training flag; tokens per text."""
    texts = [t.lower() for t in B.unsqueeze(pdf["raw"])]
    train = pdf["train"].to_numpy(dtype=bool)
    word, owner = B.word_table(texts)
    word = np.where(word == END, END ^ np.uint64(1), word)
    n, docs = np.bincount(owner, minlength=len(texts)), len(texts)
    stop = np.cumsum(n + 1) - 1  # place of every end token
    token = np.full(len(word) + docs, END, dtype=np.uint64)
    own = np.repeat(np.arange(docs), n + 1)
    inner = np.ones(len(token), dtype=bool)
    inner[stop] = False
    token[inner] = word
    before = np.concatenate(([END], token[:-1]))  # a text starts after an end
    pair = (before & np.uint64(0xFFFFFFFF00000000)) | (token >> np.uint64(32))
    return {"token": token, "pair": pair, "doc": own, "train": train[own], "size": n + 1}


def distinct(keys: np.ndarray, train: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct keys, place of every key among them, training count of each."""
    found, place = np.unique(keys, return_inverse=True)
    return found, place, np.bincount(place[train], minlength=len(found)).astype(np.uint32)


def grid(keys: np.ndarray, rows: int, cols: int) -> np.ndarray:
    """Cell of each pair: hash of the preceding word x hash of the word."""
    u = B.mix(keys >> np.uint64(32)) >> np.uint64(32)
    w = B.mix((keys & np.uint64(0xFFFFFFFF)) + np.uint64(1 << 40)) >> np.uint64(32)
    return (((u * np.uint64(rows)) >> np.uint64(32)) * np.uint64(cols) + ((w * np.uint64(cols)) >> np.uint64(32))).astype(np.int64)


def by_cell(keys: np.ndarray, rows: int, cols: int) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """Order by (cell, key), and (cell, from, to) in it."""
    cell = grid(keys, rows, cols)
    order = np.argsort(cell, kind="stable")
    cut = np.flatnonzero(np.diff(cell[order])) + 1
    at = [0, *cut.tolist(), len(keys)]
    return order, [(int(cell[order[x]]), x, y) for x, y in zip(at, at[1:]) if y > x]


def seat(count: np.ndarray, opening, rng: np.random.Generator, discount: float) -> np.ndarray:
    """Tables after seating ``count`` customers of each dish; ``opening`` gives the weight of a new table.

    The first customers sit down one by one; of many, further ones sit down in groups of a sixteenth of
    those already there, whose chances hardly change.
    """
    tables = (count > 0).astype(np.float64)
    seated, most = 1, int(count.max()) if len(count) else 0
    live = np.flatnonzero(count > 1)
    while seated < most and len(live):
        group = max(1, seated // 16) if seated >= EXACT_SEATS else 1
        new = opening[live]
        chance = new / (np.maximum(seated - discount * tables[live], 1e-9) + new)
        tables[live] += rng.binomial(np.minimum(group, count[live].astype(np.int64) - seated), np.clip(chance, 0, 1))
        seated += group
        live = live[count[live] > seated]
    return tables


def estimated_discount(count: np.ndarray) -> float:
    """n1 / (n1 + 2 n2), kept inside (0.3, 0.95)."""
    n1, n2 = float((count == 1).sum()), float((count == 2).sum())
    return min(0.95, max(0.3, n1 / (n1 + 2 * n2))) if n1 else 0.5


def model_scores(docs: DataFrame, training: Column, doc_id: str = "doc_id", text: str = "text",
                 strength: float = STRENGTH, sweeps: int = SWEEPS, burn_in: int = BURN_IN, seed: int = SEED,
                 block_bytes: int = B.BLOCK_BYTES) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score (add-one unigram), score (this model)."""
    d, n = B.blocked(docs.select(
        F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.coalesce(training, F.lit(False)).alias("train")),
        "doc_id", "text", block_bytes, ("train",))
    cols = max(1, math.isqrt(n))
    rows = math.ceil(n / cols)

    def emit(key, pdf: pd.DataFrame) -> pd.DataFrame:
        t, out = read_block(pdf), []
        found, _, count = distinct(t["token"], t["train"])
        for bucket, x, y in B.slices(found, n):
            out.append((WORDS_KIND, bucket, int(key[0]), B.pack(found[x:y]), B.planes(count[x:y]), b""))
        found, _, count = distinct(t["pair"], t["train"])
        order, cells = by_cell(found, rows, cols)
        for cell, x, y in cells:
            at = order[x:y]
            out.append((PAIRS_KIND, cell, int(key[0]), B.pack(found[at]), B.planes(count[at]), b""))
        return pd.DataFrame(out, columns=COLUMNS)

    def seat_pairs(key, pdf: pd.DataFrame) -> pd.DataFrame:
        """One cell: sampled seating of its pairs; answers to blocks, sums per context and per word."""
        keys = [B.unpack(raw) for raw in pdf["keys"]]
        counts = np.concatenate([B.unplanes(raw, np.uint32) for raw in pdf["a"]])
        found, place = np.unique(np.concatenate(keys), return_inverse=True)
        c = np.bincount(place, weights=counts, minlength=len(found))
        used = np.flatnonzero(c > 0)
        held, tables = np.zeros(len(found)), np.zeros(len(found))
        us, u = np.unique(found >> np.uint64(32), return_inverse=True)
        ws, w = np.unique(found & np.uint64(0xFFFFFFFF), return_inverse=True)
        if len(used):
            own, uu, ww = c[used], u[used], w[used]
            discount = estimated_discount(own)
            rng = np.random.default_rng([seed, int(key[0])])
            t = np.ones(len(used))
            kept = np.zeros(len(used))
            for sweep in range(sweeps):
                context = np.bincount(uu, t, len(us))
                parent = (np.bincount(ww, t, len(ws)) + 0.5) / (t.sum() + 0.5 * len(ws))
                t = seat(own, (strength / cols + discount * context[uu]) * parent[ww], rng, discount)
                if sweep >= burn_in:
                    kept += t / (sweeps - burn_in)
            tables[used] = kept
            held[used] = own - discount * kept
        out, at = [], 0
        for block, k in zip(pdf["block"], keys):
            # few distinct values: a list of them and a place in it per key
            values, own = np.unique(held[place[at:at + len(k)]].astype(np.float32), return_inverse=True)
            narrow = own.astype(np.uint8 if len(values) <= 256 else np.uint32)
            out.append((PAIRS_KIND, int(key[0]), int(block), b"", B.planes(narrow), values.tobytes()))
            at += len(k)
        for ids, total, mark in ((us, np.bincount(u, held, len(us)), b"u"), (ws, np.bincount(w, tables, len(ws)), b"w")):
            wide, total = ids[total > 0] << np.uint64(32), total[total > 0].astype(np.float32)
            for bucket, x, y in B.slices(wide, n):
                out.append((SUMS_KIND, bucket, -1, B.pack(wide[x:y]), B.planes(total[x:y]), mark))
        return pd.DataFrame(out, columns=COLUMNS)

    def seat_words(key, pdf: pd.DataFrame) -> pd.DataFrame:
        """One bucket of words: counts, sampled seating of the parent, answers to blocks, totals."""
        asked = pdf[pdf["kind"] == WORDS_KIND]
        sums = pdf[pdf["kind"] == SUMS_KIND]
        if not len(asked):
            return pd.DataFrame(columns=COLUMNS)
        keys = [B.unpack(raw) for raw in asked["keys"]]
        found, place = np.unique(np.concatenate(keys), return_inverse=True)
        c = np.bincount(place, weights=np.concatenate([B.unplanes(raw, np.uint32) for raw in asked["a"]]),
                        minlength=len(found))
        short, at = np.unique(found >> np.uint64(32), return_inverse=True)
        total = {b"u": np.zeros(len(short)), b"w": np.zeros(len(short))}  # held of the context, tables of the word
        for raw, a, mark in zip(sums["keys"], sums["a"], sums["b"]):
            k = B.unpack(raw) >> np.uint64(32)
            x = np.minimum(np.searchsorted(short, k), len(short) - 1)
            ok = short[x] == k
            total[bytes(mark)] += np.bincount(x[ok], B.unplanes(a, np.float32)[ok], len(short))
        # words that share 32 bits share their sums by halves, so that the parent stays normalised
        tables = total[b"w"][at] / np.bincount(at)[at]
        customers = np.rint(tables)
        rng = np.random.default_rng([seed, 1, int(key[0])])
        discount = estimated_discount(customers)
        held = np.zeros(len(found))
        for _ in range(max(1, sweeps - burn_in)):
            held += (tables - discount * np.minimum(seat(customers, np.full(len(found), discount), rng, discount), tables)
                     ) / max(1, sweeps - burn_in)
        held = np.maximum(held, 0.0)
        out, x = [], 0
        for block, k in zip(asked["block"], keys):
            own = place[x:x + len(k)]
            side = np.stack((held[own], total[b"u"][at[own]])).astype(np.float32)
            out.append((WORDS_KIND, int(key[0]), int(block), b"", B.planes(c[own].astype(np.int64)),
                        B.planes(side.ravel())))
            x += len(k)
        totals = np.array([c.sum(), (c > 0).sum(), tables.sum(), held.sum()])
        out.append((TOTALS_KIND, int(key[0]), -1, b"", totals.tobytes(), b""))
        return pd.DataFrame(out, columns=COLUMNS)

    names = ["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"]

    def score(pdf: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        if not len(pdf):
            return pd.DataFrame(columns=names)
        t = read_block(pdf)
        totals = told[told["kind"] == TOTALS_KIND].iloc[0]
        tokens, types, tables, held_all = (totals[k] for k in TOTALS)
        told = told.sort_values("bucket")
        words, pairs = told[told["kind"] == WORDS_KIND], told[told["kind"] == PAIRS_KIND]
        found, place = np.unique(t["token"], return_inverse=True)
        count = np.concatenate([B.unplanes(raw, np.int64) for raw in words["a"]])
        side = np.concatenate([B.unplanes(raw, np.float32).reshape(2, -1) for raw in words["b"]], axis=1).astype(float)
        base = 1.0 / (types + 1.0)
        parent = (side[0] + (strength + tables - held_all) * base) / (strength + tables)
        pair, pair_place = np.unique(t["pair"], return_inverse=True)
        order, _ = by_cell(pair, rows, cols)
        own = np.zeros(len(pair))
        own[order] = np.concatenate([
            np.frombuffer(b, dtype=np.float32)[B.unplanes(a, np.uint8 if len(b) <= 1024 else np.uint32)]
            for a, b in zip(pairs["a"], pairs["b"])])
        # the context of a token is the token before it; a text starts after an end
        end = np.searchsorted(found, END)
        before = np.concatenate(([end], place[:-1]))
        # every training token but a text's last is followed by one, and every text follows an end
        customers = count[before].astype(float)
        inside = np.minimum(side[1][before], customers)
        chance = (own[pair_place] + (strength + customers - inside) * parent[place]) / (strength + customers)
        c = count[place]
        docs_n = len(t["size"])
        total = lambda x: np.bincount(t["doc"], x, docs_n)
        return pd.DataFrame({
            "doc_id": pdf["doc_id"], "n_tokens": t["size"], "n_known": total(c > 0).astype(np.int64),
            "train_tokens": int(tokens),
            "base_score": total(np.log10((c + 1.0) / (tokens + types + 1.0))),
            "score": total(np.log10(np.maximum(chance, 1e-300)))})

    groups = d.groupBy("block")
    sent = groups.applyInPandas(emit, EMIT)
    cells = sent.filter(F.col("kind") == PAIRS_KIND).groupBy("bucket").applyInPandas(seat_pairs, EMIT)
    vocabulary = sent.filter(F.col("kind") == WORDS_KIND).unionByName(cells.filter(F.col("kind") == SUMS_KIND))
    seated = vocabulary.groupBy("bucket").applyInPandas(seat_words, EMIT)
    none = [F.lit(None).cast("double").alias(k) for k in TOTALS]
    answers = cells.filter(F.col("kind") == PAIRS_KIND).unionByName(seated.filter(F.col("kind") == WORDS_KIND)).select(
        "kind", "bucket", "block", "a", "b", *none)
    part = lambda i: F.sum(decode(F.col("a"))[i])
    totals = seated.filter(F.col("kind") == TOTALS_KIND).agg(*[part(i).alias(k) for i, k in enumerate(TOTALS)])
    empty = F.lit(b"")
    totals = totals.select(
        F.lit(TOTALS_KIND).alias("kind"), F.lit(-1).alias("bucket"),
        F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("block"), empty.alias("a"), empty.alias("b"), *TOTALS)
    return B.null_ids(groups.cogroup(answers.unionByName(totals).groupBy("block")).applyInPandas(
        score, "doc_id bigint, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"))


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def decode(raw: pd.Series) -> pd.Series:
    return pd.Series([np.frombuffer(x, dtype=np.float64).tolist() for x in raw])
