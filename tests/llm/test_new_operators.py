"""Importance resampling, periodic runs and SentencePiece against brute force, SQL and the public libraries."""

import hashlib
import math
import random
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import oracle
from lingotally import session
from lingotally.llm import common, importance, periodic_runs, piece_bpe
from lingotally.llm.catalogue import ORACLE, QUERIES, planted
from test_llm import ROWS, SCHEMA, words

NAMES = ["op11_importance_resampling", "op12_periodic_runs", "op13_sentencepiece"]


@pytest.fixture(scope="module")
def spark(spark):
    return session.checkpoints(common.arrow(session.tune(spark)))


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ROWS, SCHEMA).withColumns(
        {c: F.lit(-1) for c in ("weight", "score", "rank", "runs", "ids", "found", "made", "f")}).repartition(3)


@pytest.fixture(scope="module")
def docs(spark, sf):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]


# importance resampling


def lower_words(t):
    import re

    t = (t or "").translate(str.maketrans(common.UPPER, common.LOWER))
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t)


def brute_resample(docs, target, n_max, buckets, least, percent):
    def grams(t):
        w = lower_words(t)
        return [" ".join(w[i:i + n]) for n in range(1, n_max + 1) for i in range(len(w) - n + 1)]

    def bucket(g):
        return zlib.crc32(g.encode()) % buckets

    s = Counter(bucket(g) for _, t in docs for g in grams(t))
    t = Counter(bucket(g) for _, x in target for g in grams(x))
    ns, nt = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (ns + buckets) / ((s[b] + 1) * (nt + buckets)))) for b in range(buckets)]
    rows = []
    for i, x in docs:
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[bucket(g)] for g in grams(x))
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2 ** 32)))
        rows.append((i, len(lower_words(x)), len(grams(x)), weight, score))
    able = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0]))
    rank = {}
    for k, r in enumerate(able[:percent * len(able) // 100], 1):
        rank.setdefault(r, []).append(k)
    return sorted(((*r, rank[r].pop() if rank.get(r) else None) for r in rows), key=repr)


@pytest.mark.parametrize("n_max, percent", [(1, 10), (3, 60)])
def test_resampling_against_brute_force(spark, sf, docs, odd, n_max, percent):
    target = spark.read.parquet(f"{sf}/benchmark.parquet")
    items = [(r.item_id, r.text) for r in target.collect()]
    table = spark.read.parquet(f"{sf}/documents.parquet")
    for df, rows in ((table, docs), (odd, [(r[0], r[1]) for r in ROWS])):
        got = importance.resample(df, target, max_words=n_max, percent=percent, least_words=5, buckets=997)
        assert got.columns == ["doc_id", "n_words", "n_features", "weight", "score", "rank"]
        assert sorted(map(tuple, got.collect()), key=repr) == brute_resample(rows, items, n_max, 997, 5, percent)


def test_resampling_sql(spark, sf):
    name = NAMES[0]
    df = QUERIES[name](spark, sf)
    assert oracle.compare(df, oracle.connect(sf), ORACLE[name]) == []
    assert {t for _, t in df.dtypes} == {"bigint"}


def test_resampling_empty_tables_and_ties(spark, odd):
    none = odd.limit(0)
    assert importance.resample(none, odd).count() == 0
    assert importance.resample(odd, none).filter("rank is not null").count() == 0  # a tenth of three rows
    same = spark.createDataFrame([(7, "a b c")] * 3 + [(3, "a b c")], "doc_id int, text string")
    got = importance.resample(same, same.limit(0), least_words=3, percent=100).collect()
    assert sorted(r.rank for r in got) == [1, 2, 3, 4] and len({r.score for r in got if r.doc_id == 7}) == 1


def test_ranks_do_not_depend_on_ranges(spark):
    rows = [(i, i % 3 > 0, (i * 7919) % 50) for i in range(500)] + [(9, True, 49)]
    df = spark.createDataFrame(rows, "doc_id bigint, eligible boolean, score bigint")
    want = sorted((r for r in rows if r[1]), key=lambda r: (-r[2], r[0]))[:20 * sum(r[1] for r in rows) // 100]
    for parts in (1, 7, 40):
        got = importance.ranked(df, 20, parts).filter("rank is not null").orderBy("rank").collect()
        assert [(r.doc_id, r.score) for r in got] == [(r[0], r[2]) for r in want]
        assert [r["rank"] for r in got] == list(range(1, len(want) + 1))


@pytest.mark.parametrize("width", [1, 5, 64])
def test_position_crc(width):
    rng = np.random.default_rng(4)
    data = rng.integers(0, 256, 3000, dtype=np.uint8)
    start = np.sort(rng.integers(0, 2000, 400))
    end = start + np.where(np.arange(400) % 7, rng.integers(0, 12, 400), rng.integers(0, 1000, 400))
    got = importance.span_crc(data, start, end, width)
    assert got.tolist() == [zlib.crc32(data[a:b].tobytes()) for a, b in zip(start, end)]


# periodic runs


def brute_runs(w):
    seen = {}
    for q in range(1, len(w) // 3 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(24, 3 * q) and j > i:
                seen.setdefault((i, j + q), q)
            i = j + 1 if j == i else j
    return sorted((a, b, q) for (a, b), q in seen.items())


def brute_row(i, t):
    w = words(t)
    runs = sorted(((a, b - a, q) for a, b, q in brute_runs(w)), key=lambda r: (r[0], r[2]))
    gone = {k for a, n, q in runs for k in range(a + q, a + n)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (i, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2],
            digest("".join(f"{a},{n},{q}\n" for a, n, q in runs)),
            digest(" ".join(x for k, x in enumerate(w) if k not in gone)))


def repeat(i, t):
    h, w = zlib.crc32(str(i).encode()), words(t)
    if h % 10 or not w:
        return t
    g = h // 10
    a = g % len(w)
    p = 1 + (len(w) - a) // (3 + g % 8)
    return " ".join(w[k] if k < a else w[a + (k - a) % p] for k in range(len(w)))


def test_runs_of_documents(spark, sf, docs):
    got = sorted((tuple(r) for r in QUERIES[NAMES[1]](spark, sf).collect()), key=repr)
    assert got == sorted((brute_row(i, repeat(i, t)) for i, t in docs), key=repr)
    assert sum(r[1] for r in got) > 10


def pile(r):
    """Words of a small alphabet, with nested and overlapping repetitions of all exponents."""
    out, size = [], r.randint(1, 400)
    while len(out) < size:
        c = r.random()
        if c < 0.4:
            out += [r.choice("abc") for _ in range(r.randint(1, 20))]
        elif c < 0.9:
            u = [r.choice("ab" if r.random() < 0.5 else "abcdefg") for _ in range(r.randint(1, 40))]
            if r.random() < 0.5:
                u = u[:max(1, len(u) // 4)] * r.randint(1, 6) + u
            out += (u * 6)[:r.randint(len(u), 6 * len(u))]
        else:
            out += out[-r.randint(1, 60):]
    return out


@pytest.mark.parametrize("chunk", [200, 500_000])
def test_runs_against_brute_force(monkeypatch, chunk):
    monkeypatch.setattr(periodic_runs, "CHUNK", chunk)
    r = random.Random(chunk)
    made = [pile(r) for _ in range(400)] + [["x"] * n for n in (23, 24, 25, 300)] + [[]]
    made += [[*"abcdefgh"] * 3, [*"abcdefgh"] * 3 + ["a"], [*"zabcdefg"] + [*"abcdefgh"] * 2]
    found = periodic_runs.text_runs([" ".join(w).encode() for w in made])
    for w, (_, runs) in zip(made, found):
        assert sorted(map(tuple, runs.tolist())) == brute_runs(w)


def test_runs_survive_equal_names(monkeypatch):
    """Names of few bits agree by chance; the words decide."""
    real = periodic_runs.mix
    monkeypatch.setattr(periodic_runs, "mix", lambda x: real(x) & np.uint64(0xFFF))
    r = random.Random(8)
    made = [pile(r) for _ in range(200)]
    for w, (_, runs) in zip(made, periodic_runs.text_runs([" ".join(w).encode() for w in made])):
        assert all(w[a:b - q] == w[a + q:b] for a, b, q in runs.tolist())


def test_runs_of_odd_rows(spark, odd):
    got = {r.doc_id: r for r in periodic_runs.periodic_runs(odd).collect()}
    assert [tuple(x) for x in got[5].runs] == [(1, 12000, 3)] and got[5].collapsed == "word lorem ipsum dolor"
    assert got[1].runs == got[2].runs == got[4].runs == [] and got[1].collapsed == "" and got[3].n_words == 0
    assert got[4].collapsed == "one" and [tuple(x) for x in got[8].runs] == [(0, 90, 3)]
    assert periodic_runs.periodic_runs(odd).count() == len(ROWS) and periodic_runs.periodic_runs(odd.limit(0)).count() == 0
    assert odd.select(planted(F.col("doc_id"), F.col("text")).alias("t")).filter("t is null").count() == 1


def test_strongest_run(spark):
    runs = [(0, 30, 7), (5, 60, 14), (3, 61, 14), (4, 61, 14)]
    df = spark.createDataFrame([(runs,), ([],)], "runs array<struct<start:bigint,length:bigint,period:bigint>>")
    got = [r[0] for r in df.select(periodic_runs.strongest(F.col("runs"))).collect()]
    assert tuple(got[0]) == (3, 61, 14) and got[1] is None


# SentencePiece


@pytest.fixture(scope="module")
def model():
    import public_tokenizers
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    return path, sentencepiece.SentencePieceProcessor(model_file=path)


def strange_texts(pieces, n):
    r = random.Random(3)
    made = [None, "", " ", "  ", "▁", "\x00", "a\x00b", "\n\n", " x ", "的" * 200, " " * 500, "a" * 500, "=" * 333 + "x"]
    for _ in range(n):
        k = r.random()
        if k < 0.3:
            t = "".join(r.choice(pieces) for _ in range(r.randint(0, 80)))
        elif k < 0.5:
            t = "".join(r.choice("ab etnioslr\n  é的") for _ in range(r.randint(0, 200)))
        elif k < 0.65:
            t = "".join(chr(r.choice([r.randint(0, 0x2FF), r.randint(0, 0xD7FF), r.randint(0xE000, 0x10FFFF)]))
                        for _ in range(r.randint(0, 60)))
        elif k < 0.8:
            t = " " * r.randint(0, 90) + r.choice(pieces) * 3 + " " * r.randint(0, 90) + "▁x"
        else:
            t = "".join(r.choice(pieces).strip() for _ in range(r.randint(0, 150)))
        made.append(t)
    return made


def test_pieces_of_strange_texts(model):
    path, library = model
    v = piece_bpe.vocabulary(path)
    texts = strange_texts([p.replace("▁", " ") for p in v.pieces[259:]], 1500)
    want = library.encode([t or "" for t in texts])
    assert piece_bpe.encode_batch(piece_bpe.Memory(v), texts) == want
    assert piece_bpe.encode_batch(piece_bpe.Memory(v, most=50), texts) == want
    for ids in want:
        assert piece_bpe.decode(v, ids) == library.decode(ids)


def test_decoding_any_ids(model):
    path, library = model
    v, r = piece_bpe.vocabulary(path), random.Random(9)
    for _ in range(3000):
        ids = [r.choice([r.randint(0, 31999), r.randint(0, 260), 0xE4 + 3, 0xB8 + 3, 0xAD + 3, 29871, 261])
               for _ in range(r.randint(0, 12))]
        assert piece_bpe.decode(v, ids) == library.decode(ids)


def test_long_words_and_runs_of_spaces(model):
    path, library = model
    v, r = piece_bpe.vocabulary(path), random.Random(2)
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFGH0123456789+/"
    for t in ("ab" * 50_000, " " * 40_000 + "x", "".join(r.choice(letters) for _ in range(60_000)), "的字" * 20_000):
        assert piece_bpe.encode_batch(piece_bpe.Memory(v), [t])[0] == library.encode(t)


def test_pieces_of_documents(spark, sf, docs, odd, model):
    path, library = model
    got = {r.doc_id: r for r in QUERIES[NAMES[2]](spark, sf).collect()}
    assert len(got) == len(docs)
    for i, t in docs:
        ids = library.encode(t or "")
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()
    rows = piece_bpe.tokenized(odd, path).collect()
    want = sorted(((r[0], library.encode(r[1] or "")) for r in ROWS), key=repr)
    assert sorted(((r.doc_id, list(r.ids)) for r in rows), key=repr) == want
    assert {r.decoded for r in rows if r.doc_id in (1, 2)} == {""}
    assert piece_bpe.tokenized(odd.limit(0), path).count() == 0


def test_digest_of_strange_texts(model):
    path, library = model
    texts = strange_texts([p.replace("▁", " ") for p in piece_bpe.vocabulary(path).pieces[259:]], 400)
    rows = piece_bpe.token_text(path).func(pd.Series(texts, dtype=object))
    for t, n, written, decoded in zip(texts, *(rows[c] for c in piece_bpe.DIGEST.names)):
        ids = library.encode(t or "")
        assert (n, written, decoded) == (len(ids), ",".join(map(str, ids)), library.decode(ids))


def test_full_memory_keeps_the_words_of_the_batch(model, monkeypatch):
    """A batch above the bound merges its new words only, not those that were known."""
    v, merge, merged = piece_bpe.vocabulary(model[0]), piece_bpe.merge_rounds, []
    monkeypatch.setattr(piece_bpe, "merge_rounds", lambda v, s, part: merged.append(len(s)) or merge(v, s, part))
    memory = piece_bpe.Memory(v, most=1000)
    first = " ".join(f"word{i}" for i in range(1000))
    want = piece_bpe.encode_batch(piece_bpe.Memory(v), [first, first + " newcomer"])
    merged.clear()
    got = piece_bpe.encode_batch(memory, [first])
    got += piece_bpe.encode_batch(memory, [first + " newcomer"])
    got += piece_bpe.encode_batch(memory, [first])
    assert got == [want[0], want[1], want[0]]
    assert merged[0] > 5000 and sum(merged[1:]) == len("▁newcomer")


def test_other_models_are_refused():
    with pytest.raises(ValueError):
        piece_bpe.Vocabulary(bytes([0x0A, 3, 0x0A, 1, 0x61, 0x12, 2, 0x18, 1, 0x1A, 0]))
