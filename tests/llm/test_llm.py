"""Training-data operators against brute force, on the given tables and on awkward rows."""

import hashlib
import math
import re
import time
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
import oracle
from lingotally import session
from lingotally.llm import (
    blocks, common, decontaminate, gam, mixing, pitman_yor, secrets, simhash, spans_langid, suffix_dedup,
    weak_rules, window_dedup,
)
from lingotally.llm.catalogue import ORACLE, QUERIES

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, size string, kept string, block int"
LONG = "word" + " lorem ipsum dolor" * 4000
ROWS = [
    (1, None, None, None, 0, "x", "y", 1),
    (2, "", "en", "s1", 0, None, None, None),
    (3, " \t\n ", "en", "s1", 4, None, None, None),
    (4, "one", "en", None, 3, None, None, None),
    (5, LONG, "en", "s1", len(LONG), None, None, None),
    (6, LONG, None, "s2", len(LONG), None, None, None),
    (6, LONG, None, "s2", len(LONG), None, None, None),
    (None, "a b c d e f g h i j k l m n o p", "fr", "s2", 31, None, None, None),
    (8, "\U0001e900\U0001e901 émoji \U0001f600 " * 30, "xx", "s3", 10, None, None, None),
    (9, 'password = "Tr0ub4dor&3xyz" and AKIA' + "A1" * 9 + " token:abc", "en", "s3", 10, None, None, None),
]


@pytest.fixture(scope="module")
def spark(spark):
    return session.checkpoints(common.arrow(session.tune(spark)))


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def docs(spark, sf):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_sql(spark, sf, name):
    assert oracle.compare(QUERIES[name](spark, sf), oracle.connect(sf), ORACLE[name]) == []


def brute_windows(rows):
    least = {}
    for i, t in rows:
        w = words(t)
        for k in range(len(w) - 12):
            key = tuple(w[k:k + 13])
            if i is not None:
                least[key] = min(i, least.get(key, i))
    out = []
    for i, t in rows:
        w = words(t)
        gone = set()
        for k in range(len(w) - 12):
            if i is not None and least[tuple(w[k:k + 13])] < i:
                gone.update(range(k, k + 13))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


def test_windows_odd_rows(odd):
    got = window_dedup.dedup(odd, block_bytes=20_000).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got), key=repr) == brute_windows(
        [(r[0], r[1]) for r in ROWS])
    assert all(sum(s.end - s.start for s in r.intervals) == r.n_removed for r in got)


def brute_bytes(rows, n=100):
    first = {}
    for i, t in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        b = (t or "").encode()
        for k in range(len(b) - n + 1):
            first.setdefault(b[k:k + n], (i, k))
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - n + 1):
            if i is not None and first[b[k:k + n]] < (i, k):
                gone[k:k + n] = b"\1" * n
        kept = bytes(c for c, g in zip(b, gone) if not g)
        runs = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((i, len(b), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("block_bytes", [20_000, 200_000])
def test_suffixes(odd, spark, sf, docs, block_bytes):
    def got(df):
        return sorted(((r.doc_id, r.n_bytes, r.n_removed, len(r.spans), r.kept_sha256)
                       for r in suffix_dedup.dedup(df, block_bytes=block_bytes).collect()), key=repr)

    assert got(odd) == brute_bytes([(r[0], r[1]) for r in ROWS])
    assert got(spark.read.parquet(f"{sf}/documents.parquet")) == brute_bytes(docs)


def test_difference_cover():
    cover = suffix_dedup.difference_cover(57, 8)
    assert {(a - b) % 57 for a in cover for b in cover} == set(range(57))


def test_packing_round_trip():
    import numpy as np

    keys = np.unique(np.random.default_rng(1).integers(0, 1 << 63, 1000, dtype=np.uint64))
    assert (blocks.unpack(blocks.pack(keys)) == keys).all()
    assert sum(b - a for _, a, b in blocks.slices(keys, 7)) == len(keys)


def brute_fingerprint(t):
    from xxhash import xxh64_intdigest

    w = [x.translate(str.maketrans(common.UPPER, common.LOWER)) for x in words(t)]
    if not w:
        return 0
    grams = [" ".join(w[i:i + 3]) for i in range(max(1, len(w) - 2))]
    h = [xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_classes(fps):
    distinct = sorted({f for _, f in fps})
    root = {f: f for f in distinct}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(distinct):
        for b in distinct[:i]:
            if (a ^ b).bit_count() <= 3:
                root[find(a)] = find(b)
    least = {}
    for i, f in fps:
        if i is not None:
            least[find(f)] = min(i, least.get(find(f), i))
    return sorted(((i, f"{f:016x}", least.get(find(f))) for i, f in fps), key=repr)


def test_simhash(spark, sf, docs, odd):
    got = sorted((tuple(r) for r in QUERIES["op3_simhash"](spark, sf).collect()), key=repr)
    assert got == brute_classes([(i, brute_fingerprint(t)) for i, t in docs])
    got = simhash.near_duplicates(odd).select("doc_id", simhash.hex16(F.col("fingerprint")), "component_id")
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute_classes(
        [(r[0], brute_fingerprint(r[1])) for r in ROWS])


def test_simhash_links_survive_small_cells(spark):
    import random

    r = random.Random(5)
    fps = set()
    for _ in range(8):
        center = r.getrandbits(64)
        for _ in range(60):
            f = center
            for b in r.sample(range(64), r.randint(0, 5)):
                f ^= 1 << b
            fps.add(f)
    rows = [(i, f - (1 << 64) if f >> 63 else f) for i, f in enumerate(sorted(fps))]
    df = spark.createDataFrame(rows, "doc_id bigint, fingerprint bigint")
    for cell in (7, 4096):
        got = {x.fp % (1 << 64): x.component_id for x in simhash.classes(df, cell).collect()}
        want = {int(f, 16): c for _, f, c in brute_classes([(i, f % (1 << 64)) for i, f in rows])}
        assert got == want


def test_secrets(spark, sf, docs, odd):
    assert secrets.guess_cost("password1990") < 6 < 12 < secrets.guess_cost("xK9$vQ2!mZ7p")
    assert secrets.guess_cost("qwertyuiop") < 5 and secrets.guess_cost("aaaaaaaaaaaa") < 4
    for r in QUERIES["op2_secrets"](spark, sf).collect():
        t = dict(docs)[r.doc_id] or ""
        spans = [(m.start(), 0, m.end()) for m in re.finditer(
            r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t)
            if len(m.group(2)) >= 6]
        n = [len(spans)]
        for k, p, least in ((1, r"AKIA[A-Z0-9]+", 20), (2, r"[0-9a-f]+", 24)):
            own = [(m.start(), k, m.end()) for m in re.finditer(p, t) if m.end() - m.start() >= least]
            spans += own
            n.append(len(own))
        text = ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(spans))
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(n)
        assert r.base_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert set(filter(None, text.split(","))) <= set(r.spans.split(","))
    out = {r.doc_id: r for r in secrets.redact(odd).collect()}
    assert out[9].text == "[secret:assign]&3xyz\" and [secret:access] token:abc"
    assert out[9].n_chars == len(out[9].text) and out[1].text is None and out[5].text == LONG
    found = secrets.find_spans("login: zX8#qL0!vRw2 and secret is required")
    assert [k for k, _, _ in found] == [3]


@pytest.mark.parametrize("text, value", [
    ("DB_PASSWORD=xK9$vQ2!mZ7p", "xK9$vQ2!mZ7p"), ("DB_PASS=xK9vQ2mZ7pLw", "xK9vQ2mZ7pLw"),
    ('SMTP_PWD: "xK9vQ2mZ7pLw"', "xK9vQ2mZ7pLw"), ("Authorization: Bearer xK9vQ2mZ7pLwAA", "xK9vQ2mZ7pLwAA"),
    ('"Authorization": "Bearer xK9vQ2mZ7pLwAA"', "xK9vQ2mZ7pLwAA"), ("pwd = kjhzqwvxbtnmrp", "kjhzqwvxbtnmrp"),
    ("login: 83910472650192", "83910472650192"),
    ("the secret is responsibilities", None), ("token is representation", None), ("compass is kjhzqwvxbtnmrp", None),
    ("bearer shareholders", None), ("pwd = 11111111111111", None)])
def test_credential_contexts(text, value):
    found = [(k, text[a:b]) for k, a, b in secrets.find_spans(text)]
    assert found == ([(3, value)] if value else [])


def test_guess_cost_of_very_long_values():
    began = time.time()
    for value in ("a" * 300_000, "é" * 300_000, "qwertyuiop" * 20_000):
        secrets.guess_cost(value)
    assert time.time() - began < 60
    assert secrets.guess_cost("z" * 100_000) < 8
    assert secrets.guess_cost("") == 0.0


def test_quality_measures(spark, sf, docs):
    text = dict(docs)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    right = 0
    for r in QUERIES["op9_weak_rules"](spark, sf).collect():
        t = text[r.doc_id] or ""
        w = words(t)
        g = Counter(zip(w, w[1:], w[2:]))
        rep = {k for i in range(len(w) - 2) if g[tuple(w[i:i + 3])] > 1 for k in (i, i + 1, i + 2)}
        lines = [x for x in t.split("\n") if words(x)]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (
            len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(rep))
        assert r.base_failed == (len(w) < 50 or 100 * len(rep) > 50 * len(w))
        assert not (r.base_failed and r.kept)
        right += r.doc_id in labels and not r.base_failed and r.kept == bool(labels[r.doc_id])
    assert right >= 0.9 * sum(1 for _ in labels) - 10


def test_quality_odd_rows(odd, spark):
    assert {r.doc_id for r in weak_rules.keep_good(odd).collect()} <= {5, 6, 8}
    assert weak_rules.keep_good(odd.limit(0)).count() == 0


def test_sainte_lague(spark):
    import random

    r = random.Random(3)
    votes = {f"p{i:02d}": r.randint(1, 10_000) for i in range(40)}
    for seats in (0, 1, 39, 1000):
        want = Counter()
        for _ in range(seats):
            want[min(votes, key=lambda k: (-votes[k] / (2 * want[k] + 1), k))] += 1
        df = spark.createDataFrame([(1, k, float(v), seats) for k, v in votes.items()], "g int, k string, v double, s bigint")
        got = {x.k: x.q for x in mixing.sainte_lague(df, ["g"], "v", "s", ["k"], "q").collect()}
        assert got == {k: want[k] for k in votes}


@pytest.mark.parametrize("shard_docs", [7, 20_000])
def test_mixing(spark, sf, shard_docs):
    sizes = mixing.token_sizes(spark.read.parquet(f"{sf}/documents.parquet"))
    rows = mixing.mix(sizes, shard_docs=shard_docs).collect()
    again = mixing.mix(sizes.repartition(5), shard_docs=shard_docs).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))
    size, weight = Counter(), {}
    for r in rows:
        size[r.source] += r.size
        assert 0 <= r.taken <= 2 * r.size
    for i, s in enumerate(sorted(size)):
        weight[s] = (5, 2, 1)[i % 3]
    fixed, total = {}, 1.5 * sum(size.values())
    while True:  # cap and reshare
        rest = {s: weight[s] for s in size if s not in fixed}
        left = total - sum(fixed.values())
        share = {s: left * w / sum(rest.values()) for s, w in rest.items()}
        over = [s for s in share if share[s] > 2 * size[s]]
        if not over:
            break
        fixed |= {s: 2.0 * size[s] for s in over}
    target = fixed | share
    taken = Counter()
    for r in rows:
        assert r.target == pytest.approx(target[r.source]) and r.source_size == size[r.source]
        taken[r.source] += r.taken
    n_shards = max(1, len(rows) // len(size) // shard_docs + 1)
    assert all(abs(taken[s] - target[s]) <= 2 * mixing.BLOCK * n_shards for s in size)


@pytest.mark.parametrize("table", ["given", "odd"])
def test_mixed_texts_hold_the_taken_words(spark, sf, odd, table):
    docs = spark.read.parquet(f"{sf}/documents.parquet") if table == "given" else odd
    mixed = mixing.mix_documents(docs)
    rows = mixed.collect()
    for r in rows:
        w = words(r.text)
        want = w * r.passes + [x for s in r.spans for x in w[s.start:s.end]]
        assert words(r.mixed_text) == want and len(want) == r.taken and (r.mixed_text is None) == (not want)
        assert all(0 <= s.start < s.end <= len(w) for s in r.spans)
    out = mixing.mixture(mixed)
    got = out.collect()
    assert out.columns == [c for c in docs.columns if c not in mixing.MADE]
    assert len(got) == sum(r.taken > 0 for r in rows) and all(r.n_chars == len(r.text) for r in got)
    share, target = Counter(), {}
    for r in got:
        share[r.source] += len(words(r.text))
    for r in rows:
        target[r.source] = r.target
    assert all(abs(share[s] - t) <= 2 * mixing.BLOCK for s, t in target.items())


def test_mixing_cost_grows_with_the_text(spark):
    """Eight times the words in one text: linear work, not one split of the text per span."""
    def seconds(n):
        text = " ".join(f"w{i % 977}" for i in range(n))
        df = spark.createDataFrame([(1, text, "a"), (2, "x " * 10 * n, "b")], "doc_id bigint, text string, source string")
        began = time.time()
        assert mixing.mix_documents(df, share=0.1).count() == 2
        row = mixing.mix_documents(df, share=0.1).filter("doc_id = 1").first()
        assert len(words(row.mixed_text)) == row.taken > 0 and len(row.spans) > n // 40
        return time.time() - began

    seconds(1000)
    small, large = seconds(8000), seconds(64000)
    assert large <= 4 * small + 3


@pytest.mark.parametrize("group_shards", [1, 3])
def test_mixing_through_groups_of_shards(spark, sf, group_shards):
    sizes = mixing.token_sizes(spark.read.parquet(f"{sf}/documents.parquet")).checkpoint()
    rows = mixing.mix(sizes, shard_docs=5, group_shards=group_shards).collect()
    taken, target = Counter(), {}
    for r in rows:
        taken[r.source] += r.taken
        target[r.source] = r.target
        assert 0 <= r.taken <= 2 * r.size
    n_shards = Counter(r.source for r in rows)
    assert all(abs(taken[s] - target[s]) <= 2 * mixing.BLOCK * (n_shards[s] // 5 + 2) for s in target)


def test_mixing_odd_rows(odd):
    out = mixing.mix_documents(odd).collect()
    assert len(out) == len(ROWS) and all(0 <= r.taken <= 2 * r.size for r in out)
    assert mixing.mix_documents(odd.limit(0)).count() == 0


def test_decontamination_odd_rows(odd, spark):
    items = spark.createDataFrame(
        [(1, "Lorem ipsum dolor LOREM ipsum dolor lorem ipsum dolor lorem"), (2, None), (3, ""), (4, "one"),
         (4, "one"), (5, "never seen words here at all my good old friend of mine")], "item_id int, text string")
    got = {r.doc_id: r for r in decontaminate.hits(odd, items).collect()}
    # the first word and the two after the last whole window are outside
    assert got[5].n_hit == got[5].n_words - 3 and list(got[5].hit_items) == ["1"]
    assert (got[4].n_hit, list(got[4].hit_items)) == (1, ["4"]) and got[1].n_words == 0 and got[2].n_hit == 0
    left = decontaminate.clean(odd, items)
    assert left.columns == odd.columns and sorted(r.doc_id for r in left.collect() if r.doc_id) == [1, 2, 3, 8, 9]
    assert decontaminate.hits(odd, items.limit(0)).filter("n_hit > 0").count() == 0
    assert decontaminate.hits(odd.limit(0), items).count() == 0


def test_proximity(spark):
    d = spark.createDataFrame([(1, "the quick brown lazy fox jumps over"), (2, "quick " + "x " * 40 + "fox brown")],
                              "doc_id bigint, text string")
    items = spark.createDataFrame([(1, "quick brown fox")], "item_id int, text string")
    wins = decontaminate.windows(items).checkpoint()
    picked = decontaminate.probes(wins, decontaminate.term_counts(d, wins)).checkpoint()
    index = decontaminate.postings(d, picked)
    assert decontaminate.intersect(index, picked).count() == 0
    assert [r.doc for r in decontaminate.proximity(index, picked, slop=2).collect()] == [1]


def test_language_spans(spark, sf):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = QUERIES["op1_span_langid"](spark, sf).collect()
    held = [r for r in rows if r.held_out]
    assert {r.doc_id for r in held} == {i for i in truth if zlib.crc32(str(i).encode()) % 3 == 1}
    assert sum(truth[r.doc_id] == r.lang_pred for r in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_spans_mixed(spark):
    train = [("en", "the house is big and the dog was there with them " * 20),
             ("ru", "это большой дом и собака была там вместе с ними " * 20),
             ("de", "das haus ist groß und der hund war dort mit ihnen " * 20)]
    model = spans_langid.train(spark.createDataFrame(train, "lang string, text string"))
    text = "the dog was there with them и собака была там das haus ist groß und der hund 12 İ"
    df = spark.createDataFrame([(text,), ("中文 only",), (None,), ("123 !",)], "text string")
    spans = [r[0] for r in df.select(spans_langid.spanner(model)("text")).collect()]
    assert [(text[s.start:s.end].split()[0], s.lang) for s in spans[0]] == [("the", "en"), ("и", "ru"), ("das", "de")]
    assert spans[1][0].lang == "und" and spans[2] == spans[3] == []
    got = [tuple(r[0]) for r in df.select(spans_langid.detector(model)("text")).collect()]
    assert got[2] == got[3] == ("und", 0.0) and got[1][0] in ("en", "ru", "de")
    none = spans_langid.train(spark.createDataFrame([], "lang string, text string"))
    assert df.select(spans_langid.detector(none)("text").alias("p")).filter("p.lang <> 'und'").count() == 0


def test_a_text_in_a_script_nobody_taught_has_a_language(spark):
    train = [("en", "the house is big and the dog was there " * 9), ("fr", "la maison est grande et le chien y est " * 9)]
    model = spans_langid.train(spark.createDataFrame(train, "lang string, text string"))
    texts = [None, "", "12 !", "большой дом", "\U00030001\U00031000", "the dog", "большой the dog was there", "x" * 3]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    got = {r.i: r.p for r in df.select("i", spans_langid.detector(model)("text").alias("p")).collect()}
    assert [got[i].lang for i in (0, 1, 2)] == ["und"] * 3 and all(got[i].lang in ("en", "fr") for i in (3, 4, 7))
    assert got[5].lang == got[6].lang == "en" and all(0 <= got[i].score <= 1 for i in got) and got[3].score > 0


def test_viterbi_brute_force():
    import itertools

    import numpy as np

    rng = np.random.default_rng(2)
    scores, owner = rng.normal(size=(11, 3)) * 3, np.repeat([0, 2, 3], [6, 1, 4])
    got = spans_langid._viterbi(scores.astype(np.float32), owner, 5, 2.0)
    for o in (0, 2, 3):
        own = scores[owner == o]
        value = lambda p: sum(own[i, x] for i, x in enumerate(p)) - 2.0 * sum(a != b for a, b in zip(p, p[1:]))  # noqa: E731, B023
        assert tuple(got[owner == o]) == max(itertools.product(range(3), repeat=len(own)), key=value)


def test_gam(spark, sf):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = QUERIES["op8_gam_quality"](spark, sf).collect()
    held = [r for r in rows if r.held_out and r.doc_id in labels]
    assert sum(r.predicted == labels[r.doc_id] for r in held) >= 0.85 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)


def test_gam_pairs_and_empty():
    import numpy as np

    rng = np.random.default_rng(0)
    x = rng.random((3000, len(gam.FEATURES)))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)  # no single feature tells
    m = gam.fit_rows(x, y)
    assert ((m.score(x) > 0.5) == (y > 0.5)).mean() > 0.9
    assert gam.Model().score(gam.featurize([None, "", "a b"])).tolist() == [0.5] * 3


def test_pitman_yor(spark, sf, docs):
    text = {i: (t or "").encode().lower().split() + [None] for i, t in docs}
    c = Counter(w for i, t in text.items() if zlib.crc32(str(i).encode()) % 7 != 2 for w in t)
    n, v = sum(c.values()), len(c)
    rows = QUERIES["op4_pitman_yor"](spark, sf).collect()
    assert len(rows) == len(text)
    for r in rows:
        t = text[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(t), sum(c[w] > 0 for w in t), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t))
    held = [r for r in rows if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_pitman_yor_normalises(spark):
    train = [(i, t) for i, t in enumerate(["a b a b c", "a b b c a", "c c a", "b"] * 5)]
    vocabulary = ["a", "b", "c", "", "zzz"]
    # chances of every word after "a", the end and one unknown word add up to one
    tests = [(100 + i, f"a {w}".strip()) for i, w in enumerate(vocabulary)]
    df = spark.createDataFrame(train + tests, "doc_id bigint, text string")
    got = {r.doc_id: r.score for r in pitman_yor.model_scores(df, F.col("doc_id") < 100, block_bytes=20).collect()}
    more = spark.createDataFrame(train + [(200, "a"), (201, "a a"), (202, "a b"), (203, "a c"), (204, "a zzz")],
                                 "doc_id bigint, text string")
    rows = {r.doc_id: r for r in pitman_yor.model_scores(more, F.col("doc_id") < 100, block_bytes=1 << 20).collect()}
    assert got[103] == pytest.approx(rows[200].score, abs=0.3) and all(x < 0 for x in got.values())
    assert rows[204].n_known == 2 and rows[200].train_tokens == 5 * (6 + 6 + 4 + 2)


def test_pitman_yor_scores_do_not_depend_on_cells(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet")
    held = common.remainder(F.col("doc_id"), 7) == 2

    def per_token(block_bytes):
        rows = pitman_yor.model_scores(d, ~held, block_bytes=block_bytes).withColumn("h", held).collect()
        return [sum(r.score for r in rows if r.h == h) / sum(r.n_tokens for r in rows if r.h == h) for h in (0, 1)]

    assert per_token(4_000) == pytest.approx(per_token(1 << 30), abs=0.03)


def test_odd_rows_everywhere(spark, odd):
    empty = odd.limit(0)
    assert pitman_yor.model_scores(odd, F.lit(True)).count() == len(ROWS)
    for op in (lambda d: pitman_yor.model_scores(d, F.lit(True)), window_dedup.dedup, suffix_dedup.dedup,
               simhash.near_duplicates, secrets.scan, simhash.one_per_class,
               lambda d: d.select(gam.features("text"))):
        assert op(empty).count() == 0


def test_pipeline(spark, sf, docs):
    assert [f.__name__ for _, f in corpus_pipeline.STAGES] == [
        "quality_rules", "near_dedup", "decontamination", "secret_scans", "mixing_sources"]
    out = corpus_pipeline.run(spark, sf).collect()
    text = dict(docs)
    kept = {r.doc_id for r in QUERIES["op9_weak_rules"](spark, sf).collect() if r.kept}
    fps = brute_classes([(i, brute_fingerprint(text[i])) for i in sorted(kept)])
    first = {i for i, _, c in fps if i == c}
    leaked = {r.doc_id for r in QUERIES["op10_decontaminate"](spark, sf).collect() if r.contaminated}
    assert {r.doc_id for r in out} == first - leaked and len(out) == len(first - leaked)
    for r in out:
        spans = secrets.find_spans(text[r.doc_id])
        assert (r.text == text[r.doc_id]) == (not spans) and r.n_chars == len(r.text)
        assert r.size == len(words(r.text)) and 0 <= r.taken <= 2 * r.size


def test_pipeline_stages_take_odd_rows(spark, sf, odd):
    for name, stage in corpus_pipeline.STAGES[:4]:
        assert stage(spark, odd, sf).columns == odd.columns, name
        assert stage(spark, odd.limit(0), sf).count() == 0, name
    name, last = corpus_pipeline.STAGES[4]
    assert set(odd.columns) <= set(last(spark, odd, sf).columns) and last(spark, odd, sf).count() == len(ROWS), name
    assert last(spark, odd.limit(0), sf).count() == 0, name
    near = corpus_pipeline.near_dedup(spark, odd, sf)
    assert sorted((r.doc_id for r in near.collect()), key=repr) == sorted([1, 4, 5, 8, 9, None], key=repr)
