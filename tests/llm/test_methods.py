"""Label model, proximity search, block repeats and working names against plain computations."""

import math
import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from lingotally import session
from lingotally.llm import blocks, common, decontaminate, secrets, simhash, suffix_dedup, weak_rules, window_dedup
from lingotally.llm.catalogue import QUERIES

Q = weak_rules.P


@pytest.fixture(scope="module")
def spark(spark):
    return session.checkpoints(common.arrow(session.tune(spark)))


def voted(spark, rows, names):
    cols = [f"{Q}v_{n}" for n in names]
    df = spark.createDataFrame([(100, 0, *r) for r in rows], ", ".join(
        [f"{Q}n_words bigint", f"{Q}n_repeat_words bigint", *[f"{c} int" for c in cols]]))
    return df.repartition(4)


def chance(row, share, acc):
    x = math.log(share / (1 - share))
    for v, (g, b) in zip(row, acc):
        x += math.log(g / (1 - b)) if v == 1 else math.log((1 - g) / b) if v == -1 else 0.0
    return 1 / (1 + math.exp(-x))


def brute_em(rows, rules, rounds):
    share, w = weak_rules.PRIOR[0], weak_rules.WEIGHT
    acc = [weak_rules.PRIOR[1:] for _ in range(rules)]
    for _ in range(rounds):
        p = [chance(r, share, acc) for r in rows]
        share = (sum(p) + weak_rules.PRIOR[0] * w) / (len(rows) + w)
        acc = []
        for k in range(rules):
            good = [(q, r[k]) for q, r in zip(p, rows) if r[k]]
            acc.append(((sum(q for q, v in good if v == 1) + weak_rules.PRIOR[1] * w) / (sum(q for q, _ in good) + w),
                        (sum(1 - q for q, v in good if v == -1) + weak_rules.PRIOR[2] * w)
                        / (sum(1 - q for q, _ in good) + w)))
    return share, acc


def noisy_votes(n=3000, seed=5):
    r = random.Random(seed)
    rows, truth = [], []
    for _ in range(n):
        good = r.random() < 0.85
        row = [(1 if r.random() < 0.95 else -1) if good else (-1 if r.random() < 0.8 else 1) for _ in range(4)]
        row = [v if r.random() < 0.9 else 0 for v in row]
        row.append(-1 if r.random() < 0.3 else 1)  # a junk rule: cries at random
        rows.append(tuple(row))
        truth.append(good)
    return rows, truth


def test_label_model_equals_brute_force(spark):
    rows, _ = noisy_votes(400)
    share, acc = brute_em(rows, 5, 4)
    model = weak_rules.fit(voted(spark, rows, "abcde"), rounds=4)
    assert model["share"] == pytest.approx(share)
    for k, want in zip("abcde", acc):
        assert model["rules"][k] == pytest.approx(want)


def test_estimated_accuracies_outvote_a_junk_rule(spark):
    rows, truth = noisy_votes()
    df = voted(spark, rows, "abcde")
    model = weak_rules.fit(df)
    assert 0.6 < model["rules"]["e"][0] < 0.8 < 0.9 < min(model["rules"][k][0] for k in "abcd")
    judged = weak_rules.judge(df, model)
    alone = judged.filter(" and ".join(f"{Q}v_{k} = 1" for k in "abcd") + f" and {Q}v_e = -1")
    assert alone.count() > 100 and alone.filter(f"not {Q}kept").count() == 0
    share, acc = model["share"], [model["rules"][k] for k in "abcde"]
    right = sum((chance(r, share, acc) >= weak_rules.KEEP) == t for r, t in zip(rows, truth))
    strict = sum((-1 not in r) == t for r, t in zip(rows, truth))
    assert right > 0.93 * len(rows) > strict


def test_label_model_without_rows(spark):
    df = voted(spark, [], "ab")
    assert weak_rules.fit(df)["rules"]["a"] == pytest.approx(weak_rules.PRIOR[1:])
    short = df.union(spark.createDataFrame([(3, 0, -1, -1)], df.schema))  # fails the base rules: teaches nothing
    assert weak_rules.fit(short) == weak_rules.fit(df)


def test_kept_is_more_than_no_bad_vote(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    v = weak_rules.votes(weak_rules.measures(docs)).drop("text").checkpoint()
    judged = weak_rules.judge(v, weak_rules.fit(v)).filter(f"not {Q}base_failed")
    bad = [c for c in v.columns if c.startswith(f"{Q}v_")]
    cried = F.greatest(*[(F.col(c) == -1).cast("int") for c in bad]) == 1
    assert judged.filter(cried & F.col(f"{Q}kept")).count() > 0
    kept = {r.doc_id: r.kept for r in QUERIES["op9_weak_rules"](spark, sf).collect() if not r.base_failed}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if r.doc_id in kept}
    assert sum(kept[i] == bool(q) for i, q in labels.items()) >= 0.98 * len(labels)


def words(text):
    return [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(
        {c: c + 32 for c in range(65, 91)})) if w]


def brute_near(docs, items, n, rarest, slop, share, missing):
    counts, held = {}, [(i, words(t)) for i, t in docs]
    for _, w in held:
        for x in w:
            counts[x] = counts.get(x, 0) + 1
    windows = {}
    for i, t in items:
        w = words(t)
        for a in range(len(w) - n + 1):
            windows.setdefault(tuple(w[a:a + n]), set()).add(str(i))
    out = set()
    for win, own in windows.items():
        occur = [(j, x) for j, x in enumerate(win) if counts.get(x)]
        if len(occur) < share * n:
            continue
        seen, ranked = {}, []
        for j, x in occur:
            seen[x] = seen.get(x, 0) + 1
            ranked.append((seen[x], counts[x], x, j))
        picked = [(x, j) for _, _, x, j in sorted(ranked)[:rarest]]
        for i, w in held:
            def near(x, place):
                return x in w[max(place - slop, 0):max(place + slop + 1, 0)]
            for s in {p - j for p, x in enumerate(w) for y, j in picked[:missing + 1] if x == y}:
                got = sum(near(x, s + j) for j, x in enumerate(win))
                if sum(near(x, s + j) for x, j in picked) >= max(len(picked) - missing, 1) and got >= share * n:
                    out.add((i, s, got, win, tuple(sorted(own))))
    return sorted((i, s, got, own) for i, s, got, _, own in out)


def test_near_hits_equal_brute_force(spark):
    r = random.Random(11)
    vocabulary = [f"w{i}" for i in range(60)]
    items = [(k, " ".join(r.choices(vocabulary, k=25))) for k in range(4)] + [(9, "w1 w2 w3"), (10, None), (11, "")]
    docs = [(1, None), (2, "")]
    for i in range(3, 43):
        w = r.choices(vocabulary, k=80)
        part = words(items[i % 4][1])[5:5 + 15]
        if i % 3 == 0:
            part[7] = f"unseen{i}"  # one word replaced
        if i % 3 == 1:
            part[4:4] = ["filler"] * 2  # words moved apart
        docs.append((i, " ".join(w[:40] + part + w[40:])))
    items.append((12, " ".join(words(items[0][1])[5:11] + ["nowhere"] + words(items[0][1])[12:18])))
    d = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3)
    b = spark.createDataFrame(items, "item_id int, text string")
    got = decontaminate.near_hits(d, b)
    assert got.columns == ["doc_id", "start", "end", "n_near", "items"]
    rows = sorted((x.doc_id, x.start, x.n_near, tuple(x["items"])) for x in got.collect())
    assert rows == brute_near(docs, items, 10, 3, 5, 0.8, 1)
    assert {x[0] for x in rows} == set(range(3, 43)) and any("12" in x[3] for x in rows)
    strict = decontaminate.near_hits(d, b, missing=0)
    assert sorted((x.doc_id, x.start, x.n_near, tuple(x["items"])) for x in strict.collect()) == brute_near(
        docs, items, 10, 3, 5, 0.8, 0)
    null = spark.createDataFrame([(None, docs[5][1]), (None, "else")], d.schema)
    assert decontaminate.near_hits(null, b).filter("doc_id is null").count() > 0
    assert decontaminate.near_hits(d.limit(0), b).count() == decontaminate.near_hits(d, b.limit(0)).count() == 0


def test_phrase_spans(spark):
    item = " ".join(f"t{i}" for i in range(12))
    d = spark.createDataFrame([(1, f"a b {item} c {item}"), (2, "none"), (3, None)], "doc_id bigint, text string")
    b = spark.createDataFrame([(7, item), (8, "none")], "item_id int, text string")
    got = {r.doc_id: [(s.start, s.end, list(s["items"])) for s in r.spans] for r in decontaminate.hits(d, b).collect()}
    assert got == {1: [(s, s + 10, ["7"]) for s in (2, 3, 4, 15, 16, 17)], 2: [(0, 1, ["8"])], 3: []}


def test_block_repeats_cost_their_base():
    once, twice = secrets.guess_cost("kX9!aB3$"), secrets.guess_cost("kX9!aB3$" * 2)
    assert twice == pytest.approx(once + math.log10(2) + secrets.SEGMENT_COST)
    assert secrets.guess_cost("kX9!aB3$" * 40) == pytest.approx(once + math.log10(40) + secrets.SEGMENT_COST)
    assert secrets.guess_cost("xK9$vQ2!mZ7p") > 15 and secrets.find_spans("pwd = q7Zq7Zq7Z") == []
    r = random.Random(2)
    for _ in range(200):
        block = "".join(r.choices("ab1$", k=r.randint(1, 5)))
        value = "".join(r.choices("ab1$", k=3)) + block * r.randint(1, 5)
        want = {(i, k, n) for i in range(len(value)) for k in range(2, len(value) // 2 + 1)
                for n in [1 + next(m for m in range(len(value) + 1) if value[i + (m + 1) * k:i + (m + 2) * k] != value[i:i + k])]
                if n > 1 and not any(k % s == 0 and value[i:i + s] * (k // s) == value[i:i + k] for s in range(1, k))}
        assert set(secrets._blocks(value)) == want


def test_working_names_leave_columns_alone(spark, sf):
    text = "pwd = xK9$vQ2!mZ7p and words " + " ".join(f"v{i}" for i in range(60))
    names = ["_spans", "_new", "_w_row", "_dc_hits", "_row", "_hits", "_doc", "__doc"]
    d = spark.createDataFrame([(1, text, *names), (2, "other", *names)], ", ".join(
        ["doc_id bigint", "text string", *[f"{n} string" for n in names]]))
    items = spark.createDataFrame([(1, "not there at all")], "item_id int, text string")
    for out in (secrets.redact(d), simhash.one_per_class(d), decontaminate.clean(d, items)):
        assert out.columns == d.columns
        assert [tuple(r[n] for n in names) for r in out.collect()] == [tuple(names)] * 2


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(600)], "u bigint, v bigint").repartition(5)
    assert {(r.node, r.root) for r in simhash.components(edges).collect()} == {(i, 0) for i in range(1, 601)}


def test_keys_of_fingerprints_do_not_pass_the_driver(spark):
    fps = spark.range(2000).select(F.xxhash64("id").alias("fp"))
    nodes = fps.union(fps.select(F.col("fp").bitwiseXOR(F.lit(1)))).checkpoint(eager=True)
    found = simhash.links(nodes.repartition(4, "fp"))
    assert found.count() == 2000
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "isFinalPlan=true" in plan and "SortMergeJoin" in plan and "Broadcast" not in plan


def test_near_dedup_stage_does_not_broadcast_keys(spark, sf, monkeypatch):
    import corpus_pipeline

    kept, real = [], simhash.links
    monkeypatch.setattr(simhash, "links", lambda *args: kept.append(real(*args)) or kept[-1])
    corpus_pipeline.near_dedup(spark, spark.read.parquet(f"{sf}/documents.parquet"), sf).count()
    kept[0].collect()
    plan = kept[0]._jdf.queryExecution().executedPlan().toString()
    assert "isFinalPlan=true" in plan and "SortMergeJoin" in plan and "Broadcast" not in plan


def test_places_of_keys():
    r = np.random.default_rng(4)
    for n, top in ((0, 9), (1, 9), (500, 9), (5000, 1 << 62)):
        keys = r.integers(0, top, n, dtype=np.uint64)
        for got, want in zip(window_dedup.places(keys), np.unique(keys, return_index=True, return_inverse=True)):
            assert got.tolist() == want.tolist()
        assert blocks.distinct(keys).tolist() == np.unique(keys).tolist()


def test_owners_cost_a_plain_sort():
    """A stable sort of the keys took seven times a plain one."""
    def least(f):
        took = []
        for _ in range(7):
            began = time.process_time()
            f()
            took.append(time.process_time() - began)
        return min(took)

    keys = np.random.default_rng(1).integers(0, 1 << 63, 1_000_000, dtype=np.uint64)
    owner = np.arange(len(keys))
    assert least(lambda: window_dedup.least_owner(keys, owner)) < 4.5 * least(lambda: np.argsort(keys))


def test_repeats_inside_rows_of_one_id(spark):
    """Rows that share an id cost each other nothing, but each of them its own repeats; a later id loses them all."""
    r = random.Random(6)
    a, b, c = ("".join(r.choice("abcdefgh ") for _ in range(150)) for _ in range(3))
    rows = [(5, a + b + a), (5, b + a + c + b), (5, a * 3), (7, c + a), (9, b + b + "x"), (None, a + a), (None, a)]
    length = suffix_dedup.LENGTH
    want = []
    for k, (i, t) in enumerate(rows):
        gone = set()
        for p in range(len(t) - length + 1 if i is not None else 0):
            s = t[p:p + length]
            if t.find(s) < p or any(s in u for j, u in rows if j is not None and j < i):
                gone.update(range(p, p + length))
        want.append((i, len(t), len(gone), "".join(x for p, x in enumerate(t) if p not in gone)))
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    for size in (100, 1 << 20):
        got = [(x.doc_id, x.n_bytes, x.n_removed, x.kept.decode()) for x in suffix_dedup.dedup(df, block_bytes=size).collect()]
        assert sorted(got, key=repr) == sorted(want, key=repr)
