"""Operators on small fixtures, against brute force where SQL is not the natural check."""

import random
import time
import sys

import pandas as pd
import pytest
from pyspark import cloudpickle
from pyspark.sql import Row, functions as F

from lingotally import refdata as R
from lingotally.functions import net
from lingotally.plans.classify import classify
from lingotally.operators import (
    calibration, filters, geo, infer, intervals, langid, literals, lookups, manifest, review, rollups, rules, running,
    segments as G, sizes,
)

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


TURNS = [("d", 0, 0, 4500, "S0"), ("d", 1, 4500, 8000, "S1")]
TURN_SCHEMA = "doc_id string, turn_idx int, start_ms bigint, end_ms bigint, speaker_id string"
SEG_SCHEMA = "doc_id string, seg_idx int, start_ms bigint, end_ms bigint, text string"


def test_last_language_of_failed_sessions(spark):
    df = spark.createDataFrame([(1, 0, "de"), (1, 1, None), (2, 0, None)], "s int, chunk_idx int, language string")
    assert rows(running.last_language(df, ["s"]), "s", "last_language") == [(1, "de"), (2, "—")]


def test_attach_speaker_cases(spark):
    segs = spark.createDataFrame(
        [("d", 0, 0, 5000, "a"), ("d", 1, 5000, 7500, "b"), ("d", 2, 100000, 101000, "c"),
         ("d", 3, 8000, 9000, "touching"), ("d", 4, 4000, 5000, "tie"), ("d", 5, 10, 10, "empty")],
        SEG_SCHEMA)
    got = rows(intervals.attach_speaker(segs, spark.createDataFrame(TURNS, TURN_SCHEMA)),
               "seg_idx", "speaker_id", "text")
    assert got == [(0, "S0", "a"), (1, "S1", "b"), (2, "UNKNOWN", "c"), (3, "UNKNOWN", "touching"),
                   (4, "S0", "tie"), (5, "UNKNOWN", "empty")]


@pytest.mark.parametrize("width", [7, 1000, 10**6])
def test_attach_speaker_against_brute_force(spark, width):
    rnd = random.Random(width)
    def spans(n):
        out = []
        for i in range(n):
            s = rnd.randrange(3000)
            out.append(("hot" if rnd.random() < 0.7 else f"d{rnd.randrange(4)}", i, s, s + rnd.randrange(0, 90)))
        return out
    segs, turns = spans(150), spans(120)
    want = []
    for d, i, s, e in segs:
        best = None
        for td, ti, ts, te in turns:
            o = min(e, te) - max(s, ts)
            if td == d and o > 0 and (best is None or o > best[0]):
                best = (o, f"S{ti % 5}")
        want.append((d, i, best[1] if best else "UNKNOWN"))
    sdf = spark.createDataFrame([(*x, "t") for x in segs], SEG_SCHEMA)
    tdf = spark.createDataFrame([(*x, f"S{x[1] % 5}") for x in turns], TURN_SCHEMA)
    got = rows(intervals.attach_speaker(sdf, tdf, width=width), "doc_id", "seg_idx", "speaker_id")
    assert got == sorted(want)
    swept = intervals.attach_speaker(sdf, tdf, width=width, crowd=0)
    assert rows(swept, "doc_id", "seg_idx", "speaker_id") == sorted(want)
    talk = {(r.doc_id, r.speaker_id): r.talk_ms for r in intervals.talk_time(sdf, tdf).collect()}
    brute = {}
    for d, i, s, e in segs:
        for td, ti, ts, te in turns:
            o = min(e, te) - max(s, ts)
            if td == d and o > 0:
                brute[(d, f"S{ti % 5}")] = brute.get((d, f"S{ti % 5}"), 0) + o
    assert talk == brute


def test_long_and_extreme_intervals(spark):
    """Any length joins; copies of a row stay few, and no time value ends the job."""
    day, far = 86_400_000, 10**14
    segs = [("d", 0, 0, 5000, "a"), ("d", 1, 3 * day, 3 * day + 10, "b"), ("d", 2, 0, far, "c"),
            ("d", 3, -2**62, 2**62, "d"), ("e", 0, 5, 9, "e"), ("d", 4, -50, -20, "f"), ("d", 5, far - 9, far + 9, "g")]
    turns = [("d", 0, 0, 2 * day, "S0"), ("d", 1, 2 * day, far, "S1"), ("d", 2, 4000, 4100, "S2"), ("d", 3, -30, 0, "S3")]
    want = []
    for d, i, s, e, _ in segs:
        over = [(min(e, te) - max(s, ts), -ti, n) for td, ti, ts, te, n in turns if td == d and min(e, te) > max(s, ts)]
        want.append((d, i, max(over)[2] if over else "UNKNOWN"))
    sdf, tdf = spark.createDataFrame(segs, SEG_SCHEMA), spark.createDataFrame(turns, TURN_SCHEMA)
    for crowd in (intervals.CROWD, 0):
        assert rows(intervals.attach_speaker(sdf, tdf, crowd=crowd), "doc_id", "seg_idx", "speaker_id") == sorted(want)
    pairs = intervals.overlaps(sdf.select("doc_id", "seg_idx", "start_ms", "end_ms"), tdf)
    found = [(r.seg_idx, r.turn_idx) for r in pairs.collect()]
    assert sorted(found) == sorted(
        (i, ti) for d, i, s, e, _ in segs for td, ti, ts, te, _ in turns if td == d and min(e, te) > max(s, ts))


def test_sweep_against_brute_force():
    rnd = random.Random(5)
    for _ in range(300):
        high = rnd.choice([6, 40, 1000])
        turns = []
        for i in rnd.sample(range(1000), rnd.randint(0, 25)):
            a = rnd.randrange(high)
            turns.append((a, a + rnd.randint(1, high), i))
        spans = [(a, a + rnd.randint(1, high)) for a in (rnd.randrange(high) for _ in range(25))]
        for (s, e), got in zip(spans, intervals.best_turns(spans, turns)):
            all_of = [(min(e, te) - max(s, ts), -i) for ts, te, i in turns if min(e, te) > max(s, ts)]
            assert got == ((max(all_of)[0], -max(all_of)[1]) if all_of else None)


def test_a_crowded_minute_costs_n_log_n(spark):
    """10^5 turns and as many segments of one document inside one minute."""
    n = 100_000
    r = F.col("id")
    spans = spark.range(n).select(
        F.lit("d").alias("doc_id"), r.cast("int").alias("n"), F.pmod(F.xxhash64(r), F.lit(60_000)).alias("start_ms"),
        (F.pmod(F.xxhash64(r), F.lit(60_000)) + 1 + F.pmod(F.xxhash64(r, F.lit(1)), F.lit(700))).alias("end_ms"))
    turns = spans.withColumnRenamed("n", "turn_idx").withColumn("speaker_id", F.concat(F.lit("S"), F.col("turn_idx") % 97))
    segs = spark.range(n).select(
        F.lit("d").alias("doc_id"), r.cast("int").alias("seg_idx"), F.pmod(F.xxhash64(r, F.lit(2)), F.lit(60_000)).alias("start_ms"),
        (F.pmod(F.xxhash64(r, F.lit(2)), F.lit(60_000)) + 1 + F.pmod(F.xxhash64(r, F.lit(3)), F.lit(700))).alias("end_ms"),
        F.lit("t").alias("text"))
    began = time.time()
    got = {x.seg_idx: x for x in intervals.attach_speaker(segs, turns).collect()}
    assert len(got) == n and time.time() - began < 120
    table = [tuple(x) for x in turns.select("start_ms", "end_ms", "turn_idx", "speaker_id").collect()]
    for i in range(0, n, 2003):
        s, e = got[i].start_ms, got[i].end_ms
        want = max(((min(e, te) - max(s, ts), -k, who) for ts, te, k, who in table if min(e, te) > max(s, ts)), default=None)
        assert got[i].speaker_id == (want[2] if want else "UNKNOWN")


@pytest.mark.parametrize("pattern, want", [
    ("abc", ["abc"]), ("ab", []), ("ABCd+ef", ["abc"]), ("x?needle[0-9]{2}", ["needle"]), ("(?:foo)bar", ["foobar"]),
    ("(?:first|second)x", ["first", "second"]), ("(?:first|b)x", []), ("(abc)*", []), ("(abcd)+e", ["abcd"]),
    (r"\bword\b", ["word"]), (r"\p{L}+abc", []), ("(?x) a b c d", []), ("[a]bc", ["abc"]), ("a.b", []),
    ("(?i)HeLLo", ["hello"]), ("(?iu)kelvin", []), ("(", []), ("(?:abc|abcd)?longer", ["longer"]), ("abc{0,3}defg", ["defg"])])
def test_required_literals(pattern, want):
    assert literals.required(pattern) == want


def many_rules(n):
    """Rules with literals of their own; a few have none, some have several strings, one in three ignores case."""
    out = []
    for i in range(n):
        name = f"rule{i // 2:05d}"
        pattern = f"tok{i:05d}[0-9]+" if i % 50 else f"[q-z]{{2}}{i % 10}+y"
        out.append({"rule": name, "string_id": f"s{i}", "pattern": pattern, "nocase": i % 3 == 0, "severity": "low",
                    "literal": f"tok{i:05d}" if i % 4 == 0 and i % 50 else ""})
    return out


def test_candidates_change_no_hit(spark, monkeypatch):
    r = random.Random(2)
    table = many_rules(300)
    texts = [(k, " ".join(r.choice([f"tok{r.randrange(320):05d}{r.randrange(50)}", f"TOK{r.randrange(320):05d}7",
                                    f"zz{r.randrange(10)}y", "é", "plain"]) for _ in range(30)), None if k % 5 else "tok000017 ")
             for k in range(60)] + [(99, None, " ")]
    df = spark.createDataFrame(texts, "id int, src string, tr string").repartition(3)
    keyed = {"translation": "tr", "source": "src"}

    def run():
        hits = rules.rule_hits(df, keyed, ["id"], table).collect()
        counts = rules.rule_counts(df, keyed, ["id"], table).collect()
        return sorted(map(repr, hits)), sorted(map(repr, counts))

    few = run()
    monkeypatch.setattr(rules, "FEW", 0)
    picked = run()
    assert few == picked and len(few[0]) > 100


def test_ten_thousand_rules_cost_little_more_than_a_hundred(spark):
    r = random.Random(3)
    texts = [(k, " ".join(r.choice(["plain", "words", "of", f"tok{r.randrange(100):05d}{k}"]) for _ in range(300)))
             for k in range(2000)]
    df = spark.createDataFrame(texts, "id int, src string").repartition(8).persist()

    def seconds(n):
        table = [x for x in many_rules(n) if x["pattern"].startswith("tok")]
        best = None
        for _ in range(3):
            began = time.time()
            rules.rule_counts(df, {"source": "src"}, ["id"], table).write.format("noop").mode("overwrite").save()
            took = time.time() - began
            best = took if best is None else min(best, took)
        return best

    df.count()
    small, large = seconds(100), seconds(10_000)
    df.unpersist()
    assert large <= 2 * small + 1.0


def test_pooling_against_the_minmax_form():
    """Isotonic means are the largest over starts of the smallest over ends of plain means."""
    r = random.Random(1)
    for _ in range(200):
        counts = [(n, r.randint(0, n)) for n in (r.choice([0, 0, 1, 5, 100]) for _ in range(r.randint(1, 20)))]
        kept = [(i, c) for i, c in enumerate(counts) if c[0]]
        got = calibration.pool(counts)
        for at, (i, _) in enumerate(kept):
            def mean(a, b):
                return sum(c[1] for _, c in kept[a:b + 1]) / sum(c[0] for _, c in kept[a:b + 1])
            want = max(min(mean(a, b) for b in range(at, len(kept))) for a in range(at + 1))
            assert got[i] == pytest.approx(want)
        assert all(p is None for p, c in zip(got, counts) if not c[0])


def test_calibration_mends_confidence(spark):
    """Scores that overstate: right in score squared of the cases."""
    df = spark.range(40_000).select(
        "id", (F.pmod(F.xxhash64("id"), F.lit(10_000)) / 10_000).alias("score"),
        (F.pmod(F.xxhash64("id", F.lit(1)), F.lit(10_000)) / 10_000).alias("u"), calibration.split(F.col("id")).alias("part"))
    df = df.withColumn("good", F.col("u") < F.col("score") * F.col("score"))
    shares = {r.part: r["count"] / 40_000 for r in df.groupBy("part").count().collect()}
    assert all(abs(shares[i] - p) < 0.02 for i, p in enumerate(calibration.PARTS))
    table = calibration.fit(df.filter("part = 1"), "score", "good")
    assert table == sorted(table) and len(table) == calibration.BINS
    held = df.filter("part = 2").withColumn("p", calibration.probability(F.col("score"), table))
    before = calibration.expected_error(held, "score", "good").first().calibration_error
    after = calibration.expected_error(held, "p", "good").first().calibration_error
    assert after < 0.03 < 0.1 < before
    none = calibration.fit(df.limit(0), "score", "good", 4)
    assert none == [0.125, 0.375, 0.625, 0.875]
    odd = spark.createDataFrame([(None,), (float("nan"),), (1.0,), (7.0,), (-1.0,)], "s double")
    assert [r[0] for r in odd.select(calibration.bin_of(F.col("s"))).collect()] == [0, 0, 19, 19, 0]


def test_classify_takes_a_calibration(spark):
    train = spark.createDataFrame([("en", "the cat and the dog are here"), ("de", "der hund und die katze sind hier")],
                                  "lang string, text string")
    detect = langid.detector(langid.train_profile(train))
    df = spark.createDataFrame([("the dog and the cat are here and there they are now",), ("",)], "text string")
    plain = classify(df, detect, "en").collect()
    sure = classify(df, detect, "en", calibration=[0.7] * 20).collect()
    assert [r.confidence for r in sure] == [0.7, 0.0] and plain[0].confidence != 0.7
    assert sure[0].confidence_tier == "MEDIUM"


RANGE_SCHEMA = ("lo bigint, hi bigint, country_code string, country_name string, city string, "
                "latitude double, longitude double")


@pytest.mark.parametrize("index_bytes", [geo.INDEX_BYTES, 0])
def test_geo_lookup(spark, monkeypatch, index_bytes):
    if not index_bytes:
        monkeypatch.setattr(geo, "broadcast_if_small", lambda df: df)
    block = (8 << 24) + (8 << 16)
    ranges = spark.createDataFrame(
        [(block, block + 3 * 65536 - 1, "US", "United States", "A", 1.0, 2.0),
         (block + 3 * 65536, block + 3 * 65536, "FR", "France", "B", 3.0, 4.0)], RANGE_SCHEMA)
    v6 = spark.createDataFrame(
        [("2001" + "0" * 28, "2001" + "f" * 28, "DE", "Germany", "C", 5.0, 6.0)],
        RANGE_SCHEMA.replace("lo bigint, hi bigint", "lo string, hi string"))
    ips = ["8.8.0.0", "8.10.255.255", "8.11.0.0", "8.11.0.1", "10.0.0.1", "bad", "2001:db8::1",
           "2002::1", "fe80::1"] + ["8.8.8.8"] * 50
    got = geo.geo_lookup(spark.createDataFrame([(i,) for i in ips], "ip string"), ranges, v6, index_bytes=index_bytes)
    by_ip = {}
    for r in got.collect():
        by_ip.setdefault(r.ip, []).append(r)
    assert {k: v[0].country_code for k, v in by_ip.items()} == {
        "8.8.0.0": "US", "8.10.255.255": "US", "8.11.0.0": "FR", "8.11.0.1": None, "10.0.0.1": None,
        "bad": None, "2001:db8::1": "DE", "2002::1": None, "fe80::1": None, "8.8.8.8": "US"}
    assert len(by_ip["8.8.8.8"]) == 50 and got.count() == len(ips)
    assert {k for k, v in by_ip.items() if v[0].is_private} == {"10.0.0.1", "fe80::1"}
    assert [k for k, v in by_ip.items() if v[0].error] == ["bad"]
    assert got.columns == ["ip", "is_private", "country_code", "country_name", "city", "latitude",
                           "longitude", "asn", "org", "error"]


def test_size_check_bounds_the_probe(spark):
    assert sizes.is_small(spark.range(10), rows=10)
    assert not sizes.is_small(spark.range(11), rows=10)
    assert not sizes.is_small(spark.range(10).select(F.lit("x" * 100).alias("t")), size=500)
    big = spark.range(50).join(sizes.broadcast_if_small(spark.range(30), rows=5), "id")
    assert "BroadcastHint" not in big._jdf.queryExecution().analyzed().toString()


def test_rule_hits(spark):
    texts = [(1, "mail joe@example.com or +14155550100", "see https://example.org/path/to"),
             (2, "wallet bc1qar0srrr7xfkvy5l643lydnw9re59gtzzwf5mdq", " "),
             (3, "0x" + "ab" * 20 + " at 10.0.0.1 and 10.0.0.2", "é 300.1.1.1"), (4, None, "")]
    df = spark.createDataFrame(texts, "id int, src string, tr string")
    hits = rules.rule_hits(df, {"translation": "tr", "source": "src"}, ["id"])
    got = rows(hits, "id", "scanned_source", "rule", "n_strings")
    assert got == [(1, "source", "contact_detail", 2), (1, "translation", "web_link", 1),
                   (2, "source", "coin_account", 1), (3, "source", "coin_account", 1),
                   (3, "source", "network_host", 2)]
    flat = rules.rule_offsets(hits, ["id"]).filter("id = 3 and rule = 'network_host'")
    assert rows(flat, "offset", "data") == [(46, "10.0.0.1"), (59, "10.0.0.2")]
    custom = spark.createDataFrame([("r", "s", "needle", True, "Low", None)], R.RULE_SCHEMA)
    loaded = rules.load_rules(custom)
    got = rules.rule_hits(spark.createDataFrame([(1, "a NEEDLE")], "id int, t string"), {"x": "t"}, ["id"], loaded)
    assert rows(got, "rule", "n_strings") == [("r", 1)]


def test_ordered_concat_in_parts(spark):
    df = spark.range(2500).select((F.col("id") % 3).alias("k"), F.col("id").alias("i"))
    out = G.ordered_concat(df.repartition(7), ["k"], "i", F.col("i").cast("string"), ",", rows=64)
    for r in out.collect():
        assert [int(x) for x in r.text.split(",")] == list(range(r.k, 2500, 3))
    parts = G.ordered_parts(df, ["k"], "i", F.col("i").cast("string"), ",", rows=64)
    assert max(len(r.text.split(",")) for r in parts.collect()) <= 64


def brute_markers(tokens, offset, duration):
    import numpy as np
    out, pending, last = [], [], None
    def at(k):
        return float(np.float32(k) * np.float32(0.02))
    for text, marker in tokens:
        if marker is None:
            pending.append(text)
        else:
            if last is not None and pending:
                t = "".join(pending).strip()
                if t:
                    out.append((int((offset + at(last)) * 1000), int((offset + at(marker)) * 1000), t))
                pending = []
            last = marker
    t = "".join(pending).strip()
    if t:
        start = at(last) if last is not None else 0.0
        out.append((int((offset + start) * 1000), int((offset + duration) * 1000), t))
    return out


def test_marker_segments_against_brute_force(spark):
    rnd = random.Random(5)
    chunks = []
    for c in range(60):
        k, tokens = 0, []
        for _ in range(rnd.randrange(0, 14)):
            if rnd.random() < 0.4:
                k += rnd.randrange(1, 200)
                tokens.append((None, k))
            else:
                tokens.append((rnd.choice([" a", " bc", "  ", "é"]), None))
        chunks.append((c, tokens, 30.0 * c, 30.0))
    df = spark.createDataFrame(
        chunks, "c int, tokens array<struct<text:string,marker:int>>, offset_s double, duration_s double")
    got = {}
    for r in G.marker_segments(df, ["c"]).orderBy("c", "seg_idx").collect():
        got.setdefault(r.c, []).append((r.start_ms, r.end_ms, r.text))
    want = {c: brute_markers(t, o, d) for c, t, o, d in chunks}
    assert got == {c: s for c, s in want.items() if s}


def test_select_attempt(spark):
    data = [("a", 0, "aaaaaaaaaaaa", 0.1), ("a", 1, "good words here", 0.1), ("a", 2, "better", 0.1),
            ("b", 0, "aaaaaaaaaaaa", 0.7), ("b", 1, "words", 0.1),
            ("c", 0, "aaaaaaaaaaaa", 0.1), ("c", 5, "bbbbbbbbbbbbb", 0.1)]
    df = spark.createDataFrame(data, "chunk string, attempt int, text string, no_speech double")
    assert rows(G.select_attempt(df, ["chunk"]), "chunk", "attempt", "accepted") == [
        ("a", 1, True), ("b", 0, True), ("c", 5, False)]


RESULTS = [("/1", "ar", True, "x y z", "t"), ("/2", "ar", True, None, None), ("/3", "ar", True, "", "t"),
           ("/4", "zh", True, "a", "t"), ("/5", "zh", True, "b", "t"), ("/6", "en", False, "c", None),
           ("/7", "", False, None, None), ("/8", "zz", True, "d", "t")]


def results(spark):
    return spark.createDataFrame(
        RESULTS, "file_path string, detected_language string, is_foreign boolean, source_text string, "
                 "translated_text string").withColumn("error", F.when(F.col("file_path") == "/7", "bad"))


def test_rollups(spark):
    r = results(spark)
    groups = rollups.language_groups(r)
    assert [(g.language_code, g.language_name, g.file_count, g.total_words) for g in groups.collect()] == [
        ("ar", "Arabic", 3, 3), ("zh", "Chinese", 2, 2), ("en", "English", 1, 1), ("zz", "(unknown)", 1, 1)]
    assert rollups.dominant_language(groups, "en").first()[0] == "ar"
    tie = groups.filter("file_count = 1")
    assert rollups.dominant_language(tie, "xx").first()[0] == "zz"
    assert rollups.dominant_language(groups.filter("language_code = 'en'"), "en").first()[0] is None
    c = rollups.batch_counters(r, r.union(r)).first()
    assert (c.total_files, c.processed, c.errors, c.foreign_language, c.translated) == (16, 7, 1, 6, 5)
    s = rollups.summary(r, "en", 1.5).first()
    assert s.languages_detected == {"ar": 3, "en": 1, "zh": 2, "zz": 1} and s.dominant_language == "ar"
    keys = rollups.languages_detected(r).select(F.map_keys("languages_detected")).first()[0]
    assert keys == ["ar", "en", "zh", "zz"]


def test_regressions(spark):
    base = spark.createDataFrame([("a", 100, 0), ("a", 1, 1), ("b", 0, 0), ("c", 100, 0)],
                                 "test_name string, duration_ms bigint, position int")
    fresh = spark.createDataFrame([("a", 121), ("b", 9), ("c", 120), ("d", 1)], "test_name string, duration_ms bigint")
    assert rows(rollups.regressions(fresh, base), "test_name", "baseline_ms") == [("a", 100)]


def test_manifest_digest(spark):
    import hashlib
    files = spark.createDataFrame([("/1", bytearray(b"hello"))], "path string, content binary")
    man = manifest.manifest_rows(results(spark), manifest.file_digests(files, F.col("content")), "en")
    got = {m.original_path: m for m in man.collect()}
    assert got["/1"].sha256 == hashlib.sha256(b"hello").hexdigest() and got["/1"].size_bytes == 5
    assert got["/2"].sha256 == "" and got["/2"].size_bytes == 0 and got["/2"].translation_file == ""
    assert got["/1"].translation_file.startswith("translations/1.")
    with pytest.raises(Exception, match="lacks a notice"):
        manifest.manifest_header(man, "/", notice="").collect()


def test_assert_notice(spark):
    ok = results(spark).withColumn("notice", F.when(F.col("translated_text").isNotNull(), "n"))
    assert filters.assert_notice(ok).count() == len(RESULTS)
    bad = ok.withColumn("notice", F.lit(" "))
    assert filters.notice_violations(bad).count() == 5
    with pytest.raises(Exception, match="without a notice"):
        filters.assert_notice(bad).collect()
    assert filters.artifact_violations(filters.to_artifact(ok)).count() == 0


def test_review_replay_against_brute_force(spark):
    rnd = random.Random(3)
    log = [(f"/f{rnd.randrange(3)}", rnd.randrange(3), i, rnd.choice(["flag", "unflag", "set_status"]),
            rnd.choice(["done", "in_progress"]), f"n{i}", f"t{i}") for i in range(120)]
    state = {}
    for path, idx, i, action, status, note, at in log:
        if action == "flag":
            state[(path, idx)] = [note, at, "needs_review"]
        elif action == "unflag":
            state.pop((path, idx), None)
        elif (path, idx) in state:
            state[(path, idx)][2] = status
        if i % 40 == 39:
            df = spark.createDataFrame(
                log[: i + 1], "file_path string, segment_index int, seq int, action string, status string, "
                              "note string, at string")
            got = {(r.file_path, r.segment_index): [r.examiner_note, r.flagged_at, r.review_status]
                   for r in review.fold_review_actions(df).collect()}
            assert got == state


def test_upsert_and_recent(spark):
    schema = "file_path string, segment_index int"
    state = spark.createDataFrame([("/a", 1), ("/a", 2), ("/b", 1)], schema)
    updates = spark.createDataFrame([("/a",), ("/c",)], "file_path string")
    new = spark.createDataFrame([("/c", 7), ("/z", 1)], schema)
    assert rows(review.upsert_flags(state, updates, new), "file_path", "segment_index") == [("/b", 1), ("/c", 7)]
    opens = spark.createDataFrame([(f"/{i % 13}", i) for i in range(40)] + [("/0", 99)], "path string, seq int")
    got = [r.path for r in review.recent_files(opens).collect()]
    assert len(got) == 10 and got[-1] == "/0" and got[-2] == "/12"[:3] or got[-2] == f"/{39 % 13}"


@pytest.mark.parametrize("width", [1, 5, 64, 10**6])
def test_running_state_against_brute_force(spark, width):
    rnd = random.Random(width)
    data = [("hot" if rnd.random() < 0.8 else "cold", s, rnd.randrange(5)) for s in rnd.sample(range(-50, 1000), 300)]
    df = spark.createDataFrame(data, "run string, seq bigint, v int").repartition(5)
    want, tails, totals = [], {}, {}
    for run, seq, v in sorted(data, key=lambda x: x[1]):
        totals[run] = totals.get(run, 0) + v
        tails[run] = (tails.get(run, []) + [seq])[-8:]
        want.append((run, seq, totals[run], tuple(tails[run])))
    sums = running.running_sums(df, ["run"], "seq", {"total": F.col("v")}, width)
    assert rows(sums, "run", "seq", "total") == sorted(w[:3] for w in want)
    if width >= 8:
        recent = running.rolling_recent(df, ["run"], "seq", "seq", 8, width)
        got = sorted((r.run, r.seq, tuple(r.recent)) for r in recent.collect())
        assert got == sorted((w[0], w[1], w[3]) for w in want)


def test_latest_state(spark):
    log = [("/a", 1, "start", None, None, None), ("/a", 2, "done", True, True, None),
           ("/b", 3, "start", None, None, None), ("/c", 4, "done", True, True, None),
           ("/d", 5, "start", None, None, None), ("/d", 6, "done", True, False, "x"),
           ("/e", 7, "start", None, None, None), ("/e", 8, "done", True, True, None),
           ("/e", 9, "start", None, None, None)]
    df = spark.createDataFrame(log, "path string, seq int, type string, is_foreign boolean, "
                                    "translated boolean, error string")
    states = running.latest_state(df)
    assert rows(states, "path", "status", "is_foreign") == [
        ("/a", "done", True), ("/b", "active", False), ("/d", "error", True), ("/e", "active", True)]
    c = running.file_state_counts(states).first()
    assert (c.files, c.processed, c.foreign_files, c.translated_files, c.errors) == (4, 2, 3, 2, 1)


def test_langid_forms_agree(spark):
    texts = [("en", "the cat and the dog are in the house with the other cats"),
             ("de", "der hund und die katze sind in dem haus mit den anderen"),
             ("fr", "le chat et le chien sont dans la maison avec les autres")]
    train = spark.createDataFrame(texts, "lang string, text string")
    profile = langid.train_profile(train, k=40)
    probe = spark.createDataFrame(
        [(1, "the dogs and cats"), (2, "die hunde und der"), (3, "dans les maisons"), (4, ""), (5, "zz"),
         (6, "😀 the 😀 and"), (7, None), (8, "ЩЩЩЩ")], "doc_id int, text string")
    rel = langid.best_language(langid.language_scores(probe, profile, "doc_id"), "doc_id")
    detect = langid.detector(profile)
    col = probe.select("doc_id", detect(F.col("text")).alias("d")).select("doc_id", "d.*")
    cols = ("doc_id", "language", "score", "runner_up")
    assert rows(rel, *cols) == rows(col, *cols)
    assert [r[1] for r in rows(rel, *cols)] == ["en", "de", "fr", "", "", "en", "", ""]


def failing():
    def run(texts):
        if any("bad" in t for t in texts):
            raise ValueError("boom")
        return [t[::-1] if t != "none" else None for t in texts]
    return run


def test_thousands_of_rules(spark):
    many = [dict(rule=f"r{i}", string_id=f"s{i}", pattern=f"needle{i}x", nocase=i % 2 == 0, severity="Low",
                 literal=f"needle{i}" if i % 3 else None) for i in range(3000)]
    df = spark.createDataFrame([(1, "é needle2999x NEEDLE2998X needle7x needle7x NEEDLE7X"), (2, None), (3, " ")],
                               "id int, t string")
    hits = rules.rule_hits(df, {"s": "t"}, ["id"], many)
    assert rows(hits, "id", "rule", "n_strings") == [(1, "r2998", 1), (1, "r2999", 1), (1, "r7", 2)]
    assert rows(rules.rule_counts(df, {"s": "t"}, ["id"], many), "id", "rule", "n_strings") == [
        (1, "r2998", 1), (1, "r2999", 1), (1, "r7", 2)]
    flat = rules.rule_offsets(hits, ["id"]).filter("rule = 'r7'")
    assert rows(flat, "offset", "data") == [(27, "needle7x"), (36, "needle7x")]


def test_a_failing_batch_is_halved():
    calls = []

    def model(texts):
        calls.append(len(texts))
        if "bad" in texts:
            raise ValueError("no")
        return [t.upper() for t in texts]

    texts = [f"t{i}" for i in range(1023)] + ["bad"]
    out, errors = infer._guarded(model, texts)
    assert out == [t.upper() for t in texts[:-1]] + [None]
    assert errors[:-1] == [None] * 1023 and errors[-1] == "ValueError: no" and len(calls) == 21


def test_one_detector_and_one_model_pass(spark):
    from lingotally.plans import batch, translate

    docs = spark.createDataFrame([(1, "der hund", "de", 0.9), (2, "the dog", "en", 0.9)],
                                 "doc_id int, text string, language string, confidence double")
    docs = docs.withColumns({"dialect": F.lit(None).cast("string"), "dialect_confidence": F.lit(None).cast("double")})
    # a Python detector in front of the translation runs once: the model is the only Python node left
    @F.pandas_udf("string")
    def spoken(texts: pd.Series) -> pd.Series:
        return pd.Series(["de" if t.startswith("der") else "en" for t in texts])

    judged = docs.withColumn("language", spoken("text"))
    done = translate.translate_documents(judged, infer.tagging_model("en"), "en")
    plan = done._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInPandas") == 1 and "ArrowEvalPython" not in plan
    assert rows(done, "doc_id", "translated_text") == [(1, "[en] der hund")]

    @F.pandas_udf("struct<language:string,score:long,runner_up:long>")
    def detect(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame({"language": ["de"] * len(texts), "score": [9] * len(texts), "runner_up": [1] * len(texts)})

    files = spark.createDataFrame([("/a.txt", "audio", 9, "der hund", "", None)],
                                  "file_path string, kind string, length bigint, text string, "
                                  "upstream_language string, error string")
    results = batch.run_batch(files, detect, infer.tagging_model("en"), "en").results
    plan = results._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInPandas") == 1 and "ArrowEvalPython" not in plan
    assert rows(results, "translated_text") == [("[en] der hund",)]


def test_infer_distinct(spark):
    texts = ["abc"] * 200 + ["bad one", "xyz", "none", "", None, " "]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    out = infer.infer_distinct(df, failing, F.col("id"), partitions=3)
    got = {r.id: (r.output, r.error) for r in out.collect()}
    assert len(got) == len(texts)
    assert all(got[i] == ("cba", None) for i in range(200))
    assert got[200] == (None, "ValueError: boom") and got[201] == ("zyx", None)
    assert got[202] == (None, "no output")
    assert all(got[i] == (None, None) for i in (203, 204, 205))
    both = infer.with_fallback(failing, infer.tagging_model("b"))
    out = infer.map_model(df.filter("id > 199 and id < 203"), both)
    assert rows(out, "id", "output") == [(200, "[b] bad one"), (201, "zyx"), (202, "[b] none")]


def test_lookups(spark):
    req = spark.createDataFrame([(1, "ps"), (2, "prs"), (3, "en")], "id int, language string")
    def pick(*models):
        inst = spark.createDataFrame([(m,) for m in models], "model string")
        return [r[1] for r in rows(lookups.choose_installed(req, inst, "id"), "id", "model")]
    assert pick("pashto", "base", "tiny") == ["pashto", "base", "base"]
    assert pick("dari", "large-v3", "base") == ["large-v3", "dari", "large-v3"]
    assert pick("other") == ["tiny", "tiny", "tiny"]
    need = spark.createDataFrame([("a",), ("b",)], "component string")
    assert rows(lookups.missing_components(need, need.filter("component = 'a'")), "component") == [("b",)]


def test_search_languages(spark):
    found = filters.search_languages(R.language_catalogue(spark), "AFGHAN")
    assert [r.code for r in found.collect()] == ["prs"]
    tiers = [r.tier for r in filters.search_languages(R.language_catalogue(spark), "a").collect()]
    assert tiers == sorted(tiers, key=R.TIER_ORDER.index)
    assert R.language_catalogue(spark).count() == 37 and R.rule_table(spark).count() == 8


def test_int_to_ipv4(spark):
    df = spark.createDataFrame([("255.1.0.7",), ("0.0.0.0",), ("8.8.4.4",)], "ip string")
    back = df.select("ip", net.int_to_ipv4(net.ipv4_to_int(F.col("ip"))).alias("b"))
    assert all(r.ip == r.b for r in back.collect())


def test_results_do_not_depend_on_partitioning(spark):
    df = spark.createDataFrame([Row(k=i % 3, i=i, t=f"w{i}") for i in range(200)])
    seen = set()
    for n in (1, 4, 32):
        spark.conf.set("spark.sql.shuffle.partitions", str(n))
        out = G.transcript(df.repartition(n), ["k"], "i", "t")
        seen.add(tuple(rows(out, "k", "transcript")))
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert len(seen) == 1


@pytest.mark.parametrize("n", [32, 33, 200])
def test_language_scores_for_any_number_of_languages(spark, n):
    profile = spark.createDataFrame(
        [(f"l{i:03d}", g, w) for i in range(n) for g, w in (("abc", i + 1), (f"x{i % 10}y", 5))],
        "language string, gram string, weight int")
    df = spark.createDataFrame([(1, "zabcz"), (2, "nothing"), (3, None)], "id int, t string")
    got = langid.language_scores(df, profile, "id", "t").collect()
    assert sorted(r["score"] for r in got if r["id"] == 1) == list(range(1, n + 1))
    assert [(r["language"], r["score"]) for r in got if r["id"] != 1] == [(None, None)] * 2
    d = df.select("id", langid.detector(profile)(F.col("t")).alias("d")).collect()
    assert [tuple(r["d"]) for r in sorted(d)][:2] == [(f"l{n - 1:03d}", n, n - 1), ("", 0, 0)]


def test_languages_beyond_the_bmp(spark):
    a, b = "\U0001e922\U0001e923\U0001e924\U0001e925 ", "\U00010330\U00010331\U00010332\U00010333 "
    profile = langid.train_profile(spark.createDataFrame([("aa", a * 9), ("bb", b * 9)], "lang string, text string"))
    df = spark.createDataFrame([(1, "x" * 600 + a * 3), (2, b * 3)], "id int, t string")
    got = {r["id"]: r["d"]["language"] for r in df.select("id", langid.detector(profile)(F.col("t")).alias("d")).collect()}
    assert got == {1: "aa", 2: "bb"}
    head = df.select("id", langid.detector(profile, sample_chars=512)(F.col("t")).alias("d")).collect()
    assert {r["id"]: r["d"]["language"] for r in head} == {1: "", 2: "bb"}


def test_null_keys_keep_their_running_sums(spark):
    df = spark.createDataFrame([("a", 1, 2), (None, 1, 3), (None, 2, 4)], "k string, s bigint, v bigint")
    got = running.running_sums(df, ["k"], "s", {"t": F.col("v")}).collect()
    assert sorted((tuple(r) for r in got), key=repr) == [("a", 1, 2, 2), (None, 1, 3, 3), (None, 2, 4, 7)]
    assert running.rolling_recent(df, ["k"], "s", "v").count() == 3


def test_blank_documents_keep_a_transcript(spark):
    df = spark.createDataFrame([(1, 0, " "), (2, 0, " a "), (2, 1, "b"), (None, 0, None)], "d int, seg_idx int, text string")
    got = {r["d"]: r["transcript"] for r in G.transcript(df, ["d"]).collect()}
    assert got == {1: "", 2: "a b", None: ""}
