"""Literal cases of the scalar functions."""

import ipaddress

import pytest
from pyspark.sql import functions as F

from lingotally.functions import (
    cues as C, dialect as D, epochs as E, kinds as K, match as M, net as N, script as S, text as X,
    tiers as T,
)

MAX_LONG = 2**63 - 1


def one(spark, rows, schema, **exprs):
    df = spark.createDataFrame(rows, schema)
    return [r.asDict(recursive=True) for r in df.select(*[e.alias(n) for n, e in exprs.items()]).collect()]


@pytest.mark.parametrize("value,fmt,utc,secs,conf", [
    (0, "unix-seconds", "1970-01-01T00:00:00Z", 0, "High"),
    (1762276748, "unix-seconds", "2025-11-04T17:19:08Z", 1762276748, "High"),
    (1762276748000, "unix-milliseconds", "2025-11-04T17:19:08Z", 1762276748, "High"),
    (0, "apple-coredata", "2001-01-01T00:00:00Z", 978307200, "High"),
    (0, "cocoa-date", "2001-01-01T00:00:00Z", 978307200, "High"),
    (116444736000000000, "windows-filetime", "1970-01-01T00:00:00Z", 0, "High"),
    (11644473600000000, "webkit", "1970-01-01T00:00:00Z", 0, "High"),
    (2082844800, "hfs-plus", "1970-01-01T00:00:00Z", 0, "High"),
    (MAX_LONG, "unix-seconds", "", 0, "Low"),
    (MAX_LONG, "apple-coredata", "", 0, "Low"),
    (-MAX_LONG - 1, "hfs-plus", "", 0, "Low"),
    (-1500, "unix-milliseconds", "1969-12-31T23:59:59Z", -1, "High"),
    (-62135596800, "unix-seconds", "0001-01-01T00:00:00Z", -62135596800, "High"),
    (-62135596801, "unix-seconds", "", 0, "Low"),
    (253402300799, "unix-seconds", "9999-12-31T23:59:59Z", 253402300799, "High"),
])
def test_epoch_convert(spark, value, fmt, utc, secs, conf):
    [r] = one(spark, [(value, fmt)], "v bigint, f string", c=E.convert(F.col("v"), F.col("f")))
    assert r["c"] == {"utc": utc, "unix_seconds": secs, "confidence": conf}


def test_epoch_text_ignores_session_zone(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "Asia/Kathmandu")
    try:
        [r] = one(spark, [(1762276748,)], "v bigint", u=E.format_utc(F.col("v")))
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert r["u"] == "2025-11-04T17:19:08Z"


def test_epoch_detect(spark):
    rows = [(1762276748,), (-MAX_LONG - 1,), (0,)]
    got = one(spark, rows, "v bigint", d=E.detect_formats(F.col("v")))
    first = [(x["format"], x["confidence"]) for x in got[0]["d"]]
    assert first == [("unix-seconds", "High"), ("hfs-plus", "Medium"), ("apple-coredata", "Low")]
    assert [x["format"] for x in got[1]["d"]] == ["unix-nanoseconds", "apple-nanoseconds"]
    assert [x["confidence"] for x in got[2]["d"]] == ["Medium", "Low"]


def test_parse_format(spark):
    rows = [("unix",), ("hfs+",), ("ns-date",), ("filetime",), ("nope",)]
    got = [r["f"] for r in one(spark, rows, "n string", f=E.parse_format(F.col("n")))]
    assert got == ["unix-seconds", "hfs-plus", "cocoa-date", "windows-filetime", None]


PRIVATE = ["10.1.2.3", "172.16.0.1", "172.31.255.255", "192.168.0.1", "127.0.0.1", "169.254.9.9",
           "255.255.255.255", "192.0.2.1", "198.51.100.7", "203.0.113.9", "0.0.0.0", "224.0.0.1",
           "239.1.1.1", "100.64.0.1", "100.127.255.255", "::1", "::", "ff02::1", "fc00::1",
           "fdab::1", "fe80::1", "febf::1"]
PUBLIC = ["8.8.8.8", "172.32.0.1", "100.128.0.1", "1.1.1.1", "240.0.0.1", "2001:4860:4860::8888",
          "::ffff:1.2.3.4", "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7::", "fec0::1"]
INVALID = ["", "not an ip", "1.2.3", "1.2.3.4.5", "256.1.1.1", "01.2.3.4", "1::2::3", ":::",
           "12345::", "1:2:3:4:5:6:7:8:9", "1:2:3:4:5:6:7:8::", "::1.2.3.300", "fe80::1%eth0",
           "g::1", ":1:2", "1:2:3:4:5:6:7:", " 1.2.3.4"]


@pytest.mark.parametrize("ips,valid,private", [
    (PRIVATE, True, True), (PUBLIC, True, False), (INVALID, False, False)])
def test_addresses(spark, ips, valid, private):
    got = one(spark, [(i,) for i in ips], "ip string", ip=F.col("ip"), v=N.ip_valid(F.col("ip")),
              p=N.is_private(F.col("ip")), h=N.ipv6_to_hex(F.col("ip")))
    for r in got:
        assert (r["v"], r["p"]) == (valid, private), r
        if valid and ":" in r["ip"]:
            assert int(r["h"], 16) == int(ipaddress.IPv6Address(r["ip"]))


def test_kinds(spark):
    rows = [("a/b.MP4", b"%PDF-1.7"), ("x/.bashrc", b""), ("x.jpg", b"\xff\xfbab"),
            ("x.txt", b"\0\0\0\x18ftypmp42"), ("v.SRT", b"1\n"), ("p.pdf", b"\x1f\x8b\x08\0"),
            ("n", b"RIFF\1\2\3\4WAVE"), ("z.png", b"\xff\xd8\xff\xe0"), ("q.gif", None),
            ("w.wmv", b"PK\x03\x04"), ("t.tif", b"ID3\x04")]
    got = one(spark, [(p, bytearray(h) if h is not None else None) for p, h in rows],
              "p string, h binary", e=K.kind_from_ext(F.col("p")),
              k=K.kind_robust(F.col("p"), F.col("h")), v=K.kind_viewer(F.col("p")))
    assert [r["e"] for r in got] == ["video", "audio", "image", "audio", "subtitle", "pdf", "audio",
                                     "image", "image", "video", "image"]
    assert [r["k"] for r in got] == ["pdf", "audio", "audio", "video", "subtitle", "pdf", "audio",
                                     "image", "image", "video", "audio"]
    assert [r["v"] for r in got] == ["video", "document", "image", "document", "subtitle",
                                     "document", "document", "image", "image", "document", "document"]


def test_size_gate(spark):
    rows = [(0, "x"), (100, "x"), (101, "x"), (50, "éé"), (50, "ééé")]
    got = one(spark, rows, "n bigint, t string",
              g=K.size_gate(F.col("n"), F.col("t"), max_file=100, max_text=4))
    assert [r["g"] for r in got] == ["corrupt", None, "too_large", None, "too_large"]


def test_tiers(spark):
    rows = [(0.70, 50), (1.0, 5), (1.0, 9), (1.0, 10), (0.85, 50), (0.60, 50), (0.59, 50), (0.9, 0)]
    got = one(spark, rows, "s double, w int", t=T.confidence_tier(F.col("s"), F.col("w")))
    assert [r["t"] for r in got] == ["MEDIUM", "LOW", "LOW", "HIGH", "HIGH", "MEDIUM", "LOW", "HIGH"]
    got = one(spark, [("HIGH", 50), ("LOW", 1), ("LOW", 3), ("LOW", 50), ("MEDIUM", 20)],
              "t string, w int", a=T.confidence_advisory(F.col("t"), F.col("w")))
    assert got[0]["a"] is None and "1 word:" in got[1]["a"] and "3 words:" in got[2]["a"]
    assert len({r["a"] for r in got}) == 5


def test_text(spark):
    rows = [("Hi  there　now\n",), ("a.b!! c",), ("",), ("  \t",), ("café",), (None,)]
    got = one(spark, rows, "t string", w=X.word_count(F.col("t")), s=X.split_sentences(F.col("t")),
              b=X.is_blank(F.col("t")), u=X.unique_char_ratio(F.col("t")))
    assert [r["w"] for r in got] == [3, 2, 0, 0, 1, 0]
    assert got[1]["s"] == ["a.", "b!", "!", "c"] and got[3]["s"] == []
    assert [r["b"] for r in got] == [False, False, True, True, False, True]
    assert got[2]["u"] == 0.0 and got[4]["u"] == 1.0


def test_repetition(spark):
    got = one(spark, [("a" * 40,), ("a normal sentence of words",)], "t string",
              u=X.unique_char_ratio(F.col("t")))
    assert got[0]["u"] < 0.3 <= got[1]["u"]


def test_escapes_and_names(spark):
    [r] = one(spark, [("<a href=\"x\">&'",)], "t string", h=X.html_escape(F.col("t")),
              c=X.csv_field(F.col("t")), i=X.sanitize_id(F.col("t")))
    assert r["h"] == "&lt;a href=&quot;x&quot;&gt;&amp;&#39;"
    assert r["c"] == '"<a href=""x"">&\'"' and r["i"] == "_a_href__x____"
    got = one(spark, [("a/b/c.txt",), ("c.txt",), ("b/c.txt",)], "p string",
              b=X.base_name(F.col("p")), s=X.short_path(F.col("p")))
    assert [r["b"] for r in got] == ["c.txt"] * 3
    assert [r["s"] for r in got] == ["…/b/c.txt", "c.txt", "b/c.txt"]
    got = one(spark, [("", 1, 3, 0), ("in_progress", 0, 0, 10)], "s string, d int, n int, ms int",
              l=X.status_label(F.col("s")), p=X.percent_done(F.col("d"), F.col("n")),
              t=X.throughput(F.col("d"), F.col("ms")))
    assert [(r["l"], r["p"], r["t"]) for r in got] == [
        ("NEEDS REVIEW", 33, 0.0), ("IN PROGRESS", 0, 0.0)]


def test_scripts(spark):
    rows = [("Hello мир abc. شو 12؟ x",), ("café",), ("١٢٣",), ("123 !?",), ("a😀b漢字c",), ("नमस्ते x שלום",)]
    got = one(spark, rows, "t string", r=S.script_runs(F.col("t")), c=S.code_switch(F.col("t")),
              l=S.latin_ratio(F.col("t")))
    assert got[0]["r"] == ["latin", "cyrillic", "latin", "arabic", "latin"]
    assert got[1]["r"] == ["latin"] and got[2]["r"] == ["arabic"] and got[3]["r"] == []
    assert got[4]["r"] == ["latin", "cjk", "latin"]
    assert got[5]["r"] == ["devanagari", "latin", "hebrew"]
    assert got[0]["c"]["is_code_switched"] and got[0]["c"]["switch_count"] == 4
    assert not got[1]["c"]["is_code_switched"] and got[1]["c"]["confidence"] == 0.0
    assert got[2]["l"] == 0.0 and got[1]["l"] == 1.0


def test_long_text_does_not_overflow_the_regex_stack(spark):
    long = "word слово ، " * 200_000
    [r] = one(spark, [(long,)], "t string", n=F.size(S.script_runs(F.col("t"))),
              a=S.alpha_count(F.col("t")), w=X.word_count(F.col("t")))
    assert r["n"] == 600_000 and r["a"] == 9 * 200_000 and r["w"] == 600_000


def test_script_verdict(spark):
    rows = [(0, 0), (1, 0), (2, 0), (3, 1), (4, 1), (2, 2), (0, 3), (9, 0)]
    got = one(spark, rows, "a int, b int", v=S.script_verdict(F.col("a"), F.col("b")))
    seen = [(r["v"]["recommendation"], round(r["v"]["confidence"], 4)) for r in got]
    assert seen == [("Ambiguous", 0.0), ("A", 0.64), ("A", 0.73), ("A", 0.6825), ("A", 0.8),
                    ("Ambiguous", 0.3), ("B", 0.82), ("A", 0.95)]


def test_disambiguate(spark):
    rows = [("fa", "ټډ ښ ټ"), ("fa", "ټ"), ("fa", "ټپ"), ("fa", "سلام"), ("ar", "ټډښ")]
    g = S.glyph_profile(F.col("t"))
    v = S.script_verdict(g["n_a"], g["n_b"])
    got = one(spark, rows, "l string, t string", g=g, d=S.disambiguate(
        F.col("l"), v["recommendation"], v["confidence"], g["glyphs_a"]))
    assert got[0]["g"]["glyphs_a"] == ["ټ", "ډ", "ښ"]
    assert [r["d"]["language"] for r in got] == ["ps", "fa", "fa", "fa", "ar"]
    assert [r["d"]["note"] is not None for r in got] == [True, False, True, False, False]
    assert "ټ, ډ, ښ" in got[0]["d"]["note"]


def test_dialect(spark):
    rows = [("ليه فين امتى",), ("هون لسا مش",), ("علاش غادي، هادشي!",), ("سوالف عقب",), ("هذا نص",),
            ("داير",), ("",), ("ليه مش هون لسا",), ("هون ليه لسا فين",)]
    got = [r["d"] for r in one(spark, rows, "t string", d=D.detect_dialect(F.col("t")))]
    assert [(d["dialect"], round(d["confidence"], 4)) for d in got] == [
        ("Egyptian", 0.73), ("Levantine", 0.73), ("Moroccan", 0.73), ("Gulf", 0.62),
        ("ModernStandard", 0.4), ("Unknown", 0.2), ("Unknown", 0.0), ("Levantine", 0.62),
        ("Egyptian", 0.62)]
    assert got[1]["indicators"] == ["هون", "لسا", "مش"]
    assert got[7]["indicators"] == ["ليه", "هون", "لسا"]


def test_route(spark):
    rows = [("Egyptian", 0.73, False), ("Egyptian", 0.62, False), ("Moroccan", 0.73, True),
            ("Moroccan", 0.73, False), ("Levantine", 0.73, False), ("Iraqi", 0.65, False),
            ("Gulf", 0.95, True), ("Unknown", 0.2, True)]
    got = one(spark, rows, "d string, c double, a boolean",
              r=D.route(F.col("d"), F.col("c"), F.col("a")))
    assert [r["r"]["route"] for r in got] == [
        "NllbEgyptian", "NllbDefault", "SeamlessM4T", "NllbDefault", "NllbLevantine", "NllbIraqi",
        "NllbDefault", "NllbDefault"]
    assert got[0]["r"]["source_token"] == "arz_Arab" and got[7]["r"]["source_token"] == "ara_Arab"


def test_labels(spark):
    rows = [("cai",), ("Lev",), ("TUN",), ("xyz",)]
    got = [r["f"] for r in one(spark, rows, "l string", f=D.family_of_label(F.col("l")))]
    assert got == ["Egyptian", "Levantine", "Moroccan", "Unknown"]


def test_engine(spark):
    rows = [("hello world", "en", 0.5, True), ("hello", "en", 0.9, True), ("مرحبا hello", "ar", 0.9, True),
            ("مرحبا", "ar", 0.9, True), ("مرحبا hello", "ar", 0.2, False)]
    got = one(spark, rows, "t string, l string, c double, a boolean",
              e=S.select_engine(F.col("t"), F.col("l"), F.col("c"), F.col("a")))
    assert [r["e"] for r in got] == ["Seamless", "Nllb", "Seamless", "Nllb", "Nllb"]


SRT = "1\n00:00:01,000 --> 00:00:04,000\nHi\nthere\n\n2\n00:00:05,500 --> 00:00:08,000\nBye\n"
VTT = ("﻿WEBVTT\r\n\r\nNOTE x\r\n\r\nid1\r\n00:00:01.000 --> 00:00:04.000 align:start\r\nHello\r\n"
       "\r\n00:00:05.500 --> 00:00:08.000\r\nBye\r\n")


@pytest.mark.parametrize("body,kind,cues", [
    (SRT, "srt", [(1, 1000, 4000, "Hi\nthere", None), (2, 5500, 8000, "Bye", None)]),
    (VTT, "vtt", [(1, 1000, 4000, "Hello", None), (2, 5500, 8000, "Bye", None)]),
    ("01:23:45,678 --> 02:00:00,000\nx", "srt", None),
    ("00:00:01,000 --> 01:23:45,678\n", "srt", [(1, 1000, 5025678, "", None)]),
    ("x\n00:00:01,000 --> 00:00:02,5\na", "srt", [(1, 1000, 2005, "a", None)]),
    ("7\n00:00:01,000 --> 00:00:02,000\na\n\n\n\n0\n00:00:03,000 --> 00:00:04,000\nb", "srt",
     [(7, 1000, 2000, "a", None), (2, 3000, 4000, "b", None)]),
    ("junk", "srt", [(None, None, None, None, "block has no time line")]),
    (SRT + "\nbad\nworse", "srt", [(None, None, None, None, "time line has no arrow")]),
    ("1\n00:00:01.000 --> 00:00:02.000\na", "srt", [(None, None, None, None, "bad time stamp")]),
    ("x", "vtt", []), ("", "srt", []),
    ("x", "doc", [(None, None, None, None, "not a subtitle kind")]),
])
def test_parse_cues(spark, body, kind, cues):
    [r] = one(spark, [(body, kind)], "b string, k string", c=C.parse_cues(F.col("b"), F.col("k")))
    got = [tuple(c.values()) for c in r["c"]]
    if cues is None:
        assert got == [(1, 5025678, 7200000, "x", None)]
    else:
        assert got == cues


def test_clock_texts(spark):
    rows = [(0,), (5025678,), (360_000_000 + 61_001,)]
    got = one(spark, rows, "m bigint", s=C.format_ms(F.col("m")), v=C.format_ms(F.col("m"), "."),
              a=C.short_ms(F.col("m")), b=C.mmss(F.col("m")))
    assert [r["s"] for r in got] == ["00:00:00,000", "01:23:45,678", "100:01:01,001"]
    assert got[1]["v"] == "01:23:45.678" and got[1]["a"] == "83:45" and got[0]["b"] == "00:00"


def test_match_offsets_are_bytes(spark):
    text = "é a@b.com x@y.org ü z@q.de"
    [r] = one(spark, [(text,)], "t string", o=M.match_offsets(F.col("t"), r"[a-z]@[a-z]\.[a-z]+"))
    raw = text.encode()
    assert [(o["offset"], o["data"]) for o in r["o"]] == [
        (raw.index(x.encode()), x) for x in ("a@b.com", "x@y.org", "z@q.de")]


def test_match_offsets_of_many_hits(spark):
    import time

    n = 32_000
    df = spark.createDataFrame([("é xx1 " * n,), ("none",), (None,)], "t string")
    found = df.select(M.match_offsets(F.col("t"), "xx1").alias("o"))
    found.collect()
    start = time.perf_counter()
    full, none, null = [r["o"] for r in found.collect()]
    assert time.perf_counter() - start < 10
    assert [o["offset"] for o in full] == [7 * i + 3 for i in range(n)] and none == [] and not null


def test_values_beyond_the_range_stay_rows(spark):
    body = "1\n" + "9" * 16 + ":00:00,000 --> 00:00:02,000\nx\n"
    [r] = one(spark, [(body,)], "t string", c=C.parse_cues(F.col("t"), F.lit("srt")))
    assert [c["error"] for c in r["c"]] == ["bad time stamp"]
    got = one(spark, [(2**63 - 1,), (-2**63,), (86_399,)], "s bigint", c=E.civil_fields(F.col("s")))
    assert [g["c"]["year"] for g in got] == [None, None, 1970] and got[2]["c"]["second"] == 59
