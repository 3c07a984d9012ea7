"""Sources, sinks and the written plans."""

import json

import pytest
from pyspark.sql import functions as F

from lingotally import refdata as R
from lingotally.operators import langid, segments as G
from lingotally.plans import batch, package
from lingotally.sources import artefacts, readers, writers


@pytest.fixture
def tree(tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "one.txt").write_text("hello world")
    (tmp_path / "a" / "two.pdf").write_bytes(b"\xff\xd8\xff\xe0 not a pdf")
    (tmp_path / "three.srt").write_text("1\n00:00:01,000 --> 00:00:04,000\nHi\n")
    (tmp_path / "four.vtt").write_text("WEBVTT\n\n00:00:01.000 --> 00:00:02.000\nHo\n")
    (tmp_path / "empty.bin").write_bytes(b"")
    (tmp_path / "link.txt").symlink_to(tmp_path / "a" / "one.txt")
    return str(tmp_path)


def test_scan_tree(spark, tree):
    files = readers.scan_tree(spark, tree)
    kinds = {r.path.rsplit("/", 1)[1]: r.kind for r in readers.sniff_kinds(files).collect()}
    assert kinds["one.txt"] == "audio" and kinds["two.pdf"] == "image" and kinds["three.srt"] == "subtitle"
    heads = readers.read_heads(files)
    assert "content" not in heads.columns and max(len(r.head) for r in heads.collect()) <= 16
    plan = files.filter("length > 0").select("path")._jdf.queryExecution().toString()
    assert "content" not in plan.split("Physical Plan")[1]


def test_scan_text_and_subtitles(spark, tree):
    texts = readers.scan_text_corpus(spark, tree + "/a")
    assert [(r.path.rsplit("/", 1)[1], r.text) for r in texts.collect()] == [("one.txt", "hello world")]
    subs = readers.scan_subtitles(spark, tree)
    by = {r.path.rsplit("/", 1)[1]: r for r in subs.collect()}
    assert by["three.srt"].kind == "srt" and by["four.vtt"].kind == "vtt"
    assert by["one.txt"].error == "not a subtitle file"
    cues = G.parse_subtitles(subs.filter("error is null"))
    assert sorted((r.start_ms, r.text) for r in cues.collect()) == [(1000, "Hi"), (1000, "Ho")]


def test_labelled_values(spark, tmp_path):
    f = tmp_path / "values.txt"
    f.write_text("# head\n1762276748  login time \n\n  0\nabc bad\n+5\tx\n9999999999999999999 big\n7.5\n")
    got = [(r.line_no, r.value, r.label, r.error is not None)
           for r in readers.scan_labelled_values(spark, str(f)).orderBy("line_no").collect()]
    assert got == [(2, 1762276748, "login time", False), (4, 0, None, False), (5, None, "bad", True),
                   (6, 5, "x", False), (7, None, "big", True), (8, None, None, True)]
    assert readers.scan_labelled_values(spark, str(f), numbered=False).count() == 6


def test_ip_list(spark, tmp_path):
    f = tmp_path / "ips.txt"
    f.write_text("# list\n8.8.8.8\n\nbad\n ::1 \n")
    got = [(r.line_no, r.ip, r.error is not None)
           for r in readers.scan_ip_list(spark, str(f)).orderBy("line_no").collect()]
    assert got == [(2, "8.8.8.8", False), (4, "bad", True), (5, "::1", False)]


def test_review_flags(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"flags": [
        {"filePath": "/a", "segmentIndex": 3, "examinerNote": "n"},
        {"file_path": "/b", "segment_index": 1, "review_status": "done"}, {}]}, indent=1))
    (tmp_path / "b.json").write_text("{ not json")
    got = sorted(tuple(r) for r in readers.scan_review_flags(spark, str(tmp_path)).collect())
    assert got == [("", 0, "", "", ""), ("/a", 3, "n", "", ""), ("/b", 1, "", "done", "")]


def test_event_log(spark, tmp_path):
    (tmp_path / "log.ndjson").write_text(
        '{"type":"segment","index":1,"original":"a"}\n\nnoise\n{"type":"other"}\n{"type":"complete","total_segments":1}\n')
    got = readers.scan_event_log(spark, str(tmp_path))
    assert sorted((r["type"], r["index"], r["total_segments"]) for r in got.collect()) == [
        ("complete", None, 1), ("segment", 1, None)]
    lines = [r.value for r in writers.event_lines(got, ["type", "original"]).collect()]
    assert sorted(lines) == ['{"type":"complete"}', '{"type":"segment","original":"a"}']


def test_metrics_round_trip(spark, tmp_path):
    m = spark.createDataFrame([("a", 5, 0)], "test_name string, duration_ms bigint, position int")
    writers.write_metrics(m, str(tmp_path / "m"))
    assert readers.baseline_metrics(spark, str(tmp_path / "m")).collect() == m.collect()


def test_rule_and_range_tables(spark, tmp_path):
    R.rule_table(spark).write.parquet(str(tmp_path / "rules"))
    assert readers.rule_table(spark, str(tmp_path / "rules")).count() == 8
    spark.createDataFrame([(0, 9, "US")], "lo bigint, hi bigint, country_code string").write.parquet(
        str(tmp_path / "ranges"))
    assert readers.range_table(spark, str(tmp_path / "ranges")).first().hi == 9


def make_plan(spark):
    train = spark.createDataFrame(
        [("en", "the cat and the dog are in the house with the others"),
         ("de", "der hund und die katze sind in dem haus mit den anderen")], "lang string, text string")
    detect = langid.detector(langid.train_profile(train))
    files = spark.createDataFrame(
        [("/e/1.txt", "audio", 10, "the dog is in the house and the cat is there too now ok", "", None),
         ("/e/2.txt", "audio", 10, "der hund ist in dem haus und die katze ist auch da, ja", "", None),
         ("/e/3.txt", "audio", 10, "  ", "fr", None), ("/e/4.txt", "audio", 10, None, "", "decoder"),
         ("/e/5.png", "image", 0, "", "", None), ("/e/6.txt", "audio", 10, "der bad hund \"x\", <b>\nund", "", None),
         ("/e/7.srt", "subtitle", 10, "der hund ist in dem haus und die katze ist auch da, ja", "", None)],
        "file_path string, kind string, length bigint, text string, upstream_language string, error string")

    def failing():
        def run(texts):
            if any("bad" in t for t in texts):
                raise ValueError("model down")
            return [f"[en] {t}" for t in texts]
        return run

    return batch.run_batch(files, detect, failing, "en")


def test_batch_and_package(spark, tmp_path):
    out = str(tmp_path / "out")
    plan = batch.write_batch(make_plan(spark), out, 2.5, {"examiner": "E"})
    rows = {r.file_path: r for r in plan.results.collect()}
    assert rows["/e/1.txt"].detected_language == "en" and not rows["/e/1.txt"].is_foreign
    assert rows["/e/2.txt"].translated_text.startswith("[en] der") and rows["/e/2.txt"].notice
    assert rows["/e/3.txt"].detected_language == "fr" and rows["/e/3.txt"].source_text is None
    assert rows["/e/3.txt"].confidence_tier == "" and rows["/e/3.txt"].error is None
    assert rows["/e/4.txt"].error == "decoder" and rows["/e/5.png"].error == "corrupt"
    assert rows["/e/6.txt"].error == "ValueError: model down" and rows["/e/6.txt"].detected_language == ""
    c = plan.counters().first()
    assert (c.total_files, c.processed, c.errors, c.foreign_language, c.translated) == (7, 4, 3, 2, 2)
    s = spark.read.json(out + "/json/summary").first()
    assert s.dominant_language == "fr" or s.dominant_language == "de"
    assert s.processing_time_seconds == 2.5
    assert [g.language_code for g in spark.read.json(out + "/json/groups").collect()]
    csv = spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(out + "/csv")
    assert csv.columns == ["file_path", "input_type", "detected_language", "is_foreign", "transcript",
                           "translation", "error", "notice"] and csv.count() == 7
    assert {r.is_foreign for r in csv.collect()} == {"true", "false"}

    import hashlib
    digests = plan.results.select(
        "file_path", F.sha2(F.coalesce("source_text", F.lit("")), 256).alias("sha256"),
        F.lit(3).cast("bigint").alias("size_bytes"))
    segs = spark.createDataFrame(
        [("/e/2.txt", 0, 0, 100, "der", "[en] der"), ("/e/2.txt", 1, 100, 200, "hund", "[en] hund")],
        "file_path string, segment_index bigint, start_ms bigint, end_ms bigint, source_text string, translated_text string")
    flags = spark.createDataFrame(
        [("/e/2.txt", 1, "look", "in_progress"), ("/e/7.srt", 9, "", ""), ("", 0, "", "")],
        "file_path string, segment_index bigint, examiner_note string, review_status string")
    package.build_package(plan, digests, out + "/pkg", "/e", flags, segs, {"examiner": "E"})
    man = spark.read.json(out + "/pkg/manifest/files")
    assert man.count() == 7 and man.filter("translated").count() == 2
    head = spark.read.json(out + "/pkg/manifest/header").first()
    assert head.file_count == 7 and head.translated_count == 2 and head.machine_translation_notice
    bodies = {r.translation_file: r.body for r in spark.read.json(out + "/pkg/translation_rows").collect()}
    named = {r.original_path: r.translation_file for r in man.filter("translated").collect()}
    assert sorted(bodies) == sorted(named.values()) and len(bodies) == 2
    # the files of the package are those of its manifest, and no others
    found = {f"translations/{f.name}": f.read_text() for f in (tmp_path / "out" / "pkg" / "translations").iterdir()}
    assert found == bodies and not list((tmp_path / "out" / "pkg").glob("_staging*"))
    text = bodies[named["/e/2.txt"]]
    assert "# Source file: /e/2.txt\n" in text
    assert "[0 - 100 ms] der → [en] der\n[100 - 200 ms] hund → [en] hund\n" in text
    review = {r.file_path: r for r in spark.read.json(out + "/pkg/review").collect()}
    assert review["/e/2.txt"].original == "hund" and review["/e/2.txt"].status == "IN PROGRESS"
    assert review["/e/7.srt"].translation.startswith("[en] der hund") and review["/e/7.srt"].status == "NEEDS REVIEW"
    assert review["(unknown)"].original == "der"
    facts = {r.key: r.value for r in spark.read.json(out + "/pkg/custody").collect()}
    assert facts["examiner"] == "E" and facts["errors"] == "3"
    html = "".join(r.value for r in spark.read.text(out + "/pkg/report").collect())
    assert "errored" in html and "foreign" in html
    assert hashlib


def test_html_rows_of_one_language_span_ordered_files(spark, tmp_path):
    res = make_plan(spark).results.drop("file_path").limit(1)
    many = spark.range(400).withColumn("file_path", F.format_string("/f/%05d", "id")).join(
        res.withColumn("detected_language", F.lit("de")))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # tiny data would merge
    writers.write_html_fragments(many, str(tmp_path / "h"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    back = spark.read.text(str(tmp_path / "h")).withColumn("f", F.col("_metadata.file_path"))
    files = {}
    for r in back.collect():
        files.setdefault(r.f, []).append(r.value)
    assert len(files) > 1 and sum(map(len, files.values())) == 400
    assert all(v == sorted(v) for v in files.values())


def listing(folder):
    return sorted(str(f.relative_to(folder)) for f in folder.rglob("*") if f.is_file())


def test_artefacts_are_all_or_none(spark, tmp_path):
    """A task that fails leaves nothing; repeated and later sets leave exactly their own files."""
    out = tmp_path / "set"
    rows = [(f"t/{i % 7}/{i}.txt", p, f"{i}:{p};") for i in range(40) for p in (2, 0, 1)]
    df = spark.createDataFrame(rows, "name string, part int, body string").repartition(5)
    bad = df.withColumn("body", F.when(F.col("name") == "t/3/17.txt", F.raise_error(F.lit("broken"))).otherwise(F.col("body")))
    with pytest.raises(Exception):
        artefacts.write_artefacts(bad, str(out))
    assert not out.exists() or listing(out) == []
    artefacts.write_artefacts(df, f"file:{out}")
    names = sorted({n for n, _, _ in rows})
    assert listing(out) == ["_ARTEFACTS", *names] and (out / "_ARTEFACTS").read_text().split() == names
    assert (out / "t/3/17.txt").read_text() == "17:0;17:1;17:2;"
    with pytest.raises(Exception):
        artefacts.write_artefacts(df.limit(3), str(out), overwrite=False)
    assert listing(out) == ["_ARTEFACTS", *names]
    (out / "own.txt").write_text("kept")  # a file of somebody else
    artefacts.write_artefacts(df.filter("name < 't/2'").withColumn("body", F.lit("é")), str(out))
    left = sorted(n for n in names if n < "t/2")
    assert listing(out) == sorted(["_ARTEFACTS", "own.txt", *left]) and (out / left[0]).read_text() == "ééé"
    for name in ("../x.txt", "/x.txt", "", None, "a/../../x"):
        with pytest.raises(Exception):
            artefacts.write_artefacts(spark.createDataFrame([(name, 0, "x")], "name string, part int, body string"), str(out))
    assert listing(out) == sorted(["_ARTEFACTS", "own.txt", *left]) and not list(tmp_path.glob("*.txt"))


def test_a_repeated_attempt_does_not_count(tmp_path):
    """Two attempts of one task wrote files; the message of one comes back."""
    import pyarrow as pa

    out = tmp_path / "set"
    w = artefacts.ArtefactWriter(str(out), False)
    batch = pa.RecordBatch.from_pydict({"name": ["a/x.txt", "a/x.txt", "b.txt"], "part": [0, 1, 0], "body": ["1", "2", None]})
    first, again = w.write(iter([batch.slice(0, 2)])), w.write(iter([batch]))
    assert first.folder != again.folder and not (out / "a").exists()
    w.commit([again, None])
    assert listing(out) == ["_ARTEFACTS", "a/x.txt", "b.txt"] and (out / "a/x.txt").read_text() == "12"
    w = artefacts.ArtefactWriter(str(out), True)
    w.write(iter([batch]))
    w.abort([None])
    assert listing(out) == ["_ARTEFACTS", "a/x.txt", "b.txt"]


def test_artefact_parts_equal_whole_texts(spark):
    results = make_plan(spark).results
    seg = spark.range(9000).select(
        F.lit("/e/2.txt").alias("file_path"), F.col("id").alias("segment_index"), F.col("id").alias("start_ms"),
        (F.col("id") + 1).alias("end_ms"), F.lit("a").alias("source_text"), F.lit("b").alias("translated_text"))
    seg = seg.unionByName(seg.limit(2).withColumn("file_path", F.lit("/e/other")))
    whole = {r.file_path: r.body for r in writers.translation_text(results, seg).collect()}
    parts = {}
    for r in writers.translation_parts(results, seg).orderBy("file_path", "part").collect():
        parts.setdefault(r.file_path, []).append(r.body)
    assert {k: "".join(v) for k, v in parts.items()} == whole and len(parts["/e/2.txt"]) == 5
