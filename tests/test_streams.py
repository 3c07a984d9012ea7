"""Streams against the same operators on tables."""

import os
import time

import pytest
from pyspark.sql import functions as F

from lingotally import session
from lingotally.operators import infer, langid
from lingotally.streaming import live, progress, runner


@pytest.fixture
def events(spark, sf, tmp_path):
    """The event table as several files that arrive in order."""
    e = spark.read.parquet(f"{sf}/events.parquet")
    out = tmp_path / "events"
    e.repartitionByRange(6, "event_id").write.parquet(str(out))
    for i, f in enumerate(sorted(out.glob("part-*"))):
        os.utime(f, (1_700_000_000 + 60 * i,) * 2)
    return str(out)


def stream(spark, folder, per_trigger=1):
    return runner.file_stream(spark, folder, "*.parquet", per_trigger)


def test_chunks_stream_equals_batch(spark, events):
    def chunks(df):
        return live.live_chunks(df.withColumnRenamed("user_id", "source_id"), "1 hour").withColumn(
            "rms", F.round("rms", 6))
    got = runner.run_available(chunks(stream(spark, events)), "complete", "c")
    want = chunks(spark.read.parquet(events))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    loud = live.drop_silence(want, 50.0)
    assert loud.filter("rms < 50").count() == 0 and 0 < loud.count() < want.count()


def test_sessions_stream_equals_batch(spark, events):
    def chunks(df):
        return live.session_summary(df.select(
            F.col("user_id").alias("session_id"), F.col("event_id").alias("chunk_idx"),
            F.col("event_type").alias("language"), F.lit(None).cast("string").alias("error")))
    got = runner.run_available(chunks(stream(spark, events, 2)), "update", "s", ["session_id"])
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, chunks(spark.read.parquet(events)).collect()))


def log(df):
    return df.select(
        F.col("event_id").alias("seq"), (F.col("user_id") % 2).alias("run_id"),
        F.concat(F.lit("/"), F.col("user_id").cast("string")).alias("path"), F.lit("done").alias("type"),
        (F.col("value") > 50).alias("is_foreign"), (F.col("value") > 75).alias("translated"),
        F.when(F.col("event_type") == "error", "x").alias("error"))


def run(stream_df, writer, base):
    q = (stream_df.writeStream.option("checkpointLocation", base + "/ck").trigger(availableNow=True)
         .foreachBatch(writer).start())
    q.awaitTermination()
    return q.lastProgress["batchId"]


def test_progress_snapshots(spark, events, tmp_path):
    out = str(tmp_path / "p")
    writer = progress.progress_snapshot(out, started=time.time() - 5, target="en", total=99)
    last = run(log(stream(spark, events)), writer, out)
    assert last >= 5
    snap = {r.run_id: r for r in spark.read.parquet(f"{out}/batch={last}").collect()}
    table = log(spark.read.parquet(events))
    want = {r.run_id: r for r in progress.batch_progress(table).collect()}
    for k, w in want.items():
        assert all(snap[k][c] == w[c] for c in ("processed", "errors", "foreign_files", "translated_files"))
        newest = [r.path for r in table.filter(f"run_id = {k}").orderBy(F.desc("seq")).limit(8).collect()][::-1]
        assert [x.path for x in snap[k].recent] == newest and snap[k].complete is False
        assert (snap[k].target_language, snap[k].total_files) == ("en", 99) and snap[k].elapsed_seconds > 5


def test_follow_until_end(spark, events, tmp_path):
    def ev(df):
        return df.select(F.col("event_id").alias("seq"), F.col("user_id").alias("run_id"),
                         F.when(F.col("event_type") == "error", "error").otherwise("segment").alias("type"))
    out = str(tmp_path / "f")
    run(ev(stream(spark, events)), progress.follow_sink(out), out)
    got = spark.read.parquet(f"{out}/events").drop("batch")
    want = progress.until_end(ev(spark.read.parquet(events)))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert got.filter("type = 'error'").groupBy("run_id").count().filter("count > 1").count() == 0


def test_errors_go_to_their_own_table(spark, events, tmp_path):
    def chunks(df):
        return df.select(F.col("user_id").alias("session_id"), F.col("event_id").alias("chunk_idx"),
                         F.when(F.col("event_type") == "error", "failed").alias("error"))
    out = str(tmp_path / "e")
    run(chunks(stream(spark, events, 3)), live.split_sink(out + "/good", out + "/bad"), out)
    n = spark.read.parquet(events).groupBy(F.col("event_type") == "error").count().collect()
    n = {r[0]: r["count"] for r in n}
    assert spark.read.parquet(out + "/good").count() == n[False]
    assert spark.read.parquet(out + "/bad").count() == n[True]


def test_ordered_events(spark, events, tmp_path):
    out = str(tmp_path / "o")
    src = stream(spark, events, 6).select("user_id", "event_id")
    run(src, progress.ordered_event_sink(out, ["user_id", "event_id"]), out)
    files = sorted((tmp_path / "o" / "batch=0").glob("part-*"))
    lines = [ln for f in files for ln in f.read_text().splitlines()]
    parsed = [tuple(int(x.split(":")[1].strip("}")) for x in ln.split(",")) for ln in lines]
    assert parsed == sorted(parsed) and len(parsed) == spark.read.parquet(events).count()


def test_enrich_stream_keeps_failed_translations(spark):
    train = spark.createDataFrame([("en", "the cat and the dog"), ("de", "der hund und die katze")],
                                  "lang string, text string")
    detect = langid.detector(langid.train_profile(train))
    chunks = spark.createDataFrame(
        [(1, "the dog and the cat", ""), (2, "der hund und die bad", ""), (3, "die katze und der hund", ""),
         (4, " ", ""), (5, "ЩЩЩЩ", "ru"), (6, "ЩЩЩЩ", "")], "i int, text string, upstream_language string")

    def model():
        def go(texts):
            if any("bad" in t for t in texts):
                raise ValueError("x")
            return [f"[en] {t}" for t in texts]
        return go

    got = {r.i: (r.language, r.translated) for r in live.enrich_stream(chunks, detect, model, "en").collect()}
    assert got == {1: ("en", "the dog and the cat"), 2: ("de", "der hund und die bad"),
                   3: ("de", "[en] die katze und der hund"), 5: ("ru", "[en] ЩЩЩЩ"), 6: ("", "ЩЩЩЩ")}
    assert infer.tagging_model("en")()(["x"]) == ["[en] x"]


def test_durable_cuts_lineage(spark):
    df = session.durable(spark.range(10).withColumn("x", F.col("id") * 2))
    assert df.count() == 10 and "Range" not in df._jdf.queryExecution().toString().split("Physical")[1]
    assert session.work_dir(spark, "w") != session.work_dir(spark, "w")


def test_last_partial_chunk_can_be_left_out(spark):
    """Three samples a second for seven seconds: two whole chunks of nine samples, one of three."""
    df = spark.range(21).select(F.lit("s").alias("source_id"), F.lit(1.0).alias("value"),
                                F.timestamp_millis(F.floor(F.col("id") * 1000 / 3).cast("bigint")).alias("ts"))
    assert [r.n_samples for r in live.live_chunks(df).orderBy("chunk_start").collect()] == [9, 9, 3]
    assert [r.n_samples for r in live.live_chunks(df, full=9).orderBy("chunk_start").collect()] == [9, 9]


def test_work_folders_are_removed(spark):
    import pathlib

    folder = session.work_dir(spark, "gone")
    spark.range(3).write.parquet(folder)
    own = pathlib.Path(folder.removeprefix("file:"))
    assert own.exists() and session.drop_work(spark) >= 1 and not own.exists()
    assert session.drop_work(spark) == 0


def test_clusters_need_a_shared_folder():
    assert session.is_shared("local[4]", "file:/x") and session.is_shared("yarn", "hdfs://n/x")
    assert not session.is_shared("yarn", "file:/x") and not session.is_shared("local-cluster[2,1,1024]", "/x")


def test_snapshots_and_ends_of_null_runs(spark, tmp_path):
    schema = "seq int, run_id string, path string, type string, error string, is_foreign boolean, translated boolean"
    rows = [(1, None, "/a", "done", None, True, False), (2, "r", "/b", "done", "x", False, False),
            (3, None, "/c", "complete", None, None, None), (4, None, "/d", "done", None, False, True), (5, "r", "/e", "error", None, None, None)]
    df = spark.createDataFrame(rows, schema)
    out = str(tmp_path / "p")
    progress.progress_snapshot(out)(df, 0)
    progress.progress_snapshot(out)(df, 1)
    snap = {r.run_id: r for r in spark.read.parquet(out + "/batch=1").collect()}
    assert snap[None].processed == 4 and snap["r"].errors == 2 and len(snap[None].recent) == 4
    ended = progress.until_end(df)
    assert sorted(r.seq for r in ended.collect()) == [1, 2, 3, 5]
    progress.follow_sink(out + "/f")(df, 0)
    assert sorted(r.seq for r in spark.read.parquet(out + "/f/events").collect()) == [1, 2, 3, 5]
