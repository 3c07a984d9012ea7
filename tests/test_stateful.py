"""Keyed-state streams against the same operators on tables, in any order of arrival and across restarts."""

import os
import pickle
import random
import time
from types import SimpleNamespace

import pyarrow as pa
import pytest
from pyspark.sql import Row, functions as F

from lingotally import refdata as R
from lingotally.plans import translate as P
from lingotally.session import checkpoints
from lingotally.streaming import runner, stateful


@pytest.fixture(scope="module")
def spark(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")  # a Python worker per partition and batch
    yield stateful.stateful(checkpoints(spark))
    spark.conf.set("spark.sql.shuffle.partitions", before)
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def as_files(df, folder, parts, order=None):
    """Parquet files that arrive in order; rows keep theirs inside a file."""
    df.repartition(parts).write.parquet(folder) if order is None else df.repartitionByRange(
        parts, order).sortWithinPartitions(order).write.parquet(folder)
    for i, f in enumerate(sorted(x for x in os.listdir(folder) if x.startswith("part-"))):
        os.utime(f"{folder}/{f}", (1_700_000_000 + 60 * i,) * 2)


def append(out):
    def write(batch, batch_id):
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")
    return write


def run(df, out, mode="append"):
    q = (df.writeStream.outputMode(mode).option("checkpointLocation", f"{out}-ck").trigger(availableNow=True)
         .foreachBatch(append(out)).start())
    q.awaitTermination()
    return q


SEGMENT = "doc_id bigint, seg_idx int, text string, translated_text string, error string"


def test_segments_come_out_in_order(spark, tmp_path, monkeypatch):
    """Shuffled micro-batches, blank and failed segments, rows sent twice, a document without segments."""
    r = random.Random(4)
    segs, totals = [], [(99, 0), (None, 2)]
    for d in range(12):
        n = r.choice([1, 3, 40])
        totals.append((d, n))
        for i in range(n):
            text = None if (d + i) % 11 == 10 else " \t" if (d + i) % 5 == 4 else f"text {d} {i}"
            bad = "failed" if (d * i) % 7 == 6 else None
            segs.append((d, i, text, None if bad else f"[en] {text}", bad))
    segs += [(None, 1, "b", "B", None), (None, 0, "a", "A", None)]
    segments = spark.createDataFrame(segs, SEGMENT)
    known = spark.createDataFrame(totals, "doc_id bigint, total_segments int")
    twice = segments.unionByName(segments.filter("seg_idx % 3 = 0"))
    rows = stateful.segment_rows(twice, known)
    as_files(rows, str(tmp_path / "in"), 9)
    out = str(tmp_path / "out")
    run(stateful.segment_stream(runner.file_stream(spark, str(tmp_path / "in"), "*.parquet", 1)), out)
    got = spark.read.parquet(out).drop("batch").collect()
    want = []
    for d, n in totals:
        own = sorted((s for s in segs if s[0] == d), key=lambda s: s[1])
        sent = 0
        for _, i, text, translated, bad in own:
            if (text or "").strip():
                want.append((d, sent, 2, i, "error" if bad else "segment", None if bad else text, translated, bad,
                             None if bad else True, None, None))
                sent += 1
        want.append((d, sent, 3, 0, "complete", None, None, None, None, n, R.MT_NOTICE))
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    # the same fields as the events of a table
    classified = spark.createDataFrame(
        [(d, "de", None, None, 0.9, "x") for d, _ in totals if d is not None],
        "doc_id bigint, language string, dialect string, dialect_confidence double, confidence double, text string")
    table = P.run_events(classified, segments.filter("doc_id is not null"), "en").filter("stage >= 2")
    fields = ["doc_id", "stage", "index", "type", "original", "translated", "message", "is_complete", "total_segments"]
    mine = [tuple(x[c] for c in fields) for x in got if x.doc_id is not None]
    assert sorted(mine, key=repr) == sorted((tuple(x[c] for c in fields) for x in table.collect()), key=repr)


def test_a_crowded_document_overflows_to_the_store(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(stateful, "HELD", 50)
    n = 1000
    seg = spark.range(n).select(F.lit(1).cast("bigint").alias("doc_id"), F.col("id").cast("int").alias("seg_idx"),
                                F.concat(F.lit("s"), "id").alias("text"), F.lit("t").alias("translated_text"),
                                F.lit(None).cast("string").alias("error")).orderBy(F.desc("seg_idx"))
    rows = stateful.segment_rows(seg, spark.createDataFrame([(1, n)], "doc_id bigint, total_segments int"))
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    out = str(tmp_path / "out")
    run(stateful.segment_stream(runner.file_stream(spark, str(tmp_path / "in"), "*.parquet", 1)), out)
    got = spark.read.parquet(out).orderBy("sent").collect()
    assert [x["index"] for x in got] == [*range(n), 0] and got[-1].type == "complete"


class Store:
    """State of one key that counts its calls; all the kinds of state in one."""

    def __init__(self):
        self.calls, self.values, self.timers = 0, {}, set()

    def state(self, name):
        store = self

        class State:
            def __getattr__(self, call):
                def run(*args):
                    store.calls += 1
                    k = (name, args[0]) if call in ("getValue", "containsKey", "updateValue", "removeKey") else name
                    if call in ("update", "put", "updateValue"):
                        store.values[k] = args[-1]
                    elif call == "removeKey":
                        store.values.pop(k, None)
                    elif call == "clear":
                        for x in [x for x in store.values if x == name or x[0] == name]:
                            del store.values[x]
                    elif call in ("exists", "containsKey"):
                        return k in store.values
                    elif call in ("get", "getValue"):
                        return store.values.get(k, [] if name in ("open", "ring") else None)
                return run

        return State()

    def getValueState(self, name, *_):
        return self.state(name)

    getListState = getMapState = getValueState

    def registerTimer(self, at):
        self.calls += 1
        self.timers.add(at)

    def deleteTimer(self, at):
        self.calls += 1
        self.timers.discard(at)

    def listTimers(self):
        self.calls += 1
        return sorted(self.timers)


def test_segments_cost_a_few_store_calls(monkeypatch):
    """Documents of 80 and 1 000 segments in any order, over six micro-batches: calls by chunk, not by segment."""
    monkeypatch.setattr(stateful, "HELD", 300)
    event = [c.split()[0] for c in ("doc_id bigint, " + stateful.EVENT).split(", ")]
    for n, most in ((80, 6 * 6), (1000, 6 * 40)):
        r, store = random.Random(n), Store()
        op = stateful._InOrder(event)
        op.init(store)
        rows = [(i, None if i % 7 == 3 else f"s{i}", "t", "bad" if i % 5 == 4 else None, None, 1) for i in range(n)]
        rows += rows[::9] + [(None, None, None, None, n, 1)]
        r.shuffle(rows)
        fields = Row("index", "original", "translated", "message", "total_segments", "doc_id")
        got = []
        for b in range(6):
            got += op.handleInputRows((1,), iter([fields(*x) for x in rows[b::6]]), None)
        shown = [i for i in range(n) if i % 7 != 3]
        assert [x["index"] for x in got] == [*shown, 0] and [x.sent for x in got] == list(range(len(shown) + 1))
        assert [x.type for x in got] == ["error" if i % 5 == 4 else "segment" for i in shown] + ["complete"]
        assert store.calls <= most and list(store.values) == ["head"]


def bucket_run(rows, batches):
    """Events of the documents of one bucket, their rows dealt to ``batches`` micro-batches, and the store."""
    event = [c.split()[0] for c in ("doc_id bigint, " + stateful.EVENT).split(", ")]
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_()}
    schema = pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in ("doc_id bigint, " + stateful.EVENT).split(", ")])
    store, out = Store(), []
    op = stateful._Buckets("doc_id", "bigint", event, schema)
    op.init(store)
    for b in range(batches):
        own = rows[b::batches]
        packed = [(0, pickle.dumps([*map(list, zip(*own[i:i + 70]))])) for i in range(0, len(own), 70)]
        for r in op.handleInputRows((0,), iter(packed), None):
            out += pa.ipc.open_stream(r.events).read_all().to_pylist()
    return store, out


@pytest.mark.parametrize("held, page, near", [(100_000, 64 << 10, 8), (200, 2000, 1)])
def test_documents_share_calls_of_the_store(monkeypatch, held, page, near):
    """300 documents, one of them long and one without an id, in four micro-batches: pages of documents are read and
    written, also when they double in number or chunks of a document lie apart."""
    monkeypatch.setattr(stateful, "HELD", held)
    monkeypatch.setattr(stateful, "PAGE", page)
    monkeypatch.setattr(stateful, "NEAR", near)
    r = random.Random(9)
    docs = {d: r.randint(0, 12) for d in [None, *range(299)]} | {7: 700}
    rows = []
    for d, n in docs.items():
        h = r.getrandbits(63) // stateful.BUCKETS * stateful.BUCKETS - (1 << 62)
        rows += [(h, i, None if i % 7 == 3 else f"s{d} {i}", "t", "bad" if i % 5 == 4 else None, None, d) for i in range(n)]
        rows.append((h, None, None, None, None, n, d))
    rows += rows[::9]
    r.shuffle(rows)
    store, out = bucket_run(rows, 4)
    for d, n in docs.items():
        shown = [i for i in range(n) if i % 7 != 3]
        own = [x for x in out if x["doc_id"] == d]
        assert [(x["sent"], x["index"], x["type"], x["original"]) for x in own] == [
            *((k, i, "error" if i % 5 == 4 else "segment", None if i % 5 == 4 else f"s{d} {i}")
              for k, i in enumerate(shown)), (len(shown), 0, "complete", None)]
        assert own[-1]["total_segments"] == n
    assert not [k for k in store.values if k[0] == "far"]
    if held > len(rows):
        assert store.calls < len(docs)


CHUNK = "session_id string, ts timestamp, chunk_idx int, language string, error string"


def chunk_table(spark):
    """Sessions of three sources, one of them null, with pauses; a clock row long after all."""
    r, rows = random.Random(7), []
    for s in ("a", "b", None):
        at, idx = 1_700_000_000, 0
        for _ in range(4):
            for _ in range(r.randint(1, 12)):
                bad = r.random() < 0.2
                rows.append((s, at, idx, None if bad else r.choice(["de", "fr"]), "x" if bad else None))
                at, idx = at + r.randint(1, 30), idx + 1
            at += 200
    rows.append(("clock", 1_700_100_000, 0, "en", None))
    df = spark.createDataFrame(rows, CHUNK.replace("timestamp", "bigint"))
    return df.withColumn("ts", F.timestamp_seconds("ts"))


def test_sessions_share_a_timer():
    """Thirty sessions of a source cost a few calls of the store; those that are due end together."""
    gap, hour = 1000, 3_600_000
    names = [c.split()[0] for c in ("session_id string, " + stateful.SUMMARY).split(", ")]
    store, clock = Store(), {"now": 0}
    op = stateful._Sessions(gap, 10, names)
    op.init(store)
    values = SimpleNamespace(getCurrentWatermarkInMs=lambda: clock["now"])
    row = Row("at_ms", "chunk_idx", "language", "error", "session_id", "ts")

    def fire():
        out = []
        for at in sorted(t for t in store.timers if t < clock["now"]):
            out += op.handleExpiredTimer(("a",), values, SimpleNamespace(getExpiryTimeInMs=lambda: at))
            store.timers.discard(at)
        return out

    chunks = [row(i * hour + j * 500, 3 * i + j, "de", None, "a", None) for i in range(30) for j in range(3)]
    random.Random(3).shuffle(chunks)
    begun = [*op.handleInputRows(("a",), iter(chunks[:50]), values), *op.handleInputRows(("a",), iter(chunks[50:]), values)]
    assert {x.started_ms // hour for x in begun} == set(range(30))
    clock["now"] = 20 * hour
    ended = fire()
    assert [(x.at_ms, x.n_chunks, x.total_chunks) for x in ended] == [(i * hour + 2000, 3, 3 * i + 3) for i in range(20)]
    assert fire() == [] and len(store.timers) == 1
    list(op.handleInputRows(("a",), iter([row(20 * hour + 1200, 99, "fr", None, "a", None)]), values))
    clock["now"] = 40 * hour
    ended = fire()
    assert len(ended) == 10 and (ended[0].n_chunks, ended[0].last_language) == (4, "fr")
    assert not store.timers and not store.values and store.calls <= 25


@pytest.mark.parametrize("parts", [1, 6])
def test_sessions_stop_by_silence(spark, tmp_path, parts):
    chunks = chunk_table(spark)
    as_files(chunks, str(tmp_path / "in"), parts, "ts")
    out = str(tmp_path / "out")
    run(stateful.live_sessions(runner.file_stream(spark, str(tmp_path / "in"), "*.parquet", 1)), out)
    got = spark.read.parquet(out).drop("batch")
    until = 1_700_100_000_000 - 10_000
    want = stateful.session_log(chunks, until=until)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)
    assert got.filter("type = 'live_stopped'").count() == 12 == want.filter("type = 'live_stopped'").count()
    assert got.filter("session_id = 'clock'").collect()[0].type == "live_started"


def test_sessions_go_on_after_a_restart(spark, tmp_path):
    """The query ends in the middle of a session and is started again from its checkpoint."""
    chunks = chunk_table(spark)
    at = F.unix_seconds("ts")
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    cut = chunks.filter("session_id = 'a'").select(at).orderBy(at).collect()[5][0]
    chunks.filter(at <= cut).coalesce(1).write.parquet(folder)

    def once():
        run(stateful.live_sessions(runner.file_stream(spark, folder, "*.parquet", 5)), out)

    once()
    half = spark.read.parquet(out).count()
    chunks.filter(at > cut).coalesce(1).write.mode("append").parquet(folder)
    once()
    got = spark.read.parquet(out).drop("batch").collect()
    want = stateful.session_log(chunks, until=1_700_100_000_000 - 10_000).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, want), key=repr) and 0 < half < len(got)


def test_progress_keeps_null_runs_and_flat_cost(spark, tmp_path):
    """Fifty batches of the same size over growing numbers of runs: the last cost what the first did."""
    n, per = 50, 20
    rows = spark.range(n * per).select(
        F.col("id").alias("seq"), (F.col("id") % 7).cast("int").alias("k"), F.col("id").alias("id"))
    events = rows.select(
        "seq", F.when(F.col("k") == 0, None).when(F.col("k") == 1, F.concat(F.lit("old"), F.floor(F.col("id") / per))).otherwise(
            F.concat(F.lit("r"), "k")).alias("run_id"), F.concat(F.lit("/p"), "id").alias("path"),
        F.when(F.col("id") % 13 == 0, "started").otherwise("done").alias("type"),
        F.when(F.col("id") % 5 == 0, "bad").when(F.col("id") % 5 == 1, "").alias("error"),
        (F.col("id") % 2 == 0).alias("is_foreign"), (F.col("id") % 4 == 0).alias("translated"))
    as_files(events, str(tmp_path / "in"), n, "seq")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    out = str(tmp_path / "out")
    q = run(stateful.run_progress(runner.file_stream(spark, str(tmp_path / "in"), "*.parquet", 1)), out, "update")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    took = [p["durationMs"]["triggerExecution"] for p in q.recentProgress if p["numInputRows"]]
    assert len(took) >= 40
    early, late = sorted(took[2:12])[5], sorted(took[-10:])[5]
    assert late <= 2 * early + 1000
    newest = spark.read.parquet(out).groupBy("run_id").agg(F.max_by(F.struct(
        *stateful.COUNTERS, "recent"), "batch").alias("r")).collect()
    got = {r.run_id: tuple(r.r) for r in newest}
    table = {}
    for e in events.orderBy("seq").collect():
        if e.type == "done":
            table.setdefault(e.run_id, []).append(e)
    assert None in got and got.keys() == table.keys()
    for k, own in table.items():
        good = [e for e in own if not e.error]
        assert got[k] == (len(good), len(own) - len(good), sum(e.is_foreign for e in good),
                          sum(e.translated for e in good), [e.path for e in own[-8:]])


def test_idle_runs_are_forgotten(spark, tmp_path):
    schema = "seq int, run_id string, path string, type string, error string, is_foreign boolean, translated boolean"
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")

    def send(i):
        spark.createDataFrame([(i, "a", f"/{i}", "done", None, True, False)], schema).coalesce(1).write.mode("append").parquet(folder)

    send(1)
    seen = []
    rows = stateful.run_progress(runner.file_stream(spark, folder, "*.parquet"), ttl_ms=3000)
    q = (rows.writeStream.outputMode("update").option("checkpointLocation", f"{out}-ck").trigger(processingTime="1 second")
         .foreachBatch(lambda batch, _: seen.extend(batch.collect())).start())
    try:
        until = time.time() + 180
        while time.time() < until and not seen:
            time.sleep(1)
        time.sleep(5)
        send(2)
        while time.time() < until and len(seen) < 2:
            time.sleep(1)
    finally:
        q.stop()
    assert [list(r.recent) for r in seen] == [["/1"], ["/2"]] and seen[-1].processed == 1
