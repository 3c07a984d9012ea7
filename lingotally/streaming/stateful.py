"""Keyed state with buffers and timers: segments in order, live sessions that end by silence, last paths of a run.

The three operators keep one small state per key in the state store (RocksDB, see ``stateful``) and read or
write only what a micro-batch touches, so a batch costs its own rows, however long the stream has run.
"""

from __future__ import annotations

import gc
import pickle
import sys
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row, SparkSession, Window, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from lingotally import refdata as R
from lingotally.functions import text as X

cloudpickle.register_pickle_by_value(sys.modules[__name__])

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stateful(spark: SparkSession) -> SparkSession:
    """Keyed state needs the RocksDB store; a query keeps the store it was started with."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    return spark


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def _schema(df: DataFrame, key: str, rest: str) -> str:
    return f"`{key}` {df.schema[key].dataType.simpleString()}, {rest}"


# ---- segments in order -------------------------------------------------------------------------

EVENT = ("sent bigint, stage int, index bigint, type string, original string, translated string, message string, "
         "is_complete boolean, total_segments bigint, machine_translation_notice string")
HELD = 10_000  # rows of a document, or of a bucket of them, that a task holds outside the state store
WIDTH = 128  # neighbours by index that wait as one value of the store
BUCKETS = 2048  # keys of the state; fixed, because a stream goes on with the buckets it was started with
PAGE = 64 << 10  # bytes of documents that are read and written together, on average
NEAR = 8  # chunks of a document that lie in its page; further ones are values of their own
PACK = 16 << 20  # bytes of segments that a task packs at once


def segment_rows(segments: DataFrame, totals: DataFrame, key: str = "doc_id", idx: str = "seg_idx") -> DataFrame:
    """Input of ``segment_stream``: translated segments (text, translated_text, error), blank ones included, and
    one row per document with ``total_segments``, in any order."""
    own = segments.select(key, F.col(idx).cast("bigint").alias("index"), F.col("text").alias("original"),
                          F.col("translated_text").alias("translated"), F.col("error").alias("message"),
                          F.lit(None).cast("bigint").alias("total_segments"))
    return own.unionByName(totals.select(key, F.col("total_segments").cast("bigint")), allowMissingColumns=True)


class _InOrder(StatefulProcessor):
    """Releases the segments of a document by index; ``complete`` follows the last one.

    Every call of the store is a round trip, so segments wait in chunks of ``WIDTH`` neighbours: a document costs a
    few calls per micro-batch and chunk that it touches, not some per segment.
    """

    def __init__(self, names: list[str]):
        self.names = names

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.row = Row(*self.names)
        self.head = handle.getValueState("head", "next bigint, sent bigint, total bigint, ended boolean, chunks bigint")
        self.waiting = handle.getMapState(
            "waiting", "chunk bigint",
            "`index` array<bigint>, original array<string>, translated array<string>, message array<string>")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        self.following, self.sent, total, ended, self.chunks = self.head.get() or (0, 0, None, False, 0)
        if ended:
            return
        held: dict[int, dict[int, tuple]] = {}
        n = 0
        for index, original, translated, message, total_segments, _ in rows:
            if total is None:
                total = total_segments
            if index is not None and index >= self.following:
                held.setdefault(index // WIDTH, {}).setdefault(index, (original, translated, message))
                n += 1
            if n > HELD:
                yield from self._settle(key, held)
                n = 0
        yield from self._settle(key, held)
        if total is not None and self.following >= total:
            yield self.row(*key, self.sent, 3, 0, "complete", None, None, None, None, total, R.MT_NOTICE)
            if self.chunks:
                self.waiting.clear()
            self.chunks, ended = 0, True
        self.head.update((self.following, self.sent, total, ended, self.chunks))

    def _settle(self, key, held: dict[int, dict[int, tuple]]) -> Iterator[Row]:
        """Sends what can go out and stores the rest, so that nothing stays outside the store."""
        while True:
            no = self.following // WIDTH
            own, stored = self._chunk(no, held.pop(no, {}))
            first = self.following
            while self.following // WIDTH == no and self.following in own:
                segment = own.pop(self.following)
                if segment[0] is not None:
                    yield self._event(key, self.following, segment)
                    self.sent += 1
                self.following += 1
            if self.following // WIDTH == no:
                if len(own) != stored or self.following > first:
                    self._put(no, own, stored)
                break
            if stored:
                self.waiting.removeKey((no,))
                self.chunks -= 1
        for no, rest in held.items():
            own, stored = self._chunk(no, rest)
            if len(own) > stored:
                self._put(no, own, stored)
        held.clear()

    def _chunk(self, no: int, new: dict[int, tuple]) -> tuple[dict[int, tuple], int]:
        """Segments of a chunk, those that came first kept, and how many of them the store has."""
        found = self.waiting.getValue((no,)) if self.chunks else None
        old = {i: own for i, *own in zip(*found)} if found is not None else {}
        return {**new, **old}, len(old)

    def _put(self, no: int, own: dict[int, tuple], stored: int) -> None:
        if own:
            self.waiting.updateValue((no,), (list(own), *map(list, zip(*own.values()))))
        elif stored:
            self.waiting.removeKey((no,))
        self.chunks += bool(own) - bool(stored)

    def _event(self, key, index: int, own: tuple) -> Row:
        original, translated, message = own
        if message is not None:
            return self.row(*key, self.sent, 2, index, "error", None, None, message, None, None, None)
        return self.row(*key, self.sent, 2, index, "segment", original, translated, None, True, None, None)

    def close(self) -> None:
        pass


class _Held:
    """The state of one document at a time as ``_InOrder`` asks for it: its head and first chunks out of a page, the
    chunks far on from the store."""

    def __init__(self, far):
        self.far = far

    def getValueState(self, *_):
        return self

    getMapState = getValueState

    def turn(self, key, doc: dict) -> None:
        self.key, self.doc = key, doc

    def get(self):
        return self.doc.get("head")

    def update(self, head: tuple) -> None:
        self.doc["head"] = head

    def getValue(self, no: tuple):
        if no[0] < NEAR:
            return self.doc.get(no[0])
        found = self.far.getValue((self.key, *no)) if no[0] in self.doc else None
        return found and pickle.loads(found[0])

    def updateValue(self, no: tuple, chunk: tuple) -> None:
        self.doc[no[0]] = chunk if no[0] < NEAR else None
        if no[0] >= NEAR:
            self.far.updateValue((self.key, *no), (pickle.dumps(chunk),))

    def removeKey(self, no: tuple) -> None:
        if self.doc.pop(no[0], None) is None:
            self.far.removeKey((self.key, *no))

    def clear(self) -> None:
        for no in [no for no in self.doc if no != "head"]:
            self.removeKey((no,))


class _Buckets(StatefulProcessor):
    """``_InOrder`` for all documents of a bucket. A call of the store and a batch of rows per document cost more than
    the documents, so these share pages of some ``PAGE`` bytes, and rows come and go packed. A micro-batch reads and
    writes the pages that its documents lie in; pages double in number as they grow."""

    def __init__(self, key: str, kind: str, names: list[str], schema: pa.Schema):
        self.key, self.kind, self.names, self.schema = key, kind, names, schema

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.row = Row("events")
        self.size = handle.getValueState("size", "pages bigint, bytes bigint")
        self.pages = handle.getMapState("pages", "page bigint", "docs binary")
        self.held = _Held(handle.getMapState("far", f"`{self.key}` {self.kind}, chunk bigint", "segments binary"))
        self.one = _InOrder(self.names)
        self.one.init(self.held)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        collects = gc.isenabled()
        gc.disable()  # thousands of rows without a cycle, walked over and over, took half the time
        try:
            yield from self._handle(rows)
        finally:
            if collects:
                gc.enable()

    def _handle(self, rows: Iterator[Row]) -> Iterator[Row]:
        self.count, self.bytes = self.size.get() or (1, 0)
        waiting: dict[tuple, list[tuple]] = {}
        n, out = 0, []
        for _, packed in rows:
            hashes, *columns = pickle.loads(packed)
            for h, doc, *row in zip(hashes, columns[-1], *columns):
                waiting.setdefault((h, doc), []).append(row)
            n += len(hashes)
            if n > HELD:
                yield from self._settle(waiting, out)
                n = 0
        yield from self._settle(waiting, out)
        if out:
            yield self._packed(out)
        self.size.update((self.count, self.bytes))

    def _settle(self, waiting: dict[tuple, list[tuple]], out: list[Row]) -> Iterator[Row]:
        dealt: dict[int, list[tuple]] = {}
        for h, doc in waiting:
            dealt.setdefault(self._place(h) % self.count, []).append((h, doc))
        for no, docs in dealt.items():
            page, before = self._page(no)
            for at in docs:
                self.held.turn(at[1], page.setdefault(at, {}))
                for event in self.one.handleInputRows((at[1],), iter(waiting.pop(at)), None):
                    out.append(event)
                    if len(out) >= HELD:
                        yield self._packed(out)
            self._write(no, page, before)
        self._split()

    def _place(self, h: int) -> int:
        return (h & (1 << 63) - 1) // BUCKETS

    def _page(self, no: int) -> tuple[dict[tuple, dict], int]:
        found = self.pages.getValue((no,)) if self.bytes else None
        return (pickle.loads(found[0]), len(found[0])) if found is not None else ({}, 0)

    def _write(self, no: int, page: dict[tuple, dict], before: int) -> None:
        own = pickle.dumps(page)
        self.pages.updateValue((no,), (own,))
        self.bytes += len(own) - before

    def _split(self) -> None:
        """More pages, if they hold too much: the documents of one go to itself and to new ones."""
        old, count = self.count, self.count
        while self.bytes > count * PAGE:
            count *= 2
        if count > old:
            for no in range(old):
                page, before = self._page(no)
                parts: dict[int, dict] = {no: {}}
                for at, doc in page.items():
                    parts.setdefault(self._place(at[0]) % count, {})[at] = doc
                for part, docs in parts.items():
                    if before:
                        self._write(part, docs, before if part == no else 0)
            self.count = count

    def _packed(self, out: list[Row]) -> Row:
        columns = [pa.array(c, f.type) for c, f in zip(zip(*out), self.schema)]
        out.clear()
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, self.schema) as w:
            w.write_batch(pa.RecordBatch.from_arrays(columns, schema=self.schema))
        return self.row(sink.getvalue().to_pybytes())

    def close(self) -> None:
        pass


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per bucket that has its rows, pickled by column; the first column is the hash of the document."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            size += batch.nbytes
        if size >= PACK:
            yield _dealt(held)
            held, size = [], 0
    if held:
        yield _dealt(held)


def _dealt(held: list[pa.RecordBatch]) -> pa.RecordBatch:
    rows = pa.Table.from_batches(held)
    bucket = rows.column(0).to_numpy() % BUCKETS
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    columns = [c.to_numpy().tolist() if pa.types.is_string(c.type) else c.to_pylist() for c in rows.take(order).columns]
    starts = np.flatnonzero(np.diff(bucket, prepend=-1)).tolist()
    made = [pickle.dumps([c[a:b] for c in columns]) for a, b in zip(starts, [*starts[1:], len(bucket)])]
    return pa.RecordBatch.from_arrays([pa.array(bucket[starts], pa.int64()), pa.array(made, pa.binary())], ["_bucket", "packed"])


def _unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for events in batch.column(0):
            with pa.ipc.open_stream(events.as_buffer()) as found:
                yield from found


def segment_stream(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """Events of documents, each document's in order of index although its rows arrive in any order.

    ``rows`` as from ``segment_rows``. A segment waits in the document's buffer until all before it have gone out;
    blank segments are passed over but count; rows that come twice are taken once. ``complete`` follows the last
    segment and carries the unskipped total; what comes after it is ignored. ``sent`` numbers the events.
    Rows: key, sent, stage, index, type, original, translated, message, is_complete, total_segments, notice.
    """
    text = F.col("original")
    own = rows.select(F.xxhash64(key).alias("_hash"), "index", F.when(~X.is_blank(text), text).alias("original"),
                      "translated", "message", "total_segments", key)  # a blank segment is one without a text
    made = rows.sparkSession.createDataFrame([], _schema(rows, key, EVENT)).schema
    packed = own.mapInArrow(_pack, "_bucket bigint, packed binary").groupBy("_bucket").transformWithState(
        _Buckets(key, rows.schema[key].dataType.simpleString(), made.names, to_arrow_schema(made)),
        "events binary", "Append", "None")
    return packed.mapInArrow(_unpack, made)


# ---- live sessions -----------------------------------------------------------------------------

GAP_MS = 60_000
DELAY = "10 seconds"
SUMMARY = ("type string, started_ms bigint, at_ms bigint, n_chunks bigint, total_chunks bigint, duration_ms bigint, "
           "n_errors bigint, last_language string")


class _Sessions(StatefulProcessor):
    """Open sessions of a source as a short list of intervals, read and written whole; one timer per source, for the
    interval that ends first, ends by silence all that are due by then."""

    def __init__(self, gap_ms: int, chunk_ms: int, names: list[str]):
        self.gap, self.chunk, self.names = gap_ms, chunk_ms, names

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.row = handle, Row(*self.names)
        self.open = handle.getListState(
            "open", "first bigint, last bigint, n bigint, top bigint, errors bigint, spoken bigint, language string")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        kept = [tuple(x) for x in self.open.get()]
        new = []
        for at, chunk, language, error, *_ in rows:
            good = error is None
            new.append((at, at, 1, chunk, int(not good), chunk if good else -1, language if good else None))
        known = sorted(x[0] for x in kept)
        merged = self._merge(kept + new)
        for x in merged:
            i = bisect_left(known, x[0])
            if i == len(known) or known[i] > x[1]:
                yield self._row(key, "live_started", x[0], x)
        self.open.put(merged)
        before, due = self._due(kept), self._due(merged)
        if due != before:
            if before is not None:
                self.handle.deleteTimer(before)
            self.handle.registerTimer(due)

    def _due(self, spans: list[tuple]) -> int | None:
        """When the first of the intervals ends."""
        return min(s[1] for s in spans) + self.gap + 1 if spans else None

    def _merge(self, spans: list[tuple]) -> list[tuple]:
        """Intervals no further apart than the gap become one."""
        out: list[tuple] = []
        for s in sorted(spans, key=lambda s: (s[0], s[3])):
            if out and s[0] - out[-1][1] <= self.gap:
                a = out[-1]
                later = max(a, s, key=lambda x: x[5])
                out[-1] = (a[0], max(a[1], s[1]), a[2] + s[2], max(a[3], s[3]), a[4] + s[4], later[5], later[6])
            else:
                out.append(s)
        return out

    def _row(self, key, kind: str, at: int, s: tuple) -> Row:
        if kind == "live_started":
            return self.row(*key, kind, s[0], at, None, None, None, None, None)
        return self.row(*key, kind, s[0], at, s[2], s[3] + 1, (s[3] + 1) * self.chunk, s[4], s[6] or "—")

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())
        left = []
        for s in map(tuple, self.open.get()):
            if s[1] + self.gap + 1 <= now:
                yield self._row(key, "live_stopped", s[1] + self.gap, s)
            else:
                left.append(s)
        if left:
            self.open.put(left)
            self.handle.registerTimer(self._due(left))
        else:
            self.open.clear()

    def close(self) -> None:
        pass


def live_sessions(chunks: DataFrame, session: str = "session_id", ts: str = "ts", gap_ms: int = GAP_MS,
                  chunk_ms: int = 3000, delay: str = DELAY) -> DataFrame:
    """``live_started`` and ``live_stopped`` events of a stream of chunks (session, ts, chunk_idx, language, error).

    A session stops once the watermark has passed its last chunk by more than ``gap_ms``: an event-time timer
    raises the event, no chunk need follow. Chunks may arrive in any order within ``delay``; silent and failed
    chunks count. Totals: chunks seen, highest index + 1, that many chunk lengths, errors, and the language of
    the good chunk with the highest index.
    """
    own = chunks.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)
    own = own.select(F.unix_millis(ts).alias("at_ms"), F.col("chunk_idx").cast("bigint"), "language", "error", session, ts)
    return own.groupBy(session).transformWithState(
        _Sessions(gap_ms, chunk_ms, [session, *_names(SUMMARY)]), _schema(chunks, session, SUMMARY), "Append", "EventTime")


def session_log(chunks: DataFrame, session: str = "session_id", ts: str = "ts", gap_ms: int = GAP_MS,
                chunk_ms: int = 3000, until: int | None = None) -> DataFrame:
    """The events of ``live_sessions`` of a finished table. ``until`` (ms): sessions silent for ``gap_ms`` by then
    have stopped; without it all have."""
    own = chunks.select(session, F.unix_millis(F.col(ts).cast("timestamp")).alias("at_ms"),
                        F.col("chunk_idx").cast("bigint"), "language", "error")
    w = Window.partitionBy(session).orderBy("at_ms", "chunk_idx")
    new = F.coalesce(F.col("at_ms") - F.lag("at_ms").over(w) > gap_ms, F.lit(True))
    own = own.withColumn("_new", new.cast("int"))
    own = own.withColumn("_no", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    good = F.col("error").isNull()
    one = own.groupBy(session, "_no").agg(
        F.min("at_ms").alias("started_ms"), F.max("at_ms").alias("_last"), F.count("*").alias("n_chunks"),
        (F.max("chunk_idx") + 1).alias("total_chunks"), ((F.max("chunk_idx") + 1) * chunk_ms).alias("duration_ms"),
        F.count_if(~good).alias("n_errors"),
        F.coalesce(F.max_by("language", F.when(good, F.col("chunk_idx"))), F.lit("—")).alias("last_language"))
    begun = one.select(session, F.lit("live_started").alias("type"), "started_ms", F.col("started_ms").alias("at_ms"))
    over = one if until is None else one.filter(F.col("_last") + gap_ms + 1 <= until)
    ended = over.select(session, F.lit("live_stopped").alias("type"), "started_ms", (F.col("_last") + gap_ms).alias("at_ms"),
                        "n_chunks", "total_chunks", "duration_ms", "n_errors", "last_language")
    return begun.unionByName(ended, allowMissingColumns=True)


# ---- progress of runs --------------------------------------------------------------------------

COUNTERS = ["processed", "errors", "foreign_files", "translated_files"]


class _Ring(StatefulProcessor):
    """Counters and the last paths of a run; both are forgotten after a time without news, if one is given."""

    def __init__(self, keep: int, ttl_ms: int | None, names: list[str]):
        self.size, self.ttl, self.names = keep, ttl_ms, names

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.row = Row(*self.names)
        self.counts = handle.getValueState("counts", "a bigint, b bigint, c bigint, d bigint", self.ttl)
        self.ring = handle.getListState("ring", "seq bigint, path string", self.ttl)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        done, errors, foreign, translated = self.counts.get() if self.counts.exists() else (0, 0, 0, 0)
        ring = [tuple(x) for x in self.ring.get()]
        for r in rows:
            if r.error:
                errors += 1
            else:
                done += 1
                foreign += bool(r.is_foreign)
                translated += bool(r.translated)
            ring.append((r.seq, r.path))
            if len(ring) > 4 * self.size:
                ring = self._last(ring)
        ring = self._last(ring)
        self.counts.update((done, errors, foreign, translated))
        self.ring.put(ring)
        yield self.row(*key, done, errors, foreign, translated, [p for _, p in ring])

    def _last(self, ring: list[tuple]) -> list[tuple]:
        return sorted(ring, key=lambda x: (x[0] is not None, x[0] or 0, x[1] or ""))[-self.size:]

    def close(self) -> None:
        pass


def run_progress(events: DataFrame, run: str = "run_id", keep: int = 8, ttl_ms: int | None = None) -> DataFrame:
    """Counters and last ``keep`` paths (oldest first) of every run that a micro-batch touches, in update mode.

    ``events``: run, seq, path, type, error, is_foreign, translated; only ``done`` events count. Each run keeps its
    counters and a ring of ``keep`` paths, so a batch costs its own rows and not the number of runs. A null run is
    a run of its own. State of runs without news for ``ttl_ms`` goes away; as that runs on the clock, such a query
    makes a batch at every trigger, with or without rows, and never ends by itself.
    """
    failed = F.nullif(F.col("error"), F.lit(""))
    own = events.filter("type = 'done'").select(
        run, F.col("seq").cast("bigint"), "path", failed.alias("error"), "is_foreign", "translated")
    made = ", ".join(f"{c} bigint" for c in COUNTERS) + ", recent array<string>"
    return own.groupBy(run).transformWithState(
        _Ring(keep, ttl_ms, [run, *_names(made)]), _schema(events, run, made), "Update",
        "None" if ttl_ms is None else "ProcessingTime")
