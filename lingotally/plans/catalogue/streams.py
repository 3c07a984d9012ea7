"""Live chunks, sessions, event logs and run events, as tables and as streams."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from lingotally import refdata as R, session
from lingotally.functions import dialect as D
from lingotally.operators import infer, langid, segments as G
from lingotally.plans import translate as P
from lingotally.plans.catalogue.langid import SQL_PROFILE, SQL_SAMPLE, profile_of
from lingotally.plans.catalogue.registry import SQL_WS, TARGET, documents, query, table
from lingotally.plans.catalogue.scripts import PLANT, SQL_SCORES
from lingotally.sources import readers, writers
from lingotally.streaming import live, progress, runner, stateful

SQL_CHUNKS = """chunks AS (SELECT user_id AS source_id, CAST(epoch(date_trunc('hour', ts)) AS BIGINT)
 AS chunk_start, sqrt(avg(value * value)) AS rms, count(*) AS n_samples FROM events GROUP BY ALL)"""


def _samples(df):
    return df.select("ts", F.col("user_id").alias("source_id"), "value")


def _flat(chunks):
    return chunks.select(
        "source_id", F.unix_seconds("chunk_start").alias("chunk_start"),
        F.round("rms", 6).alias("rms"), "n_samples",
    )


LIVE = f"WITH {SQL_CHUNKS} SELECT source_id, chunk_start, round(rms, 6) AS rms, n_samples FROM chunks"


@query("live_chunks", LIVE)
def live_chunks(spark, sf):
    return _flat(live.live_chunks(_samples(table(spark, sf, "events")), "1 hour"))


@query("live_chunks_stream", LIVE)
def live_chunks_stream(spark, sf):
    """The same windows from a stream; complete mode, since append would hold back open windows."""
    stream = _samples(runner.file_stream(spark, sf, "events.parquet"))
    return _flat(runner.run_available(live.live_chunks(stream, "1 hour"), "complete", "chunks"))


@query("live_chunks_full", LIVE + " WHERE n_samples >= 2")
def live_chunks_full(spark, sf):
    """Chunks with fewer samples than a whole one are left out."""
    return _flat(live.live_chunks(_samples(table(spark, sf, "events")), "1 hour", full=2))


@query("live_silence", LIVE + " WHERE rms >= 40.0")
def live_silence(spark, sf):
    chunks = live.live_chunks(_samples(table(spark, sf, "events")), "1 hour")
    return _flat(live.drop_silence(chunks, 40.0))


@query("chunk_clock", """SELECT event_id, event_id * 3000 AS start_ms, (event_id + 1) * 3000 AS end_ms
 FROM events""")
def chunk_clock(spark, sf):
    e = table(spark, sf, "events").select("event_id", G.chunk_clock(F.col("event_id"), 3000).alias("c"))
    return e.select("event_id", "c.*")


@query("chunk_rms", """SELECT user_id, event_type, round(sqrt(avg(value * value)), 6) AS rms, count(*) AS n
 FROM events GROUP BY ALL""")
def chunk_rms(spark, sf):
    r = G.chunk_rms(table(spark, sf, "events"), ["user_id", "event_type"])
    return r.withColumn("rms", F.round("rms", 6))


def _live_log(df):
    bad = F.col("event_type") == "error"
    return df.select(
        F.col("user_id").alias("session_id"), F.col("event_id").alias("chunk_idx"),
        F.when(~bad, F.col("event_type")).alias("language"), F.when(bad, "chunk failed").alias("error"),
    )


SESSIONS = """SELECT user_id AS session_id, count(*) AS n_chunks, max(event_id) + 1 AS total_chunks,
 (max(event_id) + 1) * 3000 AS duration_ms, count(*) FILTER (WHERE event_type = 'error') AS n_errors,
 coalesce(arg_max(event_type, event_id) FILTER (WHERE event_type <> 'error'), '—') AS last_language
 FROM events GROUP BY 1"""


@query("session_summary", SESSIONS)
def session_summary(spark, sf):
    return live.session_summary(_live_log(table(spark, sf, "events")))


@query("session_summary_stream", SESSIONS)
def session_summary_stream(spark, sf):
    stream = live.session_summary(_live_log(runner.file_stream(spark, sf, "events.parquet")))
    return runner.run_available(stream, "update", "sessions", ["session_id"])


@query("isolate_errors", """SELECT 'good' AS sink, count(*) AS n FROM events WHERE event_type <> 'error'
 UNION ALL SELECT 'error', count(*) FROM events WHERE event_type = 'error'""")
def isolate_errors(spark, sf):
    good, bad = live.isolate_errors(_live_log(table(spark, sf, "events")))
    n = F.count("*").alias("n")
    return good.agg(n).select(F.lit("good").alias("sink"), "n").unionByName(
        bad.agg(n).select(F.lit("error").alias("sink"), "n")
    )


ENRICH_SAMPLE = SQL_SAMPLE.replace("{t}", "text")


@query("enrich_chunks", f"""WITH {SQL_PROFILE}, cg AS (SELECT conv_id, turn, substring(s, CAST(i AS BIGINT), 3)
 AS gram FROM (SELECT conv_id, turn, {ENRICH_SAMPLE} AS s FROM conversations),
 unnest(range(1, length(s) - 1)) AS t(i)),
 sc AS (SELECT conv_id, turn, language, sum(301 - rank) AS score FROM cg JOIN profile USING (gram)
 GROUP BY ALL),
 top AS (SELECT * FROM sc QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY score DESC,
 language) = 1),
 l AS (SELECT c.conv_id, c.turn, c.text, coalesce(top.language, 'xx') AS language FROM conversations c
 LEFT JOIN top USING (conv_id, turn) WHERE trim(c.text, {SQL_WS}) <> '')
 SELECT conv_id AS session_id, turn AS chunk_idx, language, CASE WHEN language <> '{TARGET}'
 THEN '[{TARGET}] ' ELSE '' END || text AS translated FROM l""")
def enrich_chunks(spark, sf):
    """Conversation turns as live chunks: language, translation of the foreign ones."""
    c = table(spark, sf, "conversations").select(
        F.col("conv_id").alias("session_id"), F.col("turn").alias("chunk_idx"), "text",
        F.lit("xx").alias("upstream_language"),
    )
    detect = langid.detector(profile_of(spark, sf))
    return live.enrich_stream(c, detect, infer.tagging_model(TARGET), TARGET).select(
        "session_id", "chunk_idx", "language", "translated"
    )


LINE = ("CASE event_id % 10 WHEN 0 THEN '  ' WHEN 1 THEN 'not json {' WHEN 2 THEN "
        "'{\"type\":\"noise\",\"seq\":' || event_id || '}' WHEN 3 THEN '{\"type\":\"complete\",\"run_id\":\"r' || "
        "user_id || '\",\"seq\":' || event_id || ',\"total_segments\":' || user_id || '}' ELSE "
        "'{\"type\":\"segment\",\"run_id\":\"r' || user_id || '\",\"seq\":' || event_id || '}' END")
EVENT_LOG = """SELECT event_id AS seq, 'r' || user_id AS run_id, CASE WHEN event_id % 10 = 3 THEN 'complete'
 ELSE 'segment' END AS type FROM events WHERE event_id % 10 > 2"""


@query("event_log", EVENT_LOG)
def event_log(spark, sf):
    lines = table(spark, sf, "events").select(F.expr(LINE).alias("value"))
    return readers.parse_events(lines).select("seq", "run_id", "type")


@query("event_log_stream", EVENT_LOG)
def event_log_stream(spark, sf):
    lines = runner.file_stream(spark, sf, "events.parquet").select(F.expr(LINE).alias("value"))
    stream = readers.parse_events(lines).select("seq", "run_id", "type")
    return runner.run_available(stream, "append", "events")


VALUE_LINE = ("CASE event_id % 7 WHEN 0 THEN '# comment' WHEN 1 THEN '   ' WHEN 2 THEN 'x' || event_id || ' bad' "
              "WHEN 3 THEN '  ' || event_id || chr(9) || 'label ' || user_id || '  ' ELSE "
              "CAST(event_id AS VARCHAR(20)) END")


@query("labelled_values", """SELECT event_id AS line_no, CASE WHEN event_id % 7 = 2 THEN 'x' || event_id
 ELSE CAST(event_id AS VARCHAR) END AS raw, CASE WHEN event_id % 7 = 2 THEN 'bad' WHEN event_id % 7 = 3
 THEN 'label ' || user_id END AS label, event_id % 7 = 2 AS failed FROM events WHERE event_id % 7 > 1""")
def labelled_values(spark, sf):
    lines = table(spark, sf, "events").select(
        F.col("event_id").alias("line_no"), F.expr(VALUE_LINE.replace("VARCHAR(20)", "STRING")).alias("value")
    )
    parsed = readers.parse_labelled_values(lines)
    return parsed.select("line_no", "raw", "label", F.col("error").isNotNull().alias("failed"))


@query("ip_list", """SELECT event_id AS line_no, user_id || '.1.2.' || event_id % 300 AS ip,
 event_id % 300 > 255 OR user_id > 255 AS failed FROM events WHERE event_id % 7 > 1""")
def ip_list(spark, sf):
    from lingotally.functions import net

    e = F.col("event_id")
    ip = F.concat(F.col("user_id").cast("string"), F.lit(".1.2."), (e % 300).cast("string"))
    line = F.when(e % 7 == 0, "# note").when(e % 7 == 1, "\t ").otherwise(F.concat(F.lit(" "), ip))
    lines = table(spark, sf, "events").select(e.alias("line_no"), line.alias("value"))
    kept = readers.content_lines(lines).withColumnRenamed("value", "ip")
    return kept.withColumn("failed", ~net.ip_valid(F.col("ip")))


FLAG_JSON = ("CASE event_id % 3 WHEN 0 THEN '{\"flags\":[{\"filePath\":\"/c/' || user_id || '\",\"segmentIndex\":' "
             "|| event_id || ',\"reviewStatus\":\"done\"}]}' WHEN 1 THEN '{\"flags\":[{\"file_path\":\"/c/' || user_id "
             "|| '\",\"segment_index\":' || event_id || ',\"examiner_note\":\"n\"},{}]}' ELSE '{broken' END")


@query("review_flag_files", """SELECT '/c/' || user_id AS file_path, event_id AS segment_index,
 CASE WHEN event_id % 3 = 1 THEN 'n' ELSE '' END AS examiner_note,
 CASE WHEN event_id % 3 = 0 THEN 'done' ELSE '' END AS review_status, '' AS flagged_at FROM events
 WHERE event_id % 3 < 2 UNION ALL SELECT '', 0, '', '', '' FROM events WHERE event_id % 3 = 1""")
def review_flag_files(spark, sf):
    """Flag documents in both spellings, one in three unreadable."""
    raw = table(spark, sf, "events").select(
        F.from_json(F.expr(FLAG_JSON), readers.FLAG_SCHEMA.replace(", _corrupt_record string", ""),
                    {"mode": "PERMISSIVE"}).alias("j")
    )
    return readers.flag_rows(raw.select("j.flags"))


SQL_PLANTED = f"""pl AS (SELECT doc_id, lang, {PLANT} AS text FROM documents),
 us AS (SELECT doc_id, [x FOR x IN string_split(regexp_replace(text, '([.!?۔؟。])', '\\1' || chr(1), 'g'),
 chr(1)) IF trim(x, {SQL_WS}) <> ''] AS l FROM pl),
 rn AS (SELECT pl.doc_id, CASE WHEN pl.doc_id % 3 = 0 THEN 'ar' ELSE lang END AS language, dialect,
 len(l) AS n FROM pl JOIN dv USING (doc_id) JOIN us USING (doc_id))"""


def _translated(spark, sf, store=False):
    """Documents with language and dialect, their sentences, and the foreign ones translated.

    ``store`` cuts the sentences once, into the shared folder, and looks up once a document whether it is foreign.
    """
    d = documents(spark, sf, "text", "lang").select(
        "doc_id", F.expr(PLANT).alias("text"),
        F.when(F.col("doc_id") % 3 == 0, "ar").otherwise(F.col("lang")).alias("language"),
        F.lit(0.9).alias("confidence"),
    )
    found = F.when(F.col("language") == "ar", D.detect_dialect(F.col("text")))
    docs = d.withColumn("d", found).select(
        "*", F.col("d.dialect").alias("dialect"), F.col("d.confidence").alias("dialect_confidence")
    ).drop("d")
    others = docs.filter(F.col("language") != TARGET).select("doc_id")
    if store:
        marked = docs.select("doc_id", "text").join(
            others.distinct().withColumn("_foreign", F.lit(True)), "doc_id", "left")
        units = session.stored(P.sentence_units(marked, ["doc_id", "_foreign"]), "units")
        foreign = units.filter("_foreign").drop("_foreign")
    else:
        units = P.sentence_units(docs, ["doc_id"])
        foreign = units.join(others, "doc_id", "left_semi")
    return docs, units, P.translate_segments(foreign, infer.tagging_model(TARGET), ["doc_id"])


def _run_events(spark, sf):
    docs, units, segs = _translated(spark, sf)
    return P.run_events(docs, segs, TARGET, units=units)


@query("run_events", f"""WITH {SQL_SCORES}, {SQL_PLANTED} SELECT doc_id, 'dialect' AS type, 1 AS n,
 CAST(0 AS BIGINT) AS total FROM rn WHERE language = 'ar' AND dialect <> 'Unknown'
 UNION ALL SELECT doc_id, 'dialect_routing', 1, 0 FROM rn WHERE language = 'ar'
 UNION ALL SELECT doc_id, 'segment', n, 0 FROM rn WHERE language <> '{TARGET}' AND n > 0
 UNION ALL SELECT doc_id, 'complete', 1, CASE WHEN language <> '{TARGET}' THEN n ELSE 0 END FROM rn"""
       .replace("1 AS n,", "CAST(1 AS BIGINT) AS n,"))
def run_events(spark, sf):
    e = _run_events(spark, sf)
    return e.groupBy("doc_id", "type").agg(
        F.count("*").alias("n"), F.coalesce(F.sum("total_segments"), F.lit(0)).alias("total")
    )


SQL_EVENTS = f"""{SQL_SCORES}, {SQL_PLANTED}, rv AS (SELECT rn.*, dv.confidence, CASE
  WHEN rn.dialect = 'Egyptian' AND dv.confidence >= 0.70 THEN 'NllbEgyptian'
  WHEN rn.dialect = 'Levantine' AND dv.confidence >= 0.65 THEN 'NllbLevantine'
  WHEN rn.dialect = 'Iraqi' AND dv.confidence >= 0.65 THEN 'NllbIraqi' ELSE 'NllbDefault' END AS route
  FROM rn JOIN dv USING (doc_id)),
 un AS (SELECT doc_id, i, trim(l[i + 1], {SQL_WS}) AS t FROM (SELECT doc_id, l, unnest(range(len(l))) AS i
  FROM us JOIN rn USING (doc_id) WHERE language <> '{TARGET}')),
 ev AS (SELECT doc_id, 0 AS stage, CAST(0 AS BIGINT) AS "index", 'dialect' AS type, dialect, NULL AS route, confidence,
  NULL AS original, NULL AS translated, NULL AS is_complete, NULL AS total_segments, NULL AS notice
  FROM rv WHERE language = 'ar' AND dialect <> 'Unknown'
 UNION ALL SELECT doc_id, 1, 0, 'dialect_routing', dialect, route, confidence, NULL, NULL, NULL, NULL, NULL
  FROM rv WHERE language = 'ar'
 UNION ALL SELECT doc_id, 2, i, 'segment', NULL, NULL, NULL, t, '[{TARGET}] ' || t, true, NULL, NULL FROM un
 UNION ALL SELECT doc_id, 3, 0, 'complete', NULL, NULL, NULL, NULL, NULL, NULL,
  CASE WHEN language <> '{TARGET}' THEN n ELSE 0 END, '{R.MT_NOTICE}' FROM rv)"""


@query("event_lines", f"""WITH {SQL_EVENTS} SELECT '{{"doc_id":' || doc_id || ',"stage":' || stage || ',"index":' ||
 "index" || ',"type":"' || type || '"' || CASE type
 WHEN 'dialect' THEN ',"dialect":"' || dialect || '","confidence":' || to_json(confidence)
 WHEN 'dialect_routing' THEN ',"dialect":"' || dialect || '","route":"' || route || '","confidence":' || to_json(confidence)
 WHEN 'segment' THEN ',"original":' || to_json(original) || ',"translated":' || to_json(translated) || ',"is_complete":true'
 ELSE ',"total_segments":' || total_segments || ',"machine_translation_notice":"' || notice || '"' END || '}}' AS value
 FROM ev""")
def event_lines(spark, sf):
    """Lines of all event types with all their fields."""
    return writers.event_lines(_run_events(spark, sf), [
        "doc_id", "stage", "index", "type", "dialect", "route", "confidence", "original", "translated", "message",
        "is_complete", "total_segments", "machine_translation_notice"])


SIX_FILES = 256 << 20  # bytes of document text whose segments arrive as six files


@query("segment_stream", f"""WITH {SQL_EVENTS} SELECT doc_id, CASE WHEN stage = 2 THEN "index" ELSE total_segments END
 AS sent, stage, "index", type, original, translated, CAST(NULL AS VARCHAR) AS message, is_complete,
 CAST(total_segments AS BIGINT) AS total_segments, notice AS machine_translation_notice FROM ev WHERE stage >= 2""")
def segment_stream(spark, sf):
    """Sentences that arrive in micro-batches in any order, released in order of index; ``complete`` last."""
    docs, units, segs = _translated(spark, sf, store=True)
    foreign = F.col("language") != TARGET
    totals = docs.join(units.groupBy("doc_id").agg(F.count("*").alias("n")), "doc_id", "left").select(
        "doc_id", F.when(foreign, F.coalesce("n", F.lit(0))).otherwise(0).alias("total_segments"))
    folder = session.work_dir(stateful.stateful(spark), "segments")
    rows = stateful.segment_rows(segs, totals)
    # three micro-batches of any size: files of bounded size, a third of them at a time
    size = documents(spark, sf, "text").agg(F.sum(F.octet_length("text"))).first()[0] or 0
    third = 2 * max(1, math.ceil(size / SIX_FILES))
    rows.repartition(3 * third, F.xxhash64("doc_id", "index")).write.parquet(folder)
    return runner.run_available(
        stateful.segment_stream(runner.file_stream(spark, folder, "*.parquet", third)), "append", "segment_events")


SESSION_GAP, SESSION_DELAY = 6 * 3600 * 1000, 10_000


@query("session_events_stream", f"""WITH c AS (SELECT user_id AS session_id, epoch_us(ts) // 1000 AS ms, event_id, event_type,
  epoch_us(ts) // 1000 - lag(epoch_us(ts) // 1000) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000, event_id) AS pause FROM events),
 k AS (SELECT *, sum(CASE WHEN pause IS NULL OR pause > {SESSION_GAP} THEN 1 ELSE 0 END) OVER (
  PARTITION BY session_id ORDER BY ms, event_id) AS no FROM c),
 s AS (SELECT session_id, min(ms) AS started_ms, max(ms) AS last, count(*) AS n_chunks, max(event_id) + 1 AS total_chunks,
  (max(event_id) + 1) * 3000 AS duration_ms, count(*) FILTER (WHERE event_type = 'error') AS n_errors,
  coalesce(arg_max(event_type, event_id) FILTER (WHERE event_type <> 'error'), '—') AS last_language
  FROM k GROUP BY session_id, no)
 SELECT session_id, 'live_started' AS type, started_ms, started_ms AS at_ms, NULL AS n_chunks, NULL AS total_chunks,
  NULL AS duration_ms, NULL AS n_errors, NULL AS last_language FROM s
 UNION ALL SELECT session_id, 'live_stopped', started_ms, last + {SESSION_GAP}, n_chunks, total_chunks, duration_ms,
  n_errors, last_language FROM s
  WHERE last + {SESSION_GAP} + 1 <= (SELECT max(epoch_us(ts) // 1000) FROM events) - {SESSION_DELAY}""")
def session_events_stream(spark, sf):
    """Sessions of a stream that a timer ends after hours of silence; those still open at its end have no stop."""
    e = runner.file_stream(stateful.stateful(spark), sf, "events.parquet")
    bad = F.col("event_type") == "error"
    chunks = e.select(
        F.col("user_id").alias("session_id"), "ts", F.col("event_id").alias("chunk_idx"),
        F.when(~bad, F.col("event_type")).alias("language"), F.when(bad, "chunk failed").alias("error"))
    return runner.run_available(
        stateful.live_sessions(chunks, gap_ms=SESSION_GAP, delay=f"{SESSION_DELAY} milliseconds"), "append", "session_events")


@query("run_progress_stream", """WITH log AS (SELECT user_id % 3 AS run_id, event_id, '/f/' || user_id AS path, value,
  event_type = 'error' AND event_id % 3 = 0 AS bad FROM events WHERE event_type NOT IN ('signup', 'click'))
 SELECT run_id, count(*) FILTER (WHERE NOT bad) AS processed, count(*) FILTER (WHERE bad) AS errors,
 count(*) FILTER (WHERE NOT bad AND value > 50) AS foreign_files,
 count(*) FILTER (WHERE NOT bad AND value > 75) AS translated_files,
 array_to_string(list(path ORDER BY event_id)[-8:], ',') AS recent FROM log GROUP BY 1""")
def run_progress_stream(spark, sf):
    """Counters and the last eight paths of every run, kept per run in the state store."""
    from lingotally.plans.catalogue.review import file_log

    folder = session.work_dir(stateful.stateful(spark), "file_log")
    file_log(spark, sf).repartition(4, "seq").write.parquet(folder)
    stream = stateful.run_progress(runner.file_stream(spark, folder, "*.parquet", 1))
    newest = runner.run_available(stream, "update", "run_progress", ["run_id"])
    return newest.withColumn("recent", F.array_join("recent", ","))


@query("batch_progress", """SELECT user_id % 3 AS run_id, count(*) FILTER (WHERE done AND NOT bad)
 AS processed, count(*) FILTER (WHERE done AND bad) AS errors, count(*) FILTER (WHERE done AND NOT bad
 AND value > 50) AS foreign_files, count(*) FILTER (WHERE done AND NOT bad AND value > 75)
 AS translated_files FROM (SELECT *, event_type NOT IN ('signup', 'click') AS done,
 event_type = 'error' AND event_id % 3 = 0 AS bad FROM events) GROUP BY 1""")
def batch_progress(spark, sf):
    from lingotally.plans.catalogue.review import file_log

    return progress.batch_progress(file_log(spark, sf))
