"""Segments, speakers, cues and decoder output."""

from __future__ import annotations

from pyspark.sql import functions as F

from lingotally.functions import text as X
from lingotally.operators import intervals, lookups, segments as G
from lingotally.plans.catalogue.registry import (
    SQL_SEGMENTS, SQL_WS, conversation_segments, documents, query, sql_word_count, sql_words, table,
)


@query("segments", f"WITH {SQL_SEGMENTS} SELECT * FROM segs")
def segments(spark, sf):
    return conversation_segments(spark, sf)


@query("transcripts", f"""SELECT conv_id AS doc_id, string_agg(trim(text, {SQL_WS}), ' ' ORDER BY turn)
 FILTER (WHERE trim(text, {SQL_WS}) <> '') AS transcript FROM conversations GROUP BY conv_id""")
def transcripts(spark, sf):
    c = table(spark, sf, "conversations").withColumnRenamed("conv_id", "doc_id")
    return G.transcript(c, ["doc_id"], "turn")


@query("cue_concat", """SELECT conv_id AS doc_id, string_agg(text, ' ' ORDER BY turn) AS text
 FROM conversations GROUP BY conv_id""")
def cue_concat(spark, sf):
    c = table(spark, sf, "conversations").withColumnRenamed("conv_id", "doc_id")
    return G.cue_concat(c, ["doc_id"], "turn")


def _turns(spark, sf):
    """The segment grid shifted per conversation; every third one has each turn twice (ties)."""
    s = conversation_segments(spark, sf)
    shift = F.col("doc_id") % 7 * 700
    base = s.select("doc_id", F.col("seg_idx").alias("turn_idx"), (F.col("start_ms") + shift).alias("start_ms"),
                    (F.col("end_ms") + shift).alias("end_ms"), F.col("role").alias("speaker_id"))
    copies = F.when(F.col("doc_id") % 3 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return base.withColumn("c", F.explode(copies)).select(
        "doc_id", (F.col("turn_idx") + F.col("c") * 100).alias("turn_idx"), "start_ms", "end_ms",
        F.when(F.col("c") == 1, "other").otherwise(F.col("speaker_id")).alias("speaker_id"),
    )


SQL_TURNS = f"""{SQL_SEGMENTS}, turns AS (SELECT doc_id, seg_idx + 100 * c AS turn_idx,
 start_ms + doc_id % 7 * 700 AS ts, end_ms + doc_id % 7 * 700 AS te,
 CASE WHEN c = 1 THEN 'other' ELSE role END AS speaker_id FROM segs, (VALUES (0), (1)) AS v(c)
 WHERE c = 0 OR doc_id % 3 = 0),
 pairs AS (SELECT s.doc_id, s.seg_idx, s.start_ms, s.end_ms, t.turn_idx, t.speaker_id,
 least(s.end_ms, t.te) - greatest(s.start_ms, t.ts) AS overlap FROM segs s JOIN turns t
 ON s.doc_id = t.doc_id AND s.start_ms < t.te AND t.ts < s.end_ms),
 spoken AS (SELECT s.doc_id, s.seg_idx, s.start_ms, s.end_ms, coalesce(p.speaker_id, 'UNKNOWN')
 AS speaker_id FROM segs s LEFT JOIN (SELECT * FROM pairs QUALIFY row_number() OVER (PARTITION BY
 doc_id, seg_idx ORDER BY overlap DESC, turn_idx) = 1) p USING (doc_id, seg_idx))"""


def _spoken(spark, sf):
    s = conversation_segments(spark, sf).select("doc_id", "seg_idx", "start_ms", "end_ms")
    return intervals.attach_speaker(s, _turns(spark, sf))


@query("speaker_attach", f"WITH {SQL_TURNS} SELECT * FROM spoken")
def speaker_attach(spark, sf):
    return _spoken(spark, sf)


@query("speaker_counts", f"""WITH {SQL_TURNS} SELECT doc_id, count(DISTINCT speaker_id) AS n_speakers
 FROM spoken GROUP BY doc_id""")
def speaker_counts(spark, sf):
    return intervals.speaker_count(_spoken(spark, sf))


@query("speaker_talk_time", f"""WITH {SQL_TURNS} SELECT doc_id, speaker_id,
 CAST(sum(overlap) AS BIGINT) AS talk_ms, count(*) AS n_pairs FROM pairs GROUP BY ALL""")
def speaker_talk_time(spark, sf):
    s = conversation_segments(spark, sf).select("doc_id", "seg_idx", "start_ms", "end_ms")
    return intervals.talk_time(s, _turns(spark, sf))


def _clock(ms: str, sep: str) -> str:
    return (f"printf('%02d:%02d:%02d{sep}%03d', {ms} // 3600000, {ms} % 3600000 // 60000, "
            f"{ms} % 60000 // 1000, {ms} % 1000)")


@query("srt_render", f"""WITH {SQL_SEGMENTS} SELECT doc_id, string_agg((seg_idx + 1) || chr(10) ||
 {_clock('start_ms', ',')} || ' --> ' || {_clock('end_ms', ',')} || chr(10) || text || chr(10) || chr(10),
 '' ORDER BY seg_idx) AS body FROM segs GROUP BY doc_id""")
def srt_render(spark, sf):
    return G.render_srt(conversation_segments(spark, sf), ["doc_id"])


@query("vtt_render", f"""WITH {SQL_SEGMENTS} SELECT doc_id, 'WEBVTT' || chr(10) || chr(10) ||
 string_agg({_clock('start_ms', '.')} || ' --> ' || {_clock('end_ms', '.')} || chr(10) || text ||
 chr(10) || chr(10), '' ORDER BY seg_idx) AS body FROM segs GROUP BY doc_id""")
def vtt_render(spark, sf):
    return G.render_vtt(conversation_segments(spark, sf), ["doc_id"])


FLAT = "trim(regexp_replace(text, '\\n+', chr(10), 'g'), chr(10))"


@query("srt_roundtrip", f"""WITH {SQL_SEGMENTS} SELECT doc_id, k AS kind, CAST(seg_idx + 1 AS INTEGER)
 AS cue_idx, start_ms, end_ms, {FLAT} AS text FROM segs, (VALUES ('srt'), ('vtt')) AS v(k)""")
def srt_roundtrip(spark, sf):
    """Rendered bodies of both kinds parsed back: every segment must return."""
    flat = F.btrim(F.regexp_replace("text", "\n+", "\n"), F.lit("\n"))
    s = conversation_segments(spark, sf).withColumn("text", flat)
    bodies = G.render_srt(s, ["doc_id"]).withColumn("kind", F.lit("srt")).unionByName(
        G.render_vtt(s, ["doc_id"]).withColumn("kind", F.lit("vtt"))
    )
    return G.parse_subtitles(bodies, keys=["doc_id", "kind"]).drop("error")


@query("source_words", f"""SELECT conv_id AS doc_id, CAST(sum({sql_word_count('text')}) AS BIGINT)
 AS n_words FROM conversations GROUP BY conv_id""")
def source_words(spark, sf):
    c = table(spark, sf, "conversations").withColumnRenamed("conv_id", "doc_id")
    return G.source_words(c, ["doc_id"])


@query("completion_ratio", """SELECT conv_id AS doc_id, round(avg(CASE WHEN length(text) % 3 <> 0
 THEN 1 ELSE 0 END), 6) AS completion_ratio FROM conversations GROUP BY conv_id""")
def completion_ratio(spark, sf):
    c = table(spark, sf, "conversations").select(
        F.col("conv_id").alias("doc_id"), (F.length("text") % 3 != 0).alias("is_complete")
    )
    done = G.completion_ratio(c, ["doc_id"])
    return done.withColumn("completion_ratio", F.round("completion_ratio", 6))


def _tokens(spark, sf):
    """Words of each document as decoder tokens, a time marker in place of every seventh."""
    d = documents(spark, sf, "text")
    marks = F.transform(X.words(F.col("text")), lambda w, i: F.struct(
        F.when(i % 7 != 0, F.concat(F.lit(" "), w)).alias("text"),
        F.when(i % 7 == 0, (i * 3).cast("int")).alias("marker"),
    ))
    return d.select("doc_id", marks.alias("tokens"), (F.col("doc_id") * 30.0).alias("offset_s"),
                    F.lit(30.0).alias("duration_s"))


# Islands by a running count of markers; island 0 (text before the first marker) joins island 1.
@query("marker_segments", f"""WITH w AS (SELECT doc_id, i - 1 AS pos, word FROM (SELECT doc_id,
 {sql_words('text')} AS l FROM documents), unnest(l) WITH ORDINALITY AS t(word, i)),
 isl AS (SELECT *, greatest(count(*) FILTER (WHERE pos % 7 = 0) OVER (PARTITION BY doc_id ORDER BY pos),
 1) AS island FROM w),
 agg AS (SELECT doc_id, island, max(pos * 3) FILTER (WHERE pos % 7 = 0) AS k,
 string_agg(word, ' ' ORDER BY pos) FILTER (WHERE pos % 7 <> 0) AS text FROM isl GROUP BY ALL),
 seg AS (SELECT *, lead(k) OVER (PARTITION BY doc_id ORDER BY island) AS k1 FROM agg)
 SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY island) - 1 AS INTEGER) AS seg_idx,
 CAST(trunc((doc_id * 30.0::DOUBLE + CAST(CAST(k AS FLOAT) * CAST(0.02 AS FLOAT) AS DOUBLE)) * 1000.0::DOUBLE) AS BIGINT)
  AS start_ms,
 CASE WHEN k1 IS NULL THEN CAST(trunc((doc_id * 30.0::DOUBLE + 30.0::DOUBLE) * 1000.0::DOUBLE) AS BIGINT) ELSE
  CAST(trunc((doc_id * 30.0::DOUBLE + CAST(CAST(k1 AS FLOAT) * CAST(0.02 AS FLOAT) AS DOUBLE)) * 1000.0::DOUBLE) AS BIGINT)
  END AS end_ms, text FROM seg WHERE text IS NOT NULL""")
def marker_segments(spark, sf):
    return G.marker_segments(_tokens(spark, sf), ["doc_id"])


ATTEMPT_TEXT = ("CASE WHEN (doc_id + attempt) % 4 = 0 THEN repeat('ab', 20) WHEN (doc_id + attempt) "
                "% 4 = 1 THEN repeat('a', 30) WHEN doc_id % 5 = 0 THEN repeat('xyz', 10) "
                "ELSE 'plain words ' || attempt END")
NO_SPEECH = "CASE WHEN (doc_id * 7 + attempt * 3) % 11 = 0 THEN 0.9 ELSE 0.1 END"


@query("select_attempt", f"""WITH a AS (SELECT doc_id, attempt, {ATTEMPT_TEXT} AS text, {NO_SPEECH} AS ns
 FROM labels, (VALUES (0), (1), (2), (3), (4), (5)) AS v(attempt)),
 g AS (SELECT *, ns > 0.6 OR len(list_distinct(string_split(text, ''))) / CAST(length(text) AS DOUBLE)
 >= 0.3 AS ok FROM a)
 SELECT doc_id, CAST(attempt AS INTEGER) AS attempt, text, ok AS accepted FROM g QUALIFY row_number()
 OVER (PARTITION BY doc_id ORDER BY CASE WHEN ok THEN attempt ELSE 1000 - attempt END) = 1""")
def select_attempt(spark, sf):
    labels = table(spark, sf, "labels").select("doc_id")
    tries = labels.select("doc_id", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("attempt"))
    tries = tries.select("doc_id", "attempt", F.expr(ATTEMPT_TEXT).alias("text"),
                         F.expr(NO_SPEECH).cast("double").alias("no_speech"))
    return G.select_attempt(tries, ["doc_id"]).drop("no_speech")


@query("switch_points", f"""WITH {SQL_SEGMENTS}, pts AS (SELECT user_id AS doc_id, event_id % 8 AS off,
 event_id AS position, event_type AS to_language FROM events),
 f AS (SELECT * FROM pts QUALIFY row_number() OVER (PARTITION BY doc_id, off ORDER BY position) = 1)
 SELECT doc_id, seg_idx, to_language FROM segs LEFT JOIN f ON f.doc_id = segs.doc_id
 AND f.off = segs.seg_idx""".replace("SELECT doc_id, seg_idx, to_language", "SELECT segs.doc_id, seg_idx, to_language"))
def switch_points(spark, sf):
    points = table(spark, sf, "events").select(
        F.col("user_id").alias("doc_id"), (F.col("event_id") % 8).alias("offset"),
        F.col("event_id").alias("position"), F.col("event_type").alias("to_language"),
    )
    s = conversation_segments(spark, sf).select("doc_id", "seg_idx")
    return lookups.switch_points_to_segments(s, points, ["doc_id"]).drop("position")
