"""Review flags, action replay, recent files, file states and running progress."""

from __future__ import annotations

from pyspark.sql import functions as F

from lingotally import refdata as R
from lingotally.operators import review, running
from lingotally.plans.catalogue.registry import (
    SQL_RESULTS, SQL_REVIEW_SEGMENTS, query, results, review_segments, table,
)
from lingotally.streaming import progress

ACTION = ("CASE event_type WHEN 'signup' THEN 'flag' WHEN 'view' THEN 'flag' WHEN 'error' THEN 'unflag' "
          "ELSE 'set_status' END")
STATUS = "CASE event_type WHEN 'click' THEN 'in_progress' WHEN 'purchase' THEN 'done' END"
SQL_ACTIONS = f"""act AS (SELECT '/c/' || user_id AS file_path, event_id % 6 AS segment_index,
 event_id AS seq, {ACTION} AS action, {STATUS} AS status, 'note ' || event_id AS note,
 'at ' || event_id AS at FROM events)"""
SQL_FOLD = f"""{SQL_ACTIONS}, tog AS (SELECT * FROM act WHERE action IN ('flag', 'unflag') QUALIFY
 row_number() OVER (PARTITION BY file_path, segment_index ORDER BY seq DESC) = 1),
 st AS (SELECT * FROM act WHERE action = 'set_status' QUALIFY row_number() OVER (PARTITION BY file_path,
 segment_index ORDER BY seq DESC) = 1),
 flags AS (SELECT tog.file_path, tog.segment_index, tog.note AS examiner_note, tog.at AS flagged_at,
 CASE WHEN st.seq > tog.seq THEN st.status ELSE 'needs_review' END AS review_status FROM tog
 LEFT JOIN st USING (file_path, segment_index) WHERE tog.action = 'flag')"""


def actions(spark, sf):
    e = table(spark, sf, "events")
    number = F.col("event_id").cast("string")
    return e.select(
        F.concat(F.lit("/c/"), F.col("user_id").cast("string")).alias("file_path"),
        (F.col("event_id") % 6).alias("segment_index"), F.col("event_id").alias("seq"),
        F.expr(ACTION).alias("action"), F.expr(STATUS).alias("status"),
        F.concat(F.lit("note "), number).alias("note"), F.concat(F.lit("at "), number).alias("at"),
    )


@query("review_fold", f"WITH {SQL_FOLD} SELECT * FROM flags")
def review_fold(spark, sf):
    return review.fold_review_actions(actions(spark, sf))


@query("hydrate_flags", f"""WITH {SQL_ACTIONS} SELECT file_path, segment_index, note AS examiner_note
 FROM act QUALIFY row_number() OVER (PARTITION BY file_path, segment_index ORDER BY seq DESC) = 1""")
def hydrate_flags(spark, sf):
    stored = actions(spark, sf).select(
        "file_path", "segment_index", F.col("note").alias("examiner_note"), F.col("seq").alias("position")
    )
    return review.hydrate_flags(stored)


@query("flags_review", f"""WITH {SQL_FOLD}, {SQL_REVIEW_SEGMENTS} SELECT f.file_path, f.segment_index,
 coalesce(start_ms, -1) AS start_ms, coalesce(end_ms, -1) AS end_ms, coalesce(source_text, '') AS original,
 coalesce(translated_text, '') AS translation, review_status, examiner_note, flagged_at
 FROM flags f LEFT JOIN rsegs s USING (file_path, segment_index)""")
def flags_review(spark, sf):
    flags = review.fold_review_actions(actions(spark, sf))
    shown = review.flags_to_segments(flags, review_segments(spark, sf))
    return shown.withColumns({c: F.coalesce(c, F.lit(-1)) for c in ("start_ms", "end_ms")})


@query("flag_counts", f"WITH {SQL_FOLD} SELECT file_path, count(*) AS n_flags FROM flags GROUP BY 1")
def flag_counts(spark, sf):
    return review.flag_counts(review.fold_review_actions(actions(spark, sf)))


@query("flags_upsert", f"""WITH {SQL_FOLD}, upd AS (SELECT '/c/' || user_id AS file_path FROM events
 WHERE user_id % 4 = 0 GROUP BY 1), fresh AS (SELECT DISTINCT '/c/' || user_id AS file_path, 99 AS
 segment_index, 'new' AS examiner_note, 'now' AS flagged_at, 'done' AS review_status FROM events
 WHERE user_id % 8 = 0)
 SELECT * FROM flags WHERE file_path NOT IN (SELECT file_path FROM upd) UNION ALL SELECT * FROM fresh""")
def flags_upsert(spark, sf):
    """Every fourth file is replaced; half of those get an empty list, which removes the file."""
    e = table(spark, sf, "events").select("user_id").distinct()
    path = F.concat(F.lit("/c/"), F.col("user_id").cast("string")).alias("file_path")
    updates = e.filter("user_id % 4 = 0").select(path)
    fresh = e.filter("user_id % 8 = 0").select(
        path, F.lit(99).cast("bigint").alias("segment_index"), F.lit("new").alias("examiner_note"),
        F.lit("now").alias("flagged_at"), F.lit("done").alias("review_status"),
    )
    return review.upsert_flags(review.fold_review_actions(actions(spark, sf)), updates, fresh)


SQL_FLAGGED = f"""{SQL_RESULTS}, fl AS (SELECT CASE WHEN doc_id % 5 = 0 THEN '' ELSE p2 END AS file_path,
 doc_id % 3 AS segment_index, doc_id FROM (SELECT doc_id, file_path AS p2 FROM results)),
 sg AS (SELECT file_path, k + 100 * (doc_id % 2) AS segment_index, 's' || k || ' ' || source_text AS source_text,
 't' || k || ' ' || coalesce(translated_text, '') AS translated_text FROM results,
 (VALUES (0), (1)) AS v(k) WHERE source_text IS NOT NULL),
 fseg AS (SELECT segment_index, arg_min(source_text, file_path) AS s, arg_min(translated_text, file_path)
 AS t FROM sg GROUP BY 1),
 fres AS (SELECT arg_min(source_text, file_path) AS s, arg_min(translated_text, file_path) AS t FROM results
 WHERE translated_text IS NOT NULL)"""


@query("flags_to_results", f"""WITH {SQL_FLAGGED}
 SELECT fl.file_path, fl.segment_index, CASE WHEN sg.file_path IS NOT NULL THEN sg.source_text ELSE
 coalesce(r.source_text, '') END AS original, CASE WHEN sg.file_path IS NOT NULL THEN sg.translated_text
 ELSE coalesce(r.translated_text, '') END AS translation, 'n' || fl.doc_id AS examiner_note,
 'NEEDS REVIEW' AS status FROM fl LEFT JOIN sg USING (file_path, segment_index) LEFT JOIN results r
 ON r.file_path = fl.file_path WHERE fl.file_path <> ''
 UNION ALL SELECT '(unknown)', fl.segment_index, coalesce(fseg.s, fres.s), coalesce(fseg.t, fres.t),
 'n' || fl.doc_id, 'NEEDS REVIEW' FROM fl LEFT JOIN fseg USING (segment_index), fres
 WHERE fl.file_path = ''""")
def flags_to_results(spark, sf):
    r = results(spark, sf)
    i = F.col("doc_id")
    flags = r.select(
        F.when(i % 5 == 0, "").otherwise(F.col("file_path")).alias("file_path"),
        (i % 3).alias("segment_index"), F.concat(F.lit("n"), i.cast("string")).alias("examiner_note"),
        F.lit("").alias("review_status"),
    )
    segs = r.filter(F.col("source_text").isNotNull()).select(
        "file_path", F.explode(F.array(F.lit(0), F.lit(1))).alias("k"), "source_text", "translated_text",
        "doc_id",
    ).select(
        "file_path", (F.col("k") + 100 * (i % 2)).alias("segment_index"),
        F.concat(F.lit("s"), F.col("k").cast("string"), F.lit(" "), "source_text").alias("source_text"),
        F.concat(F.lit("t"), F.col("k").cast("string"), F.lit(" "),
                 F.coalesce("translated_text", F.lit(""))).alias("translated_text"),
    )
    return review.flags_to_results(flags, r, segs)


@query("pending_translations", f"""WITH {SQL_FOLD}, {SQL_REVIEW_SEGMENTS} SELECT s.file_path,
 s.segment_index, CASE WHEN f.file_path IS NOT NULL THEN '{R.PENDING_MARK}' ELSE '' END ||
 s.translated_text AS translated_text, f.file_path IS NOT NULL AS is_flagged FROM rsegs s
 LEFT JOIN flags f USING (file_path, segment_index)""")
def pending_translations(spark, sf):
    flags = review.fold_review_actions(actions(spark, sf))
    segs = review_segments(spark, sf).select("file_path", "segment_index", "translated_text")
    return review.pending_translations(segs, flags, R.PENDING_MARK)


@query("recent_files", """SELECT '/f/' || user_id AS path, max(event_id) AS seq FROM events GROUP BY 1
 ORDER BY seq DESC LIMIT 10""")
def recent_files(spark, sf):
    opens = table(spark, sf, "events").select(
        F.concat(F.lit("/f/"), F.col("user_id").cast("string")).alias("path"),
        F.col("event_id").alias("seq"),
    )
    return review.recent_files(opens)


LOG_TYPE = "CASE WHEN event_type IN ('signup', 'click') THEN 'start' ELSE 'done' END"
SQL_LOG = f"""log AS (SELECT event_id AS seq, '/f/' || user_id AS path, user_id % 3 AS run_id,
 {LOG_TYPE} AS type, value > 50 AS is_foreign, value > 75 AS translated,
 CASE WHEN event_type = 'error' AND event_id % 3 = 0 THEN 'failed' END AS error FROM events)"""


def file_log(spark, sf):
    """File events of three runs from the event table."""
    e = table(spark, sf, "events")
    return e.select(
        F.col("event_id").alias("seq"),
        F.concat(F.lit("/f/"), F.col("user_id").cast("string")).alias("path"),
        (F.col("user_id") % 3).alias("run_id"), F.expr(LOG_TYPE).alias("type"),
        (F.col("value") > 50).alias("is_foreign"), (F.col("value") > 75).alias("translated"),
        F.when((F.col("event_type") == "error") & (F.col("event_id") % 3 == 0), "failed").alias("error"),
    )


SQL_STATE = f"""{SQL_LOG}, fs AS (SELECT path, min(seq) AS first FROM log WHERE type = 'start' GROUP BY 1),
 dn AS (SELECT log.* FROM log JOIN fs USING (path) WHERE type = 'done' AND seq > first QUALIFY
 row_number() OVER (PARTITION BY path ORDER BY seq DESC) = 1),
 ls AS (SELECT log.path, log.type FROM log JOIN fs USING (path) WHERE seq >= first QUALIFY row_number()
 OVER (PARTITION BY path ORDER BY seq DESC) = 1),
 states AS (SELECT path, CASE WHEN ls.type = 'start' THEN 'active' WHEN dn.error IS NOT NULL THEN 'error'
 ELSE 'done' END AS status, coalesce(dn.is_foreign, FALSE) AS is_foreign,
 coalesce(dn.translated, FALSE) AS translated, dn.error FROM ls LEFT JOIN dn USING (path))"""


@query("latest_state", f"WITH {SQL_STATE} SELECT * FROM states")
def latest_state(spark, sf):
    return running.latest_state(file_log(spark, sf))


@query("file_states", f"""WITH {SQL_STATE} SELECT count(*) AS files,
 count(*) FILTER (WHERE status IN ('done', 'error')) AS processed,
 count(*) FILTER (WHERE is_foreign) AS foreign_files, count(*) FILTER (WHERE translated) AS
 translated_files, count(*) FILTER (WHERE status = 'error') AS errors FROM states""")
def file_states(spark, sf):
    return running.file_state_counts(running.latest_state(file_log(spark, sf)))


@query("running_counters", f"""WITH {SQL_LOG} SELECT seq, run_id,
 CAST(sum(CASE WHEN error IS NULL THEN 1 ELSE 0 END) OVER w AS BIGINT) AS processed,
 CAST(sum(CASE WHEN error IS NOT NULL THEN 1 ELSE 0 END) OVER w AS BIGINT) AS errors
 FROM log WHERE type = 'done' WINDOW w AS (PARTITION BY run_id ORDER BY seq)""")
def running_counters(spark, sf):
    done = file_log(spark, sf).filter("type = 'done'")
    counted = running.running_sums(done, ["run_id"], "seq", {
        "processed": F.col("error").isNull().cast("int"),
        "errors": F.col("error").isNotNull().cast("int"),
    }, width=1000)
    return counted.select("seq", "run_id", "processed", "errors")


@query("rolling_recent", f"""WITH {SQL_LOG} SELECT seq, run_id, string_agg(path, ',') OVER (PARTITION BY
 run_id ORDER BY seq ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) AS recent FROM log WHERE type = 'done'""")
def rolling_recent(spark, sf):
    done = file_log(spark, sf).filter("type = 'done'").select("seq", "run_id", "path")
    recent = running.rolling_recent(done, ["run_id"], "seq", "path", width=500)
    return recent.select("seq", "run_id", F.array_join("recent", ",").alias("recent"))


@query("progress_log", f"""WITH {SQL_LOG} SELECT seq, run_id,
 CAST(sum(CASE WHEN error IS NULL AND is_foreign THEN 1 ELSE 0 END) OVER w AS BIGINT) AS foreign_files,
 string_agg(path, ',') OVER (PARTITION BY run_id ORDER BY seq ROWS BETWEEN 7 PRECEDING AND CURRENT ROW)
 AS recent FROM log WHERE type = 'done' WINDOW w AS (PARTITION BY run_id ORDER BY seq)""")
def progress_log(spark, sf):
    log = progress.progress_log(file_log(spark, sf))
    return log.select("seq", "run_id", "foreign_files", F.array_join("recent", ",").alias("recent"))


@query("until_end", f"""WITH {SQL_LOG}, ev AS (SELECT seq, path AS run_id, CASE WHEN error IS NOT NULL
 THEN 'error' WHEN seq % 31 = 0 THEN 'complete' ELSE 'segment' END AS type FROM log),
 e AS (SELECT run_id, min(seq) AS stop FROM ev WHERE type <> 'segment' GROUP BY 1)
 SELECT ev.* FROM ev LEFT JOIN e USING (run_id) WHERE stop IS NULL OR seq <= stop""")
def until_end(spark, sf):
    log = file_log(spark, sf)
    kind = F.when(F.col("error").isNotNull(), "error").when(F.col("seq") % 31 == 0, "complete")
    ev = log.select("seq", F.col("path").alias("run_id"), kind.alias("k"))
    return progress.until_end(ev.select("seq", "run_id", F.coalesce("k", F.lit("segment")).alias("type")))


@query("last_language", """SELECT user_id AS session_id, coalesce(arg_max(CASE WHEN event_type = 'error'
 THEN NULL ELSE event_type END, event_id) FILTER (WHERE event_type <> 'error'), '—') AS last_language
 FROM events GROUP BY 1""")
def last_language(spark, sf):
    """Failed chunks have no language; sessions with nothing else show the placeholder."""
    e = table(spark, sf, "events").select(
        F.col("user_id").alias("session_id"), F.col("event_id").alias("chunk_idx"),
        F.when(F.col("event_type") != "error", F.col("event_type")).alias("language"),
    )
    return running.last_language(e, ["session_id"])
