"""Rollups, checks, manifests and report rows over the results table."""

from __future__ import annotations

from pyspark.sql import functions as F

from lingotally import refdata as R
from lingotally.functions import text as X
from lingotally.operators import filters, lookups, manifest as M, rollups
from lingotally.plans.catalogue.registry import (
    SQL_RESULTS, SQL_SEGMENTS, TARGET, conversation_segments, documents, file_path, query, results,
    sql_word_count, table, values_sql,
)
from lingotally.sources import writers

NAMES = values_sql(list(R.LANGUAGE_NAMES.items()), "code, language_name")
SQL_GROUPS = f"""{SQL_RESULTS}, groups AS (SELECT detected_language AS language_code,
 coalesce(language_name, '(unknown)') AS language_name, count(*) AS file_count,
 CAST(sum(coalesce({sql_word_count('source_text')}, 0)) AS BIGINT) AS total_words
 FROM results LEFT JOIN {NAMES} ON code = detected_language WHERE detected_language <> '' GROUP BY ALL)"""


@query("language_groups", f"WITH {SQL_GROUPS} SELECT * FROM groups")
def language_groups(spark, sf):
    return rollups.language_groups(results(spark, sf))


@query("dominant_language", f"""WITH {SQL_GROUPS} SELECT language_code AS dominant_language FROM groups
 WHERE language_code <> '{TARGET}' ORDER BY file_count DESC, language_code DESC LIMIT 1""")
def dominant_language(spark, sf):
    return rollups.dominant_language(rollups.language_groups(results(spark, sf)), TARGET)


@query("dominant_source", """SELECT source AS dominant_language FROM (SELECT source, count(*) AS n
 FROM documents GROUP BY 1) WHERE source <> 'src19' ORDER BY n DESC, source DESC LIMIT 1""")
def dominant_source(spark, sf):
    """Sources have equal shares: the tie rule decides."""
    n = table(spark, sf, "documents").groupBy("source").agg(F.count("*").alias("n"))
    return rollups.dominant_language(n, "src19", "source", "n")


@query("languages_detected", f"""WITH {SQL_RESULTS} SELECT string_agg(detected_language || '=' || n, ','
 ORDER BY detected_language) AS languages FROM (SELECT detected_language, count(*) AS n FROM results
 WHERE detected_language <> '' GROUP BY 1)""")
def languages_detected(spark, sf):
    m = rollups.languages_detected(results(spark, sf))
    pairs = F.transform(F.map_entries("languages_detected"),
                        lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return m.select(F.array_join(pairs, ",").alias("languages"))


COUNTERS = """count(*) AS total_files, count(*) FILTER (WHERE error IS NULL) AS processed,
 count(*) FILTER (WHERE error IS NOT NULL) AS errors,
 count(*) FILTER (WHERE error IS NULL AND is_foreign) AS foreign_language,
 count(*) FILTER (WHERE error IS NULL AND translated_text IS NOT NULL) AS translated"""


@query("batch_counters", f"WITH {SQL_RESULTS} SELECT {COUNTERS} FROM results")
def batch_counters(spark, sf):
    return rollups.batch_counters(results(spark, sf))


@query("batch_summary", f"""WITH {SQL_RESULTS} SELECT {COUNTERS}, (SELECT detected_language FROM results
 WHERE detected_language NOT IN ('', '{TARGET}') GROUP BY 1 ORDER BY count(*) DESC, 1 DESC LIMIT 1)
 AS dominant_language, '{R.MT_NOTICE}' AS machine_translation_notice FROM results""")
def batch_summary(spark, sf):
    s = rollups.summary(results(spark, sf), TARGET, 0.0)
    return s.drop("languages_detected", "processing_time_seconds")


@query("check_rollup", """SELECT count(*) FILTER (WHERE s = 'pass') AS passed,
 count(*) FILTER (WHERE s = 'fail') AS failed, count(*) FILTER (WHERE s = 'skip') AS skipped,
 count(*) FILTER (WHERE s = 'warn') AS warned, count(*) FILTER (WHERE s = 'fail') = 0 AS ready
 FROM (SELECT CASE WHEN lang IS NULL THEN 'skip' WHEN length(text) <> n_chars THEN 'fail'
 WHEN n_chars < 100 THEN 'warn' ELSE 'pass' END AS s FROM documents)""")
def check_rollup(spark, sf):
    """Data-quality checks of every document, rolled up."""
    status = (
        F.when(F.col("lang").isNull(), "skip")
        .when(F.length("text") != F.col("n_chars"), "fail")
        .when(F.col("n_chars") < 100, "warn").otherwise("pass")
    )
    return rollups.check_rollup(documents(spark, sf).select(status.alias("status")))


METRICS = """m AS (SELECT source || '/' || lang AS test_name, CAST(sum(n_chars) AS BIGINT) AS base,
 count(*) AS n FROM documents GROUP BY ALL),
 b AS (SELECT test_name, CASE WHEN n % 5 = 0 THEN 0 ELSE base END AS duration_ms, 0 AS position FROM m
 UNION ALL SELECT test_name, base * 10, 1 FROM m)"""


@query("regressions", f"""WITH {METRICS}, f AS (SELECT test_name, base + base * (n % 7) // 10 AS duration_ms
 FROM m), first AS (SELECT test_name, duration_ms AS baseline_ms FROM b WHERE position = 0)
 SELECT test_name, f.duration_ms, baseline_ms, round(f.duration_ms / CAST(baseline_ms AS DOUBLE), 6)
 AS ratio FROM f JOIN first USING (test_name) WHERE baseline_ms <> 0
 AND f.duration_ms / CAST(baseline_ms AS DOUBLE) > 1.2""")
def regressions(spark, sf):
    m = table(spark, sf, "documents").groupBy(
        F.concat("source", F.lit("/"), "lang").alias("test_name")
    ).agg(F.sum("n_chars").alias("base"), F.count("*").alias("n"))
    slower = F.call_function("div", F.col("base") * (F.col("n") % 7), F.lit(10))
    fresh = m.select("test_name", (F.col("base") + slower).alias("duration_ms"))
    first = m.select("test_name", F.when(F.col("n") % 5 == 0, 0).otherwise(F.col("base")).alias("duration_ms"),
                     F.lit(0).alias("position"))
    second = m.select("test_name", (F.col("base") * 10).alias("duration_ms"), F.lit(1).alias("position"))
    found = rollups.regressions(fresh, first.unionByName(second))
    return found.withColumn("ratio", F.round("ratio", 6))


@query("checksum_verify", """SELECT 'd/' || doc_id || CASE WHEN doc_id % 13 = 0 THEN '.gone' ELSE '' END
 AS path, CASE WHEN doc_id % 11 = 0 THEN 'skipped' WHEN doc_id % 13 = 0 THEN 'skipped'
 WHEN doc_id % 50 = 0 THEN 'mismatch' ELSE 'ok' END AS status, CASE WHEN doc_id % 13 <> 0
 THEN sha256(text) END AS computed_sha256 FROM documents""")
def checksum_verify(spark, sf):
    d = documents(spark, sf, "text")
    i = F.col("doc_id")
    path = F.concat(F.lit("d/"), i.cast("string"))
    files = d.select(path.alias("path"), X.sha256_hex(F.col("text")).alias("sha256"))
    wanted = F.when(i % 11 == 0, "").when(i % 50 == 0, "0000").otherwise(X.sha256_hex(F.col("text")))
    gone = F.when(i % 13 == 0, F.concat(path, F.lit(".gone"))).otherwise(path)
    expected = d.select(gone.alias("path"), wanted.alias("sha256"))
    return rollups.verify_checksums(files, expected).select("path", "status", "computed_sha256")


MODEL_OF = "CASE event_type WHEN 'view' THEN 'base' WHEN 'click' THEN 'tiny' WHEN 'signup' THEN 'pashto' ELSE 'other' END"
WANTED = "CASE doc_id % 4 WHEN 0 THEN 'ps' WHEN 1 THEN 'prs' ELSE lang END"


@query("choose_installed", f"""WITH inst AS (SELECT DISTINCT {MODEL_OF} AS model FROM events),
 cand AS (SELECT * FROM (VALUES ('large-v3', 2), ('base', 3), ('tiny', 4)) AS v(model, p)
  WHERE model IN (SELECT model FROM inst))
 SELECT doc_id, language, coalesce(CASE WHEN language = 'ps' AND 'pashto' IN (SELECT model FROM inst)
 THEN 'pashto' WHEN language IN ('prs', 'fa-AF') AND 'dari' IN (SELECT model FROM inst) THEN 'dari' END,
 (SELECT model FROM cand ORDER BY p LIMIT 1), 'tiny') AS model
 FROM (SELECT doc_id, {WANTED} AS language FROM documents)""")
def choose_installed(spark, sf):
    requests = table(spark, sf, "documents").select("doc_id", F.expr(WANTED).alias("language"))
    installed = table(spark, sf, "events").select(F.expr(MODEL_OF).alias("model"))
    return lookups.choose_installed(requests, installed, "doc_id")


@query("missing_components", """SELECT DISTINCT 'doc-' || doc_id AS component FROM documents
 WHERE doc_id NOT IN (SELECT doc_id FROM labels)""")
def missing_components(spark, sf):
    name = F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("component")
    return lookups.missing_components(
        table(spark, sf, "documents").select(name), table(spark, sf, "labels").select(name)
    )


SQL_MANIFEST = f"""{SQL_RESULTS}, man AS (SELECT regexp_extract(file_path, '([^/]*)$', 1) AS original_name,
 file_path AS original_path, CASE WHEN doc_id % 17 = 0 THEN '' ELSE sha256(text) END AS sha256,
 CASE WHEN doc_id % 17 = 0 THEN 0 ELSE CAST(strlen(text) AS BIGINT) END AS size_bytes,
 detected_language AS language, translated_text IS NOT NULL AS translated,
 CASE WHEN translated_text IS NOT NULL THEN 'translations/' || regexp_extract(file_path, '([^/]*)$', 1)
 || '.' || substring(sha256(file_path), 1, 8) || '.{TARGET}.txt' ELSE '' END AS translation_file
 FROM results JOIN documents USING (doc_id))"""


def _manifest(spark, sf):
    i = F.col("doc_id")
    path = file_path(i, F.col("source"))
    moved = F.when(i % 17 == 0, F.concat(path, F.lit(".gone"))).otherwise(path)
    files = documents(spark, sf, "text", "source").select(moved.alias("path"), "text")
    digests = M.file_digests(files, F.encode("text", "UTF-8"))
    return M.manifest_rows(results(spark, sf), digests, TARGET)


@query("manifest", f"WITH {SQL_MANIFEST} SELECT * FROM man")
def manifest(spark, sf):
    """Every seventeenth original lies under another path, so its digest is missing."""
    return _manifest(spark, sf)


@query("manifest_header", f"""WITH {SQL_MANIFEST} SELECT '1.0' AS package_version, 'A. Examiner' AS examiner,
 '/ev' AS source_directory, count(*) AS file_count, count(*) FILTER (WHERE translated) AS translated_count,
 '{R.MT_NOTICE}' AS machine_translation_notice FROM man""")
def manifest_header(spark, sf):
    head = M.manifest_header(_manifest(spark, sf), "/ev", facts={"examiner": "A. Examiner"})
    return head.drop("agency", "case_number", "created_at")


@query("custody_facts", f"""WITH {SQL_RESULTS}, c AS (SELECT {COUNTERS} FROM results)
 SELECT 0 AS position, 'examiner' AS key, 'A. Examiner' AS value UNION ALL
 SELECT 1, 'processed', CAST(processed AS VARCHAR) FROM c UNION ALL
 SELECT 2, 'foreign_language', CAST(foreign_language AS VARCHAR) FROM c UNION ALL
 SELECT 3, 'translated', CAST(translated AS VARCHAR) FROM c UNION ALL
 SELECT 4, 'errors', CAST(errors AS VARCHAR) FROM c""")
def custody_facts(spark, sf):
    return M.custody_facts(rollups.batch_counters(results(spark, sf)), {"examiner": "A. Examiner"})


ESC = ("replace(replace(replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), "
       "'\"', '&quot;'), '''', '&#39;')")


def _td(x: str) -> str:
    return f"'<td>' || {ESC.replace('{x}', f'coalesce({x}, chr(0)[1:0])')} || '</td>'"


@query("html_fragments", f"""WITH {SQL_RESULTS} SELECT detected_language AS language_code, file_path,
 '<tr class="' || CASE WHEN error IS NOT NULL THEN 'errored' WHEN is_foreign THEN 'foreign' ELSE '' END
 || '">' || {_td('file_path')} || {_td('input_type')} || {_td('detected_language')} ||
 {_td('confidence_tier')} || CASE WHEN is_foreign THEN '<td>yes</td>' ELSE '<td>no</td>' END ||
 {_td('source_text')} || {_td('coalesce(translated_text, error)')} || '</tr>' AS fragment
 FROM results""".replace("chr(0)[1:0]", "''"))
def html_fragments(spark, sf):
    return writers.html_fragments(results(spark, sf))


def _csv(x: str) -> str:
    return (f"CASE WHEN regexp_matches({x}, '[,\"\\r\\n]') THEN '\"' || replace({x}, '\"', '\"\"') || '\"' "
            f"ELSE coalesce({x}, '') END")


@query("csv_rows", f"""WITH {SQL_RESULTS} SELECT file_path, {_csv('file_path')} || ',' || {_csv('input_type')}
 || ',' || {_csv('detected_language')} || ',' || CASE WHEN is_foreign THEN 'true' ELSE 'false' END || ','
 || {_csv('source_text')} || ',' || {_csv('translated_text')} || ',' || {_csv('error')} AS csv_row
 FROM results""")
def csv_rows(spark, sf):
    return writers.csv_rows(results(spark, sf))


@query("translation_text", f"""WITH {SQL_RESULTS}, {SQL_SEGMENTS}, lines AS (SELECT doc_id, string_agg(
 '[' || start_ms || ' - ' || end_ms || ' ms] ' || text || ' → [{TARGET}] ' || text || chr(10), '' ORDER BY seg_idx)
 AS l FROM segs GROUP BY doc_id)
 SELECT file_path, detected_language AS language, '# Machine translation' || chr(10) || '# Source file: '
 || file_path || chr(10) || '# Detected language: ' || detected_language || chr(10) ||
 '# {R.MT_NOTICE}' || chr(10) || chr(10) || '--- SOURCE ---' || chr(10) || source_text || chr(10) || chr(10)
 || '--- TRANSLATION ---' || chr(10) || translated_text || chr(10) || coalesce(chr(10) || '--- SEGMENTS ---'
 || chr(10) || l, '') AS body FROM results LEFT JOIN lines USING (doc_id) WHERE translated_text IS NOT NULL""")
def translation_text(spark, sf):
    """Documents and conversations of the same number share a file."""
    r = results(spark, sf)
    s = conversation_segments(spark, sf).join(r.select("doc_id", "file_path"), "doc_id").select(
        "file_path", F.col("seg_idx").alias("segment_index"), "start_ms", "end_ms",
        F.col("text").alias("source_text"),
        F.concat(F.lit(f"[{TARGET}] "), F.col("text")).alias("translated_text"),
    )
    return writers.translation_text(r, s)


@query("artifacts", f"""WITH {SQL_RESULTS} SELECT '{R.TITLE_PREFIX}Translation: ' ||
 regexp_extract(file_path, '([^/]*)$', 1) AS title, translated_text AS detail, file_path AS source_path,
 50 AS confidence, '{R.MT_NOTICE}' AS notice, source_text FROM results WHERE translated_text IS NOT NULL""")
def artifacts(spark, sf):
    a = filters.to_artifact(results(spark, sf))
    return a.select("title", "detail", "source_path", "confidence", "notice",
                    F.col("raw_data.source_text").alias("source_text"))


@query("notice_violations", f"""WITH {SQL_RESULTS} SELECT file_path FROM results
 WHERE translated_text IS NOT NULL AND doc_id % 4 = 0""")
def notice_violations(spark, sf):
    """The notice is blanked for every fourth document; exactly those translations are reported."""
    r = results(spark, sf)
    broken = r.withColumn("notice", F.when(F.col("doc_id") % 4 == 0, " ").otherwise(F.col("notice")))
    return filters.notice_violations(broken).select("file_path")


@query("assert_notice", f"""WITH {SQL_RESULTS} SELECT detected_language, count(*) AS n,
 count(translated_text) AS n_notices FROM results GROUP BY 1""")
def assert_notice(spark, sf):
    checked = filters.assert_notice(results(spark, sf))
    return checked.groupBy("detected_language").agg(
        F.count("*").alias("n"), F.count("notice").alias("n_notices")
    )
