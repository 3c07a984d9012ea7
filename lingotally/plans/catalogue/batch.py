"""The whole batch run over documents as files."""

from __future__ import annotations

from pyspark.sql import functions as F

from lingotally.functions import kinds as K
from lingotally.operators import infer, langid
from lingotally.plans.batch import run_batch
from lingotally.plans.catalogue.langid import SQL_CONF, SQL_LANGID, profile_of
from lingotally.plans.catalogue.registry import (
    SQL_KIND, SQL_PATH, SQL_WS, TARGET, documents, file_path, query, sql_word_count,
)


def files(spark, sf):
    """Documents as files: some failed upstream, some are blank."""
    i = F.col("doc_id")
    path = file_path(i, F.col("source"))
    text = F.when(i % 37 == 0, " \n ").otherwise(F.col("text"))
    return documents(spark, sf, "text", "source").select(
        path.alias("file_path"), K.kind_from_ext(path).alias("kind"),
        F.octet_length(text).cast("bigint").alias("length"), text.alias("text"),
        F.lit("und").alias("upstream_language"),
        F.when(i % 40 == 1, "decoder failed").alias("error"),
    )


SQL_BATCH = f"""{SQL_LANGID}, f AS (SELECT d.doc_id, p AS file_path, {SQL_KIND} AS input_type,
 CASE WHEN d.doc_id % 37 = 0 THEN '' WHEN trim(d.text, {SQL_WS}) = '' THEN '' ELSE d.text END AS text,
 lid.language, {SQL_CONF} AS conf, {sql_word_count('d.text')} AS nw,
 CASE WHEN d.doc_id % 40 = 1 THEN 'decoder failed' WHEN d.doc_id % 37 <> 0 AND strlen(d.text) = 0
 THEN 'corrupt' END AS error FROM (SELECT *, {SQL_PATH} AS p FROM documents) d JOIN lid USING (doc_id)),
 res AS (SELECT file_path, input_type, CASE WHEN error IS NOT NULL THEN '' WHEN text = '' OR language = ''
 THEN 'und' ELSE language END AS detected_language, error IS NULL AND text <> '' AND
 (language = '' OR language <> '{TARGET}') AS is_foreign,
 CASE WHEN error IS NOT NULL OR text = '' THEN '' WHEN nw BETWEEN 1 AND 9 THEN 'LOW' WHEN conf >= 0.85
 THEN 'HIGH' WHEN conf >= 0.60 THEN 'MEDIUM' ELSE 'LOW' END AS confidence_tier,
 CASE WHEN error IS NULL AND text <> '' AND (language = '' OR language <> '{TARGET}')
 THEN '[{TARGET}] ' || text END AS translated_text, error FROM f)"""


def plan(spark, sf):
    detect = langid.detector(profile_of(spark, sf))
    return run_batch(files(spark, sf), detect, infer.tagging_model(TARGET), TARGET)


@query("run_batch", f"WITH {SQL_BATCH} SELECT * FROM res")
def batch_results(spark, sf):
    return plan(spark, sf).results.select(
        "file_path", "input_type", "detected_language", "is_foreign", "confidence_tier",
        "translated_text", "error",
    )


@query("run_batch_groups", f"""WITH {SQL_BATCH} SELECT detected_language AS language_code, count(*) AS n_files,
 count(translated_text) AS n_translated FROM res WHERE detected_language <> '' GROUP BY 1""")
def batch_groups(spark, sf):
    """Counters of the run: the texts themselves are pruned from the rollup."""
    r = plan(spark, sf).results
    return r.filter("detected_language <> ''").groupBy(
        F.col("detected_language").alias("language_code")
    ).agg(F.count("*").alias("n_files"), F.count("translated_text").alias("n_translated"))


@query("run_batch_counters", f"""WITH {SQL_BATCH} SELECT count(*) AS total_files,
 count(*) FILTER (WHERE error IS NULL) AS processed, count(*) FILTER (WHERE error IS NOT NULL) AS errors,
 count(*) FILTER (WHERE is_foreign) AS foreign_language, count(translated_text) AS translated
 FROM res WHERE input_type IN ('video', 'audio')""".replace(
     "count(*) AS total_files", "(SELECT count(*) FROM res) AS total_files"))
def batch_run_counters(spark, sf):
    """Audio and video only: the total still counts every file found."""
    detect = langid.detector(profile_of(spark, sf))
    p = run_batch(files(spark, sf), detect, infer.tagging_model(TARGET), TARGET, ["audio", "video"])
    return p.counters()
