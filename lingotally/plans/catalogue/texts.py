"""Words, sentences, names, tiers, kinds and sizes."""

from __future__ import annotations

from pyspark.sql import functions as F

from lingotally import refdata as R
from lingotally.functions import kinds as K, text as X, tiers as T
from lingotally.operators import filters, rollups, segments as G
from lingotally.plans.catalogue.registry import (
    SQL_EXT, SQL_KIND, SQL_PATH, SQL_WS, documents, file_path, pages, query, sql_advisory,
    sql_word_count, table, values_sql,
)


@query("text_metrics", f"""SELECT doc_id, CAST(strlen(text) AS BIGINT) AS n_bytes,
 {sql_word_count('text')} AS n_words FROM documents""")
def text_metrics(spark, sf):
    return rollups.text_metrics(documents(spark, sf, "text"), ["doc_id"])


SENTENCES = f"""sent AS (SELECT doc_id, lang, [trim(x, {SQL_WS}) FOR x IN string_split(
 regexp_replace(text, '([.!?۔؟。])', '\\1' || chr(1), 'g'), chr(1)) IF trim(x, {SQL_WS}) <> '']
 AS l FROM documents)"""


@query("sentences", f"""WITH {SENTENCES}
 SELECT doc_id, CAST(i AS INTEGER) AS seg_idx, l[i + 1] AS text
 FROM sent, unnest(range(len(l))) AS t(i)""")
def sentences(spark, sf):
    return G.segment_index(documents(spark, sf, "text"), X.split_sentences(F.col("text")), ["doc_id"])


@query("sentence_stats", f"""WITH {SENTENCES}
 SELECT lang, CAST(sum(len(l)) AS BIGINT) AS n_sentences,
  CAST(sum(list_sum([length(x) FOR x IN l])) AS BIGINT) AS n_chars,
  CAST(max(len(l)) AS BIGINT) AS longest FROM sent GROUP BY lang""")
def sentence_stats(spark, sf):
    """Row-local counts first: sentences never reach the shuffle."""
    s = documents(spark, sf, "lang", "text").withColumn("s", X.split_sentences(F.col("text")))
    chars = F.aggregate("s", F.lit(0).cast("bigint"), lambda a, x: a + F.length(x))
    return s.select("lang", F.size("s").alias("n"), chars.alias("c")).groupBy("lang").agg(
        F.sum("n").alias("n_sentences"), F.sum("c").alias("n_chars"),
        F.max("n").cast("bigint").alias("longest"),
    )


@query("unique_char_ratio", """SELECT doc_id, round(CASE WHEN length(text) = 0 THEN 0.0 ELSE
 len(list_distinct(string_split(text, ''))) / CAST(length(text) AS DOUBLE) END, 6) AS ratio
 FROM documents""")
def unique_char_ratio(spark, sf):
    return documents(spark, sf, "text").select(
        "doc_id", F.round(X.unique_char_ratio(F.col("text")), 6).alias("ratio")
    )


@query("short_preview", """SELECT doc_id, substring(text, 1, 80) AS preview,
 substring(text, 1, 512) AS head FROM documents""")
def short_preview(spark, sf):
    t = F.col("text")
    return documents(spark, sf, "text").select(
        "doc_id", X.preview(t).alias("preview"), X.head_sample(t).alias("head")
    )


TIERED = f"""tiered AS (SELECT doc_id, (doc_id % 100) / 100.0 AS score,
 {sql_word_count('text')} AS n_words
 FROM documents), t2 AS (SELECT *, CASE WHEN n_words BETWEEN 1 AND 9 THEN 'LOW'
 WHEN score >= 0.85 THEN 'HIGH' WHEN score >= 0.60 THEN 'MEDIUM' ELSE 'LOW' END AS tier
 FROM tiered)"""


def _tiered(spark, sf):
    d = documents(spark, sf, "text").select(
        "doc_id", ((F.col("doc_id") % 100) / 100.0).alias("score"),
        X.word_count(F.col("text")).cast("bigint").alias("n_words"),
    )
    return d.withColumn("tier", T.confidence_tier(F.col("score"), F.col("n_words")))


@query("confidence_tiers", f"WITH {TIERED} SELECT doc_id, n_words, tier FROM t2")
def confidence_tiers(spark, sf):
    return _tiered(spark, sf).select("doc_id", "n_words", "tier")


@query("confidence_advisories", f"""WITH {TIERED} SELECT doc_id, tier, {sql_advisory('tier', 'n_words')}
 AS advisory FROM t2""")
def confidence_advisories(spark, sf):
    return _tiered(spark, sf).select(
        "doc_id", "tier", T.confidence_advisory(F.col("tier"), F.col("n_words")).alias("advisory")
    )


@query("foreign_docs", """SELECT doc_id, lang, lang <> '' AND lang <> 'en' AS is_foreign_strict,
 lang <> 'en' AS is_foreign_plain FROM (SELECT doc_id, CASE WHEN doc_id % 10 = 3 THEN '' ELSE lang
 END AS lang FROM documents) WHERE lang <> 'en'""")
def foreign_docs(spark, sf):
    lang = F.when(F.col("doc_id") % 10 == 3, "").otherwise(F.col("lang"))
    d = table(spark, sf, "documents").select("doc_id", lang.alias("lang"))
    return d.select(
        "doc_id", "lang", T.is_foreign_strict(F.col("lang"), "en").alias("is_foreign_strict"),
        T.is_foreign_plain(F.col("lang"), "en").alias("is_foreign_plain"),
    ).filter("is_foreign_plain")


@query("foreign_only", "SELECT doc_id, lang FROM documents WHERE lang <> '' AND lang <> 'en'")
def foreign_only(spark, sf):
    return filters.foreign_only(
        table(spark, sf, "documents").select("doc_id", "lang"), "en", "lang"
    )


@query("resolve_language", """SELECT doc_id, coalesce(nullif(CASE WHEN doc_id % 3 = 0 THEN ''
 ELSE lang END, ''), 'hint-' || source) AS language FROM documents""")
def resolve_language(spark, sf):
    detected = F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.col("lang"))
    hint = F.concat(F.lit("hint-"), F.col("source"))
    return table(spark, sf, "documents").select(
        "doc_id", T.resolve_language(detected, hint).alias("language")
    )


@query("non_blank", f"""SELECT role, count(*) AS n_rows, count(*) FILTER (WHERE blank) AS n_blank,
 CAST(sum(CASE WHEN blank THEN 0 ELSE length(t) END) AS BIGINT) AS n_chars FROM (SELECT role, t,
 trim(t, {SQL_WS}) = '' AS blank FROM (SELECT role, CASE WHEN turn % 5 = 4 THEN
 chr(10) || ' ' || chr(160) || chr(9) ELSE text END AS t FROM conversations)) GROUP BY role""")
def non_blank(spark, sf):
    t = F.when(F.col("turn") % 5 == 4, "\n  \t").otherwise(F.col("text"))
    marked = filters.mark_blank(table(spark, sf, "conversations").select("role", t.alias("text")))
    return marked.groupBy("role").agg(
        F.count("*").alias("n_rows"), F.count_if("is_blank").alias("n_blank"),
        F.coalesce(F.sum(F.length("text")), F.lit(0)).cast("bigint").alias("n_chars"),
    )


NOTICE_LANG = "CASE WHEN doc_id % 4 = 0 THEN 'fa' ELSE lang END"


@query("with_notice", f"""SELECT doc_id, language, '{R.MT_NOTICE}' ||
 CASE WHEN language = 'fa' THEN ' {R.FA_NOTICE}' ELSE '' END ||
 CASE WHEN doc_id % 3 = 0 THEN ' {R.ALT_ENGINE_NOTICE}' ELSE '' END AS notice
 FROM (SELECT doc_id, {NOTICE_LANG} AS language FROM documents)""")
def with_notice(spark, sf):
    d = table(spark, sf, "documents").select(
        "doc_id", F.expr(NOTICE_LANG).alias("language"),
        F.when(F.col("doc_id") % 3 == 0, "Seamless").otherwise("Nllb").alias("engine"),
    )
    return filters.with_notice(d, engine="engine").drop("engine")


@query("language_search", f"""SELECT v.code, v.name, v.tier, v.note, count(d.doc_id) AS n_docs FROM
 {values_sql(R.LANGUAGE_CATALOGUE, 'code, name, tier, note')} LEFT JOIN documents d ON d.lang = v.code
 WHERE contains(lower(code), 'an') OR contains(lower(name), 'an') OR contains(lower(note), 'an')
 GROUP BY ALL""")
def language_search(spark, sf):
    """Picker search, with the number of documents of every language found."""
    found = filters.search_languages(R.language_catalogue(spark), "AN")
    counts = table(spark, sf, "documents").groupBy(F.col("lang").alias("code")).agg(
        F.count("*").alias("n_docs")
    )
    return F.broadcast(found).join(counts, "code", "left").select(
        "code", "name", "tier", "note", F.coalesce("n_docs", F.lit(0)).alias("n_docs")
    )


RTL_LANG = "CASE doc_id % 5 WHEN 0 THEN 'ar' WHEN 1 THEN 'prs' WHEN 2 THEN 'he' ELSE lang END"


@query("is_rtl", f"""SELECT doc_id, language, language IN ({", ".join(f"'{c}'" for c in R.RTL_CODES)})
 AS is_rtl FROM (SELECT doc_id, {RTL_LANG} AS language FROM documents)""")
def is_rtl(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.expr(RTL_LANG).alias("language"))
    return filters.is_rtl(d)


HEADS = ["255044462D312E34", "0000001866747970", "FFD8FFE000104A46", "89504E470D0A1A0A",
         "52494646AAAAAAAA57415645", "FFFB9064", "00112233", "504B0304", "1F8B0800"]
SQL_HEAD = "CASE doc_id % 9 " + " ".join(f"WHEN {i} THEN '{h}'" for i, h in enumerate(HEADS)) + " END"
SQL_ROBUST = f"""CASE WHEN starts_with(h, '25504446') THEN 'pdf'
 WHEN substr(h, 9, 8) = '66747970' THEN 'video'
 WHEN starts_with(h, 'FFD8FF') OR starts_with(h, '89504E470D0A1A0A') THEN 'image'
 WHEN (starts_with(h, '52494646') AND substr(h, 17, 8) = '57415645') OR starts_with(h, '494433')
  OR (starts_with(h, 'FF') AND substr(h, 3, 1) IN ('E', 'F')) THEN 'audio'
 ELSE {SQL_KIND} END"""
SQL_FILES = f"files AS (SELECT doc_id, n_chars, {SQL_PATH} AS p, {SQL_HEAD} AS h FROM documents)"


def _files(spark, sf):
    d = table(spark, sf, "documents")
    head = F.unhex(F.element_at(F.array(*[F.lit(h) for h in HEADS]), (F.col("doc_id") % 9 + 1).cast("int")))
    return d.select("doc_id", "n_chars", file_path(F.col("doc_id"), F.col("source")).alias("path"),
                    head.alias("head"))


@query("kind_robust", f"""WITH {SQL_FILES} SELECT doc_id, {SQL_KIND} AS kind_ext,
 {SQL_ROBUST} AS kind, CASE WHEN {SQL_EXT} IN ('mp3','wav','m4a','aac','ogg','flac') THEN 'audio'
 WHEN {SQL_EXT} IN ('mp4','mov','avi','mkv','webm','m4v','3gp') THEN 'video'
 WHEN {SQL_EXT} IN ('srt','vtt') THEN 'subtitle'
 WHEN {SQL_EXT} IN ('png','jpg','jpeg','tiff','bmp','gif') THEN 'image'
 ELSE 'document' END AS kind_viewer FROM files""")
def kind_robust(spark, sf):
    p, h = F.col("path"), F.col("head")
    return _files(spark, sf).select(
        "doc_id", K.kind_from_ext(p).alias("kind_ext"), K.kind_robust(p, h).alias("kind"),
        K.kind_viewer(p).alias("kind_viewer"),
    )


@query("kind_counts", f"""WITH {SQL_FILES} SELECT {SQL_ROBUST} AS kind, count(*) AS n_files
 FROM files GROUP BY 1""")
def kind_counts(spark, sf):
    kinds = _files(spark, sf).select(K.kind_robust(F.col("path"), F.col("head")).alias("kind"))
    return rollups.kind_counts(kinds)


@query("filter_kinds", f"""WITH {SQL_FILES}, k AS (SELECT doc_id, {SQL_ROBUST} AS kind FROM files)
 SELECT kind, count(*) AS eligible, (SELECT count(*) FROM k) AS total FROM k
 WHERE kind IN ('video', 'subtitle') GROUP BY kind""")
def filter_kinds(spark, sf):
    """Eligible files per kind; the total still counts every file."""
    kinds = _files(spark, sf).select(K.kind_robust(F.col("path"), F.col("head")).alias("kind"))
    total = kinds.agg(F.count("*"))
    kept = filters.filter_kinds(kinds, ["VIDEO", "subtitle"])
    return kept.groupBy("kind").agg(F.count("*").alias("eligible")).withColumn(
        "total", total.scalar()
    )


@query("size_gate", """SELECT doc_id, length, CASE WHEN length = 0 THEN 'corrupt'
 WHEN length > 524288000 THEN 'too_large' WHEN strlen(text) > 8000 THEN 'too_large' END AS error
 FROM (SELECT doc_id, text, CASE WHEN doc_id % 20 = 0 THEN 0 ELSE n_chars * 200000 END AS length
 FROM documents)""")
def size_gate(spark, sf):
    length = F.when(F.col("doc_id") % 20 == 0, 0).otherwise(F.col("n_chars") * 200_000)
    d = documents(spark, sf, "text", "n_chars").select(
        "doc_id", "text", length.cast("bigint").alias("length")
    )
    gate = K.size_gate(F.col("length"), F.col("text"), max_text=8_000)
    return d.select("doc_id", "length", gate.alias("error"))


@query("name_scalars", """SELECT page_id, regexp_extract(url, '([^/]*)$', 1) AS base_name,
 CASE WHEN len(string_split(url, '/')) > 2 THEN '…/' || array_to_string(
  string_split(url, '/')[-2:], '/') ELSE url END AS short_path,
 regexp_replace(url, '[^A-Za-z0-9_-]', '_', 'g') AS safe_id,
 regexp_replace('__label__' || CASE WHEN page_id % 2 = 0 THEN 'de' ELSE 'fr' END, '^__label__', '')
  AS label,
 upper(replace(CASE page_id % 3 WHEN 0 THEN 'needs_review' WHEN 1 THEN 'in_progress' ELSE
  'done' END, '_', ' ')) AS status,
 sha256(html) AS sha256 FROM pages""")
def name_scalars(spark, sf):
    status = F.when(F.col("page_id") % 3 == 0, "").when(
        F.col("page_id") % 3 == 1, "in_progress").otherwise("done")
    label = F.when(F.col("page_id") % 2 == 0, "__label__de").otherwise("__label__fr")
    return pages(spark, sf).select(
        "page_id", X.base_name(F.col("url")).alias("base_name"),
        X.short_path(F.col("url")).alias("short_path"), X.sanitize_id(F.col("url")).alias("safe_id"),
        X.strip_label_prefix(label).alias("label"), X.status_label(status).alias("status"),
        X.sha256_hex(F.col("html")).alias("sha256"),
    )


@query("html_escape", """SELECT page_id, replace(replace(replace(replace(replace(html, '&', '&amp;'),
 '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;') AS escaped FROM pages""")
def html_escape(spark, sf):
    return pages(spark, sf).select("page_id", X.html_escape(F.col("html")).alias("escaped"))


@query("progress_scalars", """SELECT source, CAST(CASE WHEN total = 0 THEN 0 ELSE
 floor(100.0 * done / total + 0.5) END AS BIGINT) AS percent, round(CASE WHEN ms > 0 THEN
 total * 1000.0 / ms ELSE 0.0 END, 6) AS per_second FROM (SELECT source, count(*) AS total,
 count(*) FILTER (WHERE n_chars > 400) AS done, CAST(sum(n_chars) AS BIGINT) AS ms FROM documents
 GROUP BY source)""")
def progress_scalars(spark, sf):
    per = table(spark, sf, "documents").groupBy("source").agg(
        F.count("*").alias("total"), F.count_if(F.col("n_chars") > 400).alias("done"),
        F.sum("n_chars").alias("ms"),
    )
    return per.select(
        "source", X.percent_done(F.col("done"), F.col("total")).alias("percent"),
        F.round(X.throughput(F.col("total"), F.col("ms")), 6).alias("per_second"),
    )
