"""Trigram profile, language scores, classification, distinct inference."""

from __future__ import annotations

import sys

from pyspark import cloudpickle
from pyspark.sql import functions as F

from lingotally import refdata as R
from lingotally.functions import tiers as T
from lingotally.operators import calibration as C, infer, langid
from lingotally.plans.catalogue.registry import (
    SQL_WS, TARGET, documents, query, sql_advisory, sql_word_count, table,
)
from lingotally.plans.catalogue.scripts import (
    LETTERED, LETTERED_LANG, SQL_GLYPHS, SQL_LETTERED, SQL_LETTERED_DIALECTS,
)
from lingotally.plans.classify import classify, with_route
from lingotally.plans.translate import (
    joined_translation, sentence_units, translate_documents, translate_segments,
)
from lingotally.session import durable

# Functions of this module travel to Python workers by value: executors need no install.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

SQL_SAMPLE = r"regexp_replace(lower({t}), '[\s\x0b\x{85}\p{Z}]+', ' ', 'g')"


def sql_grams(rel: str) -> str:
    return f"""(SELECT doc_id, lang, substring(s, CAST(i AS BIGINT), 3) AS gram FROM (SELECT doc_id, lang,
 {SQL_SAMPLE.replace('{t}', 'text')} AS s FROM {rel}), unnest(range(1, length(s) - 1)) AS t(i))"""


SQL_PROFILE = f"""grams AS (SELECT * FROM {sql_grams('documents')}),
 profile AS (SELECT lang AS language, gram, count(*) AS n, row_number() OVER (PARTITION BY lang
 ORDER BY count(*) DESC, gram) AS rank FROM grams GROUP BY lang, gram
 QUALIFY row_number() OVER (PARTITION BY lang ORDER BY count(*) DESC, gram) <= 300)"""
SQL_LANGID = f"""{SQL_PROFILE}, sc AS (SELECT doc_id, language, CAST(sum(301 - rank) AS BIGINT) AS score
 FROM grams JOIN profile USING (gram) GROUP BY doc_id, language),
 rk AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, language) AS r FROM sc),
 lid AS (SELECT d.doc_id, d.lang, coalesce(a.language, '') AS language, coalesce(a.score, 0) AS score,
 coalesce(b.score, 0) AS runner_up FROM documents d
 LEFT JOIN (SELECT * FROM rk WHERE r = 1) a USING (doc_id)
 LEFT JOIN (SELECT * FROM rk WHERE r = 2) b USING (doc_id))"""
SQL_CONF = ("CASE WHEN score > 0 THEN least((score - runner_up) * 2.0::DOUBLE / score, 1.0::DOUBLE) "
            "ELSE 0.0 END")


def profile_of(spark, sf):
    """Profile of the labelled documents, stored once: scoring reads the few stored rows."""
    return durable(langid.train_profile(documents(spark, sf, "lang", "text")))


@query("ngram_profile", f"""WITH {SQL_PROFILE} SELECT language, gram, n, CAST(rank AS INTEGER) AS rank,
 CAST(301 - rank AS INTEGER) AS weight FROM profile""")
def ngram_profile(spark, sf):
    return langid.train_profile(documents(spark, sf, "lang", "text"))


@query("language_scores", f"WITH {SQL_LANGID} SELECT doc_id, language, score FROM sc")
def language_scores(spark, sf):
    d = documents(spark, sf, "text")
    scores = langid.language_scores(d, profile_of(spark, sf), "doc_id")
    return scores.filter("language is not null")


@query("langid", f"""WITH {SQL_LANGID} SELECT doc_id, language, CAST(score AS BIGINT) AS score,
 CAST(runner_up AS BIGINT) AS runner_up FROM lid""")
def langid_relational(spark, sf):
    d = documents(spark, sf, "text")
    return langid.best_language(
        langid.language_scores(d, profile_of(spark, sf), "doc_id"), "doc_id"
    )


@query("langid_confusion", f"""WITH {SQL_LANGID} SELECT lang AS truth, language, count(*) AS n_docs
 FROM lid GROUP BY ALL""")
def langid_confusion(spark, sf):
    """The row-local detector against the given labels."""
    detect = langid.detector(profile_of(spark, sf))
    d = documents(spark, sf, "lang", "text").select(F.col("lang").alias("truth"), detect(F.col("text")).alias("d"))
    return d.groupBy("truth", F.col("d.language").alias("language")).agg(F.count("*").alias("n_docs"))


# Parts by the first 32 bits of md5("11:doc_id"): 0.6 train, 0.2 calibrate, 0.2 are held out.
SQL_PART = """part AS (SELECT doc_id, CASE WHEN u < 0.6e0 THEN 0 WHEN u < 0.6e0 + 0.2e0 THEN 1 ELSE 2 END AS part FROM (
 SELECT doc_id, list_reduce(list_transform(range(1, 9), lambda i: CAST(strpos('0123456789abcdef',
 md5('11:' || doc_id)[i]) - 1 AS BIGINT)), lambda a, c: 16 * a + c) / 4294967296e0 AS u FROM documents))"""
SQL_HELD = f"""WITH {SQL_PART}, grams AS (SELECT * FROM {sql_grams('documents')}),
 profile AS (SELECT lang AS language, gram, row_number() OVER (PARTITION BY lang ORDER BY count(*) DESC, gram) AS rank
 FROM grams JOIN part USING (doc_id) WHERE part = 0 GROUP BY lang, gram
 QUALIFY row_number() OVER (PARTITION BY lang ORDER BY count(*) DESC, gram) <= 300),
 sc AS (SELECT doc_id, language, CAST(sum(301 - rank) AS BIGINT) AS score
 FROM grams JOIN profile USING (gram) GROUP BY doc_id, language),
 rk AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, language) AS r FROM sc),
 lid AS (SELECT doc_id, part, d.lang, coalesce(a.language, '') AS language, coalesce(a.score, 0) AS score,
 coalesce(b.score, 0) AS runner_up FROM documents d JOIN part USING (doc_id)
 LEFT JOIN (SELECT * FROM rk WHERE r = 1) a USING (doc_id)
 LEFT JOIN (SELECT * FROM rk WHERE r = 2) b USING (doc_id)),
 judged AS (SELECT *, least(CAST(floor(margin * 20) AS INTEGER), 19) AS bin, coalesce(language = lang, false) AS good
 FROM (SELECT *, {SQL_CONF} AS margin FROM lid)),
 cal AS (SELECT bin, count(*) AS n, count(*) FILTER (WHERE good) AS n_right FROM judged WHERE part = 1 GROUP BY bin),
 iso AS (SELECT bin, n, n_right, (SELECT max(low) FROM (SELECT j.bin, (SELECT min(share) FROM (SELECT k.bin,
  (SELECT CAST(sum(x.n_right) AS DOUBLE) / sum(x.n) FROM cal x WHERE x.bin BETWEEN j.bin AND k.bin) AS share
  FROM cal k WHERE k.bin >= c.bin)) AS low FROM cal j WHERE j.bin <= c.bin)) AS probability FROM cal c)"""


def held_out(spark, sf):
    """Documents with part, truth, detected language and margin; the profile has seen part 0 only."""
    d = documents(spark, sf, "lang", "text").withColumn("part", C.split(F.col("doc_id")))
    profile = durable(langid.train_profile(d.filter("part = 0")))
    found = d.select("doc_id", "part", F.col("lang").alias("truth"), langid.detector(profile)(F.col("text")).alias("d"))
    found = found.select("doc_id", "part", "truth", F.col("d.language").alias("language"),
                         langid.margin_confidence(F.col("d.score"), F.col("d.runner_up")).alias("margin"))
    return durable(found.withColumn("good", F.coalesce(F.col("language") == F.col("truth"), F.lit(False))))


@query("langid_calibration", f"""{SQL_HELD} SELECT bin, n, n_right, round(probability, 9) AS probability FROM iso""")
def langid_calibration(spark, sf):
    """Bins of the calibration part with their isotonic probabilities."""
    d = held_out(spark, sf).filter("part = 1")
    table = C.fit(d, "margin", "good")
    counts = C.bin_counts(d, "margin", "good")
    return counts.withColumn("probability", F.round(C.probability((F.col("bin") + 0.5) / len(table), table), 9))


@query("langid_held_out", f"""{SQL_HELD} SELECT lang AS truth, language, count(*) AS n_docs FROM judged WHERE part = 2
 GROUP BY ALL""")
def langid_held_out(spark, sf):
    """Confusion of documents that trained and calibrated nothing."""
    return held_out(spark, sf).filter("part = 2").groupBy("truth", "language").agg(F.count("*").alias("n_docs"))


@query("langid_reliability", f"""{SQL_HELD}, h AS (SELECT j.bin, j.margin, good, probability FROM judged j LEFT JOIN iso USING (bin)
 WHERE part = 2 AND probability IS NOT NULL)
 SELECT bin, count(*) AS n, round(avg(margin), 6) AS mean_margin, round(avg(probability), 6) AS probability,
 round(avg(CAST(good AS INTEGER)), 6) AS accuracy FROM h GROUP BY bin""")
def langid_reliability(spark, sf):
    """Held-out documents by bin: mean margin, calibrated probability, and the share that is right."""
    d = held_out(spark, sf)
    table = C.fit(d.filter("part = 1"), "margin", "good")
    seen = C.bin_counts(d.filter("part = 1"), "margin", "good").select("bin")
    held = d.filter("part = 2").withColumn("bin", C.bin_of(F.col("margin"))).join(seen, "bin", "left_semi")
    return held.groupBy("bin").agg(
        F.count("*").alias("n"), F.round(F.avg("margin"), 6).alias("mean_margin"),
        F.round(F.avg(C.probability(F.col("margin"), table)), 6).alias("probability"),
        F.round(F.avg(F.col("good").cast("int")), 6).alias("accuracy"))


SQL_CLASSIFIED = f"""{SQL_LANGID}, cl AS (SELECT doc_id, text, CASE WHEN trim(text, {SQL_WS}) = '' THEN ''
 ELSE language END AS language, CASE WHEN trim(text, {SQL_WS}) = '' THEN 0.0 ELSE {SQL_CONF} END
 AS confidence, {sql_word_count('text')} AS nw FROM lid JOIN documents USING (doc_id)),
 cls AS (SELECT *, CASE WHEN trim(text, {SQL_WS}) = '' THEN '' WHEN nw BETWEEN 1 AND 9 THEN 'LOW'
 WHEN confidence >= 0.85 THEN 'HIGH' WHEN confidence >= 0.60 THEN 'MEDIUM' ELSE 'LOW' END
 AS tier FROM cl)"""


def classified(spark, sf):
    detect = langid.detector(profile_of(spark, sf))
    return classify(documents(spark, sf, "text"), detect, TARGET)


@query("classify", f"""WITH {SQL_CLASSIFIED} SELECT doc_id, language, round(confidence, 6) AS confidence,
 language <> '' AND language <> '{TARGET}' AS is_foreign, tier AS confidence_tier,
 CAST(nw AS INTEGER) AS input_word_count, tier = 'HIGH' OR tier = '' AS no_advisory,
 '{TARGET}' AS target_language, {sql_advisory('tier', 'nw')} AS advisory,
 CASE WHEN language = 'ar' THEN '{R.DIALECT_NOTICE}' END AS dialect_note FROM cls""")
def classify_documents(spark, sf):
    c = classified(spark, sf)
    return c.select(
        "doc_id", "language", F.round("confidence", 6).alias("confidence"), "is_foreign",
        "confidence_tier", "input_word_count", F.col("advisory").isNull().alias("no_advisory"),
        "target_language", "advisory", "dialect_note",
    )


@query("translate_documents", f"""WITH {SQL_CLASSIFIED} SELECT doc_id, language,
 CASE WHEN trim(text, {SQL_WS}) <> '' THEN '[{TARGET}] ' || text END AS translated_text,
 CASE WHEN confidence < 0.75 THEN 'Seamless' ELSE 'Nllb' END AS engine
 FROM cls WHERE language <> '' AND language <> '{TARGET}'""")
def translated_documents(spark, sf):
    done = translate_documents(
        classified(spark, sf), infer.tagging_model(TARGET), TARGET, alt_available=True
    )
    return done.select("doc_id", "language", "translated_text", "engine")


@query("distinct_infer", f"""SELECT doc_id, CASE WHEN trim(text, {SQL_WS}) = '' THEN NULL ELSE
 '[{TARGET}] ' || text END AS output FROM documents""")
def distinct_infer(spark, sf):
    d = documents(spark, sf, "text")
    return infer.infer_distinct(d, infer.tagging_model(TARGET), F.col("doc_id")).select("doc_id", "output")


def failing_model():
    """Stand-in backend that fails on texts with a question mark."""
    def run(texts):
        if any("?" in t for t in texts):
            raise ValueError("cannot handle a question mark")
        return [f"[a] {t}" for t in texts]

    return run


@query("map_model_errors", """SELECT conv_id, turn, CASE WHEN NOT contains(text, '?') THEN '[a] ' || text END
 AS output, CASE WHEN contains(text, '?') THEN 'ValueError: cannot handle a question mark' END AS error
 FROM (SELECT conv_id, turn, text || CASE WHEN (conv_id + turn) % 4 = 0 THEN '?' ELSE '' END AS text
 FROM conversations)""")
def map_model_errors(spark, sf):
    return infer.map_model(_questions(spark, sf), failing_model)


@query("backend_fallback", """SELECT conv_id, turn, CASE WHEN contains(text, '?') THEN '[b] ' ELSE '[a] ' END
 || text AS output FROM (SELECT conv_id, turn, text || CASE WHEN (conv_id + turn) % 4 = 0 THEN '?'
 ELSE '' END AS text FROM conversations)""")
def backend_fallback(spark, sf):
    both = infer.with_fallback(failing_model, infer.tagging_model("b"))
    return infer.map_model(_questions(spark, sf), both).drop("error")


def _questions(spark, sf):
    mark = F.when((F.col("conv_id") + F.col("turn")) % 4 == 0, "?").otherwise("")
    c = table(spark, sf, "conversations")
    return c.select("conv_id", "turn", F.concat("text", mark).alias("text"))


SENT = f"""sent AS (SELECT doc_id, [trim(x, {SQL_WS}) FOR x IN string_split(regexp_replace(text,
 '([.!?۔؟。])', '\\1' || chr(1), 'g'), chr(1)) IF trim(x, {SQL_WS}) <> ''] AS l FROM documents
 WHERE lang <> '{TARGET}')"""


@query("translate_sentences", f"""WITH {SENT} SELECT doc_id, array_to_string(['[{TARGET}] ' || x FOR x IN l],
 ' ') AS translated_text FROM sent WHERE len(l) > 0""")
def translate_sentences(spark, sf):
    """Foreign documents translated sentence by sentence and joined again."""
    d = documents(spark, sf, "lang", "text").filter(T.is_foreign_strict(F.col("lang"), TARGET))
    done = translate_segments(
        sentence_units(d, ["doc_id"]), infer.tagging_model(TARGET), ["doc_id"]
    )
    return joined_translation(done, ["doc_id"])


@query("route_documents", f"""WITH {SQL_CLASSIFIED} SELECT engine, count(*) AS n_docs FROM (SELECT CASE
 WHEN confidence < 0.75 THEN 'Seamless' ELSE 'Nllb' END AS engine FROM cls) GROUP BY 1""")
def route_documents(spark, sf):
    routed = with_route(classified(spark, sf), alt_available=True)
    return routed.groupBy("engine").agg(F.count("*").alias("n_docs"))


@query("classify_scripts", f"""WITH {SQL_LETTERED}, {SQL_CLASSIFIED}, {SQL_GLYPHS}, {SQL_LETTERED_DIALECTS},
 al AS (SELECT *, CASE WHEN language = 'fa' AND v = 'A' AND gc >= 0.7 THEN 'ps' ELSE language END AS final
 FROM cls JOIN gv USING (doc_id))
 SELECT doc_id, final AS language, round(al.confidence, 6) AS confidence, final <> '' AND final <> '{TARGET}' AS is_foreign,
 tier AS confidence_tier, CAST(nw AS INTEGER) AS input_word_count, {sql_advisory('tier', 'nw')} AS advisory,
 CASE WHEN language = 'fa' AND v = 'A' AND gc >= 0.7 THEN 'Changed from fa to ps by script analysis; glyphs: ' || glyphs
 || '; confidence ' || printf('%.2f', gc) WHEN language = 'fa' AND v = 'Ambiguous' AND n_a > 0 THEN
 'Script analysis undecided; confidence ' || printf('%.2f', gc) END AS disambiguation_note,
 CASE WHEN final = 'ar' THEN dv.dialect END AS dialect,
 CASE WHEN final = 'ar' THEN round(dv.confidence, 6) END AS dialect_confidence,
 CASE WHEN final = 'ar' THEN '{R.DIALECT_NOTICE}' END AS dialect_note FROM al JOIN dv USING (doc_id)""")
def classify_scripts(spark, sf):
    """Texts in Arabic and Persian letters among the others: script analysis, dialects and their notes."""
    d = documents(spark, sf, "text", "lang").select(
        "doc_id", F.expr(LETTERED_LANG).alias("lang"), F.expr(LETTERED).alias("text"))
    d = durable(d)
    c = classify(d.drop("lang"), langid.detector(durable(langid.train_profile(d))), TARGET)
    return c.select(
        "doc_id", "language", F.round("confidence", 6).alias("confidence"), "is_foreign", "confidence_tier",
        "input_word_count", "advisory", "disambiguation_note", "dialect",
        F.round("dialect_confidence", 6).alias("dialect_confidence"), "dialect_note")
