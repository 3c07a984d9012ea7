"""Scripts, glyphs, dialects and routing."""

from __future__ import annotations

from pyspark.sql import functions as F

from lingotally import refdata as R
from lingotally.functions import dialect as D, script as S
from lingotally.operators import lookups, rollups
from lingotally.plans.catalogue.registry import SQL_WS, documents, query, table, values_sql

# Letters of the given texts moved to other scripts, so that runs and switches occur.
# (the script bounds in the SQL below are fixed values, as in functions.script)
MOVES = [("aeiou", "аеиоу"), ("nst", "نست"), ("the", "天地人"), ("dlr", "דלר")]


def _mixed(spark, sf):
    t = F.col("text")
    moved = t
    for i, (a, b) in enumerate(MOVES):
        moved = F.when(F.col("doc_id") % 6 == i + 1, F.translate(t, a, b)).otherwise(moved)
    return documents(spark, sf, "text", "lang").select(
        "doc_id", "lang", moved.alias("text")
    )


SQL_MIXED = ("mixed AS (SELECT doc_id, lang, CASE doc_id % 6 "
             + " ".join(f"WHEN {i + 1} THEN translate(text, '{a}', '{b}')" for i, (a, b) in enumerate(MOVES))
             + " ELSE text END AS text FROM documents)")
# Character by character, with a window: nothing in common with the run pattern on the Spark side.
SQL_CHARS = f"""{SQL_MIXED}, ch AS (SELECT doc_id, i, c, unicode(c) AS u,
 regexp_matches(c, '\\p{{L}}') AS alpha FROM (SELECT doc_id, string_split(text, '') AS l FROM mixed),
 unnest(l) WITH ORDINALITY AS t(c, i)),
 sc AS (SELECT *, CASE WHEN u BETWEEN 1536 AND 1791 OR u BETWEEN 1872 AND 1919 THEN 'arabic'
 WHEN u BETWEEN 1024 AND 1279 THEN 'cyrillic' WHEN u BETWEEN 19968 AND 40959 THEN 'cjk'
 WHEN u BETWEEN 1424 AND 1535 THEN 'hebrew' WHEN u BETWEEN 2304 AND 2431 THEN 'devanagari'
 WHEN alpha THEN 'latin' ELSE 'other' END AS script FROM ch),
 runs AS (SELECT doc_id, i, script, script IS DISTINCT FROM lag(script) OVER (PARTITION BY doc_id
 ORDER BY i) AS starts FROM sc WHERE script <> 'other'),
 prof AS (SELECT m.doc_id, m.text, m.lang, coalesce(n_runs, 0) AS n_runs, coalesce(alpha, 0) AS alpha,
 coalesce(latin, 0) AS latin FROM mixed m LEFT JOIN (SELECT doc_id, count(*) AS n_runs FROM runs
 WHERE starts GROUP BY 1) USING (doc_id) LEFT JOIN (SELECT doc_id, count(*) FILTER (WHERE alpha)
 AS alpha, count(*) FILTER (WHERE script = 'latin') AS latin FROM sc GROUP BY 1) USING (doc_id)),
 firsts AS (SELECT doc_id, string_agg(script, ',' ORDER BY i) AS scripts, count(*) AS n_scripts FROM
 (SELECT doc_id, script, min(i) AS i FROM runs GROUP BY ALL) GROUP BY doc_id)"""


@query("script_profile", f"""WITH {SQL_CHARS} SELECT doc_id, coalesce(scripts, '') AS scripts,
 CAST(greatest(n_runs - 1, 0) AS INTEGER) AS switch_count, CAST(alpha AS INTEGER) AS n_alpha,
 round(CASE WHEN alpha > 0 THEN latin / CAST(alpha AS DOUBLE) ELSE 0.0 END, 6) AS latin_ratio
 FROM prof LEFT JOIN firsts USING (doc_id)""")
def script_profile(spark, sf):
    d = _mixed(spark, sf).select("doc_id", S.script_profile(F.col("text")).alias("p")).select("doc_id", "p.*")
    ratio = F.when(F.col("n_alpha") > 0, F.col("n_latin") / F.col("n_alpha")).otherwise(0.0)
    return d.select(
        "doc_id", F.array_join(F.array_distinct("runs"), ",").alias("scripts"),
        S.switch_count(F.col("runs")).alias("switch_count"), "n_alpha", F.round(ratio, 6).alias("latin_ratio"),
    )


@query("script_runs", f"""WITH {SQL_CHARS} SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id
 ORDER BY i) - 1 AS INTEGER) AS run, script FROM runs WHERE starts""")
def script_runs(spark, sf):
    return _mixed(spark, sf).select(
        "doc_id", F.posexplode(S.script_runs(F.col("text"))).alias("run", "script")
    )


@query("code_switch", f"""WITH {SQL_CHARS}, c AS (SELECT doc_id, coalesce(n_scripts, 0) AS ns,
 greatest(n_runs - 1, 0) AS sw, alpha FROM prof LEFT JOIN firsts USING (doc_id))
 SELECT doc_id, ns >= 2 AND sw >= 1 AS is_code_switched, CAST(sw AS INTEGER) AS switch_count,
 round(CASE WHEN ns >= 2 AND sw >= 1 THEN greatest(least(CASE WHEN alpha > 0 THEN
 least(sw / CAST(alpha AS DOUBLE), 0.5) * 1.9 ELSE 0.0 END, 0.95), 0.3) ELSE 0.0 END, 6)
 AS confidence FROM c""")
def code_switch(spark, sf):
    d = _mixed(spark, sf).select("doc_id", S.code_switch(F.col("text")).alias("c"))
    return d.select("doc_id", "c.is_code_switched", "c.switch_count",
                    F.round("c.confidence", 6).alias("confidence"))


@query("select_engine", f"""WITH {SQL_CHARS} SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN 'Nllb'
 WHEN (doc_id % 100) / 100.0 < 0.75 THEN 'Seamless' WHEN doc_id % 6 = 2 AND alpha > 0 AND
 latin / CAST(alpha AS DOUBLE) > 0.15 THEN 'Seamless' ELSE 'Nllb' END AS engine FROM prof""")
def select_engine(spark, sf):
    lang = F.when(F.col("doc_id") % 6 == 2, "ar").otherwise(F.col("lang"))
    engine = S.select_engine(
        F.col("text"), lang, (F.col("doc_id") % 100) / 100.0, F.col("doc_id") % 11 != 0
    )
    return _mixed(spark, sf).select("doc_id", engine.alias("engine"))


# ---- glyph sets -----------------------------------------------------------------------------
GLYPHED = ("concat(text, repeat('ټ', CAST(doc_id % 6 AS INT)), repeat('پ', CAST(doc_id % 4 AS INT)), "
           "repeat('ې', CAST(doc_id % 2 AS INT)))")
SQL_VERDICT = f"""g AS (SELECT doc_id, lang, CAST(doc_id % 6 + doc_id % 2 AS INTEGER) AS n_a,
 CAST(doc_id % 4 AS INTEGER) AS n_b, CASE WHEN doc_id % 6 > 0 AND doc_id % 2 > 0 THEN 'ټ, ې'
 WHEN doc_id % 6 > 0 THEN 'ټ' ELSE '' END AS glyphs FROM documents),
 ver AS (SELECT *, CASE WHEN n_a > n_b THEN 'A' WHEN n_b > n_a THEN 'B' ELSE 'Ambiguous' END AS v,
 CASE WHEN n_a = 0 AND n_b = 0 THEN 0.0 WHEN n_a = n_b THEN 0.3 ELSE least(least(greatest(n_a, n_b), 5)
 / 5.0 * 0.45 + 0.55 * (greatest(n_a, n_b) / CAST(n_a + n_b AS DOUBLE)), 0.95) END AS conf FROM g)"""


def _glyphs(spark, sf):
    d = documents(spark, sf, "text", "lang").select(
        "doc_id", "lang", S.glyph_profile(F.expr(GLYPHED)).alias("g")
    ).select("doc_id", "lang", "g.*")
    return d.withColumn("v", S.script_verdict(F.col("n_a"), F.col("n_b")))


@query("script_verdict", f"""WITH {SQL_VERDICT} SELECT doc_id, n_a, n_b, glyphs,
 v AS recommendation, round(conf, 6) AS confidence FROM ver""")
def script_verdict(spark, sf):
    return _glyphs(spark, sf).select(
        "doc_id", "n_a", "n_b", F.array_join("glyphs_a", ", ").alias("glyphs"),
        "v.recommendation", F.round("v.confidence", 6).alias("confidence"),
    )


@query("disambiguate", f"""WITH {SQL_VERDICT}, l AS (SELECT *, CASE WHEN doc_id % 5 = 0 THEN lang
 ELSE 'fa' END AS lg FROM ver) SELECT doc_id, CASE WHEN lg = 'fa' AND v = 'A' AND conf >= 0.7
 THEN 'ps' ELSE lg END AS language, CASE WHEN lg = 'fa' AND v = 'A' AND conf >= 0.7 THEN 'changed'
 WHEN lg = 'fa' AND v = 'Ambiguous' AND n_a > 0 THEN 'undecided' ELSE 'kept' END AS outcome FROM l""")
def disambiguate(spark, sf):
    lang = F.when(F.col("doc_id") % 5 == 0, F.col("lang")).otherwise("fa")
    fixed = S.disambiguate(lang, F.col("v.recommendation"), F.col("v.confidence"), F.col("glyphs_a"))
    d = _glyphs(spark, sf).select("doc_id", fixed.alias("f"))
    return d.select(
        "doc_id", "f.language",
        F.when(F.col("f.note").isNull(), "kept").when(F.col("f.note").startswith("Changed"), "changed")
        .otherwise("undecided").alias("outcome"),
    )


# ---- dialects ---------------------------------------------------------------------------------
PLANTED = [R.DIALECT_LEXICON[f][:3] for f in R.DIALECT_ORDER] + [[R.SHARED_NEGATION] * 3]
FREQUENT = ["en", "the", "de", "e", "es", "of", "der", "la"]


def _planted_sql() -> str:
    """Frequent words replaced by markers of one family by number (same SQL in both engines)."""
    arms = []
    for i, ms in enumerate(PLANTED):
        expr = "text"
        for j, w in enumerate(FREQUENT):
            expr = f"replace({expr}, ' {w} ', ' {ms[j % 3]} ')"
        arms.append(f"WHEN {i} THEN {expr}")
    return f"CASE doc_id % 11 {' '.join(arms)} WHEN 8 THEN '' ELSE text END"


PLANT = _planted_sql()
LEX = values_sql([(f, m) for f in R.DIALECT_ORDER for m in R.DIALECT_LEXICON[f]], "dialect, marker")
ORDER = values_sql(list(enumerate(R.DIALECT_ORDER)), "decl, dialect")
SQL_SCORES = f"""tok AS (SELECT doc_id, unnest(regexp_split_to_array(text,
 '[\\s\\x0b\\x{{85}}\\p{{Z}}.,!?،؟؛]+')) AS token FROM (SELECT doc_id, {PLANT} AS text FROM documents)),
 base AS (SELECT doc_id, dialect, count(*) AS n FROM tok JOIN {LEX} ON token = marker GROUP BY ALL),
 neg AS (SELECT doc_id, count(*) AS k FROM tok WHERE token = '{R.SHARED_NEGATION}' GROUP BY 1),
 scores AS (SELECT d.doc_id, o.decl, o.dialect, coalesce(b.n, 0) + CASE WHEN o.dialect = 'Levantine'
 AND NOT EXISTS (SELECT 1 FROM base e WHERE e.doc_id = d.doc_id AND e.dialect = 'Egyptian')
 THEN coalesce(neg.k, 0) ELSE 0 END AS n FROM documents d
 CROSS JOIN (SELECT * FROM {ORDER}) o LEFT JOIN base b ON b.doc_id = d.doc_id AND b.dialect = o.dialect
 LEFT JOIN neg ON neg.doc_id = d.doc_id),
 best AS (SELECT doc_id, dialect, n FROM scores QUALIFY row_number() OVER (PARTITION BY doc_id
 ORDER BY n DESC, decl) = 1),
 dv AS (SELECT doc_id, CASE WHEN doc_id % 11 = 8 OR trim(text, {SQL_WS}) = '' THEN 'Unknown'
 WHEN n = 0 THEN 'ModernStandard'
 WHEN n = 1 THEN 'Unknown' ELSE dialect END AS dialect, CASE WHEN doc_id % 11 = 8
 OR trim(text, {SQL_WS}) = '' THEN 0.0 WHEN n = 0 THEN 0.4
 WHEN n = 1 THEN 0.2 ELSE least(least(n, 5) / 5.0 * 0.55 + 0.4, 0.95) END AS confidence
 FROM best JOIN documents USING (doc_id))"""


def _planted(spark, sf):
    return documents(spark, sf, "text").select("doc_id", F.expr(PLANT).alias("text"))


@query("dialect_scores", f"WITH {SQL_SCORES} SELECT doc_id, dialect, CAST(n AS INTEGER) AS n FROM scores WHERE n > 0")
def dialect_scores(spark, sf):
    s = _planted(spark, sf).select("doc_id", D.dialect_scores(D.marker_hits(F.col("text"))).alias("s"))
    rows = F.array(*[F.struct(F.lit(f).alias("dialect"), F.col(f"s.{f}").alias("n"))
                     for f in R.DIALECT_ORDER])
    return s.select("doc_id", F.inline(rows)).filter("n > 0")


@query("dialect_verdict", f"WITH {SQL_SCORES} SELECT doc_id, dialect, round(confidence, 6) AS confidence FROM dv")
def dialect_verdict(spark, sf):
    d = _planted(spark, sf).select("doc_id", D.detect_dialect(F.col("text")).alias("d"))
    return d.select("doc_id", "d.dialect", F.round("d.confidence", 6).alias("confidence"))


# fixed values in the SQL: route and token names, and the confidence each route asks for, as in refdata
@query("route", f"""WITH {SQL_SCORES}, r AS (SELECT doc_id, dialect, CASE
 WHEN dialect = 'Egyptian' AND confidence >= 0.70 THEN 'NllbEgyptian'
 WHEN dialect = 'Moroccan' AND confidence >= 0.65 AND doc_id % 2 = 0 THEN 'SeamlessM4T'
 WHEN dialect = 'Levantine' AND confidence >= 0.65 THEN 'NllbLevantine'
 WHEN dialect = 'Iraqi' AND confidence >= 0.65 THEN 'NllbIraqi' ELSE 'NllbDefault' END AS route
 FROM dv) SELECT doc_id, dialect, route, CASE route WHEN 'NllbEgyptian' THEN 'arz_Arab'
 WHEN 'NllbLevantine' THEN 'apc_Arab' WHEN 'NllbIraqi' THEN 'acm_Arab' ELSE 'ara_Arab' END
 AS source_token, CASE dialect WHEN 'Egyptian' THEN 'arz_Arab' WHEN 'Levantine' THEN 'apc_Arab'
 WHEN 'Iraqi' THEN 'acm_Arab' WHEN 'Moroccan' THEN 'ary_Arab' ELSE 'ara_Arab' END AS dialect_token
 FROM r""")
def route(spark, sf):
    d = _planted(spark, sf).select("doc_id", D.detect_dialect(F.col("text")).alias("d"))
    chosen = D.route(F.col("d.dialect"), F.col("d.confidence"), F.col("doc_id") % 2 == 0)
    return d.select("doc_id", "d.dialect", chosen.alias("r")).select(
        "doc_id", "dialect", "r.route", "r.source_token",
        D.dialect_token(F.col("dialect")).alias("dialect_token"),
    )


LABELS = "CASE doc_id % 7 WHEN 0 THEN 'cai' WHEN 1 THEN 'BEI' WHEN 2 THEN 'Rab' WHEN 3 THEN 'zzz' END"


@query("dialect_labels", f"""WITH {SQL_SCORES} SELECT d.doc_id, CASE d.doc_id % 7 WHEN 0 THEN 'Egyptian'
 WHEN 1 THEN 'Levantine' WHEN 2 THEN 'Moroccan' WHEN 3 THEN 'Unknown' ELSE dialect END AS dialect
 FROM documents d JOIN dv USING (doc_id)""")
def dialect_labels(spark, sf):
    """External labels win; texts without one fall back to the lexicon."""
    d = _planted(spark, sf).select(
        "doc_id", F.expr(LABELS).alias("label"), D.detect_dialect(F.col("text")).alias("d")
    )
    labelled = F.when(F.col("label").isNotNull(), D.family_of_label(F.col("label")))
    return d.select("doc_id", F.coalesce(labelled, F.col("d.dialect")).alias("dialect"))


# ---- code tables ------------------------------------------------------------------------------
CODED = ("CASE doc_id % 8 WHEN 0 THEN 'ar' WHEN 1 THEN 'ps' WHEN 2 THEN 'sv' WHEN 3 THEN 'xx' "
         "ELSE lang END")


@query("code_lookup", f"""SELECT doc_id, language, coalesce(language_name, '(unknown)') AS language_name,
 model_code, CASE WHEN model_code IS NULL THEN 'no code for language ' || language END
 AS model_code_error, ocr_code, CASE WHEN ocr_code IS NULL THEN 'no code for language ' || language END
 AS ocr_code_error FROM (SELECT doc_id, {CODED} AS language FROM documents)
 LEFT JOIN {values_sql(list(R.LANGUAGE_NAMES.items()), 'c1, language_name').replace('AS v(', 'AS n(')} ON c1 = language
 LEFT JOIN {values_sql(list(R.TRANSLATION_CODES.items()), 'c2, model_code').replace('AS v(', 'AS t(')} ON c2 = language
 LEFT JOIN {values_sql(list(R.OCR_CODES.items()), 'c3, ocr_code').replace('AS v(', 'AS o(')} ON c3 = language""")
def code_lookup(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.expr(CODED).alias("language"))
    d = rollups.with_language_name(d, "language")
    d = lookups.code_lookup(d, R.translation_codes(spark), "language_code", "model_code")
    return lookups.code_lookup(d, R.ocr_codes(spark), "language_code", "ocr_code")


# ---- classification of texts in Arabic and Persian letters ----------------------------------------
LATIN, AS_AR, AS_FA = "abcdefghijklmnopqrstuvwxyz", "ابتثجحخدذرزسشصضطظعغفقكلمنه", "منهابتثجحخدذرزسشصضطظعغفقكل"
LETTERED = (f"CASE doc_id % 4 WHEN 0 THEN translate({PLANT}, '{LATIN}', '{AS_AR}') WHEN 1 THEN "
            f"concat(translate(text, '{LATIN}', '{AS_FA}'), repeat('ټ', CAST(doc_id % 6 AS INT)), "
            "repeat('ې', CAST(doc_id % 2 AS INT)), repeat('پ', CAST(doc_id % 5 AS INT))) ELSE text END")
LETTERED_LANG = "CASE doc_id % 4 WHEN 0 THEN 'ar' WHEN 1 THEN 'fa' ELSE lang END"
SQL_LETTERED = f"documents AS (SELECT doc_id, {LETTERED_LANG} AS lang, {LETTERED} AS text FROM documents)"
SQL_LETTERED_DIALECTS = SQL_SCORES.replace(PLANT, "text").replace("doc_id % 11 = 8\n OR ", "").replace("doc_id % 11 = 8 OR ", "")
SQL_GLYPHS = f"""gl AS (SELECT doc_id, length(text) - length(translate(text, '{R.GLYPHS_A}', '')) AS n_a,
 length(text) - length(translate(text, '{R.GLYPHS_B}', '')) AS n_b,
 concat_ws(', ', CASE WHEN contains(text, 'ټ') THEN 'ټ' END, CASE WHEN contains(text, 'ې') THEN 'ې' END) AS glyphs
 FROM documents),
 gv AS (SELECT *, CASE WHEN n_a > n_b THEN 'A' WHEN n_b > n_a THEN 'B' ELSE 'Ambiguous' END AS v,
 CASE WHEN n_a = 0 AND n_b = 0 THEN 0.0 WHEN n_a = n_b THEN 0.3 ELSE least(least(greatest(n_a, n_b), 5)
 / 5.0 * 0.45 + 0.55 * (greatest(n_a, n_b) / CAST(n_a + n_b AS DOUBLE)), 0.95) END AS gc FROM gl)"""
