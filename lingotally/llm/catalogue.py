"""Queries of the training-data operators over ``documents``, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lingotally import session
from lingotally.functions.binding import let
from lingotally.llm import (
    common, decontaminate, gam, importance, mixing, periodic_runs, piece_bpe, pitman_yor, secrets, simhash,
    spans_langid, suffix_dedup, weak_rules, window_dedup,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn: Callable[[SparkSession, str], DataFrame]):
        def run(spark: SparkSession, sf: str) -> DataFrame:
            session.checkpoints(common.arrow(session.tune(spark)))
            return fn(spark, sf)

        run.__name__, run.__doc__ = name, fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql.strip()
        return fn

    return register


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/documents.parquet")


@query("op5_mix_sources")
def op5(spark, sf):
    """Words taken from every document by Sainte-Lague block quotas."""
    sizes = mixing.token_sizes(documents(spark, sf)).checkpoint(eager=True)
    return mixing.mix(sizes).drop("passes", "spans")


@query("op9_weak_rules")
def op9(spark, sf):
    """Base measures and the label model's verdict for every document."""
    voted = weak_rules.votes(weak_rules.measures(documents(spark, sf).select("doc_id", "text"))).drop("text")
    voted = voted.checkpoint(eager=True)
    q = weak_rules.P
    judged = weak_rules.judge(voted, weak_rules.fit(voted))
    return judged.select(
        "doc_id", *[F.col(q + c).alias(c) for c in (
            "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")],
        F.col(f"{q}posterior").alias("posterior"), F.col(f"{q}kept").alias("kept"))


OP10_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
  'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''),
  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
wins AS (SELECT DISTINCT item, len(w[i:i+9]) AS n, array_to_string(w[i:i+9], ' ') AS t
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM wins),
spots AS (SELECT doc_id, n, i, array_to_string(w[i:i+n-1], ' ') AS t
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lens WHERE len(w) >= n)),
hit AS (SELECT doc_id, i, n, item FROM spots JOIN wins USING (n, t)),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (
  SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, i, n FROM hit)) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS s
  FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
 CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(s, '')) AS items_sha256,
 coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)
"""


@query("op10_decontaminate", OP10_SQL)
def op10(spark, sf):
    """Words and benchmark items hit in every document."""
    found = decontaminate.hits(documents(spark, sf), spark.read.parquet(f"{sf}/benchmark.parquet"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("hit_items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("hit_items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"))


@query("op3_simhash")
def op3(spark, sf):
    """Fingerprint and near-duplicate class of every document."""
    d = simhash.near_duplicates(documents(spark, sf))
    return d.select("doc_id", simhash.hex16(F.col("fingerprint")).alias("fingerprint"), "component_id")


@query("op2_secrets")
def op2(spark, sf):
    """Secret spans of every document."""
    d = secrets.scan(documents(spark, sf).select("doc_id", "text")).drop("text")
    base = F.filter("spans", lambda s: s["kind"] != "guess")
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("bigint")
    return d.select(
        "doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"),
        count("hex").alias("n_hex"), F.sha2(secrets.render(base), 256).alias("base_sha256"),
        secrets.render(F.col("spans")).alias("spans"))


@query("op8_gam_quality")
def op8(spark, sf):
    """Quality score of every document."""
    d = documents(spark, sf).select("doc_id", gam.features("text").alias("x")).checkpoint(eager=True)
    held = common.remainder(F.col("doc_id"), 4) == 2
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    model = gam.fit(d.filter(~held), labels)
    d = d.select("doc_id", held.alias("held_out"), gam.scorer(model)("x").alias("score"))
    return d.withColumn("predicted", (F.col("score") >= 0.7).cast("int"))


@query("op1_span_langid")
def op1(spark, sf):
    """Language of every document."""
    d = documents(spark, sf)
    held = common.remainder(F.col("doc_id"), 3) == 1
    model = spans_langid.train(d.filter(~held))
    found = d.select("doc_id", held.alias("held_out"), spans_langid.detector(model)("text").alias("p"))
    return found.select("doc_id", "held_out", F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score"))


OP6_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
win AS (SELECT r, doc_id, i, hash(array_to_string(w[i:i+12], ' ')) AS h, array_to_string(w[i:i+12], ' ') AS t
  FROM (SELECT r, doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13)),
least AS (SELECT t, min(doc_id) AS m FROM win GROUP BY t HAVING count(*) > 1),
gone AS (SELECT r, list(DISTINCT p) AS ps FROM (
  SELECT r, unnest(range(i, i + 13)) AS p FROM win JOIN least USING (t) WHERE doc_id > m) GROUP BY r),
kept AS (SELECT r, doc_id, w, CASE WHEN ps IS NULL THEN w ELSE
  list_filter(list_transform(range(1, len(w) + 1), lambda x: CASE WHEN list_contains(ps, x) THEN NULL ELSE w[x] END),
              lambda y: y IS NOT NULL) END AS k FROM d LEFT JOIN gone USING (r))
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - len(k) AS BIGINT) AS n_removed,
 sha256(array_to_string(k, ' ')) AS kept_sha256 FROM kept
"""


@query("op6_window_dedup", OP6_SQL)
def op6(spark, sf):
    """Words removed from every document."""
    d = window_dedup.dedup(documents(spark, sf), keep_text=False)
    return d.select("doc_id", "n_words", "n_removed", "kept_sha256")


@query("op7_suffix_dedup")
def op7(spark, sf):
    """Bytes removed from every document."""
    d = suffix_dedup.dedup(documents(spark, sf), keep_bytes=False)
    return d.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("bigint").alias("n_spans"), "kept_sha256")


@query("op4_pitman_yor")
def op4(spark, sf):
    """Model and base log probabilities of every document."""
    d = documents(spark, sf)
    held = common.remainder(F.col("doc_id"), 7) == 2
    return pitman_yor.model_scores(d, ~held).select(
        "doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


OP11_SQL = r"""
WITH tbl AS (SELECT list_transform(range(256), lambda b: list_reduce(range(8), lambda c, i:
  CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, b)) AS t),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
  'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
  'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
dw AS (SELECT doc_id, unnest(w) AS word FROM d), bw AS (SELECT unnest(w) AS word FROM b),
hexed AS (SELECT word, hex(word) AS x FROM (SELECT word FROM dw UNION SELECT word FROM bw)),
coded AS (SELECT word, list_transform(range(length(x) // 2), lambda i:
  CAST(16 * (strpos('0123456789ABCDEF', x[2 * i + 1]) - 1) + strpos('0123456789ABCDEF', x[2 * i + 2]) - 1 AS BIGINT)) AS bytes
  FROM hexed),
hashed AS (SELECT word, xor(list_reduce(bytes, lambda c, v: xor(c >> 8, t[(xor(c, v) & 255) + 1]),
  CAST(4294967295 AS BIGINT)), 4294967295) % 10000 AS bucket FROM coded, tbl),
s AS (SELECT bucket, count(*) AS n FROM dw JOIN hashed USING (word) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS n FROM bw JOIN hashed USING (word) GROUP BY bucket),
total AS (SELECT (SELECT count(*) FROM dw) AS s, (SELECT count(*) FROM bw) AS t),
gain AS (SELECT bucket, CAST(floor(1000 * ln((coalesce(t.n, 0) + 1e0) * (total.s + 1e4)
  / ((s.n + 1e0) * (total.t + 1e4)))) AS BIGINT) AS g FROM s LEFT JOIN t USING (bucket), total),
weights AS (SELECT doc_id, sum(g) AS weight FROM dw JOIN hashed USING (word) JOIN gain USING (bucket) GROUP BY doc_id),
noise AS (SELECT doc_id, len(w) AS n, (list_reduce(list_transform(range(1, 9), lambda i: CAST(strpos('0123456789abcdef',
  sha256('2024:' || doc_id)[i]) - 1 AS BIGINT)), lambda a, c: 16 * a + c) + 0.5e0) / 4294967296e0 AS u FROM d),
scored AS (SELECT doc_id, CAST(n AS BIGINT) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
  CAST(coalesce(weight, 0) + floor(-1000 * ln(-ln(u))) AS BIGINT) AS score FROM noise LEFT JOIN weights USING (doc_id)),
placed AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r, count(*) OVER () AS n
  FROM scored WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN r <= 10 * n // 100 THEN r END AS rank
FROM scored LEFT JOIN placed USING (doc_id)
"""


@query("op11_importance_resampling", OP11_SQL)
def op11(spark, sf):
    """Importance weights of all documents towards the benchmark, and the ranks of the drawn tenth."""
    drawn = importance.resample(documents(spark, sf), spark.read.parquet(f"{sf}/benchmark.parquet"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


def planted(doc_id: Column, text: Column) -> Column:
    """Texts of which a tenth, by crc32 of the id, repeat from a word on with a period."""
    h = F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")))
    g = F.floor(h / 10)

    def repeat(w: Column) -> Column:
        a = (g % F.size(w)).cast("int")
        p = (1 + F.floor((F.size(w) - a) / (3 + g % 8))).cast("int")
        return F.array_join(F.transform(w, lambda x, i: F.when(i >= a, F.get(w, a + (i - a) % p)).otherwise(x)), " ")

    return F.when((h % 10 == 0) & text.rlike(common.WORD), let(common.words(text), repeat)).otherwise(text)


@query("op12_periodic_runs")
def op12(spark, sf):
    """Runs of words that repeat with a period in every document."""
    d = documents(spark, sf).select("doc_id", planted(F.col("doc_id"), F.col("text")).alias("text"))
    d = periodic_runs.periodic_runs(d).withColumn("best", periodic_runs.strongest(F.col("runs")))
    line = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    best = F.col("best")
    return d.select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), best["start"].alias("start"),
        best["length"].alias("length"), best["period"].alias("period"),
        F.floor(1000 * best["length"] / best["period"]).cast("bigint").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform(line, lambda x: F.concat(x, F.lit("\n"))), ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"))


@query("op13_sentencepiece")
def op13(spark, sf):
    """SentencePiece ids of every document, and the text they decode to."""
    import public_tokenizers

    made = piece_bpe.token_text(public_tokenizers.path("piece_bpe_32k.model"))
    d = documents(spark, sf).select("doc_id", made(F.col("text")).alias("made"))
    return d.select("doc_id", F.col("made.n_tokens").alias("n_tokens"), F.sha2("made.ids_text", 256).alias("ids_sha256"),
                    F.sha2("made.decoded", 256).alias("decoded_sha256"))
