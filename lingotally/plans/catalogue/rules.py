"""Pattern rules over documents and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from lingotally import refdata as R
from lingotally.operators import rules
from lingotally.plans.catalogue.registry import documents, pages, query, table, values_sql

# The same formats in RE2, whose \b is ASCII: (rule, string id, pattern, order).
RE2_RULES = [
    ("contact_detail", "mailbox", r"\b[A-Za-z0-9][A-Za-z0-9._+-]{0,63}@(?:[A-Za-z0-9-]{1,63}\.)+[A-Za-z]{2,18}\b", 0),
    ("contact_detail", "dial_number", r"\+[1-9][0-9]{7,14}\b", 1),
    ("network_host", "dotted_quad", r"\b" + R.OCTET + r"(?:\." + R.OCTET + r"){3}\b", 2),
    ("network_host", "hidden_service", r"(?i)\b[a-z2-7]{56}\.onion\b", 3),
    ("web_link", "http", r"https?://[^\s<>]{4,}", 4),
    ("coin_account", "segwit", r"(?i)\bbc1[02-9ac-hj-np-z]{11,71}\b", 5),
    ("coin_account", "base58check", r"\b[13][A-HJ-NP-Za-km-z1-9]{24,33}\b", 6),
    ("coin_account", "hex_account", r"\b0x[A-Fa-f0-9]{40}\b", 7),
]


def _sql_matches(text: str, key: str, frm: str, source: str) -> str:
    """One arm per pattern: RE2 wants constant patterns."""
    return " UNION ALL ".join(
        f"SELECT {key}, '{source}' AS scanned_source, '{rule}' AS rule, '{sid}' AS string_id, "
        f"regexp_extract_all({text}, '{pat.replace(chr(39), chr(39) * 2)}') AS m FROM {frm}"
        for rule, sid, pat, _ in RE2_RULES
    )


DOC_MATCHES = f"m AS ({_sql_matches('text', 'doc_id', 'documents', 'source')})"


@query("rule_hits", f"""WITH {DOC_MATCHES} SELECT doc_id, scanned_source, rule,
 CAST(sum(len(m)) AS BIGINT) AS n_strings FROM m WHERE len(m) > 0 GROUP BY ALL""")
def rule_hits(spark, sf):
    hits = rules.rule_counts(documents(spark, sf, "text"), {"source": "text"}, ["doc_id"])
    return hits.select("doc_id", "scanned_source", "rule", F.col("n_strings").cast("bigint"))


TWO_TEXTS = ("two AS (SELECT page_id, html, '[en] ' || CASE WHEN page_id % 3 = 0 THEN '' "
             "ELSE url || ' ' || html END AS translation FROM pages)")
PAGE_MATCHES = f"""{TWO_TEXTS}, m AS ({_sql_matches('translation', 'page_id', 'two', 'translation')}
 UNION ALL {_sql_matches('html', 'page_id', 'two', 'source')})"""


@query("rule_summary", f"""WITH {PAGE_MATCHES}, f AS (SELECT page_id, scanned_source, rule,
 sum(len(m)) AS n FROM m GROUP BY ALL HAVING sum(len(m)) > 0)
 SELECT scanned_source, rule, count(*) AS n_firings, CAST(sum(n) AS BIGINT) AS n_matches
 FROM f GROUP BY ALL""")
def rule_summary(spark, sf):
    """Translation and source of every page in one pass, tagged by text."""
    translation = F.concat(F.lit("[en] "), F.when(F.col("page_id") % 3 == 0, "").otherwise(
        F.concat("url", F.lit(" "), "html")))
    two = pages(spark, sf).select("page_id", "html", translation.alias("translation"))
    counts = rules.rule_counts(two, {"translation": "translation", "source": "html"}, ["page_id"])
    return rules.rule_summary(counts)


# Offset of hit i = bytes of the pieces before it plus bytes of the hits before it.
@query("rule_offsets", f"""WITH {DOC_MATCHES}, d AS (SELECT doc_id, rule, string_id, m,
 p.pat FROM m JOIN {values_sql([(s, pat) for _, s, pat, _ in RE2_RULES], 'sid, pat').replace(' AS v(', ' AS p(')}
 ON sid = string_id WHERE len(m) > 0),
 k AS (SELECT doc_id, rule, string_id, m, i, text FROM d JOIN documents USING (doc_id),
  unnest(range(1, len(m) + 1)) AS t(i)),
 r AS (WITH RECURSIVE w AS (
   SELECT doc_id, rule, string_id, m, 1 AS i, instr(text, m[1]) AS pos, text
    FROM k WHERE i = 1
   UNION ALL
   SELECT doc_id, rule, string_id, m, i + 1,
    pos + length(m[i]) - 1 + instr(substring(text, pos + length(m[i])), m[i + 1]), text
   FROM w WHERE i < len(m))
  SELECT * FROM w)
 SELECT doc_id, 'source' AS scanned_source, rule, string_id,
  CAST(strlen(substring(text, 1, pos - 1)) AS BIGINT) AS "offset", m[i] AS data,
  substring(m[i], 1, 80) AS preview FROM r""")
def rule_offsets(spark, sf):
    hits = rules.rule_hits(documents(spark, sf, "text"), {"source": "text"}, ["doc_id"])
    return rules.rule_offsets(hits, ["doc_id"])


PHRASES = 4  # phrases of three words per benchmark item


@query("rule_counts_many", f"""WITH ph AS (SELECT item_id, array_to_string(string_split(text, ' ')[3 * i + 1:3 * i + 3], ' ') AS p
 FROM benchmark, unnest(range({PHRASES})) AS t(i)),
 ct AS (SELECT doc_id, item_id, (length(text) - length(replace(text, p, ''))) // length(p) AS n FROM documents, ph
 WHERE length(p) >= 3 AND contains(text, p))
 SELECT doc_id, 'item' || item_id AS rule, CAST(sum(n) AS INTEGER) AS n_strings FROM ct GROUP BY ALL""")
def rule_counts_many(spark, sf):
    """Hundreds of rules, phrases of the benchmark items: an automaton picks the candidates of each text."""
    own = F.split("text", " ")
    phrases = F.transform(F.sequence(F.lit(0), F.lit(PHRASES - 1)), lambda i: F.struct(
        i.alias("i"), F.array_join(F.slice(own, 3 * i + 1, 3), " ").alias("p")))
    table_ = table(spark, sf, "benchmark").select("item_id", F.inline(phrases)).filter("length(p) >= 3").select(
        F.concat(F.lit("item"), "item_id").alias("rule"), F.concat(F.lit("s"), "i").alias("string_id"),
        F.concat(F.lit("\\Q"), "p", F.lit("\\E")).alias("pattern"), F.lit(False).alias("nocase"),
        F.lit("low").alias("severity"), F.col("p").alias("literal"))
    found = rules.rule_counts(documents(spark, sf, "text"), {"source": "text"}, ["doc_id"], rules.load_rules(table_))
    return found.select("doc_id", "rule", "n_strings")
