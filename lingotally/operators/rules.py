"""Pattern rules over texts: one projection per scan, whatever the number of rules.

Up to ``FEW`` rules are tried on every text inside the JVM. Of more, an automaton over their literals first picks
the candidates of each text (``operators.literals``), and only these are tried.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, functions as F

from lingotally import refdata as R
from lingotally.functions.match import match_offsets
from lingotally.functions.binding import let
from lingotally.functions.text import is_blank, preview
from lingotally.operators import literals

FEW = 64
STRING = "string_id:string,pattern:string,nocase:boolean,literal:string"
RULE = f"array<struct<rule:string,severity:string,strings:array<struct<{STRING}>>>>"
HIT = "array<struct<string_id:string,offset:bigint,data:string>>"


def load_rules(rules: DataFrame) -> list[dict]:
    """Rule rows for the plan: the table is written by people, hence code rather than data."""
    return [r.asDict() for r in rules.collect()]


def default_rules() -> list[dict]:
    names = ("rule", "string_id", "pattern", "nocase", "severity", "literal")
    return [dict(zip(names, row)) for row in R.RULES]


def _grouped(rules: list[dict]) -> list[dict]:
    """Strings grouped by rule."""
    by_rule: dict[str, dict] = {}
    for r in rules:
        entry = by_rule.setdefault(r["rule"], {"rule": r["rule"], "severity": r["severity"], "strings": []})
        entry["strings"].append({
            "string_id": r["string_id"], "nocase": bool(r["nocase"]), "literal": r.get("literal") or "",
            "pattern": ("(?i)" if r["nocase"] else "") + r["pattern"],
        })
    return list(by_rule.values())


def _table(grouped: list[dict]) -> Column:
    """All rules as one constant: the plan does not grow with them."""
    return F.from_json(F.lit(json.dumps(grouped)), RULE)


def _may_match(text: Column, s: Column) -> Column:
    """Cheap test first: the literal of a string occurs in each of its hits."""
    return F.when(s["nocase"], text["lower"].contains(s["literal"])).otherwise(
        text["text"].contains(s["literal"]))


def string_hits(text: Column, s: Column) -> Column:
    """Hits of one pattern string with byte offsets."""
    hits = F.transform(match_offsets(text["text"], s["pattern"]), lambda h: F.struct(
        s["string_id"].alias("string_id"), h["offset"].alias("offset"), h["data"].alias("data"),
    ))
    return F.when(_may_match(text, s), hits).otherwise(F.array().cast(HIT))


def string_count(text: Column, s: Column) -> Column:
    return F.when(_may_match(text, s), F.regexp_count(text["text"], s["pattern"])).otherwise(0)


def _scan(df: DataFrame, texts: dict[str, str], keys: list[str], rules: list[dict] | None, fire) -> DataFrame:
    """One row per key, text and rule for which ``fire(text, strings)`` says that it fired.

    The texts of a row become one array, so every rule is planned once for all of them.
    """
    grouped = _grouped(default_rules() if rules is None else rules)
    many = sum(len(r["strings"]) for r in grouped) > FEW
    table = _table(grouped)
    if many:
        pick = literals.candidates(df.sparkSession, grouped)
        df = df.withColumns({f"_cand{i}": pick(F.col(c)) for i, c in enumerate(texts.values())})
    sources = [
        F.struct(F.lit(tag).alias("tag"), F.col(c).alias("text"), F.lower(c).alias("lower"),
                 *([F.col(f"_cand{i}").alias("candidates")] if many else []))
        for i, (tag, c) in enumerate(texts.items())
    ]
    shown = F.filter(F.array(*sources), lambda t: ~F.coalesce(is_blank(t["text"]), F.lit(True)))

    def one(t: Column, r: Column) -> Column:
        return F.struct(t["tag"].alias("scanned_source"), r["rule"].alias("rule"), r["severity"].alias("severity"),
                        fire(t, r["strings"]))

    def fired(t: Column) -> Column:
        if many:
            return F.transform(t["candidates"], lambda i: let(table[i], lambda r: one(t, r)))
        return F.transform(F.col("_rules"), lambda r: one(t, r))

    rows = df if many else df.withColumn("_rules", table)
    found = rows.select(*keys, F.inline(F.flatten(F.transform(shown, fired))))
    return found.filter("n_strings > 0") if "n_strings" in found.columns else found.filter(
        F.size("strings") > 0).withColumn("n_strings", F.size("strings"))


def rule_hits(df: DataFrame, texts: dict[str, str], keys: list[str],
              rules: list[dict] | None = None) -> DataFrame:
    """One row per key, scanned text and rule that fired, with its strings and byte offsets.

    ``texts`` maps a source tag to a column, in scan order. All rules and texts are evaluated
    in one narrow projection over the input; blank texts are skipped.
    """
    return _scan(df, texts, keys, rules, lambda t, strings: F.flatten(
        F.transform(strings, lambda s: string_hits(t, s))).alias("strings"))


def rule_counts(df: DataFrame, texts: dict[str, str], keys: list[str],
                rules: list[dict] | None = None) -> DataFrame:
    """``rule_hits`` without the strings: hits are counted, no offset is computed."""
    return _scan(df, texts, keys, rules, lambda t, strings: F.aggregate(
        strings, F.lit(0), lambda n, s: n + string_count(t, s)).alias("n_strings"))


def rule_offsets(hits: DataFrame, keys: list[str]) -> DataFrame:
    """One row per match: offset in bytes, data and an 80-character preview."""
    flat = hits.select(*keys, "scanned_source", "rule", F.inline("strings"))
    return flat.withColumn("preview", preview(F.col("data")))


def rule_summary(hits: DataFrame) -> DataFrame:
    """Firings and matches per text and rule, of ``rule_hits`` or ``rule_counts``."""
    return hits.groupBy("scanned_source", "rule").agg(
        F.count("*").alias("n_firings"), F.sum("n_strings").cast("bigint").alias("n_matches")
    )
