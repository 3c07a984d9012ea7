"""Dialect scores from a marker lexicon, the verdict and the routing decision.

The lexicon is a bounded table (family, marker). It becomes hash-set literals, so scoring is one
projection over the text column: no explode, no join, no shuffle.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, functions as F

from lingotally import refdata as R
from lingotally.functions.binding import let
from lingotally.functions.text import dialect_tokens, is_blank

MIN_MARKERS = 2


def _those(hits: Column, markers: Sequence[str]) -> Column:
    """Hits that are one of a few markers; the list is one literal array."""
    quoted = ", ".join("'" + m.replace("\\", "\\\\").replace("'", "\\'") + "'" for m in markers)
    return F.filter(hits, lambda t: F.array_contains(F.expr(f"array({quoted})"), t))


def marker_hits(text: Column, lexicon: Mapping[str, Sequence[str]] = R.DIALECT_LEXICON) -> Column:
    """Tokens of the text that are a marker of any family, in order."""
    every = sorted({m for ms in lexicon.values() for m in ms} | {R.SHARED_NEGATION})
    return F.filter(dialect_tokens(text), lambda t: t.isin(every))


def dialect_scores(hits: Column, lexicon: Mapping[str, Sequence[str]] = R.DIALECT_LEXICON) -> Column:
    """Struct with one marker count per family, the shared negation credited."""
    def count(h: Column) -> Column:
        counts = {fam: F.size(_those(h, ms)) for fam, ms in lexicon.items()}
        negations = F.size(F.filter(h, lambda t: t == R.SHARED_NEGATION))
        counts[R.SHARED_CREDIT] = counts[R.SHARED_CREDIT] + F.when(
            counts[R.SHARED_BLOCKER] == 0, negations
        ).otherwise(0)
        return F.struct(*[c.alias(fam) for fam, c in counts.items()])

    return let(hits, count)


def dialect_indicators(
    hits: Column, lexicon: Mapping[str, Sequence[str]] = R.DIALECT_LEXICON
) -> Column:
    """Distinct markers seen, by family order then position; the credited negation comes last."""
    def collect(h: Column) -> Column:
        families = [_those(h, ms) for ms in lexicon.values()]
        blocked = F.size(_those(h, lexicon[R.SHARED_BLOCKER])) > 0
        shared = F.when(~blocked, F.filter(h, lambda t: t == R.SHARED_NEGATION)).otherwise(
            F.array().cast("array<string>")
        )
        return F.array_distinct(F.concat(*families, shared))

    return let(hits, collect)


def dialect_verdict(text: Column, scores: Column, families: Sequence[str]) -> Column:
    """Winner by count, ties by family order; below two markers no family is named."""
    def judge(s: Column) -> Column:
        top, winner = s["top"], None
        for fam in families:
            cond = s["n"][fam] == top
            winner = F.when(cond, fam) if winner is None else winner.when(cond, fam)
        strength = F.least(top, F.lit(5)) / F.lit(5.0) * 0.55 + 0.4
        return F.struct(
            F.when(s["blank"], "Unknown").when(top == 0, "ModernStandard")
            .when(top < MIN_MARKERS, "Unknown").otherwise(winner).alias("dialect"),
            F.when(s["blank"], 0.0).when(top == 0, 0.4).when(top < MIN_MARKERS, 0.2)
            .otherwise(F.least(strength, F.lit(0.95))).alias("confidence"),
        )

    return let(
        let(scores, lambda n: F.struct(
            n.alias("n"), F.greatest(*[n[f] for f in families]).alias("top"),
            is_blank(text).alias("blank"),
        )),
        judge,
    )


def detect_dialect(
    text: Column, lexicon: Mapping[str, Sequence[str]] = R.DIALECT_LEXICON
) -> Column:
    def build(hits: Column) -> Column:
        return let(
            dialect_verdict(text, dialect_scores(hits, lexicon), list(lexicon)),
            lambda v: F.struct(
                v["dialect"].alias("dialect"), v["confidence"].alias("confidence"),
                dialect_indicators(hits, lexicon).alias("indicators"),
            ),
        )

    return let(marker_hits(text, lexicon), build)


def route(dialect: Column, confidence: Column, alt_available: Column | bool = False) -> Column:
    """Route, source token and model of a dialect; the decision table is ``refdata.ROUTES``."""
    alt = alt_available if isinstance(alt_available, Column) else F.lit(alt_available)
    chosen = None
    for fam, bar, needs_alt, name in R.ROUTES:
        cond = (dialect == fam) & (confidence >= bar)
        cond = cond & alt if needs_alt else cond
        chosen = F.when(cond, name) if chosen is None else chosen.when(cond, name)
    chosen = chosen.otherwise(R.DEFAULT_ROUTE)
    token = F.create_map(*[F.lit(x) for kv in R.ROUTE_TOKENS.items() for x in kv])[chosen]
    token = F.coalesce(token, F.lit(R.DEFAULT_TOKEN))
    model = F.when(chosen == "SeamlessM4T", "seamless-m4t-medium").otherwise(
        F.concat(F.lit("nllb-200:"), token)
    )
    reason = F.concat(
        dialect, F.lit(" at "), F.format_string("%.2f", confidence), F.lit(" -> "), chosen
    )
    return F.struct(
        chosen.alias("route"), token.alias("source_token"), model.alias("model"),
        reason.alias("reason"), confidence.alias("confidence"),
    )


def dialect_token(dialect: Column) -> Column:
    """Source token of a family, independent of confidence."""
    tokens = F.create_map(*[F.lit(x) for kv in R.DIALECT_TOKENS.items() for x in kv])
    return F.coalesce(tokens[dialect], F.lit(R.DEFAULT_TOKEN))


def family_of_label(label: Column) -> Column:
    """External model label to family; the label set is fixed and small."""
    families = F.create_map(*[F.lit(x) for kv in R.DIALECT_LABELS.items() for x in kv])
    return F.coalesce(families[F.upper(label)], F.lit("Unknown"))
