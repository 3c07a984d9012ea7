"""Quality rules as weak supervision: rules vote or abstain, EM weighs them, posteriors decide.

Every rule looks at one measure of the text and votes good (1), bad (-1) or abstains (0) between its two
thresholds, so most texts get a vote of every rule. The label model (after Dawid and Skene, 1979; Ratner
et al., 2016) estimates the share of good texts and two accuracies per rule: how often it votes good on
good texts, and bad on bad ones. A rule that cries on texts which the others hold good loses its weight and
is outvoted; a good vote of a rule that never sees the usual kind of junk says next to nothing. Votes are
counted per vote pattern (at most 3 ** rules rows, whatever the corpus), so an EM round is one small
aggregation over that table. Priors weigh ``WEIGHT`` votes, however many rows vote.

All work is column expressions; the driver holds a few numbers per rule and round.

Defined results: null and empty texts have no words, fail the base rules and are not kept; repeated
rows are judged alike; an empty table gives an empty result; other columns of the input pass through
``judge`` untouched as long as their names do not start with ``_q_``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from lingotally import session
from lingotally.llm.common import SPACE, UPPER, WORD, char_count, whole, words

ROUNDS = 30
KEEP = 0.5
WEIGHT = 20.0  # votes that a prior counts for
PRIOR = (0.8, 0.9, 0.5)  # share of good texts; accuracy on good ones, on bad ones
MIN_WORDS, MAX_REPEAT = 50, 0.5
P = "_q_"


def _repeat_words(words: Column) -> Column:
    """Words inside 3-word windows that occur twice or more in the text.

    Windows are sorted as (hash, place) within the row; equal neighbours give the repeated places, and
    a place covers three words, less what the next one covers.
    """
    at = F.filter(
        F.transform(words, lambda w, i: F.struct(
            F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)).alias("h"), i.alias("i"))),
        lambda s: s["i"] < F.size(words) - 2)
    return F.array_sort(at)


def measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add the measures, each named ``_q_<measure>``, to every row."""
    t = whole(F.col(text))
    d = docs.withColumn(f"{P}words", words(t))
    w = F.col(f"{P}words")
    lines = F.filter(F.split(t, "\n", -1), lambda x: x.rlike(WORD))
    d = d.withColumn(f"{P}lines", lines).withColumn(f"{P}grams", _repeat_words(w))
    g = F.col(f"{P}grams")
    twice = F.array_sort(F.transform(
        F.filter(g, lambda s, j: (F.get(g, j + 1)["h"] == s["h"]).eqNullSafe(True)
                 | (F.get(g, j - 1)["h"] == s["h"]).eqNullSafe(True)),
        lambda s: s["i"]))
    d = d.withColumn(f"{P}twice", twice)
    r = F.col(f"{P}twice")
    covered = F.aggregate(
        F.transform(r, lambda i, j: F.least(F.lit(3), F.coalesce(F.get(r, j + 1) - i, F.lit(3)))),
        F.lit(0), lambda a, b: a + b)
    count = lambda cls: F.regexp_count(t, F.lit(cls)).cast("bigint")
    keep = [F.col(f"`{c}`") for c in docs.columns]
    d = d.select(
        *keep,
        F.size(w).cast("bigint").alias(f"{P}n_words"),
        (F.length(t) - char_count(t, SPACE)).alias(f"{P}word_chars"),
        count(r"[#*$%&|<>]").alias(f"{P}n_symbols"),
        F.size(f"{P}lines").cast("bigint").alias(f"{P}n_lines"),
        (F.size(f"{P}lines") - F.size(F.array_distinct(f"{P}lines"))).cast("bigint").alias(f"{P}n_dup_lines"),
        covered.cast("bigint").alias(f"{P}n_repeat_words"),
        char_count(t, UPPER).alias(f"{P}n_upper"),
        count(r"[!?]").alias(f"{P}n_marks"),
        count(r"[0-9]").alias(f"{P}n_digits"),
        count(r"[.,;:](?=[\x20\x09-\x0D]|$)").alias(f"{P}n_stops"),
    )
    return d


def rules() -> dict[str, tuple[Column, Column]]:
    """Rule -> (good, bad); where neither holds, the rule abstains. Thresholds are own choices."""
    n = F.greatest(F.col(f"{P}n_words"), F.lit(1)).cast("double")
    chars = F.greatest(F.col(f"{P}word_chars"), F.lit(1)).cast("double")
    symbols, length, stops = F.col(f"{P}n_symbols"), chars / n, F.col(f"{P}n_stops") / n
    lines = F.col(f"{P}n_dup_lines") / F.greatest(F.col(f"{P}n_lines"), F.lit(1))
    letters = 1 - (symbols + F.col(f"{P}n_marks") + F.col(f"{P}n_digits") + F.col(f"{P}n_stops")) / chars

    def low(share: Column, good: float, bad: float) -> tuple[Column, Column]:
        return share < good, share >= bad

    return {
        "symbols": low(symbols / n, 0.02, 0.1),
        "symbol_chars": low(symbols / chars, 0.005, 0.03),
        "letters": (letters >= 0.94, letters < 0.88),
        "capitals": low(F.col(f"{P}n_upper") / chars, 0.08, 0.2),
        "marks": low(F.col(f"{P}n_marks") / n, 0.05, 0.15),
        "digits": low(F.col(f"{P}n_digits") / chars, 0.03, 0.1),
        "lines": low(lines, 0.01, 0.1),
        "repeats": low(F.col(f"{P}n_repeat_words") / n, 0.1, 0.25),
        "word_length": (length.between(4.0, 6.5), (length < 3.0) | (length > 7.5)),
        "stops": (stops.between(0.08, 0.4), (stops < 0.05) | (stops > 0.7)),
    }


def votes(measured: DataFrame, made: dict[str, tuple[Column, Column]] | None = None) -> DataFrame:
    """Add ``_q_v_<rule>`` in (-1, 0, 1)."""
    return measured.withColumns({
        f"{P}v_{k}": F.when(bad, -1).when(good, 1).otherwise(0) for k, (good, bad) in (made or rules()).items()})


def posterior(model: dict) -> Column:
    """Chance that the row is good: every vote counts with the log odds that the rule's accuracies give it."""
    total = F.lit(math.log(model["share"] / (1 - model["share"])))
    for rule, (on_good, on_bad) in model["rules"].items():
        v = F.col(f"{P}v_{rule}")
        total = total + F.when(v == 1, math.log(on_good / (1 - on_bad))).when(
            v == -1, math.log((1 - on_good) / on_bad)).otherwise(0.0)
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def base_failed(min_words: int = MIN_WORDS, max_repeat: float = MAX_REPEAT) -> Column:
    n = F.col(f"{P}n_words")
    return (n < min_words) | (100 * F.col(f"{P}n_repeat_words") > 100 * max_repeat * n)


def fit(voted: DataFrame, rounds: int = ROUNDS, prior: tuple[float, float, float] = PRIOR,
        weight: float = WEIGHT) -> dict:
    """{"share", "rules": {rule: (accuracy on good texts, on bad ones)}} by expectation-maximisation over the votes
    of all rows that pass the base rules.

    E: the posterior of every vote pattern. M: a rule's accuracies are the posterior shares of its votes
    that agree with the hidden class. ``prior`` is where the rounds start and what counts for ``weight`` votes.
    """
    share, on_good, on_bad = prior
    cols = [c for c in voted.columns if c.startswith(f"{P}v_")]
    names = [c[len(f"{P}v_"):] for c in cols]
    patterns = voted.filter(~base_failed()).groupBy(*cols).agg(F.count("*").alias("_n")).checkpoint(eager=True)
    model = {"share": share, "rules": {k: (on_good, on_bad) for k in names}}
    good, bad = F.col("_n") * F.col("_p"), F.col("_n") * (1 - F.col("_p"))
    for _ in range(rounds):
        sums = [F.sum("_n").alias("n"), F.sum(good).alias("good")]
        for c, k in zip(cols, names):
            sums += [F.sum(F.when(F.col(c) == 1, good).otherwise(0.0)).alias(f"hit_good_{k}"),
                     F.sum(F.when(F.col(c) != 0, good).otherwise(0.0)).alias(f"cast_good_{k}"),
                     F.sum(F.when(F.col(c) == -1, bad).otherwise(0.0)).alias(f"hit_bad_{k}"),
                     F.sum(F.when(F.col(c) != 0, bad).otherwise(0.0)).alias(f"cast_bad_{k}")]
        row = patterns.withColumn("_p", posterior(model)).agg(*sums).first()

        def part(hit, cast, start: float) -> float:
            return ((hit or 0.0) + start * weight) / ((cast or 0.0) + weight)

        new = {"share": part(row["good"], row["n"], share), "rules": {
            k: (part(row[f"hit_good_{k}"], row[f"cast_good_{k}"], on_good),
                part(row[f"hit_bad_{k}"], row[f"cast_bad_{k}"], on_bad)) for k in names}}
        moved = max([abs(new["share"] - model["share"])] + [
            abs(a - b) for k in names for a, b in zip(new["rules"][k], model["rules"][k])])
        model = new
        if moved < 1e-4:
            break
    return model


def judge(voted: DataFrame, model: dict, keep: float = KEEP, min_words: int = MIN_WORDS,
          max_repeat: float = MAX_REPEAT) -> DataFrame:
    """Add ``_q_base_failed``, ``_q_posterior`` and ``_q_kept``."""
    out = voted.withColumn(f"{P}base_failed", base_failed(min_words, max_repeat))
    out = out.withColumn(f"{P}posterior", posterior(model))
    return out.withColumn(f"{P}kept", ~F.col(f"{P}base_failed") & (F.col(f"{P}posterior") >= keep))


def keep_good(docs: DataFrame, text: str = "text", keep: float = KEEP) -> DataFrame:
    """Rows that the rules keep, with all their columns. Rows are stored once beside their votes, so every text is
    measured once."""
    voted = votes(measures(docs, text))
    voted = session.stored(voted.select(*[F.col(f"`{c}`") for c in docs.columns], *[
        c for c in voted.columns if c.startswith(f"{P}v_") or c in (f"{P}n_words", f"{P}n_repeat_words")]), "votes")
    return judge(voted, fit(voted), keep).filter(f"{P}kept").select(*[F.col(f"`{c}`") for c in docs.columns])
