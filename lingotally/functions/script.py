"""Script statistics: runs, code switching, glyph profiles and their verdicts."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from lingotally.functions.binding import let
from lingotally.refdata import GLYPHS_A, GLYPHS_B

# Code-point ranges are tested before the alphabetic property, so digits and punctuation of a
# range belong to its script; every other alphabetic character counts as latin.
CODES = {
    "arabic": [(0x0600, 0x06FF), (0x0750, 0x077F)],
    "cyrillic": [(0x0400, 0x04FF)],
    "cjk": [(0x4E00, 0x9FFF)],
    "hebrew": [(0x0590, 0x05FF)],
    "devanagari": [(0x0900, 0x097F)],
}
RANGES = {
    name: "".join(rf"\x{{{a:04X}}}-\x{{{b:04X}}}" for a, b in spans) for name, spans in CODES.items()
}
_RANGED = "".join(RANGES.values())
LATIN = rf"[\p{{IsAlphabetic}}&&[^{_RANGED}]]"


def _run(cls: str, others: str) -> str:
    # A run starts on a character of the script and swallows unclassified characters after it.
    return rf"{cls}[{others}]*"


def _run_pattern() -> str:
    alternatives = [_run(LATIN, f"^{_RANGED}")]
    for name, own in RANGES.items():
        rest = "".join(r for n, r in RANGES.items() if n != name)
        alternatives.append(_run(f"[{own}]", rf"{own}\P{{IsAlphabetic}}&&[^{rest}]"))
    return "(?s)(?=(.))(?:" + "|".join(alternatives) + ")"


RUN_PATTERN = _run_pattern()


def _ranged_script(c: Column) -> Column:
    """Script by code point for the ranges, else null (``ascii`` yields the code point)."""
    expr = None
    for name, spans in CODES.items():
        for a, b in spans:
            cond = F.ascii(c).between(a, b)
            expr = F.when(cond, name) if expr is None else expr.when(cond, name)
    return expr


def char_script(c: Column) -> Column:
    """Script of one character, ``other`` if it is neither in a range nor a letter."""
    letter = F.when(c.rlike(r"^\p{IsAlphabetic}"), "latin").otherwise("other")
    return F.coalesce(_ranged_script(c), letter)


def _mixed_runs(text: Column) -> Column:
    return F.transform(
        F.regexp_extract_all(text, F.lit(RUN_PATTERN), F.lit(1)),
        lambda c: F.coalesce(_ranged_script(c), F.lit("latin")),
    )


def _plain_runs(has_letter: Column) -> Column:
    return F.when(has_letter, F.array(F.lit("latin"))).otherwise(F.array().cast("array<string>"))


def is_ranged(text: Column) -> Column:
    """Whether the text has a character of the ranges."""
    return text.rlike(f"[{_RANGED}]")


def script_runs(text: Column) -> Column:
    """Scripts of the maximal same-script runs in order, one regex pass, no explode.

    Text without any character of the ranges is one latin run, if it has a letter at all.
    """
    return F.when(is_ranged(text), _mixed_runs(text)).otherwise(_plain_runs(text.rlike(r"\p{IsAlphabetic}")))


def script_profile(text: Column) -> Column:
    """Struct of runs, n_alpha and n_latin. Texts without a character of the ranges are counted once: all their
    letters are latin; only the others take further passes."""
    def build(alpha: Column) -> Column:
        mixed = F.struct(_mixed_runs(text).alias("runs"), alpha.alias("n_alpha"), latin_count(text).alias("n_latin"))
        plain = F.struct(_plain_runs(alpha > 0).alias("runs"), alpha.alias("n_alpha"), alpha.alias("n_latin"))
        return F.when(is_ranged(text), mixed).otherwise(plain)

    return let(alpha_count(text), build)


def alpha_count(text: Column) -> Column:
    return F.length(F.regexp_replace(text, r"\P{IsAlphabetic}+", ""))


def latin_count(text: Column) -> Column:
    return F.length(F.regexp_replace(text, rf"[\P{{IsAlphabetic}}{_RANGED}]+", ""))


def latin_ratio(text: Column) -> Column:
    def ratio(n: Column) -> Column:
        latin = F.when(is_ranged(text), latin_count(text)).otherwise(n)
        return F.when(n > 0, latin / n).otherwise(0.0)

    return let(alpha_count(text), ratio)


def switch_count(runs: Column) -> Column:
    return F.greatest(F.size(runs) - 1, F.lit(0))


def code_switch_confidence(n_scripts: Column, switches: Column, alpha: Column) -> Column:
    rate = F.when(alpha > 0, F.least(switches / alpha, F.lit(0.5)) * 1.9).otherwise(0.0)
    return F.when(
        (n_scripts >= 2) & (switches >= 1), F.greatest(F.least(rate, F.lit(0.95)), F.lit(0.3))
    ).otherwise(0.0)


def code_switch(text: Column) -> Column:
    def judge(seen: Column) -> Column:
        scripts, switches = F.array_distinct(seen["runs"]), switch_count(seen["runs"])
        return F.struct(
            ((F.size(scripts) >= 2) & (switches >= 1)).alias("is_code_switched"),
            code_switch_confidence(F.size(scripts), switches, seen["alpha"]).alias("confidence"),
            scripts.alias("scripts"),
            switches.alias("switch_count"),
        )

    # letters are counted for texts that can switch only: a plain text has one run or none
    plain = F.struct(_plain_runs(text.rlike(r"\p{IsAlphabetic}")).alias("runs"), F.lit(0).alias("alpha"))
    mixed = F.struct(_mixed_runs(text).alias("runs"), alpha_count(text).alias("alpha"))
    return let(F.when(is_ranged(text), mixed).otherwise(plain), judge)


def glyph_count(text: Column, glyphs: str) -> Column:
    return F.length(text) - F.length(F.translate(text, glyphs, ""))


def glyph_list(text: Column, glyphs: str) -> Column:
    """Distinct glyphs in first-seen order."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"([{glyphs}])"), F.lit(1)))


def glyph_profile(text: Column, a: str = GLYPHS_A, b: str = GLYPHS_B) -> Column:
    return F.struct(
        glyph_count(text, a).alias("n_a"),
        glyph_count(text, b).alias("n_b"),
        glyph_list(text, a).alias("glyphs_a"),
        glyph_list(text, b).alias("glyphs_b"),
    )


def script_verdict(n_a: Column, n_b: Column) -> Column:
    """Which glyph set prevails: ``A``, ``B`` or ``Ambiguous``, with a confidence."""
    top = F.greatest(n_a, n_b)
    strength = F.least(top, F.lit(5)) / F.lit(5.0) * 0.45 + 0.55 * (top / (n_a + n_b))
    verdict = F.when(n_a > n_b, "A").when(n_b > n_a, "B").otherwise("Ambiguous")
    confidence = (
        F.when((n_a == 0) & (n_b == 0), 0.0)
        .when(n_a == n_b, 0.3)
        .otherwise(F.least(strength, F.lit(0.95)))
    )
    return F.struct(verdict.alias("recommendation"), confidence.alias("confidence"))


def disambiguate(
    language: Column, verdict: Column, confidence: Column, glyphs_a: Column,
    source: str = "fa", target: str = "ps", bar: float = 0.7,
) -> Column:
    """Move ``source`` to ``target`` when set A prevails clearly; note what was seen."""
    is_source = language == source
    flips = is_source & (verdict == "A") & (confidence >= bar)
    unsure = is_source & (verdict == "Ambiguous") & (F.size(glyphs_a) > 0)
    score = F.format_string("%.2f", confidence)
    note = F.when(
        flips,
        F.concat(
            F.lit(f"Changed from {source} to {target} by script analysis; glyphs: "),
            F.array_join(glyphs_a, ", "), F.lit("; confidence "), score,
        ),
    ).when(unsure, F.concat(F.lit("Script analysis undecided; confidence "), score))
    return F.struct(
        F.when(flips, target).otherwise(language).alias("language"), note.alias("note")
    )


def select_engine(
    text: Column, language: Column, confidence: Column, alt_available: Column | bool
) -> Column:
    alt = alt_available if isinstance(alt_available, Column) else F.lit(alt_available)
    mixed = (confidence < 0.75) | ((language == "ar") & (latin_ratio(text) > 0.15))
    return F.when(alt & mixed, "Seamless").otherwise("Nllb")
