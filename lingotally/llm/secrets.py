"""Secret scans: fixed patterns, and guess costs of values that stand in a credential context.

Patterns (leftmost, non-overlapping per kind) report ``assign``, ``access`` and ``hex`` spans. Beyond
them, a value after a credential word gets its guess cost: the cheapest segmentation into dictionary
words, dates, repeats (of a character or a block), keyboard walks and brute-force spans, by dynamic programming over prefixes (after
Wheeler, 2016). Values that cost ``MIN_GUESSES`` or more (of letters alone: ``LETTERS_GUESSES``) and lie
outside the pattern spans are reported as ``guess``. A credential word may follow an underscore, and
a value may follow ``Bearer`` directly.

Row-local; a text is scanned whole, whatever its length. Offsets are code points, end exclusive.

Defined results: null and empty texts have no spans; repeated rows are scanned each; an empty table
gives an empty result; other columns pass through untouched by ``scan``, which adds ``spans``.
"""

from __future__ import annotations

import math
import re
import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F

from lingotally.functions.binding import free_prefix

cloudpickle.register_pickle_by_value(sys.modules[__name__])

KINDS = ("assign", "access", "hex", "guess")
MIN_GUESSES = 10.0  # log10
LETTERS_GUESSES = 16.0  # for values of letters alone, which prose after a credential word has too
SEGMENT_COST = math.log10(2.0)
FAR = 64  # longer repeats and walks end where their run ends, which keeps very long values linear; longest block

ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
CONTEXT = re.compile(
    r"""(?<![^\W_])(?:(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|api[_-]?key|(?:access|private|secret)[_-]key|"""
    r"""credentials?|auth(?:orization)?|login|bearer)["']?\s{0,3}(?:is|was|=>|:=|[:=]|->)\s{0,3}|bearer\s{1,3})"""
    r"""["']?(?:(?:bearer|basic|token)\s{1,3})?["']?([^\s"'<>,;()]{6,})""",
    re.A | re.I)

# Own short list of frequent words in passwords, most frequent first; callers pass a larger one.
WORDS = (
    "password pass admin login welcome user test root master secret token key hello love dragon monkey "
    "shadow letmein qwerty abc summer winter spring autumn sun star football baseball princess ninja "
    "change changeme default guest demo example sample temp none null true false required optional "
    "value name the and for you with this that from your not new my our is are was were be to of in on at "
    "it or an as by secure private public access account server database system service house river "
    "green blue black white red dog cat tiger lion eagle apple orange happy lucky money world "
    # stems and endings that long words of prose and code are made of
    "ation ations ition tion sion ing ings ment ments ness less able ably ible ibly ability ibility ibilities "
    "ance ence ent ant ive ively ical ically ally ity ities ous ously ful fully ship hood ism ist ists ize ized "
    "izing ization ise ised isation ify ified ification ated ating ator ators ically ologies ology ological graph "
    "graphy graphic inter intra trans super under over counter multi micro macro extra hyper pseudo semi anti auto "
    "auth authentic author config configur commun char character crypt encrypt decrypt respons respond represent "
    "require recommend communic compre compreh hens conven consider consequ constit construct institut instruct "
    "struct distribut distinguish differen environ establish experi express identif inform implement independ "
    "industr intellig interest interna nation national know ledge manage manufactur mathemat measure necess "
    "object occasion opera organ partic particular perform person philosoph photo physic polit possib potent "
    "practic prefer present princip proced process produc profess program psych publish qualif quest reason refer "
    "regist regular relation religi resist retriev revol satisf scien sequen signif simil special stand standard "
    "substan success suffic syst techn temper tempor theor tradit transform transport understand univers "
    "valid variab verif vulner work shop share holder holders place holder string number credential file field "
    "function method return request response client session cookie store storage manager handler provider "
    "factory builder helper context current update create delete get set has can will should would could"
).split()
RANKS = {w: i + 1 for i, w in enumerate(dict.fromkeys(WORDS))}
ROWS = ("1234567890", "qwertyuiop", "asdfghjkl", "zxcvbnm", "abcdefghijklmnopqrstuvwxyz", "yxcvbnm", "azertyuiop")
DATE = re.compile(r"(?:(?:19|20)\d\d(?:[-/.]?(?:0[1-9]|1[0-2])(?:[-/.]?(?:0[1-9]|[12]\d|3[01]))?)?"
                  r"|(?:0[1-9]|[12]\d|3[01])[-/.]?(?:0[1-9]|1[0-2])[-/.]?(?:19|20)\d\d)")


def _steps() -> set[str]:
    return {a + b for row in ROWS for line in (row, row[::-1]) for a, b in zip(line, line[1:])}


STEPS = _steps()


def _run_ends(linked: list[bool]) -> list[int]:
    """End of the run at every place; ``linked[i]``: places i and i + 1 belong together."""
    ends = list(range(1, len(linked) + 2))
    for i in range(len(linked) - 1, -1, -1):
        if linked[i]:
            ends[i] = ends[i + 1]
    return ends


def _run_lengths(linked: np.ndarray) -> np.ndarray:
    """How many places in a row are linked, from every place on."""
    at = np.arange(len(linked))
    stop = np.where(linked, len(linked), at)
    return np.minimum.accumulate(stop[::-1])[::-1] - at


def _blocks(value: str) -> list[tuple[int, int, int]]:
    """(place, size, most copies) of every block of 2 to ``FAR`` characters that follows itself at once, and is no
    repetition itself."""
    codes = np.frombuffer(value.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    found, held = [], {}
    for size in range(1, min(FAR, len(codes) // 2) + 1):
        held[size] = _run_lengths(codes[:-size] == codes[size:])
        starts = np.flatnonzero(held[size] >= size)
        for d in range(1, size // 2 + 1):
            if size % d == 0 and starts.size:
                starts = starts[held[d][starts] < size - d]
        if size > 1:
            found += [(i, size, n) for i, n in zip(starts.tolist(), (held[size][starts] // size + 1).tolist())]
    return found


def guess_cost(value: str, ranks: dict[str, int] | None = None) -> float:
    """log10 of the guesses for the cheapest segmentation of ``value``.

    A repeated block costs what one copy costs, times the number of copies.
    """
    ranks = RANKS if ranks is None else ranks
    repeated, once = {}, {}
    for i, size, copies in _blocks(value):
        block = value[i:i + size]
        if block not in once:
            once[block] = guess_cost(block, ranks)
        repeated.setdefault(i, []).append((size, copies, once[block]))
    longest = max(map(len, ranks), default=0)
    low, n = value.lower(), len(value)
    best, brute = [0.0] + [math.inf] * n, [math.inf] * (n + 1)
    same = _run_ends([a == b for a, b in zip(value, value[1:])])
    walk = _run_ends([low[i:i + 2] in STEPS for i in range(n - 1)])  # keyboard walks and alphabet runs

    def offer(i: int, j: int, cost: float) -> None:
        best[j] = min(best[j], best[i] + cost + SEGMENT_COST)

    for i in range(n):
        c = value[i]
        size = 10 if c.isdigit() else 26 if c.isalpha() and c.isascii() else 33
        # a brute-force span opens here or goes on from the previous place
        brute[i + 1] = min(best[i] + SEGMENT_COST, brute[i]) + math.log10(size)
        for k in range(3, min(longest, n - i) + 1):
            rank = ranks.get(low[i:i + k])
            if rank:
                capital = value[i:i + k] != low[i:i + k]
                offer(i, i + k, math.log10(rank + 1) + (math.log10(k + 1) if capital else 0.0))
        m = DATE.match(value, i)
        if m:
            offer(i, m.end(), math.log10(365 * 120) if m.end() - i > 4 else math.log10(120))
        for ends, choices in ((same, size), (walk, 2 * len(STEPS))):
            stop = ends[i]
            for j in (*range(i + 3, min(stop, i + FAR)), stop):
                if j - i >= 3:
                    offer(i, j, math.log10(choices * (j - i)))
        for block, copies, cost in repeated.get(i, ()):
            for k in {*range(2, min(copies, FAR // block) + 1), copies}:
                offer(i, i + k * block, cost + math.log10(k))
        best[i + 1] = min(best[i + 1], brute[i + 1])
    return best[n]


def least_guesses(value: str, min_guesses: float) -> float:
    """Guess cost from which ``value`` is a secret: prose after a credential word is of letters alone."""
    return max(min_guesses, LETTERS_GUESSES) if value.isalpha() else min_guesses


def find_spans(text: str | None, ranks: dict[str, int] | None = None,
               min_guesses: float = MIN_GUESSES) -> list[tuple[int, int, int]]:
    """(kind number, start, end) by start, then kind."""
    if not text:
        return []
    found = [(0, *m.span()) for m in ASSIGN.finditer(text) if len(m.group(2)) >= 6]
    if "AKIA" in text:
        found += [(1, *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(2, *m.span()) for m in HEX.finditer(text)]
    inside = sorted((a, b) for _, a, b in found)
    for m in CONTEXT.finditer(text):
        a, b = m.span(1)
        value = m.group(1).rstrip(".!?:")
        b = a + len(value)
        if b - a >= 6 and not any(x < b and a < y for x, y in inside):
            if guess_cost(value, ranks) >= least_guesses(value, min_guesses):
                found.append((3, a, b))
    return sorted(found, key=lambda s: (s[1], s[0], s[2]))


SPANS = "array<struct<kind:string,start:int,`end`:int>>"


def scanner(words: list[str] | None = None, min_guesses: float = MIN_GUESSES):
    """Column function text -> array of (kind, start, end)."""
    ranks = None if words is None else {w: i + 1 for i, w in enumerate(words)}

    @F.pandas_udf(SPANS)
    def spans(texts: pd.Series) -> pd.Series:
        return pd.Series([[{"kind": KINDS[k], "start": a, "end": b}
                           for k, a, b in find_spans(t, ranks, min_guesses)] for t in texts])

    return spans


def scan(docs: DataFrame, text: str = "text", words: list[str] | None = None,
         min_guesses: float = MIN_GUESSES, out: str = "spans") -> DataFrame:
    return docs.withColumn(out, scanner(words, min_guesses)(F.col(text)))


def render(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(text: Column, spans: Column) -> Column:
    """Text with every span (overlaps merged) replaced by its first kind in brackets."""
    zero = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    n = F.length(text)
    step = lambda a, s: F.when(s["end"] <= a["at"], a).otherwise(F.struct(
        F.when(s["start"] < a["at"], a["out"]).otherwise(F.concat(
            a["out"], text.substr(a["at"] + 1, s["start"] - a["at"]),
            F.lit("[secret:"), s["kind"], F.lit("]"))).alias("out"), s["end"].alias("at")))
    return F.when(F.size(spans) > 0, F.aggregate(
        spans, zero, step, lambda a: F.concat(a["out"], text.substr(a["at"] + 1, n)))).otherwise(text)


def redact(docs: DataFrame, text: str = "text", length: str = "n_chars", words: list[str] | None = None,
           min_guesses: float = MIN_GUESSES) -> DataFrame:
    """All rows and columns of ``docs``, spans replaced in the text and its length column, if any, renewed."""
    p = free_prefix(docs.columns)
    d = scan(docs, text, words, min_guesses, f"{p}spans")
    d = d.withColumn(f"{p}new", redacted(F.col(f"`{text}`"), F.col(f"{p}spans")))
    new = {text: F.col(f"{p}new"), length: F.length(f"{p}new").cast("bigint")}
    return d.select(*[new[c].alias(c) if c in new else F.col(f"`{c}`") for c in docs.columns])
