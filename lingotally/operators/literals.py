"""Candidate rules of a text: one Aho-Corasick automaton over a required literal of every pattern.

A pattern can only match where a literal occurs that each of its matches contains. The literals of all rules go into
one automaton, so a text is read once however many rules there are; regular expressions run for candidates only.
Patterns without such a literal are candidates everywhere.
"""

from __future__ import annotations

import re
import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import SparkSession, functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])

LEAST = 3  # shorter literals occur nearly everywhere
PIECE = 1 << 16
FOLD = {c: c + 32 for c in range(65, 91)}


def fold(text: str) -> str:
    """Lower-cases A-Z; a superset of what patterns match in either case."""
    return text.translate(FOLD)


def required(pattern: str, least: int = LEAST) -> list[str]:
    """Literals of which every match of the pattern contains one, as long as can be told; none if there are no such."""
    try:
        tree = re._parser.parse(pattern)
    except (re.error, OverflowError, RecursionError, ValueError):
        return []  # syntax that is not shared by all engines: no literal is derived
    if tree.state.flags & re.VERBOSE or re.search(r"\(\?[a-zA-Z]*[uU]", pattern):
        return []  # with Unicode case folding a letter may match others than its two ASCII forms
    best = _of_sequence(tree)
    return sorted({fold(x) for x in best}) if best and min(map(len, best)) >= least else []


def _of_sequence(tree) -> list[str]:
    """The best choice among the runs of literal characters of a sequence and what its parts require."""
    choices: list[list[str]] = []
    run: list[str] = []

    def end() -> None:
        if run:
            choices.append(["".join(run)])
            run.clear()

    for op, value in tree:
        name = str(op)
        if name == "LITERAL":
            run.append(chr(value))
        elif name == "SUBPATTERN" and all(str(o) == "LITERAL" for o, _ in value[3]):
            run.extend(chr(v) for _, v in value[3])
        elif name == "AT":
            continue  # an edge takes no character
        else:
            end()
            if name == "SUBPATTERN":
                choices.append(_of_sequence(value[3]))
            elif name == "ATOMIC_GROUP":
                choices.append(_of_sequence(value))
            elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT") and value[0] >= 1:
                choices.append(_of_sequence(value[2]))
            elif name == "BRANCH":
                parts = [_of_sequence(x) for x in value[1]]
                choices.append([x for p in parts for x in p] if all(parts) else [])
    end()
    return max((c for c in choices if c), key=lambda c: (min(map(len, c)), -len(c)), default=[])


class Automaton:
    """Rules by the literals of their strings."""

    def __init__(self, rules: list[dict]):
        self.places: dict[str, list[int]] = {}
        self.always: list[int] = []
        for i, r in enumerate(rules):
            wanted: set[str] = set()
            for s in r["strings"]:
                own = required(s["pattern"])
                given = s.get("literal") or ""
                if len(given) >= LEAST and (not own or len(given) > min(map(len, own))):
                    own = [fold(given)]
                if not own:
                    self.always.append(i)
                    break
                wanted.update(own)
            else:
                for literal in wanted:
                    self.places.setdefault(literal, []).append(i)
        self._made = None

    def __getstate__(self):
        return {**self.__dict__, "_made": None}  # built once per worker

    def scan(self, text: str) -> list[int]:
        """Candidate rules of a text, ascending."""
        if self._made is None:
            import ahocorasick

            self._made = ahocorasick.Automaton()
            for literal, rules in self.places.items():
                self._made.add_word(literal, (literal, rules))
            if self.places:
                self._made.make_automaton()
        found = set(self.always)
        if self.places:
            seen = set()
            for _, (literal, rules) in self._made.iter(fold(text)):
                if literal not in seen:
                    seen.add(literal)
                    found.update(rules)
        return sorted(found)


def candidates(spark: SparkSession, rules: list[dict]):
    """Function from a text column to the numbers of the rules that may match it. ``rules``: entries with ``strings``."""
    shared = spark.sparkContext.broadcast(Automaton(rules))  # written by people: as large as the rule table

    @F.pandas_udf("array<int>")
    def scan(texts: pd.Series) -> pd.Series:
        a = shared.value
        return pd.Series([None if t is None else np.array(a.scan(t), dtype=np.int32) for t in texts], dtype=object)

    return scan
