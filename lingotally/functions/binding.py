"""Bind an expression to a name inside a column expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often the body uses it.

    Catalyst shares common subexpressions only where all branches need them; a lambda variable is
    shared by construction.
    """
    return F.transform(F.array(value), body)[0]


def free_prefix(columns: list[str], stem: str = "_") -> str:
    """A prefix that no column begins with, for working columns beside a user's own (names ignore case)."""
    while any(c.lower().startswith(stem) for c in columns):
        stem += "_"
    return stem
