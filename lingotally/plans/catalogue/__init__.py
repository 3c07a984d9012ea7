"""Registered queries over the given tables, each with the SQL that must give the same rows."""

from lingotally.plans.catalogue.registry import ORACLE, QUERIES
from lingotally.plans.catalogue import (  # noqa: F401  (modules register their queries)
    batch, clocks, langid, netgeo, review, rollups, rules, scripts, segments, streams, texts,
)

__all__ = ["ORACLE", "QUERIES"]
