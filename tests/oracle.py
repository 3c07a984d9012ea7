"""Side-by-side check of a registered query and its SQL on the same parquet tables."""

from __future__ import annotations

import math

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()

KINDS = {
    "tinyint": "int", "smallint": "int", "int": "int", "bigint": "int", "integer": "int",
    "double": "float", "float": "float", "string": "text", "varchar": "text", "boolean": "bool",
}


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


def _norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9) + 0.0
    return v


def _rows(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(_norm(r[i]) for i in order) for r in rows), key=repr)


def compare(df, con: duckdb.DuckDBPyConnection, sql: str) -> list[str]:
    """Differences between a DataFrame and a SQL result; empty if equal."""
    problems = []
    rel = con.sql(sql)
    names = rel.columns
    if sorted(names) != sorted(df.columns):
        return [f"columns {sorted(df.columns)} vs {sorted(names)}"]
    ours = {f.name: f.dataType.simpleString() for f in df.schema}
    theirs = {n: str(t).lower() for n, t in zip(names, rel.types)}
    for n in names:
        a, b = KINDS.get(ours[n], ours[n]), KINDS.get(theirs[n], theirs[n])
        if a != b or (a == "int" and {"bigint"} & {ours[n], theirs[n]} and ours[n] != theirs[n]):
            problems.append(f"type of {n}: {ours[n]} vs {theirs[n]}")
    left = _rows([tuple(r) for r in df.collect()], df.columns)
    right = _rows(rel.fetchall(), names)
    if len(left) != len(right):
        problems.append(f"rows {len(left)} vs {len(right)}")
    bad = [(a, b) for a, b in zip(left, right) if a != b]
    if bad:
        problems.append(f"{len(bad)} rows differ, first: {str(bad[0])[:900]}")
    return problems
