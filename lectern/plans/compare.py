"""Order-insensitive result comparison used by the oracle checks."""

from __future__ import annotations

import math


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9)
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x)) for k, x in v.items()))
    return v


def canonical_rows(columns: list[str], rows: list[tuple]) -> list[tuple]:
    """Columns sorted by name, values normalised, rows sorted."""
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(_norm(r[i]) for i in order) for r in rows]
    return sorted(out, key=lambda t: tuple((x is None, str(x)) for x in t))


def differences(s_cols, s_rows, d_cols, d_rows) -> list[str]:
    problems = []
    if sorted(s_cols) != sorted(d_cols):
        problems.append(f"columns spark={sorted(s_cols)} duck={sorted(d_cols)}")
    if len(s_rows) != len(d_rows):
        problems.append(f"rows spark={len(s_rows)} duck={len(d_rows)}")
    if not problems:
        a, b = canonical_rows(s_cols, s_rows), canonical_rows(d_cols, d_rows)
        diff = [(x, y) for x, y in zip(a, b) if x != y]
        if diff:
            problems.append(f"{len(diff)} differing rows, first: spark={diff[0][0]!r:.300} duck={diff[0][1]!r:.300}")
    return problems


# Spark simple type names and the DuckDB types that hold the same values.
SPARK_TO_DUCKDB = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE",
                   "boolean": "BOOLEAN", "date": "DATE", "timestamp_ntz": "TIMESTAMP",
                   "timestamp": "TIMESTAMP WITH TIME ZONE", "binary": "BLOB"}


def type_differences(spark_schema, duck_columns, duck_types) -> dict:
    s = {f.name: SPARK_TO_DUCKDB.get(f.dataType.simpleString(), f.dataType.simpleString())
         for f in spark_schema.fields}
    d = {c: str(t) for c, t in zip(duck_columns, duck_types)}
    return {c: (s.get(c), d.get(c)) for c in set(s) | set(d) if s.get(c) != d.get(c)}
