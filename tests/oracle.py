"""Compare a registered query with its SQL in DuckDB, column types and all rows."""

from __future__ import annotations

import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations").split()


def connect(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _kind(arrow_type):
    text = str(arrow_type)
    if text.startswith("timestamp"):
        return "timestamp"
    return {"large_string": "string", "bool": "bool"}.get(text, text)


def _rows(arrow, names):
    cols = []
    for name in names:
        col = arrow.column(name).to_pylist()
        cols.append([v.replace(tzinfo=None) if hasattr(v, "tzinfo") else v for v in col])
    rows = list(zip(*cols)) if cols else []
    return sorted(rows, key=lambda r: tuple((v is not None, str(v)) for v in r))


def _close(a, b):
    if isinstance(a, float) and isinstance(b, float):
        return a == b or math.isclose(a, b, rel_tol=1e-9, abs_tol=1.01e-6) or (
            math.isnan(a) and math.isnan(b))
    return a == b


def differences(spark_df, con, sql):
    """Human-readable differences; empty when equal.  Exact flag tells bitwise equality."""
    left = spark_df.toArrow()
    right = con.sql(sql).to_arrow_table()
    names = sorted(left.column_names)
    out = []
    if names != sorted(right.column_names):
        return [f"columns {names} vs {sorted(right.column_names)}"]
    for name in names:
        a, b = _kind(left.schema.field(name).type), _kind(right.schema.field(name).type)
        if a != b:
            out.append(f"type of {name}: {a} vs {b}")
    if left.num_rows != right.num_rows:
        return [*out, f"rows {left.num_rows} vs {right.num_rows}"]
    a, b = _rows(left, names), _rows(right, names)
    if a != b:
        bad = [(x, y) for x, y in zip(a, b) if x != y]
        loose = sum(all(_close(p, q) for p, q in zip(x, y)) for x, y in bad)
        out.append(f"{len(bad)} of {len(a)} rows differ ({loose} within rounding), first {bad[0]}")
    return out
