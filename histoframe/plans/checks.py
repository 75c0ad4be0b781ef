"""Side-by-side comparison of a Spark query with its SQL in DuckDB."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb
from pyspark.sql import DataFrame

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def sql_rows(sf_dir: str, sql: str) -> tuple[list[str], list[tuple]]:
    """Columns and rows of a SQL text over the tables of a folder."""
    db = duckdb.connect()
    for name in TABLES:
        path = Path(f"{sf_dir}/{name}.parquet")
        if path.exists():
            db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}{'/*.parquet' if path.is_dir() else ''}'")
    found = db.execute(sql)
    return [c[0] for c in found.description], found.fetchall()


def _canonical(columns: list[str], rows: list[tuple]) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda k: columns[k])

    def plain(v):
        if isinstance(v, float):
            return "nan" if math.isnan(v) else round(v + 0.0, 9)
        return v

    return sorted((tuple(plain(r[k]) for k in order) for r in rows), key=repr)


def differences(df: DataFrame, sf_dir: str, sql: str) -> str:
    """Empty if both give the same columns and rows."""
    columns, rows = sql_rows(sf_dir, sql)
    if sorted(columns) != sorted(df.columns):
        return f"columns {sorted(df.columns)} against {sorted(columns)}"
    ours, theirs = _canonical(df.columns, [tuple(r) for r in df.collect()]), _canonical(columns, rows)
    if ours == theirs:
        return ""
    mine, others = set(ours), set(theirs)
    return f"{len(ours)} rows against {len(theirs)}; only in one: {[x for x in ours if x not in others][:3]} {[x for x in theirs if x not in mine][:3]}"
