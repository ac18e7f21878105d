"""Runs a query and its SQL on the same tables and compares the rows as multisets."""

from __future__ import annotations

import math
from collections import Counter
from pathlib import Path

import duckdb


def database(sf_dir: str) -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    for path in sorted(Path(sf_dir).glob("*.parquet")):
        db.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return db


def _value(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, (bytes, bytearray)):
        return bytes(v)
    return repr(v) if isinstance(v, (list, dict)) else v


def rows(columns: list[str], found) -> Counter:
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return Counter(tuple(_value(r[i]) for i in order) for r in found)


def differences(df, sql: str, db: duckdb.DuckDBPyConnection) -> str:
    """What differs, empty if nothing does."""
    answer = db.execute(sql)
    names = [d[0] for d in answer.description]
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)}, in SQL {sorted(names)}"
    theirs, ours = rows(names, answer.fetchall()), rows(df.columns, df.collect())
    if ours == theirs:
        return ""
    return f"{sum(ours.values())} rows, in SQL {sum(theirs.values())}; only here {list((ours - theirs).items())[:3]}; only in SQL {list((theirs - ours).items())[:3]}"
