"""Rows of a Spark frame against rows of DuckDB, as multisets, floats to nine digits."""

from __future__ import annotations

import decimal
import math
from collections import Counter
from pathlib import Path


def plain(v):
    if isinstance(v, bool) or v is None:
        return str(v)
    if isinstance(v, (float, decimal.Decimal)):
        return "nan" if math.isnan(v) else f"{float(v):.9g}"
    if isinstance(v, int):
        return f"{v:d}"
    if isinstance(v, (list, tuple)):
        return str([plain(x) for x in v])
    return str(v)


def duck(sf_dir: str, sql: str) -> tuple[list[str], Counter]:
    import duckdb

    con = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    order = [names.index(n) for n in sorted(names)]
    return sorted(names), Counter(tuple(plain(r[i]) for i in order) for r in found.fetchall())


def rows(df) -> tuple[list[str], Counter]:
    names = sorted(df.columns)
    return names, Counter(tuple(plain(r[n]) for n in names) for r in df.collect())
