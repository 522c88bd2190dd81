"""Spark results against DuckDB results: same columns, same rows in any order."""

import datetime
import decimal
import math
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        path = f"{folder}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}/*.parquet')" if Path(path).is_dir() else f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}')")
    return con


def plain(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else v
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    return v


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(plain(r[i]) for i in order) for r in values]
    return [columns[i] for i in order], sorted(out, key=lambda r: tuple((x is None, str(type(x)) if isinstance(x, (datetime.date,)) else "", str(x)) for x in r))


def difference(df, con, sql):
    """None if equal, else what differs."""
    result = con.execute(sql)
    c2, r2 = rows([d[0] for d in result.description], result.fetchall())
    c1, r1 = rows(df.columns, [tuple(r) for r in df.collect()])
    if c1 != c2:
        return f"columns {c1} and {c2}"
    if len(r1) != len(r2):
        return f"{len(r1)} and {len(r2)} rows; {[r for r in r1 if r not in r2][:3]} {[r for r in r2 if r not in r1][:3]}"
    for a, b in zip(r1, r2, strict=True):
        if a != b or [type(x) for x in a] != [type(x) for x in b]:
            return f"{dict(zip(c1, a, strict=True))} and {dict(zip(c2, b, strict=True))}"
    return None
