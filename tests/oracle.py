"""Compare a query's rows with its SQL's over the same tables, as multisets and by column name."""

from __future__ import annotations

import math
from collections import Counter
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf_dir: str):
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        path = Path(sf_dir) / f"{t}.parquet"
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}/*.parquet')" if path.is_dir() else f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}')")
    return con


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else float(f"{x:.9g}")
    if isinstance(x, dict):
        return tuple(sorted((k, plain(v)) for k, v in x.items()))
    if hasattr(x, "asDict"):
        return plain(x.asDict())
    if isinstance(x, (list, tuple)):
        return tuple(map(plain, x))
    if hasattr(x, "tzinfo") and x.tzinfo is not None:
        return x.replace(tzinfo=None)
    return x


def rows(names, values):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], Counter(tuple(plain(v[i]) for i in order) for v in values)


def differences(df, con, sql: str) -> list[str]:
    out = con.sql(sql)
    want_names, want = rows(out.columns, out.fetchall())
    have_names, have = rows(df.columns, [tuple(r) for r in df.collect()])
    if want_names != have_names:
        return [f"columns {have_names}, not {want_names}"]
    more, less = have - want, want - have
    return [f"only here: {r}" for r in list(more)[:5]] + [f"only in SQL: {r}" for r in list(less)[:5]]
