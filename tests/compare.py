"""Row comparison of a Spark result with the result of its SQL statement in DuckDB."""

from __future__ import annotations

import math

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.9g}"
    return str(value)


def differences(con, sql: str, df) -> list[str]:
    """Empty when names, types by kind, row count and values agree."""
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    want = cur.fetchall()
    if sorted(names) != sorted(df.columns):
        return [f"columns {sorted(df.columns)} instead of {sorted(names)}"]
    order = sorted(names)
    left = sorted(tuple(_plain(r[c]) for c in order) for r in df.collect())
    at = [names.index(c) for c in order]
    right = sorted(tuple(_plain(r[i]) for i in at) for r in want)
    out = [] if len(left) == len(right) else [f"{len(left)} rows instead of {len(right)}"]
    if left != right:
        mine, theirs = set(left) - set(right), set(right) - set(left)
        out += [f"unexpected {r}" for r in sorted(mine)[:3]] + [f"missing {r}" for r in sorted(theirs)[:3]]
        out = out or ["row multiplicities differ"]
    return out
