"""A Spark query against its SQL in DuckDB on the same tables."""

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _cell(v):
    if v is None or (not isinstance(v, (list, tuple)) and not hasattr(v, "tolist") and pd.isna(v)):
        return "NULL"
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return str([_cell(x) for x in v])
    return repr(round(v, 6) + 0.0) if isinstance(v, float) else str(v)


def assert_same(df, sql, folder):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    found = con.execute(sql)
    names = [c[0] for c in found.description]
    assert sorted(names) == sorted(df.columns)
    order = sorted(names)
    want = sorted(tuple(_cell(dict(zip(names, r))[c]) for c in order) for r in found.fetchall())
    got = sorted(tuple(_cell(r[c]) for c in order) for r in df.collect())
    assert got == want
