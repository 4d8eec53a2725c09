"""Compares a query with its DuckDB SQL on the same tables."""

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "null"
    if isinstance(v, float):
        return repr(round(v, 6))
    if isinstance(v, (list, tuple)):
        return str([plain(x) for x in v])
    return str(v)


def same(df, sql, sf_dir):
    """Asserts equal columns and, in any order, equal rows."""
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{p}{'/*.parquet' if os.path.isdir(p) else ''}'")
    rel = con.sql(sql)
    cols, theirs = df.columns, rel.columns
    assert sorted(cols) == sorted(theirs)
    form = lambda rows, names: sorted(tuple(plain(r[names.index(c)]) for c in sorted(names)) for r in rows)
    assert form([tuple(r) for r in df.collect()], cols) == form(rel.fetchall(), theirs)
