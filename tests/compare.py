"""Spark rows against DuckDB rows."""

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def text(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "null"
    if isinstance(v, float):
        return repr(round(v, 9) + 0.0)
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(text, v)) + "]"
    return str(v)


def duck(sf_dir, sql):
    con = duckdb.connect()
    con.execute("set TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    r = con.execute(sql)
    return [d[0] for d in r.description], r.fetchall()


def same_rows(df, sf_dir, sql):
    names, rows = duck(sf_dir, sql)
    cols = sorted(df.columns)
    assert sorted(names) == cols
    ours = sorted([text(r[c]) for c in cols] for r in df.collect())
    at = [names.index(c) for c in cols]
    theirs = sorted([text(r[k]) for k in at] for r in rows)
    assert len(ours) == len(theirs)
    assert ours == theirs
