"""Compares a Spark result with DuckDB's on the same Parquet tables, order aside."""

import os

import duckdb

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _same(v):
    return round(v, 6) + 0.0 if isinstance(v, float) else v


def rows(df):
    names = sorted(df.columns)
    return sorted((tuple(_same(r[n]) for n in names) for r in df.collect()), key=str)


def duck_rows(sql, tables=None):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{(tables or {}).get(t, f'{DATA}/{t}.parquet')}'")
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    order = [names.index(n) for n in sorted(names)]
    return sorted(names), sorted((tuple(_same(r[i]) for i in order) for r in cur.fetchall()), key=str)
