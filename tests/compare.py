"""Runs a query and its SQL over the same tables and compares the rows, whatever their order."""

import decimal
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def value(v):
    if isinstance(v, float | decimal.Decimal):
        return repr(round(float(v), 9))
    if isinstance(v, list | tuple):
        return str([value(x) for x in v])
    return str(v)


def rows_of_sql(sql, sf_dir):
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for t in TABLES:
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    order = sorted(range(len(names)), key=names.__getitem__)
    return [names[i] for i in order], sorted(tuple(value(r[i]) for i in order) for r in found.fetchall())


def rows_of_frame(df):
    names = sorted(df.columns)
    return names, sorted(tuple(value(r[c]) for c in names) for r in df.collect())
