"""Comparison of Spark's rows with DuckDB's, without regard to order."""

import decimal

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def value(v):
    if isinstance(v, (float, int, decimal.Decimal)) and not isinstance(v, bool):
        return round(float(v), 8) + 0.0
    return v if v is None else str(v)


def ordered(rows):
    return sorted(rows, key=lambda r: [(x is not None, str(type(x)), x if x is not None else 0) for x in r])


def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def assert_same(df, con, sql):
    columns = sorted(df.columns)
    rel = con.sql(sql)
    assert sorted(rel.columns) == columns
    at = [rel.columns.index(c) for c in columns]
    want = ordered([tuple(value(r[i]) for i in at) for r in rel.fetchall()])
    got = ordered([tuple(value(r[c]) for c in columns) for r in df.collect()])
    assert len(got) == len(want)
    assert got == want
