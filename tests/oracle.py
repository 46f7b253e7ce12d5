"""Compares registered queries with their SQL, as rows without order."""

import math
from pathlib import Path

import duckdb


def views(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in Path(sf_dir).glob("*.parquet"):
        glob = f"{path}/*.parquet" if path.is_dir() else str(path)
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{glob}'")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else float(f"{value:.9g}")
    return value


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in found), key=lambda r: [(x is not None, str(x)) for x in r])


def same(spark, sf_dir, query, sql):
    df = query(spark, sf_dir)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    cur = views(sf_dir).execute(sql)
    want = rows([c[0] for c in cur.description], cur.fetchall())
    assert got[0] == want[0]
    assert len(got[1]) == len(want[1])
    wrong = [(a, b) for a, b in zip(got[1], want[1]) if a != b]
    assert not wrong, wrong[:3]
