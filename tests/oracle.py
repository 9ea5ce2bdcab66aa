"""Compare a DataFrame with a DuckDB query over the same tables."""

import os

import duckdb


def _norm(v):
    if isinstance(v, float):
        return float(f"{v:.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(map(_norm, v))
    return v


def compare(df, sql, sf_dir):
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{sf_dir}/{f}')")
    want = con.sql(sql)
    cols = sorted(df.columns)
    assert sorted(want.columns) == cols
    at = [want.columns.index(c) for c in cols]
    expected = sorted((tuple(_norm(r[i]) for i in at) for r in want.fetchall()), key=repr)
    got = sorted((tuple(_norm(r[c]) for c in cols) for r in df.toArrow().to_pylist()), key=repr)
    assert len(got) == len(expected)
    assert got == expected
