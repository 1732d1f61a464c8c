"""Comparison of a query's rows with its SQL in DuckDB, without order."""

import glob
import os

import duckdb


def cell(v):
    if v is None or v != v:
        return "null"
    if hasattr(v, "year"):
        return str(v)[:19]
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float)):
        return repr(float(v) + 0.0)
    return str(v)


def rows(names, records):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(cell(r[i]) for i in order) for r in records)


def from_duckdb(sql, sf_dir):
    con = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        con.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    got = con.sql(sql).to_arrow_table().to_pylist()
    return got


def compare(spark, sf_dir, query, sql):
    df = query(spark, sf_dir)
    mine = rows(df.columns, [tuple(r) for r in df.collect()])
    other = from_duckdb(sql, sf_dir)
    names = list(other[0]) if other else df.columns
    assert sorted(names) == sorted(df.columns)
    assert rows(names, [tuple(r.values()) for r in other]) == mine
    return len(mine)
