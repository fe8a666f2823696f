"""Comparison of Spark results with DuckDB's."""

import math
import os

import duckdb
import numpy as np

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def text(value):
    if value is None or (isinstance(value, (float, np.floating)) and math.isnan(value)):
        return "~"
    if isinstance(value, (list, tuple, np.ndarray)):
        return "[" + ",".join(map(text, value)) + "]"
    if isinstance(value, (bool, np.bool_)):
        return str(bool(value))
    if isinstance(value, (float, np.floating)):
        return f"{round(float(value), 6) + 0.0:.6g}" if abs(value) < 1e15 else repr(float(value))
    return str(value)


def rows(columns, tuples):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(text(r[i]) for i in order) for r in tuples)


def spark_rows(df):
    return rows(df.columns, [tuple(r) for r in df.collect()])


def duck(sf_dir=SF):
    con = duckdb.connect()
    for name in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{sf_dir}/{name}'")
    return con


def duck_rows(con, sql):
    found = con.execute(sql)
    return rows([d[0] for d in found.description], found.fetchall())
