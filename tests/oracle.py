"""Holds a query's rows against its SQL in DuckDB."""

import datetime
import decimal
import glob
import math
import os

import duckdb
import numpy as np

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def connection():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}/*.parquet'" if os.path.isdir(path) else f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def plain(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return "null"
    if isinstance(x, (bool, np.bool_)):
        return str(bool(x))
    if isinstance(x, (float, decimal.Decimal)):
        return repr(round(float(x), 6))
    if isinstance(x, (list, tuple, np.ndarray)):
        return str([plain(y) for y in x])
    if isinstance(x, (datetime.date, datetime.datetime)):
        return str(x)
    return str(x)


def same(spark, con, query, sql):
    df = query(spark, SF)
    names = sorted(df.columns)
    got = sorted(tuple(plain(x) for x in r) for r in df.select(*names).collect())
    found = con.execute(sql)
    columns = [c[0] for c in found.description]
    assert sorted(columns) == names
    order = [columns.index(n) for n in names]
    want = sorted(tuple(plain(r[i]) for i in order) for r in found.fetchall())
    assert len(got) == len(want)
    assert [g for g, w in zip(got, want) if g != w][:3] == [w for g, w in zip(got, want) if g != w][:3]
