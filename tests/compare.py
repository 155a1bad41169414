"""Compares a query's rows with DuckDB's, without regard to order."""

import math
import os
from decimal import Decimal

import duckdb
import numpy as np
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder, **frames):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{folder}/{t}.parquet"
        if os.path.exists(path):
            con.execute(f"create view {t} as select * from '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


def plain(x):
    if x is None or x is pd.NaT or x is pd.NA or (isinstance(x, float) and math.isnan(x)):
        return "null"
    if isinstance(x, (bool, np.bool_)):
        return str(bool(x))
    if isinstance(x, (int, float, np.integer, np.floating, Decimal)):
        return repr(round(float(x), 5) + 0.0)
    if isinstance(x, (list, tuple, np.ndarray)):
        return "[" + ",".join(map(plain, x)) + "]"
    return str(x)


def rows(frame):
    names = sorted(frame.columns)
    return names, sorted(tuple(plain(v) for v in r) for r in frame[names].itertuples(index=False, name=None))


def check(df, sql, folder):
    names, got = rows(df.toPandas())
    wanted_names, wanted = rows(connect(folder).sql(sql).df())
    assert names == wanted_names
    assert len(got) == len(wanted)
    assert got == wanted
