"""Runs a registered query and its SQL on the same tables and compares all rows."""

import os

import duckdb
import numpy as np
import pandas as pd

SF = "/root/testdata/sf0.001"


def connect(sf_dir):
    con = duckdb.connect()
    for name in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{sf_dir}/{name}'")
    return con


def shown(v):
    if isinstance(v, (list, tuple, np.ndarray)):
        return "[" + ",".join(map(shown, v)) + "]"
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, (float, np.floating)) and v != v):
        return "null"
    if isinstance(v, (bool, np.bool_)):
        return str(bool(v))
    if isinstance(v, (int, np.integer)) or (isinstance(v, (float, np.floating)) and float(v).is_integer()):
        return str(int(v))
    return repr(float(v)) if isinstance(v, (float, np.floating)) else str(v)


def rows_of(frame):
    names = sorted(frame.columns)
    return names, sorted("|".join(map(shown, r)) for r in frame[names].itertuples(index=False))


def check(spark, query, sql, sf_dir=SF):
    ours, theirs = rows_of(query(spark, sf_dir).toPandas()), rows_of(connect(sf_dir).execute(sql).df())
    assert ours[0] == theirs[0]
    assert ours[1] == theirs[1]
