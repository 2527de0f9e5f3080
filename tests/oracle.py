"""Runs a registered query and its SQL side by side."""

from __future__ import annotations

import glob
import math
import os

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            p = f"{p}/*.parquet" if os.path.isdir(p) else p
            con.execute(f"create view {t} as select * from '{p}'")
    return con


def _cell(x):
    if x is None or x is pd.NA or (isinstance(x, float) and math.isnan(x)):
        return None
    return float(x) if isinstance(x, float) else x if isinstance(x, str | bool | bytes) else int(x) if float(x) == int(x) and not isinstance(x, float) else x


def rows_of(frame):
    columns = sorted(frame.columns)
    return columns, sorted((tuple(_cell(v) for v in r) for r in frame[columns].astype(object).itertuples(index=False, name=None)), key=repr)


def differences(spark, con, query, sql, sf_dir):
    got_columns, got = rows_of(query(spark, sf_dir).toPandas())
    want_columns, want = rows_of(con.execute(sql).df())
    if got_columns != want_columns:
        return f"columns {got_columns} {want_columns}"
    if got != want:
        only = [x for x in got if x not in set(want)][:3], [x for x in want if x not in set(got)][:3]
        return f"{len(got)} rows, {len(want)} expected; {only}"
    return None
