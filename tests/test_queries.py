"""Every registered query that SQL can express, against DuckDB on the smallest tables."""

import datetime
import math
import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from tabulon.plans import queries


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.execute(f"create view {f.partition('.')[0]} as select * from '{sf_dir}/{f}'")
    return con


def plain(v):
    if v is None or v is pd.NaT or v is pd.NA:
        return None
    if isinstance(v, (float, np.floating)):
        return None if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, (bool, np.bool_)):
        return bool(v)
    if isinstance(v, np.integer):
        return int(v)
    return str(pd.Timestamp(v)) if isinstance(v, (pd.Timestamp, datetime.date)) else v


def rows(df):
    return sorted((tuple(plain(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False, name=None)), key=repr)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query(spark, sf_dir, duck, name):
    got, want = queries.QUERIES[name](spark, sf_dir).toPandas(), duck.execute(queries.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)



def test_other_queries_have_tests_of_their_own():
    """Those that SQL can't express are held against plain versions in test_whole.py."""
    from pathlib import Path

    text = Path(__file__).with_name("test_whole.py").read_text()
    assert all(f'"{name}"' in text for name in set(queries.QUERIES) - set(queries.ORACLES))
