"""Every query with an oracle equals its DuckDB SQL on the smallest tables."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "scripts"))

import __spark_entry__ as E  # noqa: E402
from oracle_check import TABLES, frame_rows  # noqa: E402

NAMES = sorted(E.oracle_sql())


@pytest.fixture(scope="module")
def duck(sf_small):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_small}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, sf_small, duck, name):
    got = E.queries()[name](spark, sf_small).toPandas()
    want = duck.execute(E.oracle_sql()[name]).df()
    gc, gr = frame_rows(got)
    wc, wr = frame_rows(want)
    assert gc == wc
    assert len(gr) == len(wr)
    assert gr == wr
