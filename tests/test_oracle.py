"""Every registered query runs; those with SQL give the same rows in another engine."""

import os

import numpy as np
import pytest

import __spark_entry__ as entry
from paneloom import plans

FOLDER = "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables absent")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{FOLDER}/{t}.parquet')")
    return con


def normal(frame):
    """Rows as sorted tuples of text, columns in name order."""

    def text(v):
        if v is None or v != v:
            return "NULL"
        if isinstance(v, (bool, np.bool_)):
            return str(bool(v))
        if isinstance(v, (int, float, np.number)):
            return str(float(v) + 0.0)
        return str(v)

    cols = sorted(frame.columns)
    return cols, sorted(tuple(text(v) for v in row) for row in frame[cols].astype(object).itertuples(index=False))


@pytest.mark.parametrize("key", sorted(plans.oracle_sql()))
def test_matches_sql(spark, duck, key):
    mine = entry.queries()[key](spark, FOLDER).toPandas()
    theirs = duck.execute(entry.oracle_sql()[key]).df()
    assert normal(mine) == normal(theirs)


@pytest.mark.parametrize("key", sorted(set(plans.queries()) - set(plans.oracle_sql())))
def test_runs_without_sql(spark, key):
    assert entry.queries()[key](spark, FOLDER).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
