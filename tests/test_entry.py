import math
from numbers import Real
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from tidemark import queries as engine

DATA = Path("/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def cell(v):
    if v is None or (isinstance(v, Real) and not isinstance(v, bool) and math.isnan(v)):
        return "null"
    return str(round(float(v), 5)) if isinstance(v, Real) and not isinstance(v, bool) else str(v)


def test_flagship(spark):
    got = entry.entry(spark)
    assert got.columns == ["time_bucket", "metric_name", "value"] and got.count() > 0


def test_oracles_name_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(engine.ORACLE_SQL))
def test_equals_duckdb(spark, duck, name):
    ours = engine.QUERIES[name](spark, str(DATA))
    theirs = duck.execute(engine.ORACLE_SQL[name])
    names = [c[0] for c in theirs.description]
    assert sorted(ours.columns) == sorted(names)
    order = sorted(names)
    a = sorted(tuple(cell(r[c]) for c in order) for r in ours.collect())
    at = [names.index(c) for c in order]
    assert a == sorted(tuple(cell(r[i]) for i in at) for r in theirs.fetchall())
