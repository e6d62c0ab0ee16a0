"""Every query against its SQL on the smallest tables; queries without SQL must run."""

import glob
import math
import os

import pytest

import __spark_entry__ as E

SF = os.environ.get("NETLOOM_TEST_SF", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 6) + 0.0)
    return repr(v)


@pytest.mark.parametrize("name", sorted(k for k in E.queries() if not k.startswith("p") or not k[1:2].isdigit() or k in E.oracle_sql()))
def test_query(spark, duck, name):
    df = E.queries()[name](spark, SF)
    cols = sorted(df.columns)
    rows = sorted(tuple(map(norm, r)) for r in df.select(*[f"`{c}`" for c in cols]).collect())
    if name not in E.oracle_sql():
        return
    rel = duck.execute(E.oracle_sql()[name])
    names = [x[0] for x in rel.description]
    assert sorted(names) == cols
    assert sorted(tuple(norm(r[names.index(c)]) for c in cols) for r in rel.fetchall()) == rows


def test_entry(spark):
    assert E.entry(spark).count() >= 0
    assert set(E.oracle_sql()) <= set(E.queries())
