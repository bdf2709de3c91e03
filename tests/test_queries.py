"""Each query against its SQL on the smallest fixture, as the driver compares them."""

import os

import pytest

import __spark_entry__ as entry
from frameloom import plans

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no fixture tables")


@pytest.fixture(scope="module")
def views():
    import duckdb

    db = duckdb.connect()
    for f in os.listdir(SF):
        if f.endswith(".parquet"):
            db.sql(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{SF}/{f}'")
    return db


def normal(rows, columns):
    at = sorted(range(len(columns)), key=lambda k: columns[k])
    fix = lambda x: round(float(x), 5) + 0.0 if type(x).__name__ in ("float", "Decimal") else x
    return sorted((tuple(fix(r[k]) for k in at) for r in rows), key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.mark.parametrize("name", sorted(plans.SQL))
def test_same_rows(spark, views, name):
    df = plans.QUERIES[name](spark, SF)
    want = views.sql(plans.SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    got, expected = normal(df.collect(), df.columns), normal(want.fetchall(), want.columns)
    assert len(got) == len(expected)
    for a, b in zip(got, expected, strict=True):
        assert a == pytest.approx(b, abs=2e-5) if all(isinstance(x, (int, float)) for x in a + b) else [str(x) for x in a] == [str(x) for x in b]


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.SQL)))
def test_rows_only(spark, name):
    assert plans.QUERIES[name](spark, SF).count() > 0


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
