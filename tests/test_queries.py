"""Every catalogue query against its SQL in DuckDB, on the driver's smallest tables."""

import duckdb
import pytest

from tickloom.plans import checks, queries  # noqa: F401
from tickloom.sources.tables import NAMES


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for name in NAMES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    return con


def rows(df):
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if df[c].dtype.kind == "M":
            df[c] = df[c].astype("datetime64[us]")
    return sorted(map(str, ([None if v != v else v for v in r] for r in df.astype(object).values.tolist())))


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_agrees_with_sql(spark, sf, duck, name):
    found = queries.QUERIES[name](spark, sf).toPandas()
    if name not in queries.ORACLES:
        assert len(found)
        return
    expected = duck.sql(queries.ORACLES[name]).df()
    assert sorted(found.columns) == sorted(expected.columns)
    assert {c: found[c].dtype.kind for c in found} == {c: expected[c].dtype.kind for c in found}
    assert rows(found) == rows(expected)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["session", "run_start", "run_end", "run_len", "run_value"]


def test_every_oracle_has_a_query():
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
