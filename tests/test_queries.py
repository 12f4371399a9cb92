"""Every registered query of the reference's operators against DuckDB on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from gleiswerk import plans

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for f in os.listdir(SF):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return con


def value(x):
    if x is None or x is pd.NA or x is pd.NaT or x != x:
        return "null"
    if isinstance(x, bool) or type(x).__name__ in ("bool", "bool_"):
        return str(bool(x))
    if hasattr(x, "dtype") and x.dtype.kind in "iuf" or isinstance(x, (int, float)):
        return repr(round(float(x), 6) + 0.0)
    return str(x)


def rows(df):
    names = sorted(df.columns)
    return names, sorted(tuple(value(v) for v in r) for r in df[names].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(plans.ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    got, want = rows(plans.QUERIES[name](spark, SF).toPandas()), rows(duck.sql(plans.ORACLE_SQL[name]).df())
    assert got[0] == want[0]
    assert len(got[1]) == len(want[1])
    assert got[1] == want[1]


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.ORACLE_SQL)))
def test_query_without_sql_has_whole_rows(spark, name):
    """Forecasts, by models: each type's rows are there, with finite numbers."""
    got = plans.QUERIES[name](spark, "/root/testdata/sf0.01").toPandas()
    assert len(got) and not got.duplicated().any()
    assert all(got[c].notna().all() for c in got.columns)


def test_forecast_beats_nothing_less_than_the_mean(spark):
    """Gradient-boosted trees are fitted where there are rows enough, and stay near the mean's error on noise."""
    got = plans.QUERIES["f02_hold_out_error"](spark, "/root/testdata/sf0.01").toPandas()
    assert len(got) == 10 and (got["n_fit"] >= 30).all() and (got["mae"] < 2 * got["mae_of_mean"] + 1).all()


def test_entry():
    import __spark_entry__ as entry

    known = entry.queries()
    assert "a03_day_type_stats" in known and set(entry.oracle_sql()) <= set(known)
