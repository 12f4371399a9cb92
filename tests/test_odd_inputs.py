"""Queries against their SQL on tables with rows that the given ones lack."""

import os

import duckdb
import pytest
from test_queries import SF, rows

from gleiswerk import plans


@pytest.fixture
def both(spark, tmp_path):
    """Both results of a query over the smallest tables, some of them replaced by SQL of the table."""

    def run(name, **tables):
        con = duckdb.connect()
        con.sql("SET TimeZone = 'UTC'")
        folder = tmp_path / name
        folder.mkdir()
        for t in (f.split(".")[0] for f in os.listdir(SF)):
            con.sql(f"COPY ({tables.get(t, 'SELECT * FROM {0}').format(f"'{SF}/{t}.parquet'")}) TO '{folder}/{t}.parquet' (FORMAT parquet)")
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
        return rows(plans.QUERIES[name](spark, str(folder)).toPandas()), rows(con.sql(plans.ORACLE_SQL[name]).df())

    return run


def test_departures_of_a_century_s_last_night(both):
    """All rides are of 31 December 1999, which the SQL takes for 2099; some depart after midnight."""
    got, want = both("p01_plan_rows", orders="SELECT * REPLACE (TIMESTAMP '1999-12-31' AS o_orderdate) FROM {0}")
    assert any("2100-01-01" in x for r in want[1] for x in r)
    assert got == want


@pytest.mark.parametrize("empty", ["lang = 'de' AND doc_id % 3 = 0", "lang = 'de'", "lang <> 'de' AND doc_id % 2 = 0"])
def test_remarks_of_nothing_have_no_delay(both, empty):
    """What has no remark has no delay either, so the ratio of both means is infinite."""
    blank = f"SELECT doc_id, CASE WHEN {empty} THEN ' ' ELSE text END AS text, lang, source, CASE WHEN {empty} THEN 0 ELSE n_chars END AS n_chars FROM {{0}}"
    got, want = both("a23_impact_by_type", documents=blank)
    assert got == want


def test_remarks_without_any_delay(both):
    got, want = both("a23_impact_by_type", documents="SELECT * REPLACE (CASE WHEN doc_id % 5 = 0 THEN '' ELSE text END AS text, CASE WHEN lang = 'en' THEN 0 ELSE n_chars END AS n_chars) FROM {0}")
    assert got == want
