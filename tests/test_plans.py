"""What plans of the queries must not do again: read a large table more than once, or carry its rows through more shuffles than they need."""

import re

import pytest

from gleiswerk import plans

SF = "/root/testdata/sf0.001"


@pytest.fixture
def planned(spark):
    """The plan of a query where no table is small enough to be broadcast."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield lambda name: plans.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def scans(plan, column):
    return len(re.findall(rf"FileScan parquet \[[^\]]*\b{column}#", plan))


def test_stops_with_and_without_a_reason_are_read_once(planned):
    assert scans(planned("a12_with_and_without"), "l_orderkey") == 1


def test_pairs_of_ways_are_scored_where_they_meet(planned):
    """No pair is shuffled with its states, and ways are made once."""
    plan = planned("j15_similar_services")
    assert not re.findall(r"hashpartitioning\([^)]*states", plan) and not scans(plan, "l_orderkey")


@pytest.mark.parametrize("name", ["w08_chosen_template", "w08_normalised_days"])
def test_rows_of_days_are_made_once(planned, name):
    """No row meets the templates before those alike in name and time are one, nor is the lines' table read again."""
    plan = planned(name)
    assert not scans(plan, "l_orderkey") and not re.findall(r"hashpartitioning\(line#\d+, date#\d+, ord#", plan)


def test_destinations_are_corrected_from_stops_read_once(planned):
    assert not scans(planned("j21_corrected_destination"), "l_orderkey")


def test_rides_of_a_day_dont_look_at_each_other(planned):
    """Queries look at the offers beside them in order of time, not at a list of the day's rides."""
    plan = planned("j10_nearest_ride")
    assert "Window" in plan and "rides#" not in plan
