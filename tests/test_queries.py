"""Every registered query against its SQL on the smallest tables."""

import pytest

from check import compare, connect
from fleetgauge.catalog import all_queries

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", list(all_queries()))
def test_query_agrees_with_sql(spark, con, name):
    rows, problem = compare(spark, con, all_queries()[name], FOLDER)
    assert problem is None, problem
    assert rows > 0


def test_session_zone_does_not_matter(spark, con):
    names = ["stage_deltas", "run_span", "least_loaded_device", "counter_rates", "step_counter"]
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        for name in names:
            _, problem = compare(spark, con, all_queries()[name], FOLDER)
            assert problem is None, (name, problem)
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
