"""Rates of frames that took no time, or an unknown one, as in SQL."""

import duckdb
import pytest

import __spark_entry__ as entry
import check_oracle

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def events(tmp_path_factory):
    """Frames without time, of unknown time, and of times below zero."""
    folder = tmp_path_factory.mktemp("rates")
    value = "CASE WHEN user_id % 5 = 0 THEN 0.0 WHEN user_id % 5 = 1 THEN NULL WHEN user_id % 5 = 2 AND event_id % 3 = 0 THEN 0.0 WHEN user_id % 5 = 3 THEN -value ELSE value END"
    duckdb.sql(f"COPY (SELECT * REPLACE ({value} AS value) FROM '{SF}/events.parquet') TO '{folder}/events.parquet'")
    return str(folder)


@pytest.mark.parametrize("name", ["running_fps", "stream_fps", "stream_fps_sliding", "stream_fps_closed"])
def test_rates_as_in_sql(spark, events, name):
    assert check_oracle.compare(entry.queries()[name](spark, events), check_oracle.duck(events), entry.oracle_sql()[name]) is None
