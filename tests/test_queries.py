"""A sample of the registered queries against their SQL on the smallest data set; tools/check.py runs all."""

import duckdb
import pytest

import __spark_entry__ as entry
from tools.check import TABLES, canon

from tables import SF

SAMPLE = ["bars", "adx", "macd", "candles_two_bar", "snapshots", "candidate_scan", "sector_flow", "return_distribution", "event_distance", "zone_summary", "cross_validate", "news_sentiment", "position_ledger", "confirmed_pivots", "market_sessions", "chart_patterns", "chart_patterns_5m", "chart_patterns_1w", "pattern_targets"]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, con, name):
    got, want = entry.queries()[name](spark, SF).toPandas(), con.execute(entry.oracle_sql()[name]).df()
    a, b = canon(got), canon(want)
    assert list(a.columns) == list(b.columns) and a.equals(b)


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_runs(spark):
    assert entry.entry(spark).count() >= 0
