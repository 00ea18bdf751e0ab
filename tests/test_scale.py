"""What a plan costs as the input grows: sorts, frames, buckets."""

import pytest

from barline import session
from barline.operators import backtest as B, indicators as ind
from barline.plans import load
from barline.plans.decisionplans import with_composite
from barline.series import own_rows, segmented
from barline.sources.market import Market
from tables import SF
from tests_common import bars_of, path


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_panel_sorts_its_bars_once(spark):
    assert plan_of(B.panel(bars_of(spark, path(300)))).count("Sort [") == 1


@pytest.mark.parametrize("frame", ["-199", "-119", "-59"])
def test_no_frame_of_the_panel_is_longer_than_thirty_bars(spark, frame):
    assert f"specifiedwindowframe(RowFrame, {frame}," not in plan_of(B.panel(bars_of(spark, path(300))))


def test_buckets_grow_with_the_source(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(session, "BUCKET_ROWS", 100)
    session.sized(spark, str(tmp_path), 4000)
    session.stored(spark.range(10).withColumnRenamed("id", "symbol"), "grown", str(tmp_path), ["symbol"], ["symbol"])
    table = [t.name for t in spark.catalog.listTables() if t.name.startswith("barline_grown_")][0]
    assert "40" in [r.data_type for r in spark.sql(f"describe formatted {table}").collect() if r.col_name == "Num Buckets"]


def test_ends_of_the_panel_take_no_more_than_a_query_reads(spark, market, monkeypatch):
    monkeypatch.delitem(market.__dict__, "panel", raising=False)
    plan = plan_of(with_composite(market.panel_ends()).select("symbol", "composite"))
    assert "panel" not in market.__dict__ and "collect_list" not in plan and "stddev" not in plan


class Unwritten(Market):
    """A market whose panel and snapshots must not be written."""

    @property
    def panel(self):
        raise AssertionError("the whole panel")

    @property
    def snapshots(self):
        raise AssertionError("the whole snapshots")


@pytest.mark.parametrize("name", ["zone_first_hit", "fear_signal", "sector_relative", "market_immunity", "risk_gate_summary", "prediction_events", "opening_surge", "document_rows", "output_documents", "pattern_targets"])
def test_bars_are_enough(spark, name):
    plan = plan_of(load()[0][name](Unwritten(spark, SF)))
    assert "smma" not in plan and "hurst" not in plan


@pytest.mark.parametrize("size", [4096, 300])
def test_year_range_by_brute_force(spark, size):
    o, h, lo, c, v = path(700)
    d = own_rows(ind.with_year_range(segmented(bars_of(spark, (o, h, lo, c, v), path(10)), 252, size=size)))
    assert "specifiedwindowframe(RowFrame, -251," not in plan_of(d)
    rows = {r.bar_idx: r for r in d.filter("symbol = 0").collect()}
    assert len(rows) == 700 and d.count() == 710
    for i, r in rows.items():
        hi, low, c20 = max(h[max(0, i - 251):i + 1]), min(lo[max(0, i - 251):i + 1]), c[max(0, i - 19)]
        assert (r.high_52w, r.low_52w) == (hi, low)
        assert r.pos_52w_pct == pytest.approx((c[i] - low) / (hi - low) * 100) and r.from_high_pct == pytest.approx((c[i] - hi) / hi * 100)
        assert r.change_20d_pct == (pytest.approx((c[i] - c20) / c20 * 100) if i else None)
