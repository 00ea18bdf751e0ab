"""The strategy study writes only the steps that a query reads."""

from barline.operators import backtest as B
from barline.plans import backtests as P, decisionplans
from barline.sources.market import Market
from tables import SF


def test_outcomes_are_read_without_trades_or_scores(spark, monkeypatch):
    names = []
    monkeypatch.setattr(P, "stored", lambda df, name, *a: names.append(name) or df)
    P.study(Market(spark, SF)).outcomes
    assert [n for n in names if n.startswith(("trades", "scored"))] == []


def test_setups_targets_and_risk_write_no_panel(spark):
    m = Market(spark, SF)
    P.setups(m), decisionplans.targets(m), P._risk(m)
    assert "panel" not in m.__dict__


def test_diagnostics_read_their_trades_once(spark):
    rows = [("US", "s", 1.0 * i, 0.1 * i, "target", 0.0, i - 5.0, 9.0 * i, "BULL" if i % 2 else "BEAR") for i in range(12)]
    t = spark.createDataFrame(rows, "market string, symbol string, return_pct double, r_multiple double, exit_reason string, open_gap_pct double, event_distance double, turnover double, regime string")
    d = B.diagnostics(t)
    assert {(r.attribute, r.value): r.trades for r in d.collect()}["liquidity", "low"] == 5
    assert d._jdf.queryExecution().optimizedPlan().collectLeaves().size() <= 8  # 25 when the terciles were worked out for every use
