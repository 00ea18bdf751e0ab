"""Non-overlapping trades, barrier exits and pattern de-duplication against plain loops."""

from pyspark.sql import functions as F

from barline.operators import backtest as B, patterns as P
from barline.plans.backtests import setups


def test_trades_of_a_setting_do_not_overlap_and_are_maximal(spark, market):
    o = B.outcomes(setups(market), B.fold_table(spark, B.TRAIN_BARS, B.TEST_BARS), market.universe.select("symbol", "market"))
    grid = B.strategy_grid(spark)
    assert grid.count() == 864
    prints = {B.fingerprint(g).first().fingerprint for g in (grid, grid.repartition(3), B.strategy_grid(spark))}
    assert len(prints) == 1 and len(prints.pop()) == 64
    members = market.universe.select("sector", "symbol", "market")
    changed = members.withColumn("market", F.when(F.col("symbol") == members.agg(F.max("symbol")).first()[0], "other").otherwise(F.col("market")))
    whole = [B.fingerprint(d).first().fingerprint for d in (members, members.repartition(5), changed, members.unionByName(members.limit(1)))]
    assert whole[0] == whole[1] and len(set(whole)) == 3
    kept = B.apply_settings(o, grid).select("symbol", "cfg", "split", "confirmed", "exit_idx").toPandas()
    allc = o.toPandas()
    g = {r.cfg: r for r in grid.collect()}
    got = {k: list(map(tuple, v[["confirmed", "exit_idx"]].sort_values("confirmed").to_numpy())) for k, v in kept.groupby(["symbol", "cfg", "split"])}
    want = {}
    for cfg in list(g)[::37]:
        c = g[cfg]
        for (sym, split), rows in allc[allc.delay == c.delay].groupby(["symbol", "split"]):
            free, out = -1, []
            for r in rows.sort_values("confirmed").itertuples():
                dist, above = (r.dist21, r.above21) if c.line == 21 else (r.dist50, r.above50)
                if dist <= c.tolerance * r.pivot_atr and above and (c.pullback_max is None or r.pullback_ratio <= c.pullback_max) and (c.rebound_min is None or r.rebound_ratio >= c.rebound_min) and (c.slope_min is None or r.slope >= c.slope_min) and r.confirmed > free:
                    out.append((r.confirmed, r.exit_idx))
                    free = r.exit_idx
            if out:
                want[(sym, cfg, split)] = out
    assert {k: v for k, v in got.items() if k[1] in set(list(g)[::37])} == want


def test_exits_stay_in_their_split(market, spark):
    o = B.outcomes(setups(market), B.fold_table(spark, B.TRAIN_BARS, B.TEST_BARS), market.universe.select("symbol", "market"))
    assert o.filter("split = 'train' and exit_idx >= cut").count() == 0
    assert o.filter("exit_idx < entry_idx").count() == 0


def test_cost_stress_is_monotone(spark, market):
    o = B.outcomes(setups(market), B.fold_table(spark, B.TRAIN_BARS, B.TEST_BARS), market.universe.select("symbol", "market"))
    r = B.cost_stress(o).orderBy("market", "extra").toPandas()
    for _m, g in r.groupby("market"):
        assert g.avg_return_pct.is_monotonic_decreasing and g.win_rate_pct.is_monotonic_decreasing


def test_patterns_kept_once(market):
    o = P.Options()
    raw = P.chart_patterns(market.bars, o, dedupe=False).toPandas()
    got = P.chart_patterns(market.bars, o).toPandas()
    n = 0
    for key, g in raw.groupby(["symbol", "family", "direction"]):
        order = sorted(g.itertuples(), key=lambda r: (-r.n_points, -r.status_rank, -r.score, r.ord))
        kept = []
        for c in order:
            ci = {p["idx"] for p in c.points}
            for e in kept:
                ei = {p["idx"] for p in e.points}
                share = max(0, min(c.end_idx, e.end_idx) - max(c.start_idx, e.start_idx) + 1) / (max(c.end_idx, e.end_idx) - min(c.start_idx, e.start_idx) + 1)
                near = abs(c.end_idx - e.end_idx) <= o.dedupe_window
                neck = c.neckline == c.neckline and e.neckline == e.neckline and abs(c.neckline - e.neckline) / abs(e.neckline) <= 0.015
                if ci < ei or share >= 0.75 or (near and (share >= 0.60 or neck)):
                    break
            else:
                kept.append(c)
        here = got[(got.symbol == key[0]) & (got.family == key[1]) & (got.direction == key[2])]
        assert sorted(here.ord) == sorted(k.ord for k in kept)
        n += len(kept)
    assert n == len(got) and n < len(raw)


def test_pivots_alternate(market):
    d = P.confirmed_pivots(market.bars).orderBy("symbol", "idx").toPandas()
    for _s, g in d.groupby("symbol"):
        assert (g.side.diff().dropna() != 0).all() and (g.idx.diff().dropna() >= 3).all()
    recent = P.recent_pivots(P.pattern_bars(market.bars, P.Options()), P.Options()).select("symbol", F.transform("pv", lambda x: x["idx"]).alias("i")).collect()
    for r in recent:
        assert list(d[d.symbol == r.symbol].idx)[-14:] == r.i
