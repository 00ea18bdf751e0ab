"""Snapshots, regimes, scores and the candidate scan."""

from pyspark.sql import functions as F

from barline.functions import scores as S
from barline.functions.numeric import report
from barline.operators import indicators as ind, scan
from barline.plans.indicators import _BIS, _CHASE, over
from barline.plans.registry import cte, he, q, query
from barline.plans.series import cte as _  # noqa: F401  (defines the Hurst expressions)

cte("chase", "bars", _CHASE)
cte("ends", "tr rec adx chase", f"""
SELECT symbol, bar_date, n, open, high, low, close, volume, {he('atrw', 6)} AS atr6, {he('old', 6)} AS old_atr, {he('adx', 2)} AS adx,
  CASE WHEN adx IS NOT NULL THEN {he('dip', 2)} END AS plus_di, CASE WHEN adx IS NOT NULL THEN {he('dim', 2)} END AS minus_di,
  coalesce({he('ema20', 4)}, close) AS ema20, CASE WHEN idx >= 199 THEN m200 ELSE 0.0 END AS ma200,
  {he('CASE WHEN idx >= 20 AND vp > 0 THEN volume / vp ELSE 1.0 END', 3)} AS vol_ratio, h20 AS high_20d,
  CASE WHEN idx >= 19 THEN CASE WHEN path = 0 THEN 0.0 ELSE least(abs(close - c19) / path * 100, 100.0) END ELSE 0.0 END AS efficiency,
  chasing_20, chasing_55, {_BIS} AS bis
FROM (SELECT *, CASE WHEN idx >= 34 THEN avg(tr) OVER (PARTITION BY symbol ORDER BY idx ROWS BETWEEN 33 PRECEDING AND 20 PRECEDING) END AS old,
        avg(close) {over(200)} AS m200, avg(volume) OVER (PARTITION BY symbol ORDER BY idx ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS vp,
        max(high) {over(20)} AS h20, sum(abs(close - pc)) {over(19)} AS path, lag(close, 19) OVER (PARTITION BY symbol ORDER BY idx) AS c19,
        CASE WHEN idx >= 10 THEN avg(volume) OVER (PARTITION BY symbol ORDER BY idx ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) ELSE 0 END AS v10 FROM tr) t
  JOIN rec USING (symbol, idx) JOIN adx USING (symbol, idx) JOIN chase USING (symbol, idx) WHERE idx = n - 1""")
cte("ends2", "ends", """SELECT *, atr6 / close * 100 AS atr_pct_raw, coalesce(old_atr > 0 AND atr6 >= old_atr * 1.3, FALSE) AS atr_spiking,
  coalesce(old_atr > 0 AND atr6 <= old_atr * 0.5, FALSE) AS atr_collapsing FROM ends""")
cte("rs", "bars bench", """SELECT symbol, ((c1 / c64 - 1) - (b1 / b64 - 1)) * 100 AS rs63, ((c1 / c0 - 1) - (b1 / b0 - 1)) * 100 AS rsall
  FROM (SELECT symbol, max(CASE WHEN idx = n - 1 THEN close END) AS c1, max(CASE WHEN idx = greatest(n - 64, 0) THEN close END) AS c64, max(CASE WHEN idx = 0 THEN close END) AS c0 FROM bars GROUP BY symbol),
  (SELECT max(CASE WHEN idx = n - 1 THEN close END) AS b1, max(CASE WHEN idx = n - 64 THEN close END) AS b64, max(CASE WHEN idx = 0 THEN close END) AS b0 FROM bench)""")
cte("snap", "ends2 rs hurst2", f"""
SELECT symbol, CAST(e.bar_date AS VARCHAR) AS as_of, close AS current_price, low, ma200, coalesce(adx, 0.0) AS adx, coalesce(plus_di, 0.0) AS plus_di, coalesce(minus_di, 0.0) AS minus_di,
  coalesce({he('atr6', 4)}, 0.0) AS atr, coalesce({he('atr_pct_raw', 2)}, 0.0) AS atr_pct, vol_ratio, {he('high_20d', 4)} AS high_20d, efficiency,
  {he('rsall', 2)} AS rs, ema20, hurst, CAST(bis AS DOUBLE) AS bis, chasing_20, chasing_55, coalesce(old_atr, 0.0) AS median_atr, atr_spiking, atr_collapsing
FROM ends2 e JOIN rs USING (symbol) LEFT JOIN hurst2 USING (symbol) WHERE n >= 20""")

_SNAP = ["current_price", "low", "ma200", "adx", "plus_di", "minus_di", "atr", "atr_pct", "vol_ratio", "high_20d", "efficiency", "rs", "ema20", "hurst", "bis", "median_atr"]


@query("snapshots", "snap", "SELECT symbol, as_of, " + ", ".join(f"{q(c)} AS {c}" for c in _SNAP) + ", chasing_20, chasing_55, atr_spiking, atr_collapsing FROM snap")
def _snap(m):
    s = scan.snapshots(m.bars, m.benchmark)
    return s.select("symbol", F.col("bar_date").cast("string").alias("as_of"), *[report(c).alias(c) for c in _SNAP],
                    "chasing_20", "chasing_55", "atr_spiking", "atr_collapsing")


# The benchmark as a one-symbol bar table, through the same recursions.
cte("bseries", "bench", """SELECT idx, n, close, abs(close - lag(close) OVER (ORDER BY idx)) AS tr, greatest(close - lag(close) OVER (ORDER BY idx), 0) AS dmp,
  greatest(lag(close) OVER (ORDER BY idx) - close, 0) AS dmm FROM bench""")
cte("bseed", "bseries", """SELECT *, avg(tr) OVER w AS atr0, sum(tr) OVER w AS trs0, sum(dmp) OVER w AS dps0, sum(dmm) OVER w AS dms0 FROM bseries
  WINDOW w AS (ORDER BY idx ROWS BETWEEN 13 PRECEDING AND CURRENT ROW)""")
cte("brec", "bseed", """SELECT idx, atr0 AS atr, trs0 AS trs, dps0 AS dps, dms0 AS dms FROM bseed WHERE idx = 14
  UNION ALL SELECT b.idx, (r.atr * 13 + b.tr) / 14, r.trs - r.trs / 14 + b.tr, r.dps - r.dps / 14 + b.dmp, r.dms - r.dms / 14 + b.dmm FROM brec r JOIN bseed b ON b.idx = r.idx + 1""")
cte("bend", "brec bench", f"""SELECT close, m200, {he('adx', 2)} AS adx, {he('dip', 2)} AS plus_di, {he('dim', 2)} AS minus_di, {he('atr', 6)} / close * 100 AS atr_pct FROM (
  SELECT b.idx, b.n, b.close, avg(close) OVER (ORDER BY b.idx ROWS BETWEEN 199 PRECEDING AND CURRENT ROW) AS m200, r.atr, 100 * dps / trs AS dip, 100 * dms / trs AS dim,
  avg(CASE WHEN dps + dms > 0 THEN 100 * abs(dps - dms) / (dps + dms) ELSE 0 END) OVER (ORDER BY b.idx ROWS BETWEEN 13 PRECEDING AND CURRENT ROW) AS adx
  FROM bench b LEFT JOIN brec r ON b.idx = r.idx) WHERE idx = n - 1""")


def regime_sql(price: str, ma: str, extra_bull: str = "0", extra_bear: str = "0") -> str:
    bull = f"(CASE WHEN {price} > {ma} THEN 3 ELSE 0 END + CASE WHEN adx >= 25 AND plus_di > minus_di THEN 1 ELSE 0 END + CASE WHEN plus_di > minus_di THEN 2 ELSE 0 END + {extra_bull})"
    bear = f"(CASE WHEN {price} > {ma} THEN 0 ELSE 3 END + CASE WHEN adx >= 25 AND NOT plus_di > minus_di THEN 1 ELSE 0 END + CASE WHEN NOT plus_di > minus_di THEN 2 ELSE 0 END + {extra_bear})"
    return f"""{bull} AS bull_pts, {bear} AS bear_pts, {price} BETWEEN {ma} * 0.98 AND {ma} * 1.02 AS chop_band,
      CASE WHEN {price} BETWEEN {ma} * 0.98 AND {ma} * 1.02 THEN 'SIDEWAYS' WHEN {bull} >= 5 THEN 'BULLISH' WHEN {bear} >= 5 THEN 'BEARISH' ELSE 'SIDEWAYS' END AS regime"""


_VOLREG = "CASE WHEN {0} < 1.0 THEN 'LOW_VOL' WHEN {0} <= 2.0 THEN 'NORMAL_VOL' ELSE 'HIGH_VOL' END"
cte("mkt", "bend", f"SELECT {regime_sql('close', 'm200')}, {_VOLREG.format('atr_pct')} AS vol_regime FROM bend")


@query("market_regime", "mkt", "SELECT regime, CAST(bull_pts AS BIGINT) AS bull_pts, CAST(bear_pts AS BIGINT) AS bear_pts, chop_band, vol_regime, NOT chop_band AS regime_stable FROM mkt")
def _market(m):
    return scan.market_state(m.benchmark).select("regime", "bull_pts", "bear_pts", "chop_band", "vol_regime", "regime_stable")


# Each symbol as its own market, with a volatility index and breadth made from its figures.
@query("symbol_regimes", "snap", f"""SELECT symbol, regime, CAST(bull_pts AS BIGINT) AS bull_pts, CAST(bear_pts AS BIGINT) AS bear_pts, chop_band, {_VOLREG.format('atr_pct')} AS vol_regime FROM (
  SELECT symbol, atr_pct, {regime_sql('current_price', 'ma200', 'CASE WHEN adx < 20 THEN 1 ELSE 0 END + CASE WHEN vol_ratio > 1.2 THEN 1 ELSE 0 END',
                              'CASE WHEN adx >= 30 THEN 1 ELSE 0 END + CASE WHEN vol_ratio < 0.8 THEN 1 ELSE 0 END')} FROM snap)""")
def _symreg(m):
    s = m.snapshots.withColumns(S.regime_points("current_price", "ma200", "adx", "plus_di", "minus_di", "adx", "vol_ratio"))
    return s.select("symbol", "regime", "bull_pts", "bear_pts", "chop_band", S.volatility_regime("atr_pct").alias("vol_regime"))


def cl(x: str, lo: float = 0, hi: float = 100) -> str:
    return f"greatest({lo:.1f}, least({hi:.1f}, {x}))"


_HEALTH = "CASE WHEN {0} < 1.0 THEN 15.0 * greatest(0.0, {0}) WHEN {0} <= 4.0 THEN 15.0 WHEN {0} <= 6.0 THEN 15.0 * (1.0 - ({0} - 4.0) / 2.0) ELSE 0.0 END"
_HB = "CASE WHEN hurst >= 0.7 THEN 8.0 WHEN hurst >= 0.6 THEN 5.0 WHEN hurst >= 0.5 THEN 2.0 ELSE 0.0 END"
_VB = f"CASE WHEN vol_ratio > 1.2 THEN 5.0 * {cl('(vol_ratio - 1.2) / 0.6', 0, 1)} ELSE 0.0 END"


def levels_sql(high: str, atr: str, pct: str, reg: str) -> dict[str, str]:
    buf = f"(CASE WHEN {pct} <= 2.0 THEN 0.20 WHEN {pct} >= 6.0 THEN 0.05 ELSE 0.20 + ({pct} - 2.0) / 4.0 * (0.05 - 0.20) END * CASE {reg} WHEN 'LOW_VOL' THEN 0.8 WHEN 'HIGH_VOL' THEN 1.3 ELSE 1.0 END)"
    buf = f"CAST({buf} AS DOUBLE)"
    return {"trigger": he(f"{high} + {buf} * {atr}", 4), "stop": he(f"{high} + {buf} * {atr} - 1.5 * {atr}", 4), "buffer": he(f"{buf} * 100", 2)}


_lv = levels_sql("high_20d", "atr6", "atr_pct_raw", "vol_regime")
cte("hyb0", "ends2 rs hurst1 universe bend", f"""
SELECT *, {_lv['trigger']} AS trigger, {_lv['stop']} AS stop, {_lv['buffer']} AS buffer FROM (
  SELECT e.*, {he('rs63', 2)} AS rs_pct, hurst, days_to_earnings, greatest(0.0, (high_20d - close) / close * 100) AS dist, {_VOLREG.format('atr_pct_raw')} AS vol_regime, bull_pts, bear_pts, chop_band, regime
  FROM ends2 e JOIN rs USING (symbol) LEFT JOIN hurst1 USING (symbol) LEFT JOIN universe USING (symbol)
  JOIN (SELECT x.symbol, {regime_sql('b.close', 'b.m200').replace('adx', 'x.adx').replace('plus_di', 'x.plus_di').replace('minus_di', 'x.minus_di')} FROM ends2 x, bend b) USING (symbol))""")
cte("hyb", "hyb0", f"""
SELECT *, CASE WHEN fws > 65 THEN 'AUTO_NO' WHEN ncs >= 70 AND fws <= 30 THEN 'AUTO_YES' ELSE 'CONDITIONAL' END AS action FROM (
SELECT *, {he(cl(cl('bqs - 0.8 * fws + 10.0') + ' - CASE WHEN days_to_earnings <= 1 THEN 20.0 WHEN days_to_earnings <= 3 THEN 15.0 WHEN days_to_earnings <= 5 THEN 10.0 ELSE 0.0 END'), 2)} AS ncs FROM (
SELECT *, {he(cl(f"25.0 * {cl('(adx - 15.0) / 20.0', 0, 1)} + 10.0 * {cl('(plus_di - minus_di) / 25.0', 0, 1)} + {_HEALTH.format('atr_pct_raw')} + 15.0 * {cl('1.0 - dist / 3.0', 0, 1)}"
       f" + CASE WHEN regime = 'BEARISH' THEN -10.0 WHEN regime = 'SIDEWAYS' THEN 0.0 WHEN vol_regime = 'HIGH_VOL' THEN 10.0 WHEN vol_regime = 'NORMAL_VOL' THEN 15.0 ELSE 20.0 END"
       f" + 15.0 * {cl('(rs_pct + 5.0) / 20.0', 0, 1)} + {_VB} + {_HB} + least(bis, 15)"), 2)} AS bqs,
  {he(cl(f"30.0 * {cl('1.0 - (vol_ratio - 0.6) / 0.6', 0, 1)} + CASE WHEN ext_atr > 0.8 THEN 25.0 WHEN ext_atr > 0.4 THEN 15.0 ELSE 0.0 END"
        f" + CASE WHEN adx < 20 THEN 10.0 WHEN adx < 25 THEN 7.0 WHEN adx < 30 THEN 3.0 ELSE 0.0 END + CASE WHEN atr_spiking OR atr_collapsing THEN 10.0 ELSE 0.0 END + CASE WHEN chop_band THEN 10.0 ELSE 0.0 END"), 2)} AS fws FROM (
SELECT *, {he('(close - trigger) / atr6', 3)} AS ext_atr, (close - trigger) / atr6 > 0.8 OR (close >= trigger AND (close / trigger - 1) * 100 > 4.0) AS chasing,
  (close - trigger) / atr6 > 0.8 AS wait_pullback FROM hyb0)))""")


@query("hybrid_score", "hyb", f"""SELECT symbol, {q('bqs', 2)} AS bqs, {q('fws', 2)} AS fws, {q('ncs', 2)} AS ncs, action, regime, vol_regime, {q('trigger')} AS entry_trigger, {q('stop')} AS stop_price,
  {q('buffer', 2)} AS buffer_pct, {q('ext_atr', 3)} AS ext_atr, chasing, wait_pullback FROM hyb""")
def _hybrid(m):
    d = scan.hybrid_scores(m.bars, m.benchmark, m.universe.select("symbol", "days_to_earnings"))
    return d.select("symbol", *[report(c, n).alias(c) for c, n in (("bqs", 2), ("fws", 2), ("ncs", 2), ("entry_trigger", 4), ("stop_price", 4), ("buffer_pct", 2), ("ext_atr", 3))],
                    "action", "regime", "vol_regime", "chasing", "wait_pullback")


cte("quality", "universe fundamentals", """
SELECT *, CASE WHEN missing = 3 THEN 'unknown' WHEN round_even(score, 0) >= 3 THEN 'high' WHEN round_even(score, 0) >= 2 THEN 'medium' WHEN round_even(score, 0) >= 1 THEN 'low' ELSE 'junk' END AS tier FROM (
SELECT f.*, u.sector, CASE WHEN roe IS NULL THEN 0.5 WHEN roe > 0.10 THEN 1.0 ELSE 0.0 END + CASE WHEN revenue_growth IS NULL THEN 0.5 WHEN revenue_growth > 0 THEN 1.0 ELSE 0.0 END
  + CASE WHEN debt_to_equity IS NULL THEN 0.5 WHEN debt_to_equity < 1.5 THEN 1.0 ELSE 0.0 END AS score,
  CAST(roe IS NULL AS INT) + CAST(revenue_growth IS NULL AS INT) + CAST(debt_to_equity IS NULL AS INT) AS missing FROM fundamentals f JOIN universe u USING (symbol))""")


@query("quality_tiers", "quality", f"""SELECT symbol, tier AS quality_tier, {q("CASE WHEN missing = 3 THEN 0.0 ELSE score END", 2)} AS quality_score, missing = 0 AS data_complete,
  tier IN ('unknown', 'high', 'medium') AS pass_filter, {q("CASE tier WHEN 'high' THEN 1.0 WHEN 'medium' THEN 0.75 WHEN 'unknown' THEN 0.5 ELSE 0.0 END", 2)} AS quality_multiplier,
  {q("CASE WHEN roe > 0.1 THEN CASE tier WHEN 'high' THEN 0.15 WHEN 'medium' THEN 0.05 ELSE 0.0 END ELSE 0.0 END", 2)} AS conviction_bonus FROM quality""")
def _quality(m):
    d = m.universe.select("symbol", "sector").join(m.fundamentals, "symbol").withColumns(S.quality())
    d = d.withColumn("conviction_bonus", S.conviction_bonus("quality_tier", F.col("roe") > 0.1))
    return d.select("symbol", "quality_tier", "data_complete", "pass_filter", *[report(c, 2).alias(c) for c in ("quality_score", "quality_multiplier", "conviction_bonus")])


_F6 = """(ma200 > 0 AND current_price > ma200) AS price_above_ma200, adx >= 20 AS adx_above_20, plus_di > minus_di AS plus_di_above_minus,
  atr_pct < CASE WHEN sleeve = 'HIGH_RISK' THEN 12.0 ELSE 8.0 END AS atr_pct_below_cap, ma200 > 0 AND adx > 0 AS data_quality, efficiency >= 30 AS efficiency_above_30, coalesce(hurst < 0.5, FALSE) AS hurst_warn"""
_PASS = "price_above_ma200 AND adx_above_20 AND plus_di_above_minus AND atr_pct_below_cap AND data_quality AND efficiency_above_30"


@query("technical_filters", "snap universe", f"SELECT *, {_PASS} AS passes_all FROM (SELECT symbol, {_F6} FROM snap JOIN universe USING (symbol))")
def _filters(m):
    d = m.snapshots.join(m.universe.select("symbol", "sleeve"), "symbol")
    f = S.technical_filters("current_price", "sleeve")
    return d.select("symbol", *[c.alias(k) for k, c in f.items()])


_sl = levels_sql("high_20d", "atr", "atr_pct", "vol_regime")
_EP = "CASE WHEN days_to_earnings <= 1 THEN 20.0 WHEN days_to_earnings <= 3 THEN 15.0 WHEN days_to_earnings <= 5 THEN 10.0 ELSE 0.0 END"
_BQS = {
    "bqs_trend": f"25.0 * {cl('(adx - 15.0) / 20.0', 0, 1)}", "bqs_direction": f"10.0 * {cl('(plus_di - minus_di) / 25.0', 0, 1)}",
    "bqs_volatility": _HEALTH.format("atr_pct"), "bqs_proximity": f"15.0 * {cl('1.0 - dist / 3.0', 0, 1)}",
    "bqs_tailwind": "CASE WHEN regime = 'BEARISH' THEN -10.0 WHEN regime = 'BULLISH' THEN 10.0 ELSE 0.0 END",
    "bqs_rs": f"15.0 * {cl('(rs + 5.0) / 20.0', 0, 1)}", "bqs_vol_bonus": _VB, "bqs_bis": "bis", "bqs_hurst": _HB,
}
_FWS = {
    "fws_volume": f"30.0 * {cl('1.0 - (vol_ratio - 0.6) / 0.6', 0, 1)}",
    "fws_extension": "CASE WHEN chasing_20 AND chasing_55 THEN 25.0 WHEN chasing_20 OR chasing_55 THEN 15.0 ELSE 0.0 END",
    "fws_marginal_trend": "CASE WHEN adx < 20 THEN 10.0 WHEN adx <= 25 THEN 7.0 WHEN adx <= 30 THEN 3.0 ELSE 0.0 END",
    "fws_vol_shock": "CASE WHEN atr_spiking OR soft_cap OR atr_collapsing THEN 10.0 ELSE 0.0 END",
    "fws_regime_instability": "CASE WHEN chop_band THEN 10.0 ELSE 0.0 END",
}


def size_sql(entry: str, stop: str, eq: str = "1e7", risk: str = "1.0") -> dict[str, str]:
    cap = f"({eq} * CASE sleeve WHEN 'ETF' THEN 20.0 WHEN 'HIGH_RISK' THEN 8.0 WHEN 'HEDGE' THEN 10.0 ELSE 15.0 END / 100.0)"
    want = f"({eq} * ({risk} / 100.0) / ({entry} - {stop}))"
    sh = f"CASE WHEN {want} * {entry} > {cap} THEN {cap} / {entry} ELSE {want} END"
    bad = f"{entry} <= 0 OR {stop} >= {entry}"
    w = lambda x: f"CASE WHEN {bad} THEN 0.0 ELSE {x} END"
    return {"shares": w(he(sh, 4)), "risk_amount": w(he(f"({sh}) * ({entry} - {stop})", 2)), "risk_pct": w(he(f"({sh}) * ({entry} - {stop}) / {eq} * 100", 3)),
            "total_cost": w(he(f"CASE WHEN {want} * {entry} > {cap} THEN {cap} ELSE {want} * {entry} END", 2))}


cte("scan0", "snap universe quality mkt", f"""
SELECT *, {_PASS} AS passes_all, (trigger - current_price) / current_price * 100 AS d0 FROM (
SELECT s.*, u.name, u.sleeve, u.sector, u.cluster, u.market, u.days_to_earnings, q.tier AS quality_tier, CASE q.tier WHEN 'high' THEN 1.0 WHEN 'medium' THEN 0.75 ELSE 0.5 END AS mult,
  m.regime, m.vol_regime, m.chop_band, greatest(0.0, (high_20d - current_price) / current_price * 100) AS dist, median_atr > 0 AND atr >= median_atr * 1.3 AS soft_cap, {_F6}, {_sl['trigger']} AS trigger
FROM snap s JOIN universe u USING (symbol) JOIN quality q USING (symbol), mkt m WHERE q.tier IN ('high', 'medium', 'unknown') AND current_price > 0)""")
cte("scan1", "scan0", f"""
SELECT *, {he('least(100.0, ncs * mult)', 2)} AS adjusted_ncs, CASE WHEN fws > 65 THEN 'AUTO_NO' WHEN ncs >= 70 AND fws <= 30 THEN 'AUTO_YES' ELSE 'CONDITIONAL' END AS action,
  {he("CASE sleeve WHEN 'CORE' THEN 40.0 WHEN 'ETF' THEN 20.0 WHEN 'HIGH_RISK' THEN 10.0 ELSE 5.0 END + CASE WHEN st = 'READY' THEN 30.0 WHEN st = 'WATCH' THEN 10.0 ELSE 0.0 END + bqs * 0.5 + least(adx, 50.0) * 0.3 + least(vol_ratio, 3.0) * 5.0 + least(efficiency, 100.0) * 0.2 + least(rs, 100.0) * 0.1", 2)} AS rank_score,
  passes_tech AND st NOT IN ('FAR', 'EARNINGS_BLOCK') AS open_for_entry FROM (
SELECT *, {he(cl(cl('bqs - 0.8 * fws + 10.0') + ' - ' + _EP), 2)} AS ncs FROM (
SELECT *, {he(cl(' + '.join('(' + x + ')' for x in _BQS.values())), 2)} AS bqs, {he(cl(' + '.join('(' + x + ')' for x in _FWS.values())), 2)} AS fws, trigger - 1.5 * atr AS stop0,
  CASE WHEN days_to_earnings <= 2 THEN 'EARNINGS_BLOCK' WHEN d0 <= 2.0 THEN CASE WHEN soft_cap THEN 'WATCH' ELSE 'READY' END WHEN d0 <= 3.0 THEN 'WATCH' ELSE 'FAR' END AS st,
  passes_all AND NOT coalesce(days_to_earnings <= 2, FALSE) AS passes_tech FROM scan0))""")
_s1, _s2 = size_sql("trigger", "stop0"), size_sql("zone_entry", "zone_stop")
cte("scan2", "scan1", f"""
SELECT *, CASE WHEN resumed THEN 'READY' WHEN stretched THEN 'WAIT_PULLBACK' ELSE st END AS status, CASE WHEN resumed THEN zone_entry ELSE trigger END AS entry_trigger,
  CASE WHEN resumed THEN zone_stop ELSE stop0 END AS stop_price, {', '.join(f"CASE WHEN resumed THEN {_s2[k]} WHEN open_for_entry THEN {_s1[k]} END AS {k}" for k in _s1)} FROM (
SELECT *, stretched AND greatest(high_20d, ema20) > 0 AND low <= hi AND current_price >= hi AS resumed, {he('hi', 4)} AS zone_entry, {he('greatest(high_20d, ema20) - 0.25 * atr - atr * 0.5', 4)} AS zone_stop FROM (
SELECT *, greatest(high_20d, ema20) + 0.25 * atr AS hi, open_for_entry AND atr > 0 AND ((current_price - trigger) / atr > 0.8 OR (current_price >= trigger AND (current_price / trigger - 1) * 100 > 4.0)) AS stretched FROM scan1))""")
cte("scan", "scan2", f"""SELECT *, CASE WHEN open_for_entry THEN {_s1['total_cost']} / 1e7 * 100 <= CASE sleeve WHEN 'ETF' THEN 20.0 WHEN 'HIGH_RISK' THEN 8.0 WHEN 'HEDGE' THEN 10.0 ELSE 15.0 END
   AND {_s1['total_cost']} / 1e7 * 100 <= 40.0 AND {_s1['risk_amount']} / 1e7 * 100 <= 6.0 ELSE TRUE END AS passes_risk, NOT stretched OR resumed AS passes_chase,
   passes_tech AND {he('current_price', 4)} >= {he('entry_trigger', 4)} AS triggered FROM scan2""")


def the_scan(m, **kw):
    return scan.candidate_scan(m.snapshots, m.universe, m.fundamentals, scan.market_state(m.benchmark), **kw)


_num = [("price", "current_price", 4), ("entry_trigger", "entry_trigger", 4), ("stop_price", he("stop_price", 4), 4), ("distance_pct", he("(entry_trigger - current_price) / current_price * 100", 2), 2),
        ("rank_score", "rank_score", 2), ("bqs", "bqs", 2), ("fws", "fws", 2), ("ncs", "ncs", 2), ("adjusted_ncs", "adjusted_ncs", 2), ("shares", "shares", 4), ("risk_amount", "risk_amount", 2),
        ("risk_pct", "risk_pct", 3), ("total_cost", "total_cost", 2)]


@query("candidate_scan", "scan", "SELECT symbol, name, sleeve, sector, market, status, triggered, action, quality_tier, passes_tech, passes_risk, passes_chase, hurst_warn, "
       + ", ".join(f"{q(x, d)} AS {n}" for n, x, d in _num) + " FROM scan")
def _scan(m):
    return the_scan(m).select("symbol", "name", "sleeve", "sector", "market", "status", "triggered", "action", "quality_tier", "passes_tech", "passes_risk", "passes_chase", "hurst_warn",
                              *[report(n, d).alias(n) for n, _, d in _num])


@query("scan_summary", "scan universe", """SELECT count(*) FILTER (passes_tech AND status = 'READY') AS ready_count, count(*) FILTER (passes_tech AND status IN ('WATCH', 'WAIT_PULLBACK')) AS watch_count,
  count(*) FILTER (status = 'FAR') AS far_count, count(*) FILTER (passes_tech) AS passed_filters, count(*) FILTER (passes_tech AND passes_risk) AS passed_risk,
  count(*) FILTER (passes_tech AND passes_chase) AS passed_anti_chase, (SELECT count(*) FROM universe) AS total_scanned FROM scan""")
def _scan_summary(m):
    return scan.scan_summary(the_scan(m), m.universe)


@query("score_components", "scan1", "SELECT symbol, " + ", ".join(f"{q(he(x, 2), 2)} AS {k}" for k, x in {**_BQS, **_FWS}.items()) + f", {q(_EP, 2)} AS earnings_penalty FROM scan1")
def _components(m):
    d = the_scan(m)
    return d.select("symbol", *[report(f"bqs_components.{k}", 2).alias(k) for k in _BQS], *[report(f"fws_components.{k}", 2).alias(k) for k in _FWS],
                    report("earnings_penalty", 2).alias("earnings_penalty"))


@query("top_ready", "scan", f"""SELECT * FROM (SELECT symbol, market, action, {q('adjusted_ncs', 2)} AS adjusted_ncs, row_number() OVER (PARTITION BY market ORDER BY triggered DESC,
  CASE WHEN status = 'READY' THEN 0 WHEN status IN ('WATCH', 'WAIT_PULLBACK') THEN 1 WHEN status = 'EARNINGS_BLOCK' THEN 2 ELSE 3 END, adjusted_ncs DESC, rank_score DESC, symbol) AS place FROM scan) WHERE place <= 5""")
def _top_ready(m):
    from barline.operators.rank import top_k

    d = top_k(the_scan(m), ["market"], scan.scan_order(), 5, "place")
    return d.select("symbol", "market", "action", report("adjusted_ncs", 2).alias("adjusted_ncs"), F.col("place").cast("long").alias("place"))


# Row-wise decision functions over every bar, not only the last.
@query("entry_decisions", "tr", f"""SELECT symbol, idx AS bar_idx, status, {q('trigger')} AS entry_trigger, {q('stop')} AS stop_price, {q('buffer', 2)} AS buffer_pct, reason AS chase_reason,
  CASE WHEN hit THEN {q(he('hi', 4))} END AS pullback_entry FROM (SELECT *, CASE WHEN (trigger - close) / close * 100 <= 2 THEN 'READY' WHEN (trigger - close) / close * 100 <= 3 THEN 'WATCH' ELSE 'FAR' END AS status,
  CASE WHEN atr <= 0 THEN 'NO_ATR' WHEN (close - trigger) / atr > 0.8 THEN 'WAIT_PULLBACK' WHEN close >= trigger AND (close / trigger - 1) * 100 > CASE WHEN dayofweek(bar_date) = 1 THEN 3.0 ELSE 4.0 END THEN 'GAP_CHASE' ELSE 'OK' END AS reason,
  atr > 0 AND low <= hi AND close >= hi AS hit FROM (SELECT *, greatest(ph20, s20) + 0.25 * atr AS hi, {levels_sql('ph20', 'atr', 'pct', 'vr')['trigger']} AS trigger, {levels_sql('ph20', 'atr', 'pct', 'vr')['stop']} AS stop,
  {levels_sql('ph20', 'atr', 'pct', 'vr')['buffer']} AS buffer FROM (SELECT *, atr / close * 100 AS pct, {_VOLREG.format('(atr / close * 100)')} AS vr FROM (SELECT *, avg(tr) {over(14)} AS atr, avg(close) {over(20)} AS s20,
  max(high) OVER (PARTITION BY symbol ORDER BY idx ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS ph20 FROM tr)) WHERE idx >= 20))""")
def _entry(m):
    from barline.series import own_rows, prior, segmented

    d = ind.with_tr(segmented(m.bars, 40)).withColumns({"ph20": F.max("high").over(prior(20))})
    d = d.withColumns({"atr": F.avg("tr").over(_last14()), "s20": ind.sma(20)})
    d = own_rows(d).filter("bar_idx >= 20").withColumn("pct", F.col("atr") / F.col("close") * 100)
    d = d.withColumn("vr", S.volatility_regime("pct"))
    d = d.withColumns(S.entry_levels("ph20", "atr", "pct", "vr"))
    monday = F.weekday("bar_date") == 0
    d = d.withColumns(S.anti_chase_v2("close", "entry_trigger", "atr", monday)).withColumn("pb", S.pullback_entry("close", "ph20", "s20", "atr", "low"))
    return d.select("symbol", F.col("bar_idx").cast("long").alias("bar_idx"), S.candidate_status("close", "entry_trigger").alias("status"), report("entry_trigger").alias("entry_trigger"),
                    report("stop_price").alias("stop_price"), report("buffer_pct", 2).alias("buffer_pct"), "chase_reason", report("pb.entry_price").alias("pullback_entry"))


def _last14():
    from barline.series import last

    return last(14)
