"""Back-tests."""

from functools import cached_property

from pyspark.sql import functions as F

from barline.functions.numeric import report
from barline.operators import backtest as B, indicators as ind, joins as J
from barline.plans.indicators import _SLOPE, over
from barline.plans.markets import regime_by_date
from barline.plans.registry import cte, he, q, query
from barline.series import back, own_rows, segmented
from barline.session import stored, written

_pre = "OVER (PARTITION BY symbol ORDER BY idx ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)"
cte("panel", "tr rec adx macd0 sig", f"""
SELECT *, lag(ma20, 5) OVER w AS ma20_old, smma21 - smma200 AS gap, lag(smma21 - smma200, 5) OVER w AS gap_old,
  coalesce(count(atr) {over(20)} = 20 AND avg(atr) {over(5)} / avg(atr) OVER (PARTITION BY symbol ORDER BY idx ROWS BETWEEN 19 PRECEDING AND 5 PRECEDING) > 1.3, FALSE) AS expanding FROM (
SELECT t.*, CASE WHEN idx >= 13 THEN avg(coalesce(tr, high - low)) {over(14)} END AS atr, CASE WHEN idx >= 19 THEN avg(close) {over(20)} END AS ma20, CASE WHEN idx >= 59 THEN avg(close) {over(60)} END AS ma60,
  CASE WHEN idx >= 119 THEN avg(close) {over(120)} END AS ma120, CASE WHEN idx >= 19 THEN avg(close) {over(20)} - 2 * stddev_pop(close) {over(20)} END AS bb_lower,
  CASE WHEN idx >= 20 THEN volume / avg(volume) {_pre} ELSE 1.0 END AS vr_prior, CASE WHEN idx >= 19 THEN volume / avg(volume) {over(20)} ELSE 1.0 END AS vr_incl, sum(close * volume) {over(20)} / sum(volume) {over(20)} AS vwap,
  min(low) {_pre} AS low20, max(high) {over(20)} AS hi20, min(low) {over(20)} AS lo20, list_sum(list_sort(list(low) {over(20)})[1:3]) / 3 AS strong, avg(volume) {over(20)} AS av20, coalesce(avg(close * volume) {_pre}, 0) AS turnover,
  CASE WHEN al = 0 THEN 100 ELSE 100 - 100 / (1 + ag / al) END AS rsi, macd, sig, adx, dip, dim, smma21, smma50, smma200, {_SLOPE.replace('OVER (PARTITION BY symbol ORDER BY idx)', 'OVER (PARTITION BY symbol ORDER BY idx)')} AS slope,
  coalesce(low < lag(low, 2) OVER (PARTITION BY symbol ORDER BY idx) AND low < lag(low) OVER (PARTITION BY symbol ORDER BY idx) AND low < lead(low) OVER (PARTITION BY symbol ORDER BY idx) AND low < lead(low, 2) OVER (PARTITION BY symbol ORDER BY idx), FALSE) AS lf,
  max(high) {over(60)} - 0.382 * (max(high) {over(60)} - min(low) {over(60)}) AS fib382, CASE WHEN idx >= 29 THEN list_sum(list_sort(list(low) {over(30)})[1:5]) / 5 END AS support
FROM tr t JOIN rec USING (symbol, idx) JOIN adx USING (symbol, idx) JOIN macd0 USING (symbol, idx) JOIN sig USING (symbol, idx)) WINDOW w AS (PARTITION BY symbol ORDER BY idx)""")
cte("risk", "panel universe", """
SELECT *, CASE WHEN score >= 68 THEN 'severe' WHEN score >= 50 THEN 'high' WHEN score >= 30 THEN 'medium' ELSE 'low' END AS lv, CASE WHEN score >= 68 THEN 1.05 WHEN score >= 50 THEN 0.75 WHEN score >= 30 THEN 0.45 ELSE 0.20 END AS sh FROM (
SELECT p.*, u.market, CASE WHEN market = 'KRX' THEN 1.18 ELSE 0.92 END AS bw, CASE WHEN market = 'KRX' THEN 0.20 ELSE 0.15 END AS base, least(100,
  CASE WHEN close < ma20 THEN 10 ELSE 0 END + CASE WHEN close < ma60 THEN 12 ELSE 0 END + CASE WHEN close < ma120 THEN 8 ELSE 0 END + CASE WHEN (ma20 - ma20_old) / ma20_old * 100 < -0.6 THEN 8 ELSE 0 END
  + CASE WHEN macd <= sig THEN 10 ELSE 0 END + CASE WHEN coalesce(adx, 20) >= 25 AND dim > dip THEN 16 ELSE 0 END + CASE WHEN rsi < 40 OR rsi > 70 THEN 8 ELSE 0 END
  + CASE WHEN atr / close * 100 >= CASE WHEN market = 'KRX' THEN 5.5 ELSE 3.2 END THEN 14 WHEN atr / close * 100 >= CASE WHEN market = 'KRX' THEN 4.0 ELSE 2.4 END THEN 7 ELSE 0 END
  + CASE WHEN close < low20 THEN 16 ELSE 0 END + CASE WHEN close < strong THEN 12 ELSE 0 END + CASE WHEN volume >= av20 * 1.35 AND close < pc THEN 10 ELSE 0 END
  + CASE WHEN vr_incl < 0.70 AND close < ma20 THEN 8 ELSE 0 END + CASE WHEN open < pc * 0.985 AND close <= open * 1.01 THEN 10 ELSE 0 END + CASE WHEN expanding THEN 8 ELSE 0 END) AS score
FROM panel p JOIN universe u USING (symbol))""")
_SAMPLE = "n - 59 >= 260 AND idx - 59 >= greatest(140, n - 59 - 190) AND idx - 59 < n - 59 - 21 AND (idx - 59 - greatest(140, n - 59 - 190)) % 21 = 0"


@query("downside_risk", "risk", "SELECT symbol, idx AS bar_idx, CAST(score AS BIGINT) AS risk_score, lv AS risk_level, score >= 50 AS hold_signal FROM risk")
def _risk(m):
    d = m.panel_view().join(m.universe.select("symbol", "market"), "symbol").withColumns(B.downside_risk())
    return d.select("symbol", F.col("bar_idx").cast("long").alias("bar_idx"), F.col("risk_score").cast("long").alias("risk_score"), "risk_level", "hold_signal")


cte("zb", "risk", f"""
SELECT symbol, market, idx, close, atr, score, lv, vr_incl, logic, zone, CASE WHEN logic = 'baseline' THEN lo ELSE greatest(least(lo, greatest(hi, close * 0.10 + d * 0.05) - d * 0.05), close * 0.10) END AS lo,
  CASE WHEN logic = 'baseline' THEN hi ELSE greatest(hi, close * 0.10 + d * 0.05) END AS hi FROM (
SELECT *, unnest([{{'logic': 'baseline', 'zone': 'primary', 'lo': close - 0.45 * atr - 0.2 * atr * bw, 'hi': close - 0.45 * atr + 0.2 * atr * bw}}, {{'logic': 'baseline', 'zone': 'secondary', 'lo': close - 0.875 * atr - 0.225 * atr * bw, 'hi': close - 0.875 * atr + 0.225 * atr * bw}},
  {{'logic': 'current', 'zone': 'primary', 'lo': CASE WHEN weak THEN least(pm - phw, least(pm + phw, strong - d * 0.10) - d * 0.20) ELSE pm - phw END, 'hi': CASE WHEN weak THEN least(pm + phw, strong - d * 0.10) ELSE pm + phw END}},
  {{'logic': 'current', 'zone': 'secondary', 'lo': least(bb - d * 0.35 * bw, least(bb + d * 0.35 * bw, close - d * 0.05) - d * 0.05), 'hi': least(bb + d * 0.35 * bw, close - d * 0.05)}}], recursive := true) FROM (
SELECT *, CASE WHEN weak THEN least(b0, strong - d * (0.75 + sh * 0.30)) ELSE b0 END AS bb FROM (SELECT *, least((bb_lower + ma20) / 2, a0 - d * (0.35 + sh * 0.45)) AS b0, 0.2 * d * bw AS phw, close - (k1 + k2) / 2 * d AS pm FROM (
SELECT *, least((vwap + ma20) / 2, close - d * (0.55 + base + sh)) AS a0, CASE WHEN lv = 'severe' THEN greatest(0.25 + base + sh, 1.55) ELSE 0.25 + base + sh END AS k1, CASE WHEN lv = 'severe' THEN greatest(0.65 + base + sh, 2.15) ELSE 0.65 + base + sh END AS k2 FROM (
SELECT *, least(atr, close * 0.15) AS d, lv IN ('high', 'severe') AS weak FROM risk WHERE {_SAMPLE})))))""")
cte("zt", "zb bars", """
SELECT *, CASE WHEN ep IS NOT NULL THEN minlow <= ep - atr * 0.75 END AS extra_drop, (last_close - ep) / ep * 100 AS ret, (minlow - ep) / ep * 100 AS mdd FROM (
SELECT z.symbol, z.market, z.idx, z.close, z.atr, z.score, z.lv, z.vr_incl, z.logic, z.zone, z.lo, z.hi, e.first_idx, e.ep, bool_or(b.low <= e.ep - z.atr * CASE WHEN z.zone = 'primary' THEN 1.35 ELSE 1.75 END) AS stop_hit,
  bool_or(b.high >= e.ep + z.atr * CASE WHEN z.zone = 'primary' THEN 1.15 ELSE 1.65 END) AS bounce, min(b.low) AS minlow, max_by(b.close, b.idx) AS last_close
FROM zb z LEFT JOIN (SELECT symbol, idx, logic, zone, first_idx, least(hi, greatest(lo, b2.close)) AS ep FROM (SELECT z.symbol, z.idx, z.logic, z.zone, z.lo, z.hi, min(b.idx) AS first_idx FROM zb z JOIN bars b ON b.symbol = z.symbol AND b.idx BETWEEN z.idx + 1 AND z.idx + 20 AND b.low <= z.hi
   GROUP BY ALL) f JOIN (SELECT symbol AS s2, idx AS i2, close FROM bars) b2 ON b2.s2 = f.symbol AND b2.i2 = f.first_idx) e USING (symbol, idx, logic, zone)
  LEFT JOIN bars b ON b.symbol = z.symbol AND b.idx BETWEEN e.first_idx AND z.idx + 20 GROUP BY ALL)""")


def zones(m):
    return m.zone_trades


@query("zone_trades", "zt", f"SELECT symbol, idx AS bar_idx, logic, zone, {q('lo')} AS low_band, {q('hi')} AS high_band, {q('ep')} AS entry_price, CAST(stop_hit AS DOUBLE) AS stop_hit, CAST(bounce AS DOUBLE) AS bounce_success, CAST(extra_drop AS DOUBLE) AS extra_drop, {q('ret')} AS return_pct, {q('mdd')} AS mdd_pct, {q(he('vr_incl', 3), 3)} AS vol_ratio, CAST(score AS BIGINT) AS risk_score FROM zt")
def _zones(m):
    d = zones(m)
    return d.select("symbol", F.col("bar_idx").cast("long").alias("bar_idx"), "logic", "zone", report("low").alias("low_band"), report("high").alias("high_band"), report("entry_price").alias("entry_price"),
                    *[F.col(c).cast("double").alias(c) for c in ("stop_hit", "bounce_success", "extra_drop")], report("return_pct").alias("return_pct"), report("mdd_pct").alias("mdd_pct"), report("vol_ratio", 3).alias("vol_ratio"), F.col("risk_score").cast("long").alias("risk_score"))


_pct = lambda c: he(f"avg(CAST({c} AS DOUBLE)) * 100", 2)


@query("zone_summary", "zt", f"""SELECT market, logic, zone, count(*) AS signals, count(ep) AS entries, {q(he('count(ep) / count(*) * 100', 2), 2)} AS entry_rate, {q(_pct('bounce'), 2)} AS bounce_rate, {q(_pct('stop_hit'), 2)} AS stop_rate, {q(_pct('extra_drop'), 2)} AS extra_drop_rate,
  {q('avg(ret)', 3)} AS avg_return_pct, {q('avg(mdd)', 3)} AS avg_mdd_pct, {q('median(CASE WHEN ep IS NOT NULL THEN atr / close * 100 END)', 3)} AS median_atr_pct, {q('median(CASE WHEN ep IS NOT NULL THEN ' + he('vr_incl', 3) + ' END)', 3)} AS median_vol_ratio FROM zt GROUP BY market, logic, zone HAVING count(ep) > 0""")
def _zsum(m):
    d = B.zone_summary(zones(m))
    return d.select("market", "logic", "zone", "signals", "entries", *[report(c, 2).alias(c) for c in ("entry_rate", "bounce_rate", "stop_rate", "extra_drop_rate")], *[report(c, 3).alias(c) for c in ("avg_return_pct", "avg_mdd_pct", "median_atr_pct", "median_vol_ratio")])


@query("risk_gate_summary", "zt", f"""SELECT market, count(*) FILTER (logic = 'current' AND zone = 'primary') AS risk_samples, {q(he("avg(CASE WHEN logic = 'current' AND zone = 'primary' THEN CAST(score >= 50 AS DOUBLE) END) * 100", 2), 2)} AS hold_rate,
  {q(he("avg(CASE WHEN logic = 'current' AND ep IS NOT NULL AND score >= 55 THEN CAST(extra_drop AS DOUBLE) END) * 100", 2), 2)} AS high_risk_extra_drop_rate, count(*) FILTER (logic = 'current' AND zone = 'primary' AND score >= 68) AS severe_samples FROM zt GROUP BY market""")
def _gate(m):
    d = B.risk_gate_summary(zones(m))
    return d.select("market", "risk_samples", "severe_samples", report("hold_rate", 2).alias("hold_rate"), report("high_risk_extra_drop_rate", 2).alias("high_risk_extra_drop_rate"))


# -- strategy ---------------------------------------------------------------------------------

def vals(xs, t="DOUBLE"):
    return "(CAST([" + ", ".join("NULL" if x is None else str(x) for x in xs) + f"] AS {t}[]))"


cte("grid", "", f"""SELECT row_number() OVER (ORDER BY a, b, c, d, e, f) - 1 AS cfg, {vals(B.RETEST_LINES, 'INT')}[a] AS line, {vals(B.ENTRY_DELAYS, 'INT')}[b] AS delay, {vals(B.ATR_TOLERANCES)}[c] AS tol, {vals(B.PULLBACK_VOLUME_MAX)}[d] AS pv,
  {vals(B.REBOUND_VOLUME_MIN)}[e] AS rv, {vals(B.SLOPE_MIN)}[f] AS sl FROM range(1, 3) t1(a), range(1, 5) t2(b), range(1, 5) t3(c), range(1, 4) t4(d), range(1, 4) t5(e), range(1, 4) t6(f)""")


cte("setup", "panel", """SELECT * FROM (SELECT symbol, n, idx AS confirmed, close AS cc, slope, gap, gap_old, vr_prior AS rb, lag(vr_prior, 2) OVER w AS pb, lag(low, 2) OVER w AS pl2, lag(atr, 2) OVER w AS pa, lag(lf, 2) OVER w AS plf,
  smma21 > smma50 AND smma50 > smma200 AND lag(smma21, 2) OVER w > lag(smma50, 2) OVER w AND lag(smma50, 2) OVER w > lag(smma200, 2) OVER w AS fan, abs(lag(low, 2) OVER w - lag(smma21, 2) OVER w) AS d21, abs(lag(low, 2) OVER w - lag(smma50, 2) OVER w) AS d50,
  close > smma21 AS a21, close > smma50 AS a50 FROM panel WINDOW w AS (PARTITION BY symbol ORDER BY idx)) WHERE plf AND fan AND gap > gap_old AND confirmed >= 220""")


def outcome_cte(name: str, folds: str) -> None:
    cte(f"{name}_e", "setup bars universe", f"""
SELECT s.*, u.market, fold, CASE WHEN confirmed < cut THEN 'train' ELSE 'test' END AS split, CASE WHEN confirmed < cut THEN cut ELSE ne END AS until, delay, confirmed + delay AS ei, pl2 - 0.1 * pa AS stop FROM (
  SELECT *, n - off AS ne, n - off - test AS cut FROM setup, (VALUES {folds}) t(fold, off, train, test, need) WHERE n - off >= need) s JOIN universe u USING (symbol), (SELECT unnest([0, 1, 3, 5]) AS delay)
WHERE confirmed >= greatest(220, ne - train - test) AND confirmed < CASE WHEN confirmed < cut THEN cut ELSE ne END - 20 AND confirmed + delay < CASE WHEN confirmed < cut THEN cut ELSE ne END AND confirmed + delay < ne - 1""")
    cte(name, f"{name}_e bars", f"""
SELECT *, CASE WHEN market = 'KRX' THEN 0.20 ELSE 0.10 END AS cost, {he('(x - entry) / entry * 100', 6)} AS gross, {he("(x - entry) / entry * 100 - CASE WHEN market = 'KRX' THEN 0.20 ELSE 0.10 END", 6)} AS ret,
  {he("((x - entry) - entry * CASE WHEN market = 'KRX' THEN 0.20 ELSE 0.10 END / 100) / (entry - stop)", 6)} AS r, {he('(entry - cc) / cc * 100', 6)} AS og FROM (
SELECT e.*, coalesce(h.hit, e.fin) AS xi, CASE WHEN h.hit IS NULL THEN f.close WHEN b.open <= e.stop OR b.open >= e.target THEN b.open WHEN b.low <= e.stop THEN e.stop ELSE e.target END AS x,
  CASE WHEN h.hit IS NULL THEN 'time' WHEN b.open <= e.stop THEN 'stop_gap' WHEN b.open >= e.target THEN 'target_gap' WHEN b.low <= e.stop THEN 'stop' ELSE 'target' END AS why FROM (
  SELECT *, entry + 2.0 * (entry - stop) AS target FROM (SELECT e.*, CASE WHEN delay = 0 THEN cc ELSE b.open END AS entry, least(ei + 20, until - 1) AS fin FROM {name}_e e JOIN (SELECT symbol, idx, open FROM bars) b ON b.symbol = e.symbol AND b.idx = e.ei) WHERE entry > stop) e
  LEFT JOIN (SELECT e2.symbol, e2.fold, e2.confirmed, e2.delay, min(b.idx) AS hit FROM (SELECT *, entry + 2.0 * (entry - stop) AS target FROM (SELECT e.*, CASE WHEN delay = 0 THEN cc ELSE b.open END AS entry, least(ei + 20, until - 1) AS fin FROM {name}_e e
      JOIN (SELECT symbol, idx, open FROM bars) b ON b.symbol = e.symbol AND b.idx = e.ei)) e2 JOIN bars b ON b.symbol = e2.symbol AND b.idx BETWEEN e2.ei + CASE WHEN delay = 0 THEN 1 ELSE 0 END AND e2.fin
      AND (b.low <= e2.stop OR b.high >= e2.target OR b.open <= e2.stop OR b.open >= e2.target) GROUP BY ALL) h USING (symbol, fold, confirmed, delay)
  LEFT JOIN bars b ON b.symbol = e.symbol AND b.idx = h.hit JOIN bars f ON f.symbol = e.symbol AND f.idx = e.fin)""")


outcome_cte("out", "(1, 0, 168, 84, 0)")
_QF = 4
outcome_cte("outq", ", ".join(f"({k + 1}, {(_QF - k - 1) * 63}, 189, 63, {220 + 189 + 63})" for k in range(_QF)))
_MF = 4
outcome_cte("outm", ", ".join(f"({k + 1}, {(_MF - k - 1) * 21}, 231, 21, {220 + 231 + 21})" for k in range(_MF)))


def greedy_cte(name: str, out: str, grid: str, on: str = "") -> None:
    """Candidates numbered per group, then walked in order keeping those after the last exit."""
    cte(f"{name}_c", f"{out} {grid}", f"""SELECT o.* EXCLUDE (delay), g.cfg, row_number() OVER (PARTITION BY o.symbol, g.cfg, o.fold, o.split ORDER BY confirmed) AS k FROM {out} o JOIN {grid} g ON o.delay = g.delay {on}
  AND CASE WHEN g.line = 21 THEN d21 ELSE d50 END <= g.tol * pa AND CASE WHEN g.line = 21 THEN a21 ELSE a50 END AND (g.pv IS NULL OR pb <= g.pv) AND (g.rv IS NULL OR rb >= g.rv) AND (g.sl IS NULL OR slope >= g.sl)""")
    cte(f"{name}_w", f"{name}_c", f"""SELECT symbol, cfg, fold, split, k, TRUE AS kept, xi AS upto FROM {name}_c WHERE k = 1
  UNION ALL SELECT c.symbol, c.cfg, c.fold, c.split, c.k, c.confirmed > w.upto, CASE WHEN c.confirmed > w.upto THEN c.xi ELSE w.upto END FROM {name}_w w JOIN {name}_c c ON c.symbol = w.symbol AND c.cfg = w.cfg AND c.fold = w.fold AND c.split = w.split AND c.k = w.k + 1""")
    cte(name, f"{name}_w", f"SELECT c.* FROM {name}_c c JOIN {name}_w w USING (symbol, cfg, fold, split, k) WHERE w.kept")


greedy_cte("trades", "out", "grid")
greedy_cte("tradesq", "outq", "grid")
greedy_cte("tradesm", "outm", "grid")


def summary_sql(keys: str, src: str) -> str:
    m = "1.96 * coalesce(stddev_samp(r), 0) / sqrt(count(*))"
    return f"""SELECT {keys}, count(*) AS trades, {q('avg(CAST(ret > 0 AS DOUBLE)) * 100', 2)} AS win_rate_pct, {q('avg(ret)', 4)} AS avg_return_pct, {q('median(ret)', 4)} AS median_return_pct, {q('avg(r)', 4)} AS avg_r, {q('median(r)', 4)} AS median_r,
  {q('avg(r) - ' + m, 4)} AS r_ci_low, {q('avg(r) + ' + m, 4)} AS r_ci_high, {q("coalesce(sum(ret) FILTER (ret > 0), 0) / abs(nullif(sum(ret) FILTER (ret < 0), 0))", 4)} AS profit_factor, {q('coalesce(stddev_samp(ret), 0)', 4)} AS return_std,
  {q('max(ret) FILTER (ret > 0) / sum(ret) FILTER (ret > 0) * 100', 2)} AS largest_profit_share_pct, {q('avg(og)', 4)} AS avg_open_gap_pct, {q("avg(CAST(why LIKE 'target%' AS DOUBLE)) * 100", 2)} AS target_rate_pct, {q("avg(CAST(why LIKE 'stop%' AS DOUBLE)) * 100", 2)} AS stop_rate_pct
  FROM {src} GROUP BY {keys}"""


_SUM = [("win_rate_pct", 2), ("avg_return_pct", 4), ("median_return_pct", 4), ("avg_r", 4), ("median_r", 4), ("r_ci_low", 4), ("r_ci_high", 4), ("profit_factor", 4), ("return_std", 4), ("largest_profit_share_pct", 2), ("avg_open_gap_pct", 4), ("target_rate_pct", 2), ("stop_rate_pct", 2)]
_SUMQ = ", ".join(f"{q(c, d)} AS {c}" for c, d in _SUM)
_sumc = lambda: [report(c, d).alias(c) for c, d in _SUM]
_OBJ = "CASE WHEN trades >= 30 THEN r_ci_low + median_r * 0.15 + least(coalesce(profit_factor, 0.0), 2.0) * 0.05 + win_rate_pct / 100.0 * 0.03 + ln(1 + trades) * 0.01 - greatest(0.0, CASE WHEN coalesce(largest_profit_share_pct, 0) = 0 THEN 100.0 ELSE largest_profit_share_pct END - 35.0) / 100.0 * 0.10 ELSE -999.0 END"


def scored_cte(name: str, trades: str, folds: str) -> None:
    cte(f"{name}_s", trades, summary_sql("market, fold, cfg", f"(SELECT * FROM {trades} WHERE split = 'train')"))
    cte(name, f"{name}_s grid universe", f"SELECT m.market, f.fold, g.*, coalesce(s.trades, 0) AS trades, s.* EXCLUDE (market, fold, cfg, trades), {_OBJ.replace('trades', 'coalesce(s.trades, 0)', 2)} AS objective FROM (SELECT DISTINCT market FROM universe) m, (SELECT unnest({folds}) AS fold) f, grid g LEFT JOIN {name}_s s ON s.market = m.market AND s.fold = f.fold AND s.cfg = g.cfg")
    cte(f"{name}_b", name, f"SELECT * EXCLUDE (k) FROM (SELECT *, row_number() OVER (PARTITION BY market, fold ORDER BY objective <= -900, CASE WHEN objective > -900 THEN -objective ELSE -trades END, cfg) AS k FROM {name} WHERE delay >= 1) WHERE k = 1")


scored_cte("scored", "trades", "[1]")
scored_cte("scoredq", "tradesq", str([*range(1, _QF + 1)]))
scored_cte("scoredm", "tradesm", str([*range(1, _MF + 1)]))


class Study:
    """The strategy study of one market data set. Each step is written when a query first reads it: one that reads
    outcomes plans and runs neither trades nor scores."""

    def __init__(self, m, name="base", train=B.TRAIN_BARS, test=B.TEST_BARS, folds=1, check=False):
        self.m, self.name = m, name
        self.grid = B.strategy_grid(m.spark)
        self.folds = B.fold_table(m.spark, train, test, folds, check)
        self.markets = m.universe.select("symbol", "market")

    @cached_property
    def outcomes(self):
        return stored(B.outcomes(setups(self.m), self.folds, self.markets), f"outcomes_{self.name}", self.m.path, ["symbol"], ["symbol", "confirmed"])

    @cached_property
    def trades(self):
        return stored(B.apply_settings(self.outcomes, self.grid), f"trades_{self.name}", self.m.path, ["symbol"], ["symbol", "cfg"])

    @cached_property
    def scored(self):
        scopes = self.markets.select("market").distinct().crossJoin(self.folds.select("fold"))
        return stored(B.scored_settings(self.trades, self.grid, scopes), f"scored_{self.name}", self.m.path, ["market"], ["market", "fold", "cfg"])

    @property
    def best(self):
        return B.best_settings(self.scored)

    def selected(self, split="test"):
        b = self.best.select("market", "fold", "cfg")
        return self.trades.filter(F.col("split") == split).join(F.broadcast(b), ["market", "fold", "cfg"])


def setups(m):
    return stored(B.setups(m.panel_view(), m.bars), "setups", m.path, ["symbol"], ["symbol", "confirmed"])


def study(m, name="base", **kw):
    return Study(m, "_".join([name, *(f"{k}{v}" for k, v in sorted(kw.items()))]).lower(), **kw)


@query("retest_setups", "setup", f"SELECT symbol, confirmed, {q('pl2 - 0.1 * pa')} AS stop, {q('pb')} AS pullback_ratio, {q('rb')} AS rebound_ratio, {q('slope', 5)} AS slope, a21 AS above21, a50 AS above50, {q('d21')} AS dist21, {q('d50')} AS dist50 FROM setup")
def _setups(m):
    d = setups(m)
    return d.select("symbol", F.col("confirmed").cast("long").alias("confirmed"), *[report(c, n).alias(c) for c, n in (("stop", 4), ("pullback_ratio", 4), ("rebound_ratio", 4), ("slope", 5), ("dist21", 4), ("dist50", 4))], "above21", "above50")


@query("barrier_exits", "out", f"SELECT symbol, confirmed, CAST(delay AS BIGINT) AS delay, split, ei AS entry_idx, xi AS exit_idx, why AS exit_reason, {q('entry')} AS entry, {q('x')} AS exit_price, {q('gross')} AS gross_pct, {q('ret')} AS return_pct, {q('r')} AS r_multiple, {q('og')} AS open_gap_pct FROM out")
def _exits(m):
    d = study(m).outcomes
    return d.select("symbol", *[F.col(c).cast("long").alias(c) for c in ("confirmed", "delay", "entry_idx", "exit_idx")], "split", "exit_reason", *[report(c).alias(c) for c in ("entry", "exit_price", "gross_pct", "return_pct", "r_multiple", "open_gap_pct")])


@query("eligible_setups", "trades_c", "SELECT cfg, market, split, count(*) AS setups, count(DISTINCT symbol) AS symbols FROM trades_c GROUP BY cfg, market, split")
def _eligible(m):
    s = study(m)
    d = B.eligible(s.outcomes, s.grid).groupBy("cfg", "market", "split", "symbol").agg(F.count(F.lit(1)).alias("k"))
    return d.groupBy(F.col("cfg").cast("long").alias("cfg"), "market", "split").agg(F.sum("k").cast("double").alias("setups"), F.count(F.lit(1)).alias("symbols")).withColumn("setups", F.col("setups").cast("long"))


@query("strategy_trades", "trades", f"SELECT symbol, cfg, split, confirmed, ei AS entry_idx, xi AS exit_idx, why AS exit_reason, {q('ret')} AS return_pct, {q('r')} AS r_multiple FROM trades")
def _trades(m):
    d = study(m).trades
    return d.select("symbol", *[F.col(c).cast("long").alias(c) for c in ("cfg", "confirmed", "entry_idx", "exit_idx")], "split", "exit_reason", report("return_pct").alias("return_pct"), report("r_multiple").alias("r_multiple"))


@query("trade_summary", "trades", f"SELECT market, split, cfg, trades, {_SUMQ} FROM ({summary_sql('market, split, cfg', 'trades')})")
def _tsum(m):
    d = B.summarize_trades(study(m).trades, ["market", "split", "cfg"])
    return d.select("market", "split", F.col("cfg").cast("long").alias("cfg"), "trades", *_sumc())


@query("best_settings", "scored_b", f"SELECT market, cfg, CAST(line AS BIGINT) AS line, CAST(delay AS BIGINT) AS delay, tol AS tolerance, trades, {q('objective', 5)} AS objective FROM scored_b")
def _best(m):
    return study(m).best.select("market", *[F.col(c).cast("long").alias(c) for c in ("cfg", "line", "delay")], "tolerance", "trades", report("objective", 5).alias("objective"))


@query("top_settings", "scored", f"SELECT market, cfg, trades, {q('objective', 5)} AS objective, place FROM (SELECT *, row_number() OVER (PARTITION BY market ORDER BY objective DESC, cfg) AS place FROM scored WHERE objective > -900) WHERE place <= 10")
def _top(m):
    d = B.top_settings(study(m).scored)
    return d.select("market", F.col("cfg").cast("long").alias("cfg"), "trades", report("objective", 5).alias("objective"), F.col("place").cast("long").alias("place"))


_same = {c: f"s.{c} IS NOT DISTINCT FROM b.{c}" for c in ("delay", "line", "tol", "pv", "rv", "sl")}
_FACT = {"entry_delay": ["delay"], "retest_line": ["line"], "atr_tolerance": ["tol"], "volume_filter": ["pv", "rv"], "smma200_slope": ["sl"]}


@query("factor_analysis", "scored scored_b", " UNION ALL ".join(
    f"SELECT s.market, '{f}' AS factor, s.cfg, s.trades, {q('s.objective', 5)} AS objective FROM scored s JOIN scored_b b ON s.market = b.market AND " + " AND ".join(v for k, v in _same.items() if k not in free) for f, free in _FACT.items()))
def _factor(m):
    s = study(m)
    return B.factor_analysis(s.scored, s.best).select("market", "factor", F.col("cfg").cast("long").alias("cfg"), "trades", report("objective", 5).alias("objective"))


cte("sel", "trades scored_b", "SELECT t.* FROM trades t JOIN scored_b b ON t.market = b.market AND t.cfg = b.cfg WHERE t.split = 'test'")


@query("cost_stress", "sel", f"""SELECT market, extra, count(*) AS trades, {q(he('avg(r2)', 4))} AS avg_return_pct, {q(he('avg(CAST(r2 > 0 AS DOUBLE)) * 100', 2), 2)} AS win_rate_pct, {q(he('coalesce(sum(r2) FILTER (r2 > 0), 0) / abs(nullif(sum(r2) FILTER (r2 < 0), 0))', 4))} AS profit_factor FROM (
  SELECT market, extra, gross - cost - extra AS r2 FROM sel, (SELECT unnest([0.00, 0.10, 0.25, 0.50]::DOUBLE[]) AS extra)) GROUP BY market, extra""")
def _cost(m):
    d = B.cost_stress(study(m).selected())
    return d.select("market", "extra", "trades", report("avg_return_pct").alias("avg_return_pct"), report("win_rate_pct", 2).alias("win_rate_pct"), report("profit_factor").alias("profit_factor"))


cte("ctx", "sel panel brg evd", """SELECT s.*, p.turnover, coalesce(g.regime, 'UNKNOWN') AS regime, d.event_distance FROM sel s JOIN panel p ON p.symbol = s.symbol AND p.idx = s.ei LEFT JOIN brg g ON g.bar_date = p.bar_date LEFT JOIN evd d ON d.symbol = s.symbol AND d.idx = s.ei""")
cte("evd", "bars event_dates", """SELECT b.symbol, b.idx, min_by(p.pos - b.idx, row(abs(p.pos - b.idx), p.pos)) AS event_distance FROM bars b LEFT JOIN (
  SELECT e.symbol, coalesce(min(x.idx) FILTER (x.bar_date >= e.event_date), max(x.idx)) AS pos FROM event_dates e JOIN bars x ON e.symbol = x.symbol GROUP BY e.symbol, e.event_date) p ON b.symbol = p.symbol GROUP BY b.symbol, b.idx""")
cte("diag", "ctx", """SELECT *, 'market_regime' AS attribute, regime AS value FROM ctx UNION ALL SELECT *, 'earnings_proximity', CASE WHEN event_distance IS NULL THEN 'unavailable' WHEN abs(event_distance) <= 5 THEN 'within_5_bars' ELSE 'outside_5_bars' END FROM ctx
  UNION ALL SELECT * EXCLUDE (lo, hi), 'liquidity', CASE WHEN turnover <= lo THEN 'low' WHEN turnover <= hi THEN 'mid' ELSE 'high' END FROM (SELECT *, quantile_cont(turnover, 1.0/3) OVER (PARTITION BY market) AS lo, quantile_cont(turnover, 2.0/3) OVER (PARTITION BY market) AS hi FROM ctx)""")


@query("strategy_diagnostics", "diag", f"SELECT market, attribute, value, trades, {_SUMQ} FROM ({summary_sql('market, attribute, value', 'diag')})")
def _diag(m):
    t = B.with_context(study(m).selected(), m.panel_view(), regime_by_date(m.benchmark), J.event_distance(m.bars, m.event_dates))
    return B.diagnostics(t).select("market", "attribute", "value", "trades", *_sumc())


cte("slopegrid", "scored_b", f"SELECT market AS gm, i AS cfg, line, delay, tol, pv, rv, {vals(B.SLOPE_LEVELS)}[i + 1] AS sl FROM scored_b, range(0, {len(B.SLOPE_LEVELS)}) t(i)")
greedy_cte("slopetrades", "out", "slopegrid", "AND o.market = g.gm")


@query("slope_sensitivity", "slopetrades", f"SELECT market, cfg AS level, split, trades, {_SUMQ} FROM ({summary_sql('market, cfg, split', 'slopetrades')})")
def _slope(m):
    s = study(m)
    t = written(B.apply_settings(s.outcomes, B.slope_variants(s.best), ("market",)), "slope-trades")
    return B.summarize_trades(t, ["market", "cfg", "split"]).select("market", F.col("cfg").cast("long").alias("level"), "split", "trades", *_sumc())


for _n, _sc, _tr, _args in (("walk_forward_quarterly", "scoredq", "tradesq", (*B.QUARTERLY, _QF)), ("walk_forward_monthly", "scoredm", "tradesm", (*B.MONTHLY, _MF))):
    cte(f"{_n}_t", f"{_tr} {_sc}_b", f"SELECT t.* FROM {_tr} t JOIN {_sc}_b b ON t.market = b.market AND t.fold = b.fold AND t.cfg = b.cfg WHERE split = 'test'")
    cte(_n, f"{_n}_t", summary_sql("market, fold", f"{_n}_t"))

    def _wf(m, n=_n, a=_args):
        s = study(m, n.split("_")[-1], train=a[0], test=a[1], folds=a[2], check=True)
        d, _t = B.walk_forward(s.trades, s.scored)
        return d.select("market", *[F.col(c).cast("long").alias(c) for c in ("fold", "cfg")], "train_trades", "trades", *_sumc())

    query(_n, f"{_n} {_sc}_b", f"SELECT b.market, CAST(b.fold AS BIGINT) AS fold, b.cfg, b.trades AS train_trades, coalesce(w.trades, 0) AS trades, " + ", ".join(f"{q('w.' + c, d)} AS {c}" for c, d in _SUM) + f" FROM {_sc}_b b LEFT JOIN {_n} w ON w.market = b.market AND w.fold = b.fold")(_wf)


@query("positive_folds", "walk_forward_quarterly scoredq_b", f"SELECT b.market, count(*) AS folds, count(*) FILTER (w.avg_r > 0) AS positive_folds, {q('count(*) FILTER (w.avg_r > 0) / count(*)')} AS positive_ratio FROM scoredq_b b LEFT JOIN walk_forward_quarterly w USING (market, fold) GROUP BY b.market")
def _posf(m):
    s = study(m, "quarterly", train=B.QUARTERLY[0], test=B.QUARTERLY[1], folds=_QF, check=True)
    d, _t = B.walk_forward(s.trades, s.scored)
    return B.positive_folds(d).withColumn("positive_ratio", report("positive_ratio"))


@query("validation_verdict", "scored_b sel walk_forward_quarterly_t walk_forward_quarterly scoredq_b", f"""SELECT l.market, CASE WHEN {{l}} AND {{w}} AND coalesce(f.ratio, 0) >= 0.75 THEN 'accepted' WHEN {{l}} AND w.trades IS NULL THEN 'provisional' ELSE 'rejected' END AS verdict
  FROM ({summary_sql('market', 'sel')}) l LEFT JOIN ({summary_sql('market', 'walk_forward_quarterly_t')}) w USING (market) LEFT JOIN (SELECT b.market, count(*) FILTER (w.avg_r > 0) / count(*) AS ratio FROM scoredq_b b LEFT JOIN walk_forward_quarterly w USING (market, fold) GROUP BY b.market) f USING (market)"""
       .replace("{l}", "coalesce(l.trades >= 30 AND l.avg_r > 0 AND l.profit_factor > 1 AND l.r_ci_low > 0, FALSE)").replace("{w}", "coalesce(w.trades >= 30 AND w.avg_r > 0 AND w.profit_factor > 1 AND w.r_ci_low > 0, FALSE)"))
def _verdict(m):
    latest = B.summarize_trades(written(study(m).selected(), "selected"), ["market"]).select("market", F.struct("trades", "avg_r", "profit_factor", "r_ci_low").alias("latest"))
    s = study(m, "quarterly", train=B.QUARTERLY[0], test=B.QUARTERLY[1], folds=_QF, check=True)
    d, t = B.walk_forward(s.trades, s.scored)
    roll = B.summarize_trades(t, ["market"]).select("market", F.struct("trades", "avg_r", "profit_factor", "r_ci_low").alias("rolling"))
    j = latest.join(roll, "market", "left").join(B.positive_folds(d).select("market", "positive_ratio"), "market", "left")
    return j.select("market", B.verdict(F.lit(True), F.col("latest"), F.col("rolling"), F.col("positive_ratio")).alias("verdict"))


# -- zones on portfolio returns ---------------------------------------------------------------

cte("zs", "moves panel", "SELECT v.market, v.bar_date, avg(v.ret) AS ret, avg(p.atr / p.close) AS atr FROM moves v JOIN panel p USING (symbol, idx) WHERE v.ret IS NOT NULL AND p.atr IS NOT NULL GROUP BY v.market, v.bar_date")
cte("zs1", "zs", "SELECT *, row_number() OVER (PARTITION BY market ORDER BY bar_date) - 1 AS t, count(*) OVER (PARTITION BY market) AS n FROM zs")
cte("zs2", "zs1", "SELECT a.market, a.t, a.atr, b.t - a.t AS j, exp(sum(ln(1 + b.ret)) OVER (PARTITION BY a.market, a.t ORDER BY b.t)) AS g FROM zs1 a JOIN zs1 b ON a.market = b.market AND b.t BETWEEN a.t + 1 AND a.t + 20 WHERE a.t >= 30 AND a.t < a.n - 20")


@query("zone_first_hit", "zs2", f"""SELECT market, zone, {q('avg(CAST(win AS DOUBLE)) * 100', 3)} AS win_prob, {q('avg(ret) * 100', 5)} AS expected_return_pct, {q('avg(hold)', 4)} AS avg_hold_days, {q('coalesce(avg(lost), 0) * 100', 5)} AS avg_failed_loss_pct,
  {q('avg(ret) / (stddev_pop(ret) + 1e-9) * sqrt(252 / greatest(avg(hold), 1))', 3)} AS sharpe_proxy FROM (SELECT *, CASE WHEN win THEN tp - 1 ELSE fin - 1 END AS ret, CASE WHEN win THEN htp ELSE 20 END AS hold, CASE WHEN NOT win THEN least(0, mn - 1) END AS lost FROM (
  SELECT *, htp IS NOT NULL AND (hsl IS NULL OR htp <= hsl) AS win FROM (SELECT market, zone, t, any_value(1 + (1.45 + 0.35 * k) * atr) AS tp, min(j) FILTER (g / (1 - k * atr) >= 1 + (1.45 + 0.35 * k) * atr) AS htp, min(j) FILTER (g / (1 - k * atr) <= 1 - (0.95 + 0.25 * k) * atr) AS hsl,
  max_by(g / (1 - k * atr), j) AS fin, min(g / (1 - k * atr)) AS mn FROM zs2, (VALUES ('A', 0.45::DOUBLE), ('B', 0.875::DOUBLE), ('C', 1.4::DOUBLE)) z(zone, k) GROUP BY market, zone, t))) GROUP BY market, zone""")
def _zfh(m):
    d = ind.with_tr(segmented(m.bars, 20)).withColumns({"ret": F.col("close") / back("close") - 1, "atr": ind.atr_warm()})
    d = own_rows(d).filter("ret is not null and atr is not null").select("symbol", "bar_date", "ret", (F.col("atr") / F.col("close")).alias("a")).join(m.universe.select("symbol", "market"), "symbol")
    s = d.groupBy("market", "bar_date").agg(F.avg("ret").alias("ret"), F.avg("a").alias("atr"))
    r = B.zone_first_hit(s, ["market"])
    return r.select("market", "zone", report("win_prob", 3).alias("win_prob"), report("expected_return_pct", 5).alias("expected_return_pct"), report("avg_hold_days", 4).alias("avg_hold_days"), report("avg_failed_loss_pct", 5).alias("avg_failed_loss_pct"), report("sharpe_proxy", 3).alias("sharpe_proxy"))
