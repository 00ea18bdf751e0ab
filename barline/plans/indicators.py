"""Bars and indicators."""

from pyspark.sql import functions as F

from barline.functions.numeric import report
from barline.operators import indicators as ind
from barline.plans import sqlbars  # noqa: F401
from barline.plans.registry import q, query
from barline.series import by_symbol, own_rows, segmented


def frame(m, lookback: int = 260, lookahead: int = 0):
    return segmented(m.bars, lookback, lookahead)


def shown(df, *cols, **digits):
    """Key columns plus the listed ones, doubles rounded for output."""
    return own_rows(df).select(
        "symbol", F.col("bar_idx").cast("long").alias("bar_idx"),
        *[c for c in cols], *[report(c, d).alias(c) for c, d in digits.items()]
    )


_W = "OVER (PARTITION BY symbol ORDER BY idx ROWS BETWEEN {} PRECEDING AND CURRENT ROW)"


def over(n: int) -> str:
    return _W.format(n - 1)


@query("bars", "bars", "SELECT symbol, CAST(bar_date AS VARCHAR) AS bar_date, open, high, low, close, volume, CAST(idx AS BIGINT) AS bar_idx FROM bars")
def _bars(m):
    return m.bars.select("symbol", F.col("bar_date").cast("string").alias("bar_date"), "open", "high", "low", "close", "volume",
                         F.col("bar_idx").cast("long").alias("bar_idx"))


@query("sma", "bars", "SELECT symbol, idx AS bar_idx, " + ", ".join(
    f"CASE WHEN idx >= {n - 1} THEN {q(f'avg(close) {over(n)}', 4)} END AS sma{n}" for n in (5, 20, 60, 120, 200)) + " FROM bars")
def _sma(m):
    df = frame(m).withColumns({f"sma{n}": ind.sma(n) for n in (5, 20, 60, 120, 200)})
    return shown(df, **{f"sma{n}": 4 for n in (5, 20, 60, 120, 200)})


@query("ema", "rec", f"SELECT symbol, idx AS bar_idx, {q('ema20')} AS ema20 FROM rec")
def _ema(m):
    return shown(ind.with_ema20(frame(m, 450)), ema20=4)


@query("smma", "rec", f"SELECT symbol, idx AS bar_idx, {q('smma21')} AS smma21, {q('smma50')} AS smma50, {q('smma200')} AS smma200 FROM rec")
def _smma(m):
    return shown(ind.with_smma(frame(m, 8000), 21, 50, 200), smma21=4, smma50=4, smma200=4)


@query("true_range", "tr", f"SELECT symbol, idx AS bar_idx, {q('tr')} AS tr FROM tr")
def _tr(m):
    return shown(ind.with_tr(frame(m, 1)), tr=4)


@query("atr_wilder", "rec", f"SELECT symbol, idx AS bar_idx, {q('atrw', 5)} AS atr_wilder FROM rec")
def _atrw(m):
    return shown(ind.with_atr_wilder(ind.with_tr(frame(m, ind.WILDER14))), atr_wilder=5)


@query("atr_simple", "tr", f"SELECT symbol, idx AS bar_idx, {q('avg(coalesce(tr, high - low)) ' + over(14), 5)} AS atr_simple FROM tr")
def _atrs(m):
    return shown(ind.with_atr_simple(frame(m, 20)), atr_simple=5)


@query("atr_warmup", "tr", f"SELECT symbol, idx AS bar_idx, CASE WHEN idx >= 13 THEN {q('avg(coalesce(tr, high - low)) ' + over(14), 5)} END AS atr FROM tr")
def _atr14(m):
    return shown(ind.with_tr(frame(m, 20)).withColumn("atr", ind.atr_warm()), atr=5)


@query("index_volatility", "tr", f"SELECT symbol, {q('v')} AS vol_pct FROM (SELECT symbol, idx, n, avg(tr) {over(14)} / close * 100 AS v FROM tr) WHERE idx = n - 1")
def _ivol(m):
    df = ind.with_tr(frame(m, 20)).withColumn("vol_pct", ind.index_volatility_pct())
    return own_rows(df).filter("bar_idx = n_bars - 1").select("symbol", report("vol_pct").alias("vol_pct"))


@query("adx", "adx", f"""SELECT symbol, idx AS bar_idx, {q('adx')} AS adx, CASE WHEN adx IS NOT NULL THEN {q('dip')} END AS plus_di,
  CASE WHEN adx IS NOT NULL THEN {q('dim')} END AS minus_di FROM adx""")
def _adx(m):
    return shown(ind.with_adx(ind.with_tr(frame(m, ind.WILDER14))), adx=4, plus_di=4, minus_di=4)


@query("rsi", "rec", f"SELECT symbol, idx AS bar_idx, CASE WHEN al IS NOT NULL THEN CASE WHEN al = 0 THEN 100.0 ELSE {q('100 - 100 / (1 + ag / al)')} END END AS rsi FROM rec")
def _rsi(m):
    return shown(ind.with_rsi(frame(m, ind.WILDER14)), rsi=4)


@query("macd", "macd0 sig", f"SELECT symbol, idx AS bar_idx, {q('macd', 5)} AS macd, {q('sig', 5)} AS macd_signal FROM macd0 JOIN sig USING (symbol, idx)")
def _macd(m):
    return shown(ind.with_macd(frame(m, 760)), macd=5, macd_signal=5)


@query("stochastic", "bars", f"""SELECT symbol, idx AS bar_idx, {q('k')} AS stoch_k, CASE WHEN count(k) {over(3)} = 3 THEN {q('avg(k) ' + over(3))} END AS stoch_d FROM (
  SELECT *, CASE WHEN idx >= 13 AND hi <> lo THEN 100 * (close - lo) / (hi - lo) END AS k FROM (
  SELECT *, min(low) {over(14)} AS lo, max(high) {over(14)} AS hi FROM bars))""")
def _stoch(m):
    df = frame(m, 20).withColumn("stoch_k", ind.stochastic_k()).withColumn("stoch_d", ind.stochastic_d())
    return shown(df, stoch_k=4, stoch_d=4)


@query("bollinger", "bars", f"""SELECT symbol, idx AS bar_idx, CASE WHEN idx >= 19 THEN {q('m')} END AS bb_middle,
  CASE WHEN idx >= 19 THEN {q('m + 2 * s')} END AS bb_upper, CASE WHEN idx >= 19 THEN {q('m - 2 * s')} END AS bb_lower
  FROM (SELECT *, avg(close) {over(20)} AS m, stddev_pop(close) {over(20)} AS s FROM bars)""")
def _bb(m):
    return shown(frame(m, 20).withColumns(ind.bollinger()), bb_middle=4, bb_upper=4, bb_lower=4)


@query("obv", "tr", "SELECT symbol, idx AS bar_idx, sum(coalesce(sign(close - pc) * volume, 0.0)) OVER (PARTITION BY symbol ORDER BY idx ROWS UNBOUNDED PRECEDING) AS obv FROM tr")
def _obv(m):
    df = own_rows(frame(m, 1).withColumn("signed_volume", ind.signed_volume())).withColumn("obv", ind.obv())
    return df.select("symbol", F.col("bar_idx").cast("long").alias("bar_idx"), "obv")


@query("aroon", "bars", f"""SELECT symbol, idx AS bar_idx, CASE WHEN idx >= 25 THEN {q('100.0 * (25 - (idx - hi)) / 25')} END AS aroon_up,
  CASE WHEN idx >= 25 THEN {q('100.0 * (25 - (idx - lo)) / 25')} END AS aroon_down FROM (
  SELECT symbol, idx, max(row(high, idx)) {over(26)} AS h, min(row(low, -idx)) {over(26)} AS l, struct_extract(max(row(high, idx)) {over(26)}, 2) AS hi,
  -struct_extract(min(row(low, -idx)) {over(26)}, 2) AS lo FROM bars)""")
def _aroon(m):
    return shown(frame(m, 30).withColumns(ind.aroon()), aroon_up=4, aroon_down=4)


@query("buy_pressure", "bars", f"""SELECT symbol, idx AS bar_idx, CASE WHEN idx >= 13 THEN {q(f'sum(volume * place) {over(14)} / sum(volume) {over(14)}')} END AS buy_pressure
  FROM (SELECT *, CASE WHEN high = low THEN 0.5 ELSE (close - low) / (high - low) END AS place FROM bars)""")
def _bp(m):
    return shown(frame(m, 20).withColumn("buy_pressure", ind.buy_pressure()), buy_pressure=4)


@query("parabolic_sar", "bars psar", f"SELECT symbol, idx AS bar_idx, CASE WHEN idx >= 1 THEN {q('sar')} END AS psar FROM psar")
def _psar(m):
    df = ind.parabolic_sar(m.bars)
    return df.select("symbol", F.col("bar_idx").cast("long").alias("bar_idx"), report(F.nanvl("psar", F.lit(None))).alias("psar"))


@query("volume_ratio", "bars", f"""SELECT symbol, idx AS bar_idx, CASE WHEN idx >= 20 AND p > 0 THEN {q('volume / p')} ELSE 1.0 END AS ratio_prior,
  CASE WHEN idx >= 19 AND i > 0 THEN {q('volume / i')} ELSE 1.0 END AS ratio_inclusive, {q('volume / pos')} AS ratio_positive
  FROM (SELECT *, avg(volume) OVER (PARTITION BY symbol ORDER BY idx ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS p, avg(volume) {over(20)} AS i,
  avg(CASE WHEN volume > 0 THEN volume END) OVER (PARTITION BY symbol ORDER BY idx ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS pos FROM bars)""")
def _vr(m):
    df = frame(m, 25).withColumns({"ratio_prior": ind.volume_ratio_prior(), "ratio_inclusive": ind.volume_ratio_inclusive(),
                                   "ratio_positive": ind.volume_ratio_positive()})
    return shown(df, ratio_prior=4, ratio_inclusive=4, ratio_positive=4)


@query("efficiency_ratio", "tr", f"""SELECT symbol, idx AS bar_idx, CASE WHEN idx >= 19 THEN CASE WHEN path = 0 THEN 0.0 ELSE {q('least(abs(close - c19) / path * 100, 100.0)')} END ELSE 0.0 END AS efficiency
  FROM (SELECT *, lag(close, 19) OVER (PARTITION BY symbol ORDER BY idx) AS c19, sum(abs(close - pc)) {over(19)} AS path FROM tr)""")
def _eff(m):
    return shown(frame(m, 25).withColumn("abs_move", ind.abs_move()).withColumn("efficiency", ind.efficiency()), efficiency=4)


@query("rolling_highs", "bars", f"""SELECT symbol, idx AS bar_idx, h20 AS high_20, h55 AS high_55, {q('greatest(0.0, (h20 - close) / close * 100)')} AS distance_pct
  FROM (SELECT *, max(high) {over(20)} AS h20, max(high) {over(55)} AS h55 FROM bars)""")
def _highs(m):
    df = frame(m, 60).withColumns({"high_20": ind.high_of(20), "high_55": ind.high_of(55)}).withColumn("distance_pct", ind.distance_to_high_pct())
    return shown(df, "high_20", "high_55", distance_pct=4)


_CHASE = f"""SELECT symbol, idx, max(f20) {over(5)} = 1 AND idx >= 24 AS chasing_20, max(f55) {over(5)} = 1 AND idx >= 24 AS chasing_55 FROM (
  SELECT symbol, idx, CASE WHEN idx >= 20 AND close > max(high) OVER (PARTITION BY symbol ORDER BY idx ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS f20,
  CASE WHEN idx >= 55 AND close > max(high) OVER (PARTITION BY symbol ORDER BY idx ROWS BETWEEN 55 PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS f55 FROM bars)"""


@query("chasing_flags", "bars", _CHASE.replace("symbol, idx, max(f20)", "symbol, idx AS bar_idx, max(f20)", 1))
def _chase(m):
    return shown(with_chasing(frame(m, 65)), "chasing_20", "chasing_55")


def with_chasing(df):
    df = df.withColumns({"_f20": ind.above_prior_high(20), "_f55": ind.above_prior_high(55)})
    return df.withColumns({"chasing_20": ind.chasing("_f20"), "chasing_55": ind.chasing("_f55")}).drop("_f20", "_f55")


@query("atr_shock", "tr rec", f"""SELECT symbol, idx AS bar_idx, {q('old', 5)} AS old_atr, coalesce(old > 0 AND atrw >= old * 1.3, FALSE) AS atr_spiking,
  coalesce(old > 0 AND atrw <= old * 0.5, FALSE) AS atr_collapsing FROM (
  SELECT symbol, idx, CASE WHEN idx >= 34 THEN avg(tr) OVER (PARTITION BY symbol ORDER BY idx ROWS BETWEEN 33 PRECEDING AND 20 PRECEDING) END AS old FROM tr) JOIN rec USING (symbol, idx)""")
def _shock(m):
    df = ind.with_atr_wilder(ind.with_tr(frame(m, ind.WILDER14))).withColumn("old_atr", ind.old_atr())
    return shown(df.withColumns({"atr_spiking": ind.atr_spiking(), "atr_collapsing": ind.atr_collapsing()}), "atr_spiking", "atr_collapsing", old_atr=5)


@query("relative_strength", "bars bench", f"""SELECT symbol, {q("((c1 / c64 - 1) - (b1 / b64 - 1)) * 100")} AS rs_63, {q("((c1 / c0 - 1) - (b1 / b0 - 1)) * 100")} AS rs_all
  FROM (SELECT symbol, max(CASE WHEN idx = n - 1 THEN close END) AS c1, max(CASE WHEN idx = n - 64 THEN close END) AS c64, max(CASE WHEN idx = 0 THEN close END) AS c0 FROM bars GROUP BY symbol),
  (SELECT max(CASE WHEN idx = n - 1 THEN close END) AS b1, max(CASE WHEN idx = n - 64 THEN close END) AS b64, max(CASE WHEN idx = 0 THEN close END) AS b0 FROM bench)""")
def _rs(m):
    from barline.operators.joins import relative_strength

    return relative_strength(m.bars, m.benchmark).select("symbol", report("rs_63").alias("rs_63"), report("rs_all").alias("rs_all"))


_BIS = """CASE WHEN high > low AND abs(close - open) / (high - low) > 0.6 THEN 5 WHEN high > low AND abs(close - open) / (high - low) >= 0.4 THEN 2 ELSE 0 END
  + CASE WHEN v10 > 0 AND volume / v10 > 1.5 THEN 5 WHEN v10 > 0 AND volume / v10 >= 1.0 THEN 2 ELSE 0 END
  + CASE WHEN high > low AND (close - low) / (high - low) >= 0.7 THEN 5 WHEN high > low AND (close - low) / (high - low) >= 0.3 THEN 2 ELSE 0 END"""


@query("breakout_integrity", "bars", f"""SELECT symbol, idx AS bar_idx, CAST({_BIS} AS BIGINT) AS bis FROM (
  SELECT *, CASE WHEN idx >= 10 THEN avg(volume) OVER (PARTITION BY symbol ORDER BY idx ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) ELSE 0 END AS v10 FROM bars)""")
def _bis(m):
    df = frame(m, 15).withColumn("avg_volume_10", ind.avg_volume_prior()).withColumn("bis", ind.breakout_integrity().cast("long"))
    return shown(df, "bis")


@query("percent_change", "bars", "SELECT symbol, idx AS bar_idx, " + ", ".join(
    f"{q(f'(close - lag(close, {k}) OVER (PARTITION BY symbol ORDER BY idx)) / lag(close, {k}) OVER (PARTITION BY symbol ORDER BY idx) * 100')} AS change_{k}" for k in (5, 10)) + " FROM bars")
def _chg(m):
    return shown(frame(m, 12).withColumns({f"change_{k}": ind.change_pct(k) for k in (5, 10)}), change_5=4, change_10=4)


@query("year_range", "bars", f"""SELECT symbol, idx AS bar_idx, hi AS high_52w, lo AS low_52w, {q('CASE WHEN hi > lo THEN (close - lo) / (hi - lo) * 100 END')} AS pos_52w_pct,
  CASE WHEN idx >= 1 THEN {q('(close - f20) / f20 * 100')} END AS change_20d_pct, {q('(close - hi) / hi * 100')} AS from_high_pct FROM (
  SELECT *, max(high) {over(252)} AS hi, min(low) {over(252)} AS lo, first_value(close) {over(20)} AS f20 FROM bars)""")
def _yr(m):
    return shown(ind.with_year_range(frame(m, 252)), "high_52w", "low_52w", pos_52w_pct=4, change_20d_pct=4, from_high_pct=4)


@query("volume_spike", "bars", f"""SELECT symbol, idx AS bar_idx, coalesce(volume > 0 AND v > 0 AND volume / v >= 2.0, FALSE) AS volume_spike FROM (
  SELECT *, round(avg(CASE WHEN volume <> 0 THEN volume END) {over(20)}) AS v FROM bars)""")
def _spike(m):
    return shown(frame(m, 20).withColumn("volume_spike", ind.volume_spike()), "volume_spike")


_SLOPE = "CASE WHEN lag(smma200, 20) OVER (PARTITION BY symbol ORDER BY idx) > 0 THEN (smma200 - lag(smma200, 20) OVER (PARTITION BY symbol ORDER BY idx)) / lag(smma200, 20) OVER (PARTITION BY symbol ORDER BY idx) * 100 ELSE 0.0 END"


@query("smma_slope", "rec", f"SELECT symbol, idx AS bar_idx, {q(_SLOPE, 5)} AS smma200_slope FROM rec")
def _slope(m):
    return shown(ind.with_smma(frame(m, 8000), 200).withColumn("smma200_slope", ind.smma_slope_pct()), smma200_slope=5)


@query("trend_regime", "rec bars", f"""SELECT symbol, idx AS bar_idx, CASE WHEN smma200 IS NOT NULL AND idx >= 20 THEN CASE WHEN close > smma200 AND sl > 0.10 THEN 'BULL'
  WHEN close < smma200 AND sl < -0.10 THEN 'BEAR' ELSE 'SIDEWAYS' END END AS regime FROM (SELECT symbol, idx, smma200, {_SLOPE} AS sl FROM rec) JOIN bars USING (symbol, idx)""")
def _regime(m):
    df = ind.with_smma(frame(m, 8000), 200).withColumn("smma200_slope", ind.smma_slope_pct())
    return shown(df.withColumn("regime", ind.trend_regime()), "regime")


@query("turnover", "bars", f"SELECT symbol, idx AS bar_idx, coalesce({q('avg(close * volume) OVER (PARTITION BY symbol ORDER BY idx ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)', 3)}, 0.0) AS turnover_20 FROM bars")
def _turn(m):
    return shown(frame(m, 20).withColumn("turnover_20", ind.turnover_before()), turnover_20=3)


@query("support_zones", "bars", f"""SELECT symbol, idx AS bar_idx, CASE WHEN len(l30) >= 5 THEN {q('list_sum(list_sort(l30)[1:5]) / 5')} END AS support_zone,
  CASE WHEN len(l20) >= 3 THEN {q('list_sum(list_sort(l20)[1:3]) / 3')} END AS strong_support FROM (SELECT symbol, idx, list(low) {over(30)} AS l30, list(low) {over(20)} AS l20 FROM bars)""")
def _support(m):
    df = frame(m, 30).withColumns({"support_zone": ind.lowest_mean(30, 5), "strong_support": ind.lowest_mean(20, 3)})
    return shown(df, support_zone=4, strong_support=4)


@query("volatility_expansion", "tr", f"""SELECT symbol, idx AS bar_idx, coalesce(count(atr) {over(20)} = 20 AND avg(atr) {over(5)} / avg(atr) OVER (PARTITION BY symbol ORDER BY idx ROWS BETWEEN 19 PRECEDING AND 5 PRECEDING) > 1.3, FALSE) AS expanding
  FROM (SELECT symbol, idx, CASE WHEN idx >= 13 THEN avg(coalesce(tr, high - low)) {over(14)} END AS atr FROM tr)""")
def _expand(m):
    df = ind.with_tr(frame(m, 40)).withColumn("atr", ind.atr_warm())
    return shown(df.withColumn("expanding", ind.expanding_volatility("atr")), "expanding")


@query("vwap_fibonacci", "bars", f"""SELECT symbol, idx AS bar_idx, CASE WHEN idx >= 19 THEN {q(f'sum(close * volume) {over(20)} / sum(volume) {over(20)}')} END AS vwap,
  {q('hi - 0.382 * (hi - lo)')} AS fib_382, {q('hi - 0.5 * (hi - lo)')} AS fib_500, {q('hi - 0.618 * (hi - lo)')} AS fib_618
  FROM (SELECT *, max(high) {over(60)} AS hi, min(low) {over(60)} AS lo FROM bars)""")
def _vwap(m):
    return shown(frame(m, 60).withColumn("vwap", ind.vwap()).withColumns(ind.fibonacci()), vwap=4, fib_382=4, fib_500=4, fib_618=4)


@query("pivot_levels", "tr", f"""SELECT symbol, idx AS bar_idx, {q('p')} AS pivot, {q('2 * p - pl')} AS r1, {q('2 * p - ph')} AS s1, {q('p + (ph - pl)')} AS r2, {q('p - (ph - pl)')} AS s2
  FROM (SELECT *, (ph + pl + pc) / 3 AS p FROM tr)""")
def _piv(m):
    return shown(frame(m, 1).withColumns(ind.pivot_levels()), pivot=4, r1=4, s1=4, r2=4, s2=4)


_LL = "{f}({c}, {k}) OVER (PARTITION BY symbol ORDER BY idx)"


def _frac(c: str, op: str) -> str:
    return "coalesce(" + " AND ".join(f"{c} {op} " + _LL.format(f=f, c=c, k=k) for f, k in (("lag", 2), ("lag", 1), ("lead", 1), ("lead", 2))) + ", FALSE)"


@query("fractals", "bars", f"SELECT symbol, idx AS bar_idx, idx + 2 AS confirmed_idx, u AS upper, l AS lower FROM (SELECT symbol, idx, {_frac('high', '>')} AS u, {_frac('low', '<')} AS l FROM bars) WHERE u OR l")
def _fractals(m):
    df = frame(m, 2, 2).withColumns({"upper": ind.fractal("upper"), "lower": ind.fractal("lower")}).filter("upper or lower")
    return shown(df.withColumn("confirmed_idx", (F.col("bar_idx") + 2).cast("long")), "confirmed_idx", "upper", "lower")


@query("bar_returns", "tr", f"SELECT symbol, idx AS bar_idx, {q('close / pc - 1', 6)} AS ret FROM tr WHERE pc IS NOT NULL")
def _ret(m):
    df = frame(m, 1).withColumn("_p", F.lag("close").over(by_symbol())).filter("_p is not null")
    return shown(df.withColumn("ret", F.col("close") / F.col("_p") - 1), ret=6)
