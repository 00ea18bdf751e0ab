"""Candlesticks, Hurst exponents and forecasts."""

from pyspark.sql import functions as F

from barline.functions import candles
from barline.functions.numeric import report
from barline.operators import forecast as fc, hurst, indicators as ind
from barline.plans.registry import cte, q, query
from barline.series import own_rows, segmented

_lagged = [f"lag({k}, {i}) OVER w AS {k}{i}" for k in (*candles.BASE, *candles.SIZED) for i in range(1, 6)]
cte("candle0", "bars", "SELECT symbol, idx, open AS o, high AS h, low AS l, close AS c, " + ", ".join(
    f"{v} AS {k}" for k, v in candles.BASE.items() if k not in "ohlc") + " FROM bars")
cte("candle1", "candle0", """SELECT *, body > avgb AS big, body < 0.5 * avgb AS small FROM (SELECT *, CASE WHEN idx >= 10 THEN
  avg(body) OVER (PARTITION BY symbol ORDER BY idx ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) END AS avgb FROM candle0)""")
cte("candle", "candle1", "SELECT *, " + ", ".join(_lagged) + " FROM candle1 WINDOW w AS (PARTITION BY symbol ORDER BY idx)")


def _register(name: str, group: dict) -> None:
    sql = " UNION ALL ".join(
        f"SELECT symbol, idx AS bar_idx, '{n}' AS pattern, '{d}' AS direction, CAST({conf} AS BIGINT) AS confidence FROM candle WHERE {t}"
        for n, (d, conf, t) in group.items())

    @query(name, "candle", sql)
    def _run(m):
        found = candles.candlesticks(segmented(m.bars, 16), list(group))
        return own_rows(found).select("symbol", F.col("bar_idx").cast("long").alias("bar_idx"), "pattern", "direction", "confidence")


_register("candles_one_bar", candles.ONE_BAR)
_register("candles_two_bar", candles.TWO_BAR)
_register("candles_three_bar", candles.THREE_BAR)
_register("candles_multi_bar", candles.MULTI_BAR)

cte("hrange", "bars", """
  SELECT symbol, size, chunk, max(dev) - min(dev) AS rng, max(sd) AS sd FROM (
    SELECT *, sum(v - mean) OVER (PARTITION BY symbol, size, chunk ORDER BY idx ROWS UNBOUNDED PRECEDING) AS dev FROM (
      SELECT *, avg(v) OVER (PARTITION BY symbol, size, chunk) AS mean, stddev_pop(v) OVER (PARTITION BY symbol, size, chunk) AS sd
      FROM (SELECT b.symbol, s.size, b.idx // s.size AS chunk, b.idx, b.close AS v FROM bars b, (SELECT unnest(range(2, 20)) AS size) s
            WHERE b.n >= 40 AND (b.idx // s.size) * s.size < b.n - s.size)))
  GROUP BY symbol, size, chunk""")
cte("hurst1", "hrange", """SELECT symbol, round_even(regr_slope(ln(rs), ln(size)) * 1e4, 0) / 1e4 AS hurst FROM (
  SELECT symbol, size, avg(CASE WHEN sd > 0 AND rng / sd > 0 THEN rng / sd END) AS rs, count(*) AS k FROM hrange GROUP BY symbol, size) WHERE rs IS NOT NULL AND k >= 2
  GROUP BY symbol HAVING count(*) >= 3""")
cte("hsize", "", "SELECT CAST(8 AS BIGINT) AS size UNION ALL SELECT greatest(size + 1, size * 3 // 2) FROM hsize WHERE size < 1000000")
cte("hrange2", "tr hsize", """
  SELECT symbol, size, chunk, max(dev) - min(dev) AS rng, max(sd) AS sd FROM (
    SELECT *, sum(v - mean) OVER (PARTITION BY symbol, size, chunk ORDER BY pos ROWS UNBOUNDED PRECEDING) AS dev FROM (
      SELECT *, avg(v) OVER (PARTITION BY symbol, size, chunk) AS mean, stddev_pop(v) OVER (PARTITION BY symbol, size, chunk) AS sd
      FROM (SELECT b.symbol, s.size, b.pos // s.size AS chunk, b.pos, b.v FROM
              (SELECT symbol, idx - 1 AS pos, n - 1 AS k, ln(close / pc) AS v FROM tr WHERE n >= 50 AND pc IS NOT NULL) b,
              hsize s
            WHERE s.size <= b.k // 2 AND (b.pos // s.size + 1) * s.size <= b.k)))
  GROUP BY symbol, size, chunk""")
cte("hurst2", "hrange2", """SELECT symbol, greatest(0.0, least(1.0, regr_slope(ln(rs), ln(size)))) AS hurst FROM (
  SELECT symbol, size, avg(CASE WHEN sd > 0 AND rng / sd > 0 THEN rng / sd END) AS rs FROM hrange2 GROUP BY symbol, size) WHERE rs IS NOT NULL
  GROUP BY symbol HAVING count(*) >= 3""")


@query("hurst_prices", "hurst1", "SELECT symbol, hurst FROM hurst1")
def _h1(m):
    return hurst.hurst_prices(m.bars)


@query("hurst_returns", "hurst2", f"SELECT symbol, {q('hurst', 5)} AS hurst FROM hurst2")
def _h2(m):
    return hurst.hurst_returns(m.bars).select("symbol", report("hurst", 5).alias("hurst"))


cte("trend60", "bars", """SELECT symbol, regr_intercept(close, x) AS level, regr_slope(close, x) AS slope,
  sqrt(greatest(regr_syy(close, x) - regr_slope(close, x) * regr_sxy(close, x), 0) / count(*)) AS sd
  FROM (SELECT *, CAST(idx - n + 1 AS DOUBLE) AS x FROM bars WHERE idx >= n - 60) GROUP BY symbol HAVING count(*) >= 20""")
cte("holt", "bars", """
  SELECT a.symbol, CAST(0 AS BIGINT) AS idx, a.close AS lv, b.close - a.close AS td FROM bars a JOIN bars b ON a.symbol = b.symbol AND a.idx = 0 AND b.idx = 1
  UNION ALL SELECT h.symbol, b.idx, 0.3 * b.close + 0.7 * (h.lv + h.td), 0.1 * (0.3 * b.close + 0.7 * (h.lv + h.td) - h.lv) + 0.9 * h.td
  FROM holt h JOIN bars b ON b.symbol = h.symbol AND b.idx = h.idx + 1""")


@query("forecast", "trend60 holt", f"""SELECT t.symbol, CAST(step AS BIGINT) AS step, {q('level + slope * step')} AS linear, {q('level + slope * step - 1.96 * sd')} AS lower,
  {q('level + slope * step + 1.96 * sd')} AS upper, {q('lv + td * step')} AS holt, {q('(level + slope * step + lv + td * step) / 2')} AS ensemble
  FROM trend60 t JOIN (SELECT h.* FROM holt h JOIN bars b ON h.symbol = b.symbol AND h.idx = b.idx WHERE b.idx = b.n - 1) h ON t.symbol = h.symbol, (SELECT unnest(range(1, 31)) AS step)""")
def _forecast(m):
    f = fc.forecast(m.bars)
    return f.select("symbol", F.col("step").cast("long").alias("step"), *[report(c).alias(c) for c in ("linear", "lower", "upper", "holt", "ensemble")])


@query("best_lookback", "bars", f"""
SELECT symbol, min_by(lookback, row(err, lookback)) AS lookback, {q('min(err)')} AS error FROM (
  SELECT symbol, lookback, round(avg(abs(p - close)), 9) AS err FROM (
    SELECT t.symbol, l.lookback, t.idx, t.close, regr_intercept(b.close, CAST(b.idx - t.idx AS DOUBLE)) AS p
    FROM bars t, (SELECT unnest(range(20, 121, 5)) AS lookback) l, bars b
    WHERE t.idx >= t.n - 12 AND l.lookback <= t.n - 12 AND b.symbol = t.symbol AND b.idx BETWEEN t.idx - l.lookback AND t.idx - 1
    GROUP BY t.symbol, l.lookback, t.idx, t.close) GROUP BY symbol, lookback) GROUP BY symbol""")
def _lookback(m):
    return fc.best_lookback(m.bars).select("symbol", F.col("lookback").cast("long").alias("lookback"), report("error").alias("error"))


@query("history_stage", "bars", """SELECT symbol, count(*) AS bar_count, CASE WHEN count(*) < 20 THEN 'new' WHEN count(*) < 60 THEN 'short' WHEN count(*) < 120 THEN 'limited' ELSE 'sufficient' END AS stage,
  CAST(CASE WHEN count(*) < 20 THEN 45 WHEN count(*) < 60 THEN 60 WHEN count(*) < 120 THEN 75 ELSE 90 END AS BIGINT) AS confidence_cap
  FROM bars GROUP BY symbol""")
def _stage(m):
    d = m.bars.groupBy("symbol").agg(F.count(F.lit(1)).alias("bar_count")).withColumns(ind.history_stage())
    return d.withColumn("confidence_cap", F.col("confidence_cap").cast("long"))
