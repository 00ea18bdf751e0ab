"""Common table expressions of the SQL side: bars, windows over them, and recursive smoothing."""

from barline.plans.registry import cte

cte("steps", "", """
  SELECT l_suppkey AS symbol, l_shipdate AS bar_date, l_quantity AS qty, l_tax AS tax,
         row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS rn,
         SUM(CAST(round((l_discount - 0.05) * 4000) AS BIGINT)) OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_extendedprice
           ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS w,
         CAST(round((l_discount - 0.05) * 4000) AS BIGINT) AS d
  FROM lineitem""")
cte("px", "steps", """
  SELECT symbol, bar_date, rn, qty, tax, 100 * exp(w / 10000.0) AS c,
         100 * exp((w - d) / 10000.0) * (1 + (qty - 25) * 0.0008) AS o FROM steps""")
cte("hl", "px", """
  SELECT *, greatest(o, c) * (1 + tax * 0.1) AS h, least(o, c) * (1 - qty * 0.00016) AS l FROM px""")
cte("rawbars", "hl", """
  SELECT CAST(symbol AS BIGINT) AS symbol, CAST(bar_date AS DATE) AS bar_date,
         round(min_by(o, rn), 4) AS open, round(max(h), 4) AS high, round(min(l), 4) AS low,
         round(max_by(c, rn), 4) AS close, sum(qty) AS volume
  FROM hl GROUP BY symbol, bar_date""")
cte("bars", "rawbars", """
  SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY bar_date) - 1 AS idx,
         count(*) OVER (PARTITION BY symbol) AS n FROM rawbars""")
cte("tr", "bars", """
  SELECT *, CASE WHEN pc IS NOT NULL THEN greatest(high - low, abs(high - pc), abs(low - pc)) END AS tr,
         CASE WHEN pc IS NOT NULL THEN CASE WHEN high - ph > pl - low AND high - ph > 0 THEN high - ph ELSE 0.0 END END AS dmp,
         CASE WHEN pc IS NOT NULL THEN CASE WHEN pl - low > high - ph AND pl - low > 0 THEN pl - low ELSE 0.0 END END AS dmm,
         greatest(close - pc, 0.0) AS gain, greatest(pc - close, 0.0) AS loss
  FROM (SELECT *, lag(close) OVER w AS pc, lag(high) OVER w AS ph, lag(low) OVER w AS pl
        FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY idx))""")
_seed = {
    "s12": ("avg(close)", 12), "s26": ("avg(close)", 26), "s20": ("avg(close)", 20), "s21": ("avg(close)", 21),
    "s50": ("avg(close)", 50), "s200": ("avg(close)", 200), "str": ("avg(tr)", 14), "sdp": ("sum(dmp)", 14),
    "sdm": ("sum(dmm)", 14), "strs": ("sum(tr)", 14), "sg": ("avg(gain)", 14), "sl": ("avg(loss)", 14),
}
cte("seeds", "tr", "SELECT *, " + ", ".join(
    f"{f} OVER (PARTITION BY symbol ORDER BY idx ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) AS {k}"
    for k, (f, n) in _seed.items()) + " FROM tr")


def _step(out: str, x: str, seed: str, first: int, expr: str) -> str:
    return f"CASE WHEN b.idx = {first} THEN b.{seed} WHEN b.idx > {first} THEN {expr.format(y='r.' + out, x='b.' + x)} END AS {out}"


_series = [("ema12", "close", "s12", 11, "{x} * (2.0/13) + {y} * (1 - 2.0/13)"),
           ("ema26", "close", "s26", 25, "{x} * (2.0/27) + {y} * (1 - 2.0/27)"),
           ("ema20", "close", "s20", 19, "{x} * (2.0/21) + {y} * (1 - 2.0/21)"),
           ("smma21", "close", "s21", 20, "({y} * 20 + {x}) / 21"),
           ("smma50", "close", "s50", 49, "({y} * 49 + {x}) / 50"),
           ("smma200", "close", "s200", 199, "({y} * 199 + {x}) / 200"),
           ("atrw", "tr", "str", 14, "({y} * 13 + {x}) / 14"),
           ("trs", "tr", "strs", 14, "{y} - {y} / 14 + {x}"),
           ("dps", "dmp", "sdp", 14, "{y} - {y} / 14 + {x}"),
           ("dms", "dmm", "sdm", 14, "{y} - {y} / 14 + {x}"),
           ("ag", "gain", "sg", 14, "({y} * 13 + {x}) / 14"),
           ("al", "loss", "sl", 14, "({y} * 13 + {x}) / 14")]
# Every series advances bar by bar, straight from its definition.
cte("rec", "seeds", "SELECT symbol, idx, " + ", ".join(f"CAST(NULL AS DOUBLE) AS {s[0]}" for s in _series)
    + " FROM seeds WHERE idx = 0 UNION ALL SELECT b.symbol, b.idx, " + ", ".join(_step(*s) for s in _series)
    + " FROM rec r JOIN seeds b ON b.symbol = r.symbol AND b.idx = r.idx + 1")
cte("macd0", "rec", """
  SELECT symbol, idx, ema12 - ema26 AS macd,
         avg(ema12 - ema26) OVER (PARTITION BY symbol ORDER BY idx ROWS BETWEEN 8 PRECEDING AND CURRENT ROW) AS seed FROM rec""")
cte("sig", "macd0", """
  SELECT symbol, idx, CAST(NULL AS DOUBLE) AS sig FROM macd0 WHERE idx = 0
  UNION ALL SELECT b.symbol, b.idx, CASE WHEN b.idx = 33 THEN b.seed WHEN b.idx > 33 THEN b.macd * 0.2 + r.sig * 0.8 END
  FROM sig r JOIN macd0 b ON b.symbol = r.symbol AND b.idx = r.idx + 1""")
cte("dx", "rec", """
  SELECT symbol, idx, CASE WHEN trs <> 0 THEN 100 * dps / trs END AS dip, CASE WHEN trs <> 0 THEN 100 * dms / trs END AS dim,
         CASE WHEN trs <> 0 THEN CASE WHEN dps + dms <> 0 THEN 100 * abs(dps - dms) / (dps + dms) ELSE 0.0 END END AS dx FROM rec""")
cte("adx", "dx", """
  SELECT symbol, idx, dip, dim, CASE WHEN count(dx) OVER w = 14 THEN avg(dx) OVER w END AS adx
  FROM dx WINDOW w AS (PARTITION BY symbol ORDER BY idx ROWS BETWEEN 13 PRECEDING AND CURRENT ROW)""")
cte("universe", "", """
SELECT s.s_suppkey AS symbol, s.s_name AS name, n.n_name AS sector, r.r_name AS cluster,
       CASE WHEN r.r_regionkey % 2 = 0 THEN 'KRX' ELSE 'US' END AS market,
       CASE CAST(s.s_suppkey % 4 AS INT) WHEN 0 THEN 'CORE' WHEN 1 THEN 'ETF' WHEN 2 THEN 'HIGH_RISK' ELSE 'HEDGE' END AS sleeve,
       CASE WHEN s.s_suppkey % 5 = 0 THEN NULL ELSE CAST((s.s_suppkey * 7) % 30 AS INT) END AS days_to_earnings
FROM supplier s JOIN nation n ON s.s_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey""")
cte("fundamentals", "", """
SELECT s_suppkey AS symbol,
       CASE WHEN s_suppkey % 7 = 0 THEN NULL ELSE round(s_acctbal / 50000.0, 4) END AS roe,
       CASE WHEN s_suppkey % 11 = 0 THEN NULL ELSE (s_suppkey % 40) / 10.0e0 END AS debt_to_equity,
       CASE WHEN s_suppkey % 13 = 0 THEN NULL ELSE ((s_suppkey * 3) % 50 - 20) / 100.0e0 END AS revenue_growth,
       ((s_suppkey * 5) % 40 - 5) / 1000.0e0 AS return_on_assets
FROM supplier""")
cte("benchday", "", "SELECT l_shipdate, CAST(round(avg((l_discount - 0.05) * 4000)) AS BIGINT) AS step, sum(l_quantity) AS vol FROM lineitem GROUP BY l_shipdate")
cte("bench", "benchday", """
SELECT *, row_number() OVER (ORDER BY bar_date) - 1 AS idx, count(*) OVER () AS n FROM (
  SELECT bar_date, round(1000 * exp(w / 10000.0), 4) AS close, vol AS volume FROM (
    SELECT CAST(l_shipdate AS DATE) AS bar_date, SUM(step) OVER (ORDER BY l_shipdate ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS w, vol FROM benchday))""")
cte("quotes", "", """
SELECT event_id, user_id AS symbol, ts AS quote_ts, value AS price, event_type, props,
       CASE event_type WHEN 'purchase' THEN 1 WHEN 'click' THEN 2 WHEN 'view' THEN 3 WHEN 'signup' THEN 4 ELSE 5 END AS source_priority
FROM events WHERE value > 0""")
cte("event_dates", "", """
SELECT DISTINCT o_custkey % 100 AS symbol, CAST(o_orderdate AS DATE) AS event_date
FROM orders WHERE o_orderpriority = '1-URGENT' AND o_custkey % 10 = 0""")
cte("psar", "bars", """
  SELECT symbol, idx, low AS sar, high AS ep, 0.02 AS af, TRUE AS up, high AS h1, low AS l1, high AS h2, low AS l2 FROM bars WHERE idx = 0
  UNION ALL
  SELECT symbol, idx, CASE WHEN flip THEN ep ELSE s END,
         CASE WHEN flip THEN (CASE WHEN up THEN low ELSE high END) WHEN up THEN greatest(ep, high) ELSE least(ep, low) END,
         CASE WHEN flip THEN 0.02 WHEN idx > 1 AND ((up AND high > ep) OR (NOT up AND low < ep)) THEN least(af + 0.02, 0.20) ELSE af END,
         CASE WHEN flip THEN NOT up ELSE up END, high, low, h1, l1
  FROM (SELECT *, idx > 1 AND ((up AND low < s) OR (NOT up AND high > s)) AS flip FROM (
    SELECT b.symbol, b.idx, b.high, b.low, r.ep, r.af, r.up, r.h1, r.l1,
           CASE WHEN b.idx = 1 THEN r.sar WHEN r.up THEN least(r.sar + r.af * (r.ep - r.sar), r.l1, r.l2)
                ELSE greatest(r.sar + r.af * (r.ep - r.sar), r.h1, r.h2) END AS s
    FROM psar r JOIN bars b ON b.symbol = r.symbol AND b.idx = r.idx + 1))""")
