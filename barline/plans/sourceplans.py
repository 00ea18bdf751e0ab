"""Sources, rules on single rows, sessions and portfolio checks."""

from pyspark.sql import functions as F

from barline.functions import calendar as C
from barline.functions.numeric import report
from barline.operators import aggregates as A, backtest as B, decisions as D, indicators as ind
from barline.plans.decisionplans import plan
from barline.plans.backtests import zones
from barline.plans.registry import cte, he, q, query
from barline.series import own_rows, segmented
from barline.sources import readers as R

_BUCKET = {"5M": "to_timestamp(floor(epoch(quote_ts) / 300) * 300)::TIMESTAMP", "30M": "to_timestamp(floor(epoch(quote_ts) / 1800) * 1800)::TIMESTAMP", "15M": "to_timestamp(floor(epoch(quote_ts) / 900) * 900)::TIMESTAMP", "1H": "date_trunc('hour', quote_ts)", "1D": "date_trunc('day', quote_ts)", "1W": "date_trunc('week', quote_ts)"}
for _f, _b in _BUCKET.items():
    def _tick(m, f=_f):
        d = R.build_bars(m.quotes, f)
        return d.select("symbol", F.date_format("bar_ts", "yyyy-MM-dd HH:mm:ss").alias("bar_ts"), "open", "high", "low", "close", "volume")

    query(f"tick_bars_{_f.lower()}", "quotes", f"SELECT symbol, strftime(b, '%Y-%m-%d %H:%M:%S') AS bar_ts, min_by(price, row(quote_ts, event_id)) AS open, max(price) AS high, min(price) AS low, max_by(price, row(quote_ts, event_id)) AS close, CAST(count(*) AS DOUBLE) AS volume FROM (SELECT *, {_b} AS b FROM quotes) GROUP BY symbol, b")(_tick)


@query("normalized_bars", "", "SELECT l_orderkey AS k, l_linenumber AS line, l_extendedprice AS open, l_extendedprice AS high, l_extendedprice * 0.98 AS low, l_extendedprice * 0.99 AS close FROM lineitem WHERE l_returnflag <> 'N'")
def _norm(m):
    p = F.col("l_extendedprice")
    raw = m.table("lineitem").select(F.col("l_orderkey").alias("K"), F.col("l_linenumber").alias("Line"), p.alias("Open"), p.alias(" High"), (p * 0.98).alias("Low"), F.when(F.col("l_returnflag") != "N", p * 0.99).alias("CLOSE"))
    return R.normalized_bars(raw)


cte("rawact", "bars", "SELECT *, CASE WHEN idx < n // 2 THEN 0.5 ELSE 1.0 END AS ratio, CASE WHEN idx % 63 = 0 THEN 0.5 ELSE 0.0 END AS dividend, CASE WHEN idx = n // 2 THEN 2.0 ELSE 0.0 END AS split FROM bars")


def raw_actions(m):
    i, n = F.col("bar_idx"), F.col("n_bars")
    half = F.floor(n / 2)
    return m.bars.withColumns({"adj_close": F.col("close") * F.when(i < half, 0.5).otherwise(1.0), "dividend": F.when(i % 63 == 0, 0.5).otherwise(0.0), "split": F.when(i == half, 2.0).otherwise(0.0)})


@query("adjusted_prices", "rawact", "SELECT symbol, idx AS bar_idx, " + ", ".join(f"{q(f'{c} * ratio')} AS {c}" for c in ("open", "high", "low", "close")) + ", volume FROM rawact")
def _adj(m):
    d = R.adjust_prices(raw_actions(m))
    return d.select("symbol", F.col("bar_idx").cast("long").alias("bar_idx"), *[report(c).alias(c) for c in ("open", "high", "low", "close")], "volume")


cte("adjser", "rawact", "SELECT symbol, idx, open * ratio AS o, close * ratio AS c, avg(close * ratio) OVER (PARTITION BY symbol ORDER BY idx ROWS BETWEEN 199 PRECEDING AND CURRENT ROW) AS seed FROM rawact")
cte("adjsm", "adjser", "SELECT symbol, idx, seed AS s FROM adjser WHERE idx = 199 UNION ALL SELECT b.symbol, b.idx, (r.s * 199 + b.c) / 200 FROM adjsm r JOIN adjser b ON b.symbol = r.symbol AND b.idx = r.idx + 1")


@query("corporate_actions", "rawact adjser adjsm rec", f"""SELECT symbol, idx AS bar_idx, dividend, split, {q('rg')} AS raw_gap, {q('ag2')} AS adj_gap, {q('abs(rg) - abs(ag2)')} AS gap_reduction, {q('rj', 6)} AS raw_jump, {q('aj', 6)} AS adj_jump FROM (
  SELECT r.symbol, r.idx, dividend, split, (r.open / lag(r.close) OVER w - 1) * 100 AS rg, (a.o / lag(a.c) OVER w - 1) * 100 AS ag2, (k.smma200 / lag(k.smma200) OVER w - 1) * 100 AS rj, (m.s / lag(m.s) OVER w - 1) * 100 AS aj
  FROM rawact r JOIN adjser a USING (symbol, idx) JOIN rec k USING (symbol, idx) LEFT JOIN adjsm m ON m.symbol = r.symbol AND m.idx = r.idx WINDOW w AS (PARTITION BY r.symbol ORDER BY r.idx)) WHERE (dividend <> 0 OR split <> 0) AND idx >= 1""")
def _actions(m):
    return actions(m).select("symbol", F.col("bar_idx").cast("long").alias("bar_idx"), "dividend", "split", *[report(c).alias(c) for c in ("raw_gap", "adj_gap", "gap_reduction")], *[report(c, 6).alias(c) for c in ("raw_jump", "adj_jump")])


def actions(m):
    raw = raw_actions(m)
    sm = lambda d: own_rows(ind.with_smma(segmented(d, 8000), 200))
    return R.corporate_actions(sm(raw), sm(R.adjust_prices(raw)))


@query("action_medians", "rawact", f"""SELECT kind, count(*) AS events, {q('median(d)', 3)} AS median_gap_reduction FROM (SELECT CASE WHEN split <> 0 THEN 'split' ELSE 'dividend' END AS kind, abs(rg) - abs(ag) AS d FROM (SELECT *, (open / lag(close) OVER w - 1) * 100 AS rg, (open * ratio / lag(close * ratio) OVER w - 1) * 100 AS ag
  FROM rawact WINDOW w AS (PARTITION BY symbol ORDER BY idx)) WHERE (dividend <> 0 OR split <> 0) AND idx >= 1) GROUP BY kind""")
def _actmed(m):
    from barline.operators.quantiles import exact_quantiles

    d = actions(m).withColumn("kind", F.when(F.col("split") != 0, "split").otherwise("dividend"))
    med = exact_quantiles(d, ["kind"], {"g": F.col("gap_reduction")}, [0.5])
    return d.groupBy("kind").agg(F.count(F.lit(1)).alias("events")).join(med, "kind").select("kind", "events", report("g_50", 3).alias("median_gap_reduction"))


_px, _df = "CAST(round(value * 100) AS BIGINT)", "event_id % 37"


@query("parsed_quotes", "", f"SELECT event_id, price, diff, price - diff AS prev_close, {q(he('CASE WHEN price <> diff THEN diff / (price - diff) * 100 ELSE 0 END', 2), 2)} AS change_pct, CASE WHEN diff > 0 THEN 'up' WHEN diff < 0 THEN 'down' ELSE 'flat' END AS direction FROM (SELECT event_id, CAST({_px} AS DOUBLE) AS price, CAST(CASE WHEN event_id % 2 = 0 THEN -({_df}) ELSE {_df} END AS DOUBLE) AS diff FROM events)")
def _quotes(m):
    num = lambda c: F.format_number(c, 0)
    e = m.table("events").withColumns({"px": F.round(F.col("value") * 100).cast("long"), "df": F.col("event_id") % 37})
    js = F.to_json(F.struct(num("px").alias("closePrice"), num("df").alias("compareToPreviousClosePrice"), F.struct(F.when(F.col("event_id") % 2 == 0, "5").otherwise("2").alias("code")).alias("compareToPreviousPrice"), num("user_id").alias("tradeVolume")))
    d = R.parse_quotes(e.select("event_id", js.alias("json")))
    return d.select("event_id", "price", (F.col("diff") + 0.0).alias("diff"), "prev_close", report("change_pct", 2).alias("change_pct"), "direction")


cte("ixrow", "", "SELECT event_id, value AS cur, user_id / 100.0 AS chg, CASE event_id % 3 WHEN 0 THEN 'up' WHEN 1 THEN 'down' ELSE 'flat' END AS dir, CASE WHEN event_id % 4 = 0 THEN 9.9 ELSE round_even((user_id / 100.0) / (CASE WHEN event_id % 3 = 0 THEN value - user_id / 100.0 ELSE value + user_id / 100.0 END) * 1e4, 0) / 100 END AS pct FROM events")


@query("validated_indices", "ixrow", f"SELECT event_id, ok AS available, CASE WHEN ok THEN {q('prev')} END AS prev_close, CASE WHEN ok THEN {q('sg * abs(pct)', 2)} END AS pct_value FROM (SELECT *, coalesce(cur > 0 AND (dir <> 'flat' OR (abs(chg) <= 0.0001 AND abs(pct) <= 0.0001)) AND prev > 0 AND abs(abs((cur - prev) / prev * 100) - CASE WHEN sg = 0 THEN 0 ELSE abs(pct) END) <= 0.05, FALSE) AS ok FROM (SELECT *, CASE dir WHEN 'up' THEN 1 WHEN 'down' THEN -1 ELSE 0 END AS sg, CASE dir WHEN 'up' THEN cur - chg WHEN 'down' THEN cur + chg ELSE cur END AS prev FROM ixrow))")
def _indices(m):
    e = m.table("events").withColumns({"cur": F.col("value"), "chg": F.col("user_id") / 100.0, "dir": F.when(F.col("event_id") % 3 == 0, "up").when(F.col("event_id") % 3 == 1, "down").otherwise("flat")})
    base = F.when(F.col("dir") == "up", F.col("cur") - F.col("chg")).otherwise(F.col("cur") + F.col("chg"))
    e = e.withColumn("pct", F.when(F.col("event_id") % 4 == 0, 9.9).otherwise(F.bround(F.try_divide(F.col("chg"), base) * 1e4, 0) / 100))
    d = e.withColumns(D.validate_index("cur", "chg", "pct", "dir"))
    return d.select("event_id", "available", report("prev_close").alias("prev_close"), report("pct_value", 2).alias("pct_value"))


@query("parsed_changes", "", f"SELECT event_id, {q('floor(value * 100) / 100', 2)} AS abs_value, CAST(user_id AS DOUBLE) AS pct_value, CASE event_id % 3 WHEN 0 THEN 'up' WHEN 1 THEN 'down' ELSE 'flat' END AS direction, CASE event_id % 3 WHEN 0 THEN 'up' WHEN 1 THEN 'down' ELSE 'flat' END AS inferred FROM events")
def _changes(m):
    i = F.col("event_id")
    word = F.when(i % 3 == 0, "상승").when(i % 3 == 1, "하락").otherwise("보합")
    t = F.concat_ws(" ", F.format_number(F.floor(F.col("value") * 100) / 100, 2), F.concat(F.when(i % 3 == 1, "-").otherwise(""), F.col("user_id").cast("string"), F.lit("%")), word)
    d = m.table("events").withColumn("t", t).withColumns(D.parse_change("t"))
    return d.select("event_id", report("abs_value", 2).alias("abs_value"), "pct_value", "direction", D.text_direction(F.concat(F.when(F.col("direction") == "down", "▼").when(F.col("direction") == "up", "+").otherwise(""), F.lit("1"))).alias("inferred"))


@query("price_ticks", "", """SELECT event_id, CAST(least(t, CASE WHEN kq THEN 100 ELSE 1000 END) AS BIGINT) AS tick, CAST(floor(p / least(t, CASE WHEN kq THEN 100 ELSE 1000 END)) * least(t, CASE WHEN kq THEN 100 ELSE 1000 END) AS BIGINT) AS snapped, value > 0 AND value < 20 AS eligible FROM (
  SELECT event_id, value, value * 1500 AS p, user_id % 2 = 0 AS kq, CASE WHEN value * 1500 < 1000 THEN 1 WHEN value * 1500 < 5000 THEN 5 WHEN value * 1500 < 10000 THEN 10 WHEN value * 1500 < 50000 THEN 50 WHEN value * 1500 < 100000 THEN 100 WHEN value * 1500 < 500000 THEN 500 ELSE 1000 END AS t FROM events)""")
def _ticks(m):
    d = m.table("events").withColumns({"p": F.col("value") * 1500, "board": F.when(F.col("user_id") % 2 == 0, "KOSDAQ").otherwise("KOSPI")})
    return d.select("event_id", D.tick_size("p", "board").cast("long").alias("tick"), D.snap("p", "board").cast("long").alias("snapped"), D.surge_eligible(F.col("value")).alias("eligible"))


@query("exclusion_reasons", "", "SELECT event_id, CASE WHEN user_id % 3 = 0 THEN 'vi_active,' ELSE '' END || CASE WHEN user_id % 5 = 0 THEN 'management,' ELSE '' END || CASE WHEN user_id % 7 = 0 THEN 'warning,' ELSE '' END || CASE WHEN event_type = 'error' THEN 'short_overheat,' ELSE '' END || CASE WHEN user_id % 11 = 0 THEN 'trading_halt,' ELSE '' END AS reasons FROM events")
def _excl(m):
    u = F.col("user_id")
    d = m.table("events").withColumns({"vi_active": u % 3 == 0, "management": u % 5 == 0, "warning": u % 7 == 0, "short_overheat": F.col("event_type") == "error", "trading_halt": u % 11 == 0})
    return d.select("event_id", F.concat_ws("", F.transform(D.exclusion_reasons(), lambda r: F.concat(r, F.lit(",")))).alias("reasons"))


_ST = "CASE event_type WHEN 'error' THEN 'halt' WHEN 'purchase' THEN 'management' WHEN 'signup' THEN 'delisting' ELSE 'normal' END"


@query("security_status", "", f"SELECT symbol, status, status IN ('halt', 'delisting') AS blocked FROM (SELECT user_id AS symbol, max_by({_ST}, row(ts, event_id)) AS status FROM events GROUP BY user_id)")
def _status(m):
    s = F.when(F.col("event_type") == "error", "halt").when(F.col("event_type") == "purchase", "management").when(F.col("event_type") == "signup", "delisting").otherwise("normal")
    return D.security_status(m.table("events").select(F.col("user_id").alias("symbol"), s.alias("status"), F.col("ts").alias("notice_ts"), F.col("event_id").alias("notice_id")))


@query("halt_release", "", "SELECT event_id, CASE WHEN event_id % 3 <> 2 AND CAST(ts AS DATE) >= DATE '2024-01-15' THEN strftime(ts, '%Y-%m-%d') END AS release_date, CASE WHEN event_id % 3 <> 2 AND CAST(ts AS DATE) >= DATE '2024-01-15' THEN 'disclosed' ELSE 'undetermined' END AS release_label FROM events")
def _halt(m):
    ts, i = F.col("ts").cast("timestamp"), F.col("event_id")
    text = F.when(i % 3 == 0, F.concat(F.lit("매매거래정지해제일 "), F.date_format(ts, "yyyy'년'MM'월'dd'일' HH:mm"), F.lit(" 부터"))).when(i % 3 == 1, F.concat(F.lit("3. 해제일시 "), F.date_format(ts, "yyyy-MM-dd"), F.lit(" - 4. 근거규정"))).otherwise("법원의 결정 확인시까지")
    d = m.table("events").withColumns({"text": text, "today": F.to_date(F.lit("2024-01-15"))}).withColumns(D.halt_release("text", "today"))
    return d.select("event_id", F.col("release_date").cast("string").alias("release_date"), "release_label")


@query("clean_fundamentals", "", """SELECT s_suppkey AS symbol, CASE WHEN s_suppkey % 7 <> 0 THEN s_acctbal END AS roe, CASE WHEN s_suppkey % 5 = 0 THEN NULL WHEN s_suppkey % 40 > 10 THEN (s_suppkey % 40) / 100.0e0 ELSE (s_suppkey % 40) * 1.0e0 END AS debt_to_equity FROM supplier""")
def _fund(m):
    k = F.col("s_suppkey")
    d = m.table("supplier").select(k.alias("symbol"), F.when(k % 7 == 0, "None").otherwise(F.col("s_acctbal").cast("string")).alias("roe"), F.when(k % 5 == 0, "-").otherwise((k % 40).cast("string")).alias("debt_to_equity"), F.lit("").alias("revenue_growth"), F.lit("NaN").alias("return_on_assets"))
    return R.normalize_fundamentals(d).select("symbol", "roe", "debt_to_equity")


@query("recent_earnings", "", "SELECT symbol, report_id, place FROM (SELECT o_custkey AS symbol, o_orderkey AS report_id, row_number() OVER (PARTITION BY o_custkey ORDER BY CAST(o_orderdate AS DATE) DESC, o_orderkey) AS place FROM orders) WHERE place <= 4")
def _earn(m):
    d = m.table("orders").select(F.col("o_custkey").alias("symbol"), F.col("o_orderkey").alias("report_id"), F.col("o_orderdate").cast("date").alias("fiscal_date"), F.col("o_totalprice").alias("eps"))
    return R.recent_earnings(d).select("symbol", "report_id", F.col("place").cast("long").alias("place"))


# -- sessions ---------------------------------------------------------------------------------

cte("sess", "", "SELECT event_id, ts + INTERVAL 731 DAY AS u FROM events")
_hol = ", ".join(f"'{d}'" for d in C.HOLIDAYS)
_ear = ", ".join(f"'{d}'" for d in C.EARLY_CLOSES)
# The events fall in January 2026, when New York is five hours behind UTC and Seoul nine ahead.
cte("sess2", "sess", f"SELECT *, CAST(t AS DATE) AS d, hour(t) * 60 + minute(t) AS mi, isodow(t) < 6 AND strftime(t, '%Y-%m-%d') NOT IN ({_hol}) AS td, isodow(t - INTERVAL 1 DAY) < 6 AND strftime(t - INTERVAL 1 DAY, '%Y-%m-%d') NOT IN ({_hol}) AS yd, strftime(t, '%Y-%m-%d') IN ({_ear}) AS early FROM (SELECT *, u - INTERVAL 5 HOUR AS t, u + INTERVAL 9 HOUR AS k FROM sess)")


@query("market_sessions", "sess2", """SELECT event_id, CASE WHEN mi < 240 THEN CASE WHEN td OR yd THEN 'overnight' ELSE 'closed' END WHEN NOT td THEN 'closed' WHEN mi < 570 THEN 'pre_market' WHEN mi < CASE WHEN early THEN 780 ELSE 960 END THEN 'regular' WHEN mi < 1200 THEN 'after_hours' ELSE 'overnight' END AS session,
  CASE WHEN isodow(k) > 5 THEN 'closed' WHEN hour(k) * 60 + minute(k) < 540 THEN 'before_open' WHEN hour(k) * 60 + minute(k) < 930 THEN 'open' ELSE 'after_close' END AS kr_status,
  CASE WHEN isodow(k) < 6 AND hour(k) >= 9 AND event_id % 4 = 0 THEN 'unknown' WHEN isodow(k) < 6 AND hour(k) >= 9 AND event_id % 4 = 1 THEN 'holiday_or_stale' WHEN isodow(k) > 5 THEN 'closed' WHEN hour(k) * 60 + minute(k) < 540 THEN 'before_open' WHEN hour(k) * 60 + minute(k) < 930 THEN 'open' ELSE 'after_close' END AS reconciled, strftime(k, '%Y-%m-%d %H:%M:%S') AS kr_time FROM sess2""")
def _sessions(m):
    d = m.table("events").withColumn("u", F.col("ts").cast("timestamp") + F.expr("interval 731 days")).withColumn("k", C.korea_time("u"))
    trade = F.when(F.col("event_id") % 4 == 0, F.lit(None)).when(F.col("event_id") % 4 == 1, F.date_sub(F.to_date("k"), 3)).otherwise(F.to_date("k"))
    d = d.withColumn("traded", trade)
    return d.select("event_id", C.session("u").alias("session"), C.korea_status("k").alias("kr_status"), C.reconcile_status("k", "traded").alias("reconciled"), F.date_format("k", "yyyy-MM-dd HH:mm:ss").alias("kr_time"))


@query("projected_sessions", "", f"""WITH days AS (SELECT d, row_number() OVER (ORDER BY d) AS r FROM (SELECT CAST(unnest(generate_series(DATE '2025-01-01', DATE '2028-12-31', INTERVAL 1 DAY)) AS DATE) AS d) WHERE isodow(d) < 6 AND strftime(d, '%Y-%m-%d') NOT IN ({_hol})),
  o AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) + 10957 AS s, o_custkey % 200 + 1 AS k FROM orders), c AS (SELECT s, (SELECT count(*) FROM days x WHERE x.d <= o.s) AS before FROM (SELECT DISTINCT s FROM o) o)
  SELECT o_orderkey, CAST(t.d AS VARCHAR) AS session_date, CASE WHEN t.d IS NULL THEN 'outside_calendar' ELSE 'known' END AS calendar_status FROM o JOIN c USING (s) LEFT JOIN days t ON t.r = c.before + o.k AND o.s >= DATE '2025-01-01'""")
def _proj(m):
    s = F.date_add(F.col("o_orderdate").cast("date"), 10957)
    d = m.table("orders").select("o_orderkey", s.alias("s"), (F.col("o_custkey") % 200 + 1).cast("int").alias("k"))
    return C.project_sessions(d, "s", "k").select("o_orderkey", F.col("session_date").cast("string").alias("session_date"), "calendar_status")


# -- portfolio checks -------------------------------------------------------------------------

cte("pstate", "pos", f"SELECT account, count(*) FILTER (status = 'OPEN') AS op, sum(CASE WHEN status = 'OPEN' THEN value END) AS mv, sum(CASE WHEN status = 'OPEN' THEN open_risk END) AS risk, count(*) FILTER (status = 'OPEN' AND NOT has_stop) AS ms, 20 * sum(CASE WHEN status = 'OPEN' THEN value END) AS eq FROM pos GROUP BY account")
cte("assess", "scan pstate pos", """SELECT *, CASE WHEN stop_price >= entry_trigger THEN 'STOP_BELOW_ENTRY,' ELSE '' END || CASE WHEN sh < 1 THEN 'MIN_SHARES,' ELSE '' END || CASE WHEN (risk + sh * per) / eq * 100 > 10 THEN 'MAX_OPEN_RISK,' ELSE '' END || CASE WHEN op >= 6 THEN 'MAX_POSITIONS,' ELSE '' END || CASE WHEN per / entry_trigger * 100 > 10 THEN 'STOP_DISTANCE,' ELSE '' END
  || CASE WHEN sh * entry_trigger / (mv + sh * entry_trigger) * 100 > 25 THEN 'CONCENTRATION,' ELSE '' END || CASE WHEN (sv + sh * entry_trigger) / eq * 100 > 40 THEN 'SECTOR_CONCENTRATION,' ELSE '' END AS v FROM (
  SELECT *, least(CASE WHEN want * entry_trigger > cap THEN floor(cap / entry_trigger) ELSE want END, floor(cash / entry_trigger)) AS sh FROM (SELECT s.symbol, p.*, s.entry_trigger, s.stop_price, s.sleeve, coalesce(x.sv, 0) AS sv, eq / 4 AS cash, greatest(entry_trigger - stop_price, 0.01) AS per,
  floor(least(eq * 0.01, eq / 4) / greatest(entry_trigger - stop_price, 0.01)) AS want, eq * CASE sleeve WHEN 'ETF' THEN 0.20 WHEN 'HIGH_RISK' THEN 0.08 WHEN 'HEDGE' THEN 0.10 ELSE 0.15 END AS cap
  FROM (SELECT symbol, sector, sleeve, entry_trigger, round_even(stop_price * 1e4, 0) / 1e4 AS stop_price FROM scan) s JOIN pstate p ON p.account = s.symbol % 7 + 1 LEFT JOIN (SELECT account, sector, sum(value) AS sv FROM pos WHERE status = 'OPEN' GROUP BY account, sector) x ON x.account = p.account AND x.sector = s.sector))""")


@query("trade_assessment", "assess", f"SELECT account, symbol, v AS violations, v = '' AS approved, sh AS shares, {q('sh * entry_trigger', 2)} AS position_value FROM assess")
def _assess(m):
    from barline.plans.scanning import the_scan

    f = A.with_position_figures(m.positions)
    st = A.portfolio_state(f, ["account"], F.col("market_value") * 20).withColumn("cash", F.col("equity") / 4)
    sv = f.filter("status = 'OPEN'").groupBy("account", "sector").agg(F.sum("value").alias("sector_value"))
    props = the_scan(m).select("symbol", "sector", "sleeve", F.col("entry_trigger").alias("entry_price"), "stop_price").withColumn("account", (F.col("symbol") % 7 + 1).cast("int"))
    d = A.assess_trades(props, st, sv, ["account"])
    return d.select("account", "symbol", F.concat_ws("", F.transform("violations", lambda x: F.concat(x, F.lit(",")))).alias("violations"), "approved", "shares", report("position_value", 2).alias("position_value"))


@query("risk_gates", "scan1 pos", f"""SELECT symbol, status_ok, {q('cost', 2)} AS total_cost, sector_ok, risk_ok FROM (SELECT s.symbol, open_for_entry AS status_ok, cost, CASE WHEN open_for_entry THEN (coalesce(x.sv, 0) + cost) / 1e10 * 100 <= 40 ELSE TRUE END AS sector_ok, CASE WHEN open_for_entry THEN (t.rk + risk) / 1e10 * 100 <= 6 ELSE TRUE END AS risk_ok FROM (
  SELECT *, CASE WHEN open_for_entry THEN {he('least(sh * trigger, cap)', 2)} END AS cost, CASE WHEN open_for_entry THEN {he('least(sh, cap / trigger) * (trigger - stop0)', 2)} END AS risk FROM (SELECT *, 1e10 * 0.01 / (trigger - stop0) AS sh, 1e10 * CASE sleeve WHEN 'ETF' THEN 0.20 WHEN 'HIGH_RISK' THEN 0.08 WHEN 'HEDGE' THEN 0.10 ELSE 0.15 END AS cap FROM scan1)) s
  LEFT JOIN (SELECT sector, sum(value) AS sv FROM pos WHERE status = 'OPEN' GROUP BY sector) x USING (sector), (SELECT sum(open_risk) AS rk FROM pos WHERE status = 'OPEN') t)""")
def _gates(m):
    from barline.plans.scanning import the_scan

    held = A.with_position_figures(m.positions).filter("status = 'OPEN'").select("sector", "value", F.col("open_risk").alias("risk_dollars"))
    d = the_scan(m, equity=1e10, positions=held)
    ok = lambda n: F.coalesce(F.exists(F.filter("risk_gates", lambda g: g["name"] == n), lambda g: g["passed"]), F.lit(True))
    return d.select("symbol", F.col("risk_gates").isNotNull().alias("status_ok"), report("total_cost", 2).alias("total_cost"), ok("sector_concentration").alias("sector_ok"), ok("open_risk_cap").alias("risk_ok"))


cte("surge", "comp moves", "SELECT c.symbol, c.idx, m.ret * 100 AS chg, c.close * c.volume AS tv, vr_prior AS rv, trend, rsi, (c.close - c.low) / nullif(c.high - c.low, 0) AS flow, c.symbol % 2 = 0 AS intra FROM comp c JOIN moves m USING (symbol, idx) WHERE c.idx >= 59")
_u = lambda x: f"greatest(0.0, least(1.0, {x}))"


@query("opening_surge", "surge", f"""SELECT symbol, idx AS bar_idx, CASE WHEN chg >= 5 THEN -1.0 ELSE {q(f"greatest(0.0, 25 * {_u('tv / 100000.0')} + 20 * {_u('(rv - 1) / 2')} + 20 * {_u('chg / 8')} + 15 * {_u('(trend + 1) / 2')} + CASE WHEN intra THEN 12 * {_u('flow')} ELSE 0 END - CASE WHEN rsi > 75 THEN 10 ELSE 0 END)")} END AS surge_score FROM surge WHERE flow IS NOT NULL""")
def _surge(m):
    from barline.plans.decisionplans import with_composite

    d = with_composite(m.panel_view().filter("bar_idx >= 59")).withColumns({"chg": (F.col("close") / F.col("prev_close") - 1) * 100, "tv": F.col("close") * F.col("volume"), "flow": (F.col("close") - F.col("low")) / F.nullif(F.col("high") - F.col("low"), F.lit(0.0)), "intra": F.col("symbol") % 2 == 0})
    d = d.filter("flow is not null").withColumns(D.surge_score("tv", "vr_prior", "chg", "trend", "flow", "intra", "rsi", 5.0))
    s = F.when(F.col("surge_score") == -1.0, -1.0).otherwise(report("surge_score"))
    return d.select("symbol", F.col("bar_idx").cast("long").alias("bar_idx"), s.alias("surge_score"))


@query("output_documents")
def _docs(m):
    p = plan(m)
    return R.output_contract(D.buy_bands(p), D.take_profit_levels(p))


_BANDS = "struct<bands:array<struct<band:string,price_range:array<double>,win_probability_pct:double>>>"
_DOCUMENT = f"struct<buy_price:struct<current:double,aggressive:{_BANDS},recommended:{_BANDS}>,risk_scenarios:struct<tp_levels:array<struct<profile:string,level:int,price:double,hit_prob_pct:double>>>>"


@query("document_rows", "bands2 tp", f"""SELECT symbol, family AS part, band AS name, {q('lo')} AS low, {q('hi')} AS high, {q('win_pct', 1)} AS prob_pct FROM bands2
  UNION ALL SELECT symbol, 'tp', profile || '-' || CAST(lvl AS VARCHAR), {q('price')}, {q('price')}, {q('cp', 1)} FROM tp""")
def _doc_rows(m):
    """The documents read back: one row for each band and level in them."""
    d = _docs(m).select("symbol", F.from_json("document", _DOCUMENT).alias("d"))
    row = lambda part, label, low, high, prob: F.struct(part.alias("part"), label.alias("name"), low.alias("low"), high.alias("high"), prob.alias("prob_pct"))
    bands = lambda f: F.transform(f"d.buy_price.{f}.bands", lambda b: row(F.lit(f), b["band"], b["price_range"][0], b["price_range"][1], b["win_probability_pct"]))
    levels = F.transform("d.risk_scenarios.tp_levels", lambda t: row(F.lit("tp"), F.concat_ws("-", t["profile"], t["level"].cast("string")), t["price"], t["price"], t["hit_prob_pct"]))
    d = d.select("symbol", F.explode(F.concat(bands("aggressive"), bands("recommended"), levels)).alias("r")).select("symbol", "r.*")
    return d.select("symbol", "part", "name", report("low").alias("low"), report("high").alias("high"), report("prob_pct", 1).alias("prob_pct"))


@query("prediction_events", "zt", f"SELECT CAST(symbol AS VARCHAR) AS symbol, market, CAST(score AS BIGINT) AS risk_score, {q('close')} AS current, {q('max(lo) FILTER (zone = ' + chr(39) + 'primary' + chr(39) + ')')} AS primary_low, {q('max(hi) FILTER (zone = ' + chr(39) + 'secondary' + chr(39) + ')')} AS secondary_high FROM zt WHERE logic = 'current' GROUP BY symbol, market, idx, score, close")
def _events(m):
    d = R.prediction_events(zones(m))
    return d.select("symbol", "market", "risk_score", report("current").alias("current"), report(F.col("bands.primary")[0]).alias("primary_low"), report(F.col("bands.secondary")[1]).alias("secondary_high"))


_PARTS = ", ".join(f"CAST(sum(CAST(('0x' || substr(h, {15 * i + 1}, 15)) AS BIGINT)) AS VARCHAR)" for i in range(4))
_MEMBER = """sha256('{"market":"' || market || '","sleeve":"' || sleeve || '","symbol":' || CAST(symbol AS VARCHAR) || '}')"""


@query("universe_fingerprint", "universe", f"SELECT sector, count(*) AS members, sha256(concat_ws('|', CAST(count(*) AS VARCHAR), {_PARTS})) AS fingerprint FROM (SELECT sector, {_MEMBER} AS h FROM universe) GROUP BY sector")
def _fp(m):
    return B.fingerprint(m.universe.select("sector", "symbol", "market", "sleeve"), "sector")
