"""Batch forms of the live operators."""

from pyspark.sql import functions as F

from barline.functions.numeric import report
from barline.plans.registry import cte, q, query
from barline.streaming import live as L

_ts = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
_st = lambda c: f"strftime({c}, '%Y-%m-%d %H:%M:%S')"
cte("ticks", "", "SELECT user_id AS symbol, ts AS quote_ts, value AS price, event_id, event_type FROM events WHERE value > 0")


def ticks(m):
    return L.ticks(m.table("events"))


@query("live_bars", "ticks", f"SELECT symbol, {_st('b')} AS bar_ts, min_by(price, row(quote_ts, event_id)) AS open, max(price) AS high, min(price) AS low, max_by(price, row(quote_ts, event_id)) AS close, count(*) AS volume FROM (SELECT *, date_trunc('hour', quote_ts) AS b FROM ticks) GROUP BY symbol, b")
def _bars(m):
    return L.live_bars(ticks(m)).select("symbol", _ts("bar_ts"), "open", "high", "low", "close", "volume")


@query("sliding_turnover", "ticks", f"SELECT symbol, {_st('s')} AS window_start, count(*) AS n, {q('sum(price)')} AS turnover, {q('sum(CASE WHEN quote_ts >= s + INTERVAL 3 HOUR THEN price ELSE 0 END) / sum(price)')} AS recent_share FROM (SELECT *, date_trunc('hour', quote_ts) - to_hours(CAST(k AS INT)) AS s FROM ticks, range(0, 4) t(k)) GROUP BY symbol, s")
def _slide(m):
    return L.sliding_turnover(ticks(m)).select("symbol", _ts("window_start"), "n", report("turnover").alias("turnover"), report("recent_share").alias("recent_share"))


@query("activity_sessions", "ticks", f"SELECT symbol, {_st('min(quote_ts)')} AS session_start, count(*) AS n, max(price) AS high, min(price) AS low FROM (SELECT *, sum(new) OVER (PARTITION BY symbol ORDER BY quote_ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM (SELECT *, CASE WHEN quote_ts < lag(quote_ts) OVER (PARTITION BY symbol ORDER BY quote_ts, event_id) + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM ticks)) GROUP BY symbol, s")
def _sess(m):
    return L.activity_sessions(ticks(m)).select("symbol", _ts("session_start"), "n", "high", "low")


cte("recs", "ticks", "SELECT rec_id, symbol, rec_ts, rec_price FROM (SELECT symbol || '|' || strftime(quote_ts, '%Y-%m-%d') AS rec_id, symbol, quote_ts AS rec_ts, price AS rec_price FROM ticks WHERE event_type = 'purchase') QUALIFY row_number() OVER (PARTITION BY rec_id ORDER BY rec_ts, rec_price) = 1")


def recs(m):
    return L.record_once(L.recommendations(ticks(m)))


@query("recorded_recommendations", "recs", f"SELECT rec_id, symbol, {_st('rec_ts')} AS rec_ts, rec_price FROM recs")
def _recs(m):
    return recs(m).select("rec_id", "symbol", _ts("rec_ts"), "rec_price")


cte("checks", "recs ticks", """SELECT r.rec_id, c.checkpoint, r.rec_price, min_by(t.price, row(t.quote_ts, t.event_id)) AS price, min(t.quote_ts) AS seen FROM recs r CROSS JOIN (VALUES ('m30', 30), ('m60', 60), ('close', 390)) c(checkpoint, mins)
  LEFT JOIN ticks t ON t.symbol = r.symbol AND t.quote_ts >= r.rec_ts + to_minutes(c.mins) AND t.quote_ts <= r.rec_ts + to_minutes(c.mins) + INTERVAL 6 HOUR GROUP BY ALL""")


@query("outcome_checkpoints", "checks", f"SELECT rec_id, checkpoint, CASE WHEN price IS NULL THEN 'unobservable' ELSE 'completed' END AS status, {_st('seen')} AS seen_ts, {q('(price / rec_price - 1) * 100')} AS return_pct FROM checks")
def _checks(m):
    return L.checkpoints(recs(m), ticks(m)).select("rec_id", "checkpoint", "status", _ts("seen_ts"), report("return_pct").alias("return_pct"))


@query("running_summary", "checks", f"SELECT checkpoint, count(price) AS completed, count(*) FILTER (price IS NULL) AS unobservable, {q('avg((price / rec_price - 1) * 100)', 3)} AS avg_return_pct FROM checks GROUP BY checkpoint")
def _summary(m):
    return L.running_summary(L.checkpoints(recs(m), ticks(m))).withColumn("avg_return_pct", report("avg_return_pct", 3))


@query("fresh_quotes", "ticks", f"SELECT event_id, {q('age', 3)} AS age_min FROM (SELECT *, (event_id % 700)::DOUBLE AS age FROM ticks) WHERE age <= CASE WHEN event_type = 'error' THEN 120 ELSE 480 END")
def _fresh(m):
    t = ticks(m).withColumn("arrived", F.col("quote_ts") + F.make_dt_interval(mins=(F.col("event_id") % 700).cast("int")))
    return L.fresh(t, "arrived", {"error": 120}).select("event_id", report("age_min", 3).alias("age_min"))


@query("tagged_ticks", "ticks", "SELECT CASE WHEN mi < 240 THEN CASE WHEN td OR yd THEN 'overnight' ELSE 'closed' END WHEN NOT td THEN 'closed' WHEN mi < 570 THEN 'pre_market' WHEN mi < 960 THEN 'regular' WHEN mi < 1200 THEN 'after_hours' ELSE 'overnight' END AS session, count(*) AS n FROM (SELECT hour(t) * 60 + minute(t) AS mi, isodow(t) < 6 AS td, isodow(t - INTERVAL 1 DAY) < 6 AS yd FROM (SELECT quote_ts - INTERVAL 5 HOUR AS t FROM ticks)) GROUP BY 1")
def _tag(m):
    return L.tagged(ticks(m)).groupBy("session").agg(F.count(F.lit(1)).alias("n"))


@query("flagged_ticks", "ticks", "SELECT event_id, coalesce(f.blocked, FALSE) AS blocked FROM ticks t LEFT JOIN (SELECT s_suppkey AS symbol, s_acctbal < 0 AS blocked FROM supplier) f USING (symbol)")
def _flags(m):
    flags = m.table("supplier").select(F.col("s_suppkey").alias("symbol"), (F.col("s_acctbal") < 0).alias("blocked"))
    return L.with_flags(ticks(m), flags).select("event_id", "blocked")


cte("led_e", "ticks", "SELECT symbol AS id, row(quote_ts, event_id) AS k, CASE event_type WHEN 'signup' THEN 'open' WHEN 'error' THEN 'stop' WHEN 'purchase' THEN 'close' ELSE 'price' END AS kind, price AS v FROM ticks")
cte("led_o", "led_e", "SELECT o.id, o.o, min(e.k) AS c FROM (SELECT id, min(k) AS o FROM led_e WHERE kind = 'open' GROUP BY id) o LEFT JOIN led_e e ON e.id = o.id AND e.kind = 'close' AND e.k >= o.o GROUP BY o.id, o.o")


@query("position_ledger", "led_e led_o", """SELECT id AS position_id, min_by(v, k) FILTER (kind = 'open') AS entry_price, max(v) FILTER (kind = 'stop') AS stop_price, coalesce(max_by(v, k) FILTER (kind = 'price'), min_by(v, k) FILTER (kind = 'open')) AS last_price, max(v) FILTER (kind = 'close') AS close_price,
  CASE WHEN count(*) FILTER (kind = 'close') > 0 THEN 'CLOSED' ELSE 'OPEN' END AS status, count(*) FILTER (kind = 'price') AS updates FROM led_e JOIN led_o x USING (id) WHERE k >= o AND (c IS NULL OR k <= c) GROUP BY id""")
def _ledger(m):
    return L.ledger(L.ledger_events(ticks(m)))
