"""Immunity, recommendations, confidence and price plans."""

from pyspark.sql import functions as F

from barline.functions import scores as S, text as T
from barline.functions.numeric import half_even, report
from barline.operators import aggregates as A, backtest as B, decisions as D, news as N
from barline.operators.scan import end_values
from barline.plans.indicators import over
from barline.plans.markets import last_changes, overnight
from barline.plans.newsplans import impact_sql, sentiments, stock_news
from barline.plans.registry import cte, he, q, query
from barline.session import written
from barline.plans.scanning import _HEALTH, _VOLREG, cl, levels_sql, the_scan
from barline.sources.market import news

# -- immunity ---------------------------------------------------------------------------------

cte("danger", "snap", """SELECT *, CASE WHEN sc >= 65 THEN 'IMMUNE' WHEN sc >= 40 THEN 'ALERT' WHEN sc >= 20 THEN 'CAUTION' ELSE 'CLEAR' END AS lv FROM (SELECT *, least(100.0, CASE WHEN dev < -20 THEN 35.0 WHEN dev < -10 THEN 20.0 ELSE 0.0 END + CASE WHEN adx >= 40 THEN 40.0 WHEN adx >= 30 THEN 25.0 WHEN adx >= 20 THEN 10.0 ELSE 0.0 END
  + CASE WHEN atr_pct >= 5 THEN 20.0 WHEN atr_pct >= 3 THEN 10.0 ELSE 0.0 END + CASE WHEN vol_ratio < 0.7 THEN 10.0 ELSE 0.0 END) AS sc FROM (SELECT *, CASE WHEN ma200 > 0 THEN (current_price / ma200 - 1) * 100 END AS dev FROM snap))""")


def danger(m):
    return m.snapshot_ends().withColumn("ma200_dev", F.when(F.col("ma200") > 0, (F.col("current_price") / F.col("ma200") - 1) * 100))


@query("market_immunity", "danger", f"SELECT symbol, {q(he('sc', 1), 1)} AS immune_score, lv AS immune_level, lv IN ('IMMUNE', 'ALERT') AS disable_new_entries, lv <> 'CLEAR' AS disable_automated, lv = 'ALERT' AS confirm_manually FROM danger")
def _immune(m):
    d = danger(m).withColumns(D.immunity("adx", "ma200_dev", "atr_pct", "vol_ratio"))
    return d.select("symbol", report("immune_score", 1).alias("immune_score"), "immune_level", "disable_new_entries", "disable_automated", "confirm_manually")


_cr = ", ".join(f"('{n}', {v}::DOUBLE, {d}::DOUBLE, {x}::DOUBLE)" for n, v, d, x, _dd, _s in D.CRISES)


@query("crisis_similarity", "danger", f"""SELECT symbol, crisis, {q('sim', 5)} AS similarity, row_number() OVER (PARTITION BY symbol ORDER BY round(sim, 9) DESC, crisis) AS place FROM (SELECT symbol, crisis, greatest(0.0, least(1.0,
  (adx * v + coalesce(dev, 0) * d + atr_pct * x) / (sqrt(adx * adx + coalesce(dev, 0) ** 2 + atr_pct * atr_pct) * sqrt(v * v + d * d + x * x)))) AS sim FROM danger, (VALUES {_cr}) c(crisis, v, d, x)) QUALIFY place <= 3""")
def _crisis(m):
    from barline.operators.rank import top_k

    d = D.crisis_similarity(danger(m), "adx", "ma200_dev", "atr_pct")
    d = top_k(d.select("symbol", "crisis", "similarity"), ["symbol"], [F.desc(F.round("similarity", 9)), F.asc("crisis")], 3)
    return d.select("symbol", "crisis", report("similarity", 5).alias("similarity"), F.col("place").cast("long").alias("place"))


@query("embedding_similarity", "", f"""SELECT a.vec_id, {q('list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / (sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) * sqrt(list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[])))')} AS similarity
  FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def _emb(m):
    e = m.table("embeddings")
    b = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return e.join(b, "vec_id").select("vec_id", report(D.cosine(F.col("embedding"), F.col("other"), -1.0)).alias("similarity"))


# -- recommendations --------------------------------------------------------------------------

_REC = """CASE WHEN up = 3 THEN 'strong_buy' WHEN up = 2 THEN 'buy' WHEN dn = 3 THEN 'strong_sell' WHEN dn = 2 THEN 'sell' ELSE 'hold' END"""
cte("three", "latest night news bars", f"""SELECT *, {_REC} AS rec, CASE WHEN up = 3 OR (dn = 3 AND up < 2) THEN 'high' WHEN up = 2 OR dn = 2 THEN 'medium' ELSE 'low' END AS conf0 FROM (SELECT *, CAST(ns = 'positive' AS INT) + CAST(overnight = 'up' AS INT) + CAST(zone = 'low_zone' AS INT) AS up,
  CAST(ns = 'negative' AS INT) + CAST(overnight = 'down' AS INT) + CAST(zone = 'high_zone' AS INT) AS dn FROM (SELECT l.symbol, coalesce(w.ns, 'neutral') AS ns, n.overnight, CASE WHEN y.p >= 80 THEN 'high_zone' WHEN y.p <= 20 THEN 'low_zone' ELSE 'neutral' END AS zone, y.spike, l.change_pct
  FROM latest l JOIN night n USING (symbol) JOIN (SELECT symbol, (close - lo) / (hi - lo) * 100 AS p, coalesce(volume / v20 >= 2, FALSE) AS spike FROM (SELECT *, max(high) {over(252)} AS hi, min(low) {over(252)} AS lo, round(avg(nullif(volume, 0)) {over(20)}) AS v20 FROM bars) WHERE idx = n - 1) y USING (symbol)
  LEFT JOIN (SELECT symbol, CASE WHEN p + g = 0 THEN 'neutral' WHEN p / (p + g) >= 0.6 THEN 'positive' WHEN p / (p + g) <= 0.3 THEN 'negative' ELSE 'neutral' END AS ns FROM (SELECT symbol, count(*) FILTER (i = 'positive') AS p, count(*) FILTER (i = 'negative') AS g FROM (SELECT symbol, {impact_sql('stock')} AS i FROM news) GROUP BY symbol)) w USING (symbol)))""")
_conf = "CASE WHEN spike AND conf0 = 'high' THEN 'medium' ELSE conf0 END"


def three(m):
    from barline.operators import indicators as ind
    from barline.series import tail

    y = ind.with_year_range(tail(m.bars, 260)).withColumn("spike", ind.volume_spike()).filter("bar_idx = n_bars - 1").select("symbol", "spike", "pos_52w_pct")
    ns = N.impact_balance(news(m).withColumn("impact", T.impact("title")), ["symbol"]).select("symbol", "news_sentiment")
    d = m.latest_moves.select("symbol", "change_pct").join(overnight(m).select("symbol", "overnight"), "symbol").join(y, "symbol").join(ns, "symbol", "left").fillna("neutral", ["news_sentiment"])
    d = d.withColumns(D.three_signals("news_sentiment", "overnight", "pos_52w_pct"))
    return d.withColumn("confidence", D.spike_downgrade("confidence", "spike"))


@query("three_signals", "three", f"SELECT symbol, ns AS news_sentiment, overnight, zone AS price_zone, rec AS recommendation, {_conf} AS confidence FROM three")
def _three(m):
    return three(m).select("symbol", "news_sentiment", "overnight", "price_zone", "recommendation", "confidence")


def inline_hybrid(bars):
    """The composite on the last twenty closes alone: no ranges, no benchmark, hence no ADX and a
    sideways regime. Fewer than ten closes give no row; fewer than twenty an AUTO_NO."""
    n = F.least(F.col("n_bars"), F.lit(20))
    b = bars.filter((F.col("bar_idx") >= F.col("n_bars") - 20) & (F.col("n_bars") >= 10)).withColumns({
        "bar_idx": (F.col("bar_idx") - F.col("n_bars") + n).cast("int"), "n_bars": n.cast("long"), "open": F.col("close"), "high": F.col("close"), "low": F.col("close"), "volume": F.lit(1.0)})
    d = end_values(b)
    has = F.col("atr6") > 0
    d = d.withColumn("vr_", F.when(has, S.volatility_regime("atr_pct_raw")).otherwise("NORMAL_VOL"))
    d = d.withColumns({k: F.when(has, c) for k, c in S.entry_levels("high_20d", "atr6", "atr_pct_raw", "vr_").items()}).withColumns(S.anti_chase_v1("close", "entry_trigger", "atr6"))
    z, one = F.lit(0.0), F.lit(1.0)
    dist = F.greatest(z, (F.col("high_20d") - F.col("close")) / F.col("close") * 100)
    pct = F.coalesce("atr_pct_raw", F.lit(3.0))
    d = d.withColumns({"h_bqs": S.bqs_v1(z, z, z, pct, dist, F.lit("SIDEWAYS"), "vr_", z, one, F.lit(None).cast("double"), F.lit(0)), "h_fws": S.fws_v1(one, "ext_atr", z, F.lit(False), F.lit(False), F.lit(False))})
    d = d.withColumn("h_ncs", S.ncs("h_bqs", "h_fws")).withColumns({"h_action": S.action("h_ncs", "h_fws"), "h_regime": F.lit("SIDEWAYS")})
    short = F.col("n_bars") < 20
    fixed = {"h_bqs": 0.0, "h_fws": 50.0, "h_ncs": 0.0, "h_action": "AUTO_NO"}
    return d.withColumns({k: F.when(short, F.lit(v)).otherwise(F.col(k)) for k, v in fixed.items()}).select("symbol", *fixed, "h_regime")


# Twenty closes have nineteen moves: the mean of the first fourteen, then five Wilder steps.
_w = "list_reduce(list_prepend(list_avg(t[1:14]), t[15:19]), lambda a, x: (a * 13 + x) / 14)"
cte("inl", "bars", f"""SELECT *, {he(cl('bqs - 0.8 * fws + 10.0'), 2)} AS ncs FROM (SELECT *, {he(cl(_HEALTH.format('pct') + f" + 15.0 * {cl('1.0 - dist / 3.0', 0, 1)} + 15.0 * 0.25"), 2)} AS bqs, {he('CASE WHEN ext > 0.8 THEN 25.0 WHEN ext > 0.4 THEN 15.0 ELSE 0.0 END + 10.0 + 10.0 + 10.0', 2)} AS fws FROM (
  SELECT *, {he('(c - trigger) / atr6', 3)} AS ext FROM (SELECT *, {levels_sql('h', 'atr6', 'pct', 'vr')['trigger']} AS trigger, greatest(0.0, (h - c) / c * 100) AS dist FROM (SELECT *, {_VOLREG.format('pct')} AS vr FROM (SELECT *, atr6 / c * 100 AS pct FROM (
  SELECT symbol, {he(_w, 6)} AS atr6, c, h FROM (SELECT symbol, list(abs(close - p) ORDER BY idx) FILTER (idx >= n - 19) AS t, max_by(close, idx) AS c, max(close) AS h FROM (SELECT *, lag(close) OVER (PARTITION BY symbol ORDER BY idx) AS p FROM bars) WHERE idx >= n - 20 GROUP BY symbol)))))))""")
_inact = "CASE WHEN fws > 65 THEN 'AUTO_NO' WHEN ncs >= 70 AND fws <= 30 THEN 'AUTO_YES' ELSE 'CONDITIONAL' END"
cte("reco", "three inl", f"SELECT t.symbol, t.change_pct, ns, rec, CASE WHEN {_inact} = 'AUTO_NO' THEN 'low' ELSE {_conf} END AS conf, bqs, fws, ncs, {_inact} AS act FROM three t JOIN inl USING (symbol)")


def recommended(m):
    d = three(m).join(inline_hybrid(m.bars), "symbol", "left")
    return d.withColumns(D.adjust_recommendation(action="h_action", regime="h_regime", applies=F.col("h_action").isNotNull()))


@query("recommendations", "reco", f"SELECT symbol, rec AS recommendation, conf AS confidence, act AS action, {q('bqs', 2)} AS bqs, {q('fws', 2)} AS fws, {q('ncs', 2)} AS ncs FROM reco")
def _reco(m):
    return recommended(m).select("symbol", "recommendation", "confidence", F.col("h_action").alias("action"), report("h_bqs", 2).alias("bqs"), report("h_fws", 2).alias("fws"), report("h_ncs", 2).alias("ncs"))


_OUT = """CASE rec WHEN 'strong_buy' THEN CASE WHEN pct >= 2 THEN 'hit' WHEN pct >= 0 THEN 'partial' ELSE 'miss' END WHEN 'buy' THEN CASE WHEN pct > 0.5 THEN 'hit' WHEN pct >= -0.5 THEN 'partial' ELSE 'miss' END
  WHEN 'hold' THEN CASE WHEN abs(pct) < 1.5 THEN 'hit' WHEN abs(pct) < 3 THEN 'partial' ELSE 'miss' END WHEN 'sell' THEN CASE WHEN pct < -0.5 THEN 'hit' WHEN pct <= 0.5 THEN 'partial' ELSE 'miss' END
  ELSE CASE WHEN pct <= -2 THEN 'hit' WHEN pct <= 0 THEN 'partial' ELSE 'miss' END END"""
# Every bar's own move, read as the outcome of a recommendation made from the move before.
cte("pred", "moves", f"""SELECT *, {_OUT} AS outcome, CASE WHEN rec IN ('strong_buy', 'buy') THEN 'up' WHEN rec IN ('sell', 'strong_sell') THEN 'down' ELSE 'flat' END AS pd, CASE WHEN pct > 0.3 THEN 'up' WHEN pct < -0.3 THEN 'down' ELSE 'flat' END AS ad FROM (
  SELECT symbol, idx, market, ret * 100 AS pct, CASE WHEN p > 1.5 THEN 'strong_buy' WHEN p > 0.5 THEN 'buy' WHEN p < -1.5 THEN 'strong_sell' WHEN p < -0.5 THEN 'sell' ELSE 'hold' END AS rec FROM (SELECT *, lag(ret) OVER (PARTITION BY symbol ORDER BY idx) * 100 AS p FROM moves) WHERE p IS NOT NULL)""")


def predictions(m):
    from pyspark.sql import Window

    p = F.lag("ret").over(Window.partitionBy("symbol").orderBy("bar_idx")) * 100
    rec = F.when(F.col("p") > 1.5, "strong_buy").when(F.col("p") > 0.5, "buy").when(F.col("p") < -1.5, "strong_sell").when(F.col("p") < -0.5, "sell").otherwise("hold")
    d = m.moves.withColumn("p", p).filter("p is not null").withColumns({"rec": rec, "pct": F.col("ret") * 100})
    return d.withColumns({"outcome": D.classify_outcome("rec", "pct"), "predicted": D.predicted_direction("rec"), "actual": D.actual_direction("pct")})


@query("prediction_outcomes", "pred", "SELECT symbol, idx AS bar_idx, rec, outcome, pd AS predicted, ad AS actual FROM pred")
def _outc(m):
    return predictions(m).select("symbol", F.col("bar_idx").cast("long").alias("bar_idx"), "rec", "outcome", "predicted", "actual")


@query("outcome_accuracy", "pred", f"SELECT market, rec, count(*) AS total, count(*) FILTER (outcome = 'hit') AS hits, count(*) FILTER (outcome = 'partial') AS partial, count(*) FILTER (outcome = 'miss') AS misses, {q(he('(count(*) FILTER (outcome = ' + chr(39) + 'hit' + chr(39) + ') + 0.5 * count(*) FILTER (outcome = ' + chr(39) + 'partial' + chr(39) + ')) / count(*)', 3), 3)} AS hit_rate, {q(he('count(*) FILTER (pd = ad) / count(*)', 3), 3)} AS directional_accuracy FROM pred GROUP BY market, rec")
def _acc(m):
    d = D.outcome_accuracy(predictions(m), ["market", "rec"])
    return d.select("market", "rec", "total", "hits", "partial", "misses", report("hit_rate", 3).alias("hit_rate"), report("directional_accuracy", 3).alias("directional_accuracy"))


@query("stock_report", "reco news", f"""SELECT r.rec AS recommendation, count(*) AS stocks, sum(coalesce(k, 0)) AS news_24h, CAST(max(latest) AS VARCHAR) AS latest_news FROM reco r LEFT JOIN (SELECT symbol, count(*) AS k, max(date_trunc('second', published)) AS latest FROM news WHERE published >= TIMESTAMP '2024-01-30 00:00:00' AND published < TIMESTAMP '2024-01-31 00:00:00' GROUP BY symbol) n USING (symbol) GROUP BY r.rec""")
def _report(m):
    at = F.to_timestamp(F.lit("2024-01-31 00:00:00"))
    n = N.recent(news(m).filter(F.col("published") < at), "published", at).groupBy("symbol").agg(F.count(F.lit(1)).alias("k"), F.max(F.date_trunc("second", "published")).alias("latest"))
    d = recommended(m).join(n, "symbol", "left").groupBy("recommendation").agg(F.count(F.lit(1)).alias("stocks"), F.sum(F.coalesce("k", F.lit(0))).cast("double").alias("news_24h"), F.max("latest").alias("latest"))
    return d.select("recommendation", "stocks", "news_24h", F.date_format("latest", "yyyy-MM-dd HH:mm:ss").alias("latest_news"))


@query("stock_report_rows", "reco snews latest", f"""SELECT symbol, rec AS recommendation, CAST(k AS BIGINT) AS news_count, CAST(seen AS VARCHAR) AS latest_at, title AS latest_title, impact AS latest_impact, outcome, predicted, actual, {q('pct')} AS actual_change_pct FROM (
  SELECT r.symbol, r.rec, coalesce(k, 0) AS k, t.published AS seen, t.title, t.impact, l.change_pct AS pct, CASE WHEN l.change_pct IS NULL THEN 'n/a' ELSE {_OUT.replace('pct', 'l.change_pct')} END AS outcome,
    CASE WHEN rec IN ('strong_buy', 'buy') THEN 'up' WHEN rec IN ('sell', 'strong_sell') THEN 'down' ELSE 'flat' END AS predicted, CASE WHEN l.change_pct > 0.3 THEN 'up' WHEN l.change_pct < -0.3 THEN 'down' ELSE 'flat' END AS actual
  FROM reco r LEFT JOIN latest l USING (symbol) LEFT JOIN (SELECT symbol, count(*) AS k FROM snews WHERE published >= TIMESTAMP '2024-01-30 00:00:00' AND published < TIMESTAMP '2024-01-31 00:00:00' GROUP BY symbol) c USING (symbol)
  LEFT JOIN (SELECT * FROM snews WHERE published >= TIMESTAMP '2024-01-30 00:00:00' AND published < TIMESTAMP '2024-01-31 00:00:00' QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY published DESC, news_id) = 1) t USING (symbol))""")
def _report_rows(m):
    """Each stock's recommendation, its news of the last day, and how the day turned out. Groups are not gathered."""
    at = F.to_timestamp(F.lit("2024-01-31 00:00:00"))
    items = N.recent(stock_news(m).filter(F.col("published") < at), "published", at)
    d = N.with_latest(recommended(m).select("symbol", "recommendation"), items, ["symbol"]).join(m.latest_moves.select("symbol", "change_pct"), "symbol", "left")
    d = d.withColumns({"outcome": D.classify_outcome("recommendation", "change_pct"), "predicted": D.predicted_direction("recommendation"), "actual": D.actual_direction("change_pct")})
    return d.select("symbol", "recommendation", "news_count", F.date_format("latest_at", "yyyy-MM-dd HH:mm:ss").alias("latest_at"), "latest_title", "latest_impact", "outcome", "predicted", "actual", report("change_pct").alias("actual_change_pct"))


_briefing = "SELECT cluster, symbol, close, bar_date, volume >= 10 AS avail, CASE WHEN sleeve IN ('CORE', 'ETF') THEN 'index' ELSE 'overnight' END AS kind, CASE sleeve WHEN 'HIGH_RISK' THEN 'VIX' WHEN 'HEDGE' THEN CASE WHEN change_pct > 1 THEN '다우' ELSE 'S&P 500' END ELSE name END AS nm, CASE direction WHEN 'up' THEN 1.0 WHEN 'down' THEN -1.0 ELSE 0.0 END AS sc FROM latest"
_feel = lambda x: f"CASE WHEN {x} > 0.3 THEN 'positive' WHEN {x} < -0.3 THEN 'negative' ELSE 'neutral' END"


@query("core_summary", "latest snews", f"""SELECT cluster, {_feel('a')} AS market_mood, {_feel('b')} AS kr_mood, {_feel('c')} AS us_mood, k AS available_indices, e AS expected_indices, o AS overnight_markets, CAST(as_of AS VARCHAR) AS as_of,
  CASE WHEN v >= 30 THEN 'extreme_fear' WHEN v >= 20 THEN 'fear' WHEN v <= 13 THEN 'complacency' WHEN v IS NOT NULL THEN 'normal' END AS vix_signal, coalesce(p, 0) AS positive_news, coalesce(g, 0) AS negative_news, coalesce(z, 0) AS neutral_news FROM (
  SELECT cluster, avg(CASE WHEN kind = 'index' AND avail THEN sc WHEN nm = 'S&P 500' AND kind = 'overnight' THEN 1.5 * sc END) AS a, avg(CASE WHEN kind = 'index' AND avail THEN sc END) AS b, avg(CASE WHEN kind = 'overnight' AND nm <> 'VIX' THEN sc END) AS c,
    count(*) FILTER (kind = 'index' AND avail) AS k, count(*) FILTER (kind = 'index') AS e, count(*) FILTER (kind = 'overnight') AS o, min_by(close, symbol) FILTER (kind = 'overnight' AND nm = 'VIX') AS v, min_by(bar_date, symbol) FILTER (kind = 'index' AND avail) AS as_of FROM ({_briefing}) GROUP BY cluster)
  LEFT JOIN (SELECT cluster, count(*) FILTER (impact = 'positive') AS p, count(*) FILTER (impact = 'negative') AS g, count(*) FILTER (impact = 'neutral') AS z FROM snews GROUP BY cluster) USING (cluster)""")
def _core(m):
    nm = F.when(F.col("sleeve") == "HIGH_RISK", "VIX").when(F.col("sleeve") == "HEDGE", F.when(F.col("change_pct") > 1, "다우").otherwise("S&P 500")).otherwise(F.col("name"))
    rows = m.latest_moves.select("cluster", nm.alias("name"), F.when(F.col("sleeve").isin("CORE", "ETF"), "index").otherwise("overnight").alias("kind"), "direction", (F.col("volume") >= 10).alias("available"), F.col("close").alias("value"), F.col("bar_date").alias("as_of"), F.col("symbol").alias("place"))
    return A.core_summary(rows, stock_news(m).select("cluster", "impact"), ["cluster"]).withColumn("as_of", F.col("as_of").cast("string"))


# -- composite, cross reference, confidence ---------------------------------------------------

_TREND = "greatest(-1.0, least(1.0, CASE WHEN close > ma20 THEN 0.25 ELSE -0.15 END + CASE WHEN close > ma60 THEN 0.25 ELSE -0.15 END + CASE WHEN macd > sig THEN 0.20 ELSE -0.10 END + CASE WHEN rsi >= 45 AND rsi <= 65 THEN 0.15 WHEN rsi > 75 THEN -0.20 WHEN rsi < 35 THEN 0.05 ELSE 0.0 END + CASE WHEN coalesce(adx, 20) >= 25 THEN 0.15 ELSE 0.0 END))::DOUBLE"
_c1 = lambda x: f"greatest(-1.0, least(1.0, {x}))"
cte("comp", "panel", f"SELECT *, greatest(0.0, least(100.0, 50 + (35 * trend + 30 * {_c1('(rsi - 50) / 30')} + 20 * {_c1('(3 - atr / close * 100) / 3')} + 15 * {_c1('vr_prior - 1')}) / 2)) AS composite FROM (SELECT *, {_TREND} AS trend FROM panel)")


def with_composite(p):
    one = lambda c: F.greatest(F.lit(-1.0), F.least(F.lit(1.0), c))
    d = p.withColumn("trend", D.trend_score())
    axes = {"trend": F.col("trend"), "momentum": one((F.col("rsi") - 50) / 30), "volatility": one((3 - F.col("atr") / F.col("close") * 100) / 3), "volume": one(F.col("vr_prior") - 1)}
    return d.withColumn("composite", D.composite_score(axes))


@query("composite_score", "comp", f"SELECT symbol, idx AS bar_idx, {q('trend', 2)} AS trend_score, {q('composite')} AS composite FROM comp WHERE idx >= 59")
def _comp(m):
    d = with_composite(m.panel_view().filter("bar_idx >= 59"))
    return d.select("symbol", F.col("bar_idx").cast("long").alias("bar_idx"), report("trend", 2).alias("trend_score"), report("composite").alias("composite"))


cte("xref", "scan reco comp", f"""SELECT *, CASE WHEN fin >= 75 THEN 'STRONG_BUY' WHEN fin >= 60 THEN 'BUY' WHEN fin >= 40 THEN 'HOLD' WHEN fin >= 25 THEN 'SELL' ELSE 'AVOID' END AS label, CASE WHEN clash THEN 'low' WHEN ncs >= 70 AND fws <= 30 AND st = 'READY' THEN 'high' WHEN ncs >= 50 AND fws <= 50 THEN 'medium' ELSE 'low' END AS cf FROM (
  SELECT *, greatest(0.0, least(100.0, model * 0.4 + ncs * 0.3 + bqs * 0.15 + nsc * 0.15 - least(40.0, pen))) AS fin FROM (
  SELECT coalesce(s.symbol, r.symbol) AS symbol, coalesce(s.status, 'UNKNOWN') AS st, rec, ns, coalesce(nullif(coalesce(r.ncs, s.ncs), 0), 50) AS ncs, coalesce(nullif(coalesce(r.bqs, s.bqs), 0), 50) AS bqs, coalesce(nullif(coalesce(r.fws, s.fws), 0), 50) AS fws,
   CASE WHEN coalesce(c.m, 50.0) <> 50.0 THEN c.m ELSE CASE rec WHEN 'strong_buy' THEN 90.0 WHEN 'buy' THEN 70.0 WHEN 'sell' THEN 30.0 WHEN 'strong_sell' THEN 10.0 ELSE 50.0 END END AS model, CASE ns WHEN 'positive' THEN 75.0 WHEN 'negative' THEN 25.0 ELSE 50.0 END AS nsc,
   (coalesce(s.status = 'READY', FALSE) AND ns = 'negative') OR coalesce(s.action, r.act) = 'AUTO_NO' AS clash, CASE WHEN s.status = 'READY' AND ns = 'negative' THEN 10 ELSE 0 END + CASE WHEN coalesce(s.action, r.act) = 'AUTO_NO' THEN 15 ELSE 0 END + CASE WHEN s.status IN ('FAR', 'EARNINGS_BLOCK') THEN 10 ELSE 0 END + CASE WHEN conf = 'low' THEN 8 ELSE 0 END AS pen
  FROM reco r FULL JOIN scan s USING (symbol) LEFT JOIN (SELECT symbol, composite AS m FROM comp WHERE idx = n - 1) c ON c.symbol = coalesce(s.symbol, r.symbol)))""")


@query("cross_reference", "xref", f"SELECT symbol, {q(he('fin', 1), 1)} AS final_score, label AS final_label, cf AS confidence, st AS scan_status FROM xref")
def _xref(m):
    model = with_composite(m.panel_ends()).select("symbol", F.col("composite").alias("model_score"))
    d = D.cross_reference(the_scan(m), recommended(m), model)
    return d.select("symbol", report("final_score", 1).alias("final_score"), "final_label", "confidence", "scan_status")


cte("macro", "snap bars", """SELECT s.symbol, adx AS vix, c10 AS vix_chg, c5 AS sp5, c10 AS sp10, c5 / 3 AS dxy FROM snap s JOIN (SELECT symbol, (close - lag(close, 5) OVER w) / lag(close, 5) OVER w * 100 AS c5, (close - lag(close, 10) OVER w) / lag(close, 10) OVER w * 100 AS c10, idx, n FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY idx)) b ON b.symbol = s.symbol AND b.idx = b.n - 1""")
cte("macro2", "macro", """SELECT *, CASE regime WHEN 'Risk-Off' THEN -6 WHEN 'Transition' THEN -3 ELSE 0 END AS wt FROM (SELECT *, CASE WHEN vix < 16 AND sp5 > 1 AND NOT dxy > 1 THEN 'Risk-On' WHEN vix > 22 AND sp5 < -1 THEN 'Risk-Off' WHEN (sp5 * sp10 < 0 AND abs(sp5) > 1) OR abs(vix_chg) > 25 THEN 'Transition'
  WHEN abs(sp5) < 0.5 AND abs(dxy) < 0.5 AND vix < 22 THEN 'Neutral' ELSE 'Transition' END AS regime FROM macro)""")


def macro(m):
    d = m.snapshot_ends().select("symbol", "adx").join(last_changes(m), "symbol")
    return d.withColumns(D.macro_regime("adx", "change_10", "change_5", "change_10", F.col("change_5") / 3))


@query("macro_regime", "macro2", "SELECT symbol, regime AS macro_regime, CAST(wt AS BIGINT) AS macro_weight FROM macro2")
def _macro(m):
    return macro(m).select("symbol", "macro_regime", F.col("macro_weight").cast("long").alias("macro_weight"))


cte("conf", "comp macro2 universe nsent snap", f"""SELECT symbol, tech, ai, sent, mkt, regime, wt, days_to_earnings AS de, hc, ai_ * 0.30 + tech * 0.35 + sent * 0.15 + mkt * 0.20 AS w, CASE WHEN ai IS NULL THEN [tech, sent, mkt] ELSE [tech, sent, mkt, ai] END AS src FROM (SELECT c.symbol, c.composite AS tech, CASE WHEN c.symbol % 3 <> 0 THEN s.efficiency END AS ai,
  CASE WHEN c.symbol % 3 <> 0 THEN s.efficiency ELSE c.composite END AS ai_, coalesce(n.sentiment_score, 50.0) AS sent, greatest(0.0, least(100.0, 50 + 10 * m.sp5)) AS mkt, m.regime, m.wt, u.days_to_earnings, CASE WHEN c.symbol % 2 = 0 THEN 60 END AS hc FROM comp c JOIN macro2 m USING (symbol) JOIN universe u USING (symbol) JOIN snap s USING (symbol) LEFT JOIN nsent n USING (symbol) WHERE c.idx = c.n - 1)""")
cte("conf2", "conf", """SELECT *, round_even(greatest(5.0, least(95.0, least(greatest(5.0, least(95.0, 50 + abs(w - 50) / 50.0 * 38 - pen + wt)), least(cap, CASE WHEN de IS NULL OR de < 0 THEN 100 WHEN de <= 1 THEN 60 WHEN de <= 5 THEN 70 ELSE 100 END, coalesce(hc, 100))))), 0) AS confidence,
  round_even(greatest(4.0, least(45.0, least(30.0, sd * 1.2) + CASE regime WHEN 'Transition' THEN 8 WHEN 'Risk-Off' THEN 6 ELSE 2 END + CASE WHEN de BETWEEN 0 AND 5 THEN 6 ELSE 0 END)), 0) AS ispread FROM (
  SELECT *, list_stddev_pop(src) AS sd, CASE WHEN spread > 50 THEN 12 WHEN spread > 35 THEN 7 WHEN spread > 25 THEN 3 ELSE 0 END AS pen, CASE WHEN spread > 50 THEN 55 WHEN spread > 35 THEN 65 WHEN spread > 25 THEN 75 ELSE 100 END AS cap FROM (SELECT *, list_max(src) - list_min(src) AS spread FROM conf))""")


@query("signal_confidence", "conf2", f"""SELECT symbol, {q('w')} AS weighted_score, CASE WHEN w >= 60 THEN 'BUY' WHEN w <= 40 THEN 'SELL' ELSE 'NEUTRAL' END AS signal, CAST(confidence AS BIGINT) AS confidence, {q('spread')} AS score_spread, CAST(least(round_even(greatest(0.0, least(100.0, confidence - ispread / 2)), 0), CASE WHEN hc IS NOT NULL THEN confidence ELSE 200 END) AS BIGINT) AS interval_low,
  CAST(least(round_even(greatest(0.0, least(100.0, confidence + ispread / 2)), 0), coalesce(hc, 200)) AS BIGINT) AS interval_high FROM conf2""")
def _sigconf(m):
    p = with_composite(m.panel_ends()).select("symbol", F.col("composite").alias("technical"))
    d = p.join(macro(m).select("symbol", "macro_regime", "macro_weight", "change_5"), "symbol").join(m.universe.select("symbol", "days_to_earnings"), "symbol").join(m.snapshots.select("symbol", "efficiency"), "symbol")
    d = d.join(sentiments(m).select("symbol", F.col("sentiment_score").alias("sentiment")), "symbol", "left")
    d = d.withColumns({"ai": F.when(F.col("symbol") % 3 != 0, F.col("efficiency")), "market": F.greatest(F.lit(0.0), F.least(F.lit(100.0), 50 + 10 * F.col("change_5"))), "sector_adjust": F.lit(0), "history_cap": F.when(F.col("symbol") % 2 == 0, 60)})
    d = D.signal_confidence(d)
    return d.select("symbol", report("weighted_score").alias("weighted_score"), "signal", "confidence", report("score_spread").alias("score_spread"), "interval_low", "interval_high")


# -- price plans ------------------------------------------------------------------------------

cte("simil", "panel", """SELECT s.symbol, coalesce(avg(CAST(best / close - 1 >= greatest(0.012, s.nap / 100 * 0.8) AS INT)), 0.55) AS win, count(best) AS k FROM (SELECT symbol, rsi AS nr, atr / close * 100 AS nap, n FROM panel WHERE idx = n - 1) s LEFT JOIN (
  SELECT symbol, idx, close, rsi, atr / close * 100 AS ap, max(close) OVER (PARTITION BY symbol ORDER BY idx ROWS BETWEEN 1 FOLLOWING AND 20 FOLLOWING) AS best FROM panel WHERE idx >= 59) h ON h.symbol = s.symbol AND h.idx - 59 >= 20 AND h.idx < s.n - 20 AND abs(h.rsi - s.nr) <= 8 AND abs(h.ap - s.nap) <= 0.7 AND s.n - 59 >= 60 GROUP BY s.symbol""")


@query("similar_patterns", "simil", f"SELECT symbol, {q('win')} AS pattern_win, k AS pattern_n FROM simil")
def _simil(m):
    d = D.similar_pattern_rate(m.panel)
    return d.select("symbol", report("pattern_win").alias("pattern_win"), "pattern_n")


def prob_sql(base: str, pct="pct", trend="trend", win="win", k="k") -> str:
    r = f"({pct} / CASE WHEN market = 'US' THEN 1.83 ELSE 2.37 END)"
    return he(f"greatest(0.05, least(0.92, {base} + CASE WHEN market = 'US' THEN 0.05 ELSE -0.06 END - 0.08 * greatest(0.0, {r} - 1) + 0.03 * greatest(0.0, 1 - {r}) + 0.10 * {trend} + ({win} - {base}) * 0.35 * least({k} / 12.0, 1.0))) * 100", 1)


cte("plan", "comp simil universe", "SELECT c.*, u.market, s.win, s.k, atr / close * 100 AS pct FROM comp c JOIN simil s USING (symbol) JOIN universe u USING (symbol) WHERE idx = n - 1")
_z = ", ".join(f"('{mk}', '{z}', {a}::DOUBLE, {b}::DOUBLE, {w}::DOUBLE)" for mk, rows in D.ZONES.items() for z, a, b, w, *_r in rows)
cte("bb", "plan", f"""SELECT *, {prob_sql('wp')} AS win_pct FROM (SELECT symbol, market, close, atr, pct, trend, win, k, n, band, d1, d2, wp, CASE WHEN market = 'US' THEN 0.92 ELSE 1.18 END * atr AS aw, CASE band WHEN 'A' THEN anc WHEN 'B' THEN CASE WHEN fib382 < close THEN (anc + fib382) / 2 ELSE anc - atr * 0.35 END ELSE (strong + support) / 2 END AS ax FROM (
  SELECT p.*, list_avg(list_filter([ma20 * 0.995, ma20 * 0.995, vwap, CASE WHEN fib382 < close THEN fib382 END], lambda x: x IS NOT NULL)) AS anc FROM plan p) JOIN (VALUES {_z}) z(mk, band, d1, d2, wp) ON mk = market)""")
cte("bands2", "bb", "SELECT symbol, close, n, band, win_pct, 'aggressive' AS family, close - d2 * aw AS lo, close - d1 * aw AS hi FROM bb UNION ALL SELECT symbol, close, n, band, win_pct, 'recommended', ax - d2 * aw * 0.75, ax - d1 * aw * 0.45 FROM bb")


def plan(m):
    """One row per symbol; several reports read it, so it is written once."""
    if not hasattr(m, "price_plan"):
        m.price_plan = written(D.plan_rows(m.panel_view(), m.universe.select("symbol", "market")), "plan")
    return m.price_plan


@query("buy_bands", "bands2", f"SELECT symbol, family, band, {q('lo')} AS low, {q('hi')} AS high, {q('win_pct', 1)} AS win_pct, {q('100 - win_pct', 1)} AS loss_pct FROM bands2")
def _bands(m):
    d = D.buy_bands(plan(m))
    return d.select("symbol", "family", "band", report("low").alias("low"), report("high").alias("high"), report("win_pct", 1).alias("win_pct"), report("loss_pct", 1).alias("loss_pct"))


_tpv = ", ".join(f"('{mk}', '{k}', {D.RISK_MODEL[k][0]}::DOUBLE, {i + 1}, {D.RISK_MODEL[k][1][i]}::DOUBLE, {D.TP_PROB[mk][k][i]}::DOUBLE, {D.TP_DAYS[mk][k][i]})" for mk in D.TP_PROB for k in D.RISK_MODEL for i in range(3))
cte("tp", "plan", f"""SELECT *, min(p + 3.0 * lvl) OVER (PARTITION BY symbol, profile ORDER BY lvl) - 3.0 * lvl AS cp, close + atr * mul * CASE WHEN market = 'US' THEN 1.05 ELSE 0.95 END AS price, close - sm * atr * CASE WHEN market = 'US' THEN 0.92 ELSE 1.18 END AS stop FROM (
  SELECT symbol, market, close, atr, pct, profile, sm, lvl, mul, days, {prob_sql('base')} AS p FROM plan JOIN (VALUES {_tpv}) t(mk, profile, sm, lvl, mul, base, days) ON mk = market)""")


@query("take_profit_levels", "tp", f"SELECT symbol, profile, CAST(lvl AS BIGINT) AS level, {q('price')} AS price, {q('cp', 1)} AS hit_prob_pct, CAST(days AS BIGINT) AS days, {q('(price - close) / greatest(close - stop, 1e-9)')} AS risk_reward, {q('-sm * pct * CASE WHEN market = ' + chr(39) + 'US' + chr(39) + ' THEN 0.96 ELSE 1.08 END * (1 + 0.05 * (lvl - 1))')} AS failed_loss_pct FROM tp")
def _tp(m):
    d = D.take_profit_levels(plan(m))
    return d.select("symbol", "profile", F.col("level").cast("long").alias("level"), report("price").alias("price"), report("hit_prob_pct", 1).alias("hit_prob_pct"), F.col("days").cast("long").alias("days"), report("risk_reward").alias("risk_reward"), report("failed_loss_pct").alias("failed_loss_pct"))


@query("band_steps", "bands2 bars", f"""SELECT symbol, family, band, CAST(stp AS BIGINT) AS step, {q('price')} AS price, alloc AS allocation_pct, {q('reached / paths * 100')} AS reach_pct, {q('dmin', 2)} AS days_min, {q('dmax', 2)} AS days_max FROM (
  SELECT b.symbol, b.family, b.band, stp, any_value(price) AS price, any_value([10.0, 15.0, 20.0, 25.0, 30.0]::DOUBLE[])[stp] AS alloc, any_value(n - 30) AS paths, count(day) AS reached, quantile_cont(day, 0.25) AS dmin, quantile_cont(day, 0.75) AS dmax FROM (
  SELECT b.*, h.idx, min(f.idx - h.idx) AS day FROM (SELECT *, hi - (hi - lo) * (stp - 1) / 4 AS price, 1 - (hi - (hi - lo) * (stp - 1) / 4) / close AS depth FROM bands2, (SELECT unnest(range(1, 6)) AS stp)) b JOIN bars h ON h.symbol = b.symbol AND h.idx < h.n - 30
  LEFT JOIN bars f ON f.symbol = h.symbol AND f.idx BETWEEN h.idx + 1 AND h.idx + 30 AND 1 - f.low / h.close >= b.depth GROUP BY ALL) b GROUP BY b.symbol, b.family, b.band, stp)""")
def _steps(m):
    d = D.band_steps(D.buy_bands(plan(m)), m.bars)
    return d.select("symbol", "family", "band", F.col("step").cast("long").alias("step"), report("price").alias("price"), "allocation_pct", report("reach_pct").alias("reach_pct"), report("days_min", 2).alias("days_min"), report("days_max", 2).alias("days_max"))


# -- target back-test -------------------------------------------------------------------------

cte("tsig", "comp universe", "SELECT c.*, u.market, atr / close * 100 AS pct, 0.55 AS win, 0 AS k FROM comp c JOIN universe u USING (symbol) WHERE n >= 300 AND idx - 59 >= greatest(140, n - 59 - 252 - 90) AND idx - 59 < n - 59 - 90 AND (idx - 59 - greatest(140, n - 59 - 252 - 90)) % 15 = 0")
cte("tt", "tsig", f"""SELECT symbol, market, idx, profile, close, price, least(p1 - 3.0, p2) AS conf FROM (SELECT symbol, market, idx, close, profile, max(CASE WHEN lvl = 2 THEN close + atr * mul * CASE WHEN market = 'US' THEN 1.05 ELSE 0.95 END END) AS price, max(CASE WHEN lvl = 1 THEN p END) AS p1, max(CASE WHEN lvl = 2 THEN p END) AS p2 FROM (
  SELECT t.*, v.*, {prob_sql('base')} AS p FROM tsig t JOIN (VALUES {_tpv}) v(mk, profile, sm, lvl, mul, base, days) ON mk = market WHERE lvl <= 2) GROUP BY ALL)
UNION ALL SELECT symbol, market, idx, 'pullback_main', close, greatest(hi20, close + atr), {prob_sql("CASE WHEN market = 'US' THEN 0.66 ELSE 0.56 END")} FROM tsig
UNION ALL SELECT symbol, market, idx, 'pullback_ext', close, greatest(hi20, close + atr) + 0.618 * (hi20 - lo20), {prob_sql("CASE WHEN market = 'US' THEN 0.40 ELSE 0.29 END")} FROM tsig""")
cte("thit", "tt bars", "SELECT t.*, (price - close) / close * 100 AS needed, (SELECT min(b.idx) FROM bars b WHERE b.symbol = t.symbol AND b.idx BETWEEN t.idx + 1 AND t.idx + 90 AND b.high >= t.price) - t.idx AS days FROM tt t")


def targets(m):
    """The touches of all profiles' targets; three reports read them, so they are written once."""
    if not hasattr(m, "target_hits"):
        p = m.panel_view().filter("n_bars >= 300")
        s = B.sampled(p, 252 + 90, 15, 90).join(m.universe.select("symbol", "market"), "symbol")
        s = s.select("symbol", "market", "bar_idx", "close", "atr", "high20", "low20", D.trend_score().alias("trend"), (F.col("atr") / F.col("close") * 100).alias("atr_pct"), F.lit(0.55).alias("pattern_win"), F.lit(0).alias("pattern_n"))
        s = written(s, "signals")  # both kinds of targets read them
        tp = D.take_profit_levels(s).filter("level = 2")
        keys = ["symbol", "market", "bar_idx", "close"]
        sig = tp.groupBy(*keys).agg(F.collect_list(F.struct("profile", F.col("price").alias("target"), F.col("hit_prob_pct").alias("confidence"), half_even("return_pct", 2).alias("needed_pct"))).alias("targets"))
        said = {k: D.probability(F.when(F.col("market") == "US", D.TP_PROB["US"]["balanced"][i]).otherwise(D.TP_PROB["KRX"]["balanced"][i]), "atr_pct", "market", "trend", "pattern_win", "pattern_n") for k, i in (("main", 0), ("ext", 2))}
        pull = s.withColumns(said).select(*keys, "main", "ext", B.pullback_targets().alias("ts"))
        full = F.transform("ts", lambda t: F.struct(t["profile"].alias("profile"), t["target"].alias("target"), F.when(t["profile"] == "pullback_main", F.col("main")).otherwise(F.col("ext")).alias("confidence"), half_even((t["target"] - F.col("close")) / F.col("close") * 100, 2).alias("needed_pct")))
        m.target_hits = written(B.target_hits(sig.unionByName(pull.select(*keys, full.alias("targets"))), m.bars), "targets")
    return m.target_hits


@query("target_hits", "thit", f"SELECT symbol, idx AS bar_idx, profile, {q('price')} AS target, {q('conf', 1)} AS confidence, CAST(days AS DOUBLE) AS days_to_hit FROM thit")
def _thit(m):
    return targets(m).select("symbol", F.col("bar_idx").cast("long").alias("bar_idx"), "profile", report("target").alias("target"), report("confidence", 1).alias("confidence"), F.col("days_to_hit").cast("double").alias("days_to_hit"))


@query("target_summary", "thit", f"SELECT market, profile, count(*) AS n_signals, {q(he('avg(CAST(days IS NOT NULL AS DOUBLE)) * 100', 1), 1)} AS hit_rate_pct, {q('avg(' + he('needed', 2) + ')', 1)} AS avg_needed_pct, {q('median(conf)', 2)} AS median_confidence, CAST(median(days) AS DOUBLE) AS median_days_to_hit FROM thit GROUP BY market, profile")
def _tsum(m):
    from barline.operators.quantiles import exact_quantiles

    h = targets(m)
    d = B.target_summary(h).join(exact_quantiles(h, ["market", "profile"], {"c": F.col("confidence")}, [0.5]), ["market", "profile"])
    avg = h.groupBy("market", "profile").agg(report(F.avg("needed_pct"), 1).alias("needed"))
    return d.join(avg, ["market", "profile"]).select("market", "profile", "n_signals", report("hit_rate_pct", 1).alias("hit_rate_pct"), F.col("needed").alias("avg_needed_pct"), report("c_50", 2).alias("median_confidence"), "median_days_to_hit")


@query("calibration", "thit", f"SELECT profile, bucket, count(*) AS n_signals, {q('avg(conf)', 2)} AS predicted_pct, {q('avg(h) * 100', 2)} AS actual_pct FROM (SELECT *, CASE WHEN conf < 35 THEN 'low' WHEN conf < 60 THEN 'mid' ELSE 'high' END AS bucket, CAST(days IS NOT NULL AS DOUBLE) AS h FROM thit) GROUP BY profile, bucket")
def _calib(m):
    h = targets(m)
    d = B.calibration(h)
    b = F.when(F.col("confidence") < 35, "low").when(F.col("confidence") < 60, "mid").otherwise("high")
    fine = h.withColumn("bucket", b).groupBy("profile", "bucket").agg(report(F.avg("confidence"), 2).alias("p"), report(F.avg(F.col("hit").cast("double")) * 100, 2).alias("a"))
    return d.join(fine, ["profile", "bucket"]).select("profile", "bucket", "n_signals", F.col("p").alias("predicted_pct"), F.col("a").alias("actual_pct"))
