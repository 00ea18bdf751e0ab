"""Risk levels, recommendations, confidence and price plans, row by row over prepared tables."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from barline.functions.numeric import bands, col, flag, half_even, points
from barline.functions.scores import lookup
from barline.series import SEGMENT, by_symbol, own_rows, segmented

# -- market immunity --------------------------------------------------------------------------

# Name, volatility index, distance from the 200-day mean, volatility, drawdown, severity.
CRISES = [
    ("COVID-19 (2020-03)", 82.0, -30.0, 6.5, -34.0, "EXTREME"), ("GFC (2008-10)", 89.5, -35.0, 7.0, -50.0, "EXTREME"), ("Dot-com (2002-10)", 42.0, -25.0, 4.0, -49.0, "SEVERE"),
    ("Flash Crash (2010-05)", 45.0, -12.0, 5.5, -16.0, "SEVERE"), ("Sell-off (2018-12)", 36.0, -10.0, 3.0, -20.0, "MODERATE"), ("Rate shock (2022)", 38.0, -18.0, 3.5, -27.0, "MODERATE"),
    ("Ordinary correction", 25.0, -5.0, 1.5, -8.0, "MILD"),
]


def immunity(vix, ma200_dev, vol_pct, advance_decline=None, bars=None) -> dict[str, Column]:
    """Danger score 0..100, level and switches. NULL inputs add nothing. With ``bars`` given, a
    history below five bars is only a caution."""
    v, d, a = col(vix), col(ma200_dev), col(vol_pct)
    total = (F.when(d < -20, 35.0).when(d < -10, 20.0).otherwise(0.0) + F.when(v >= 40, 40.0).when(v >= 30, 25.0).when(v >= 20, 10.0).otherwise(0.0)
             + F.when(a >= 5, 20.0).when(a >= 3, 10.0).otherwise(0.0))
    if advance_decline is not None:
        total = total + points(flag(col(advance_decline) < 0.7), 10)
    score = F.least(total, F.lit(100.0))
    level = bands(score, [(">=", 65, "IMMUNE"), (">=", 40, "ALERT"), (">=", 20, "CAUTION")], "CLEAR")
    short = flag(col(bars) < 5) if bars is not None else F.lit(False)
    score, level = F.when(short, 50.0).otherwise(half_even(score, 1)), F.when(short, "CAUTION").otherwise(level)
    return {
        "immune_score": score, "immune_level": level, "disable_new_entries": ~short & level.isin("IMMUNE", "ALERT"), "disable_automated": ~short & level.isin("IMMUNE", "ALERT", "CAUTION"),
        "reduce_size": ~short & level.isin("IMMUNE", "ALERT", "CAUTION"), "confirm_manually": ~short & (level == "ALERT"),
    }


def cosine(a: Column, b: Column, lo: float = 0.0, hi: float = 1.0) -> Column:
    """Cosine similarity of two arrays, clipped; 0 where one has no length."""
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda s, v: s + v)
    dot = total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))
    norm = F.sqrt(total(F.transform(a, lambda x: x.cast("double") * x.cast("double")))) * F.sqrt(total(F.transform(b, lambda x: x.cast("double") * x.cast("double"))))
    return F.when(norm == 0, 0.0).otherwise(F.greatest(F.lit(lo), F.least(F.lit(hi), dot / F.nullif(norm, F.lit(0.0)))))


def crisis_similarity(states: DataFrame, vix="vix", dev="ma200_dev", vol="vol_pct") -> DataFrame:
    """Every state against the seven crises. The crises are a literal table of fixed size."""
    now = F.array(F.coalesce(col(vix), F.lit(15.0)), F.coalesce(col(dev), F.lit(0.0)), F.coalesce(col(vol), F.lit(1.5)))
    table = F.array(*[F.struct(F.lit(n).alias("crisis"), F.lit(v).alias("c_vix"), F.lit(d).alias("c_dev"), F.lit(x).alias("c_vol"), F.lit(dd).alias("c_drawdown"), F.lit(s).alias("severity")) for n, v, d, x, dd, s in CRISES])
    d = states.withColumn("_c", F.explode(table)).select("*", "_c.*").drop("_c")
    return d.withColumn("similarity", cosine(now, F.array("c_vix", -F.abs("c_dev"), "c_vol")))


# -- recommendations --------------------------------------------------------------------------

def three_signals(news, overnight, position_pct) -> dict[str, Column]:
    """Recommendation and confidence from news, overnight direction and place in the year's range."""
    p = col(position_pct)
    zone = F.when(p >= 80, "high_zone").when(p <= 20, "low_zone").otherwise("neutral")
    n = lambda *c: sum(((x.cast("int")) for x in map(flag, c)), F.lit(0))
    up, down = n(col(news) == "positive", col(overnight) == "up", zone == "low_zone"), n(col(news) == "negative", col(overnight) == "down", zone == "high_zone")
    rec = F.when(up == 3, "strong_buy").when(up == 2, "buy").when(down == 3, "strong_sell").when(down == 2, "sell").otherwise("hold")
    conf = F.when((up == 3) | ((down == 3) & (up < 2)), "high").when((up == 2) | (down == 2), "medium").otherwise("low")
    return {"price_zone": zone, "recommendation": rec, "confidence": conf}


def spike_downgrade(confidence, spike) -> Column:
    return F.when(flag(col(spike)) & (col(confidence) == "high"), "medium").otherwise(col(confidence))


def adjust_recommendation(rec="recommendation", conf="confidence", action="action", regime="regime", applies=None) -> dict[str, Column]:
    """Score and regime on a recommendation: AUTO_NO lowers confidence, AUTO_YES in a bull market
    raises that of a buy, and a bear market turns a buy into a hold."""
    on = F.lit(True) if applies is None else flag(applies)
    r, c, a, g = map(col, (rec, conf, action, regime))
    buy = r.isin("buy", "strong_buy")
    c2 = F.when(a == "AUTO_NO", "low").when((a == "AUTO_YES") & (g == "BULLISH") & buy, "high").otherwise(c)
    bear = (g == "BEARISH") & buy
    return {"recommendation": F.when(on & bear, "hold").otherwise(r), "confidence": F.when(on, F.when(bear, "low").otherwise(c2)).otherwise(c)}


def classify_outcome(rec, pct) -> Column:
    r, p = col(rec), col(pct)
    tier = lambda hit, part: F.when(hit, "hit").when(part, "partial").otherwise("miss")
    return (F.when(p.isNull(), "n/a").when(r == "strong_buy", tier(p >= 2, p >= 0)).when(r == "buy", tier(p > 0.5, p >= -0.5)).when(r == "hold", tier(F.abs(p) < 1.5, F.abs(p) < 3))
            .when(r == "sell", tier(p < -0.5, p <= 0.5)).when(r == "strong_sell", tier(p <= -2, p <= 0)).otherwise("n/a"))


def predicted_direction(rec) -> Column:
    return F.when(col(rec).isin("strong_buy", "buy"), "up").when(col(rec).isin("strong_sell", "sell"), "down").otherwise("flat")


def actual_direction(pct) -> Column:
    return F.when(col(pct) > 0.3, "up").when(col(pct) < -0.3, "down").otherwise("flat")


def outcome_accuracy(df: DataFrame, keys: list[str]) -> DataFrame:
    """Hits, half credit for partials, and directional accuracy; rows without outcome do not count."""
    n = lambda v: F.count_if(F.col("outcome") == v)
    g = df.filter("outcome <> 'n/a'").groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total"), n("hit").alias("hits"), n("partial").alias("partial"), n("miss").alias("misses"), F.count_if(F.col("predicted") == F.col("actual")).alias("_d"))
    return g.withColumns({"hit_rate": half_even((F.col("hits") + 0.5 * F.col("partial")) / F.col("total"), 3), "directional_accuracy": half_even(F.col("_d") / F.col("total"), 3)}).drop("_d")


# -- cross reference --------------------------------------------------------------------------

def cross_reference(scan: DataFrame, analysed: DataFrame, model: DataFrame) -> DataFrame:
    """Scan, analysis and model score of each symbol as one final score.

    ``scan``: ``symbol, status, action, ncs, bqs, fws``; ``analysed``: ``symbol, news_sentiment,
    recommendation, confidence, h_ncs, h_bqs, h_fws, h_regime, h_action``; ``model``: ``symbol,
    model_score``. A score of 0 reads as missing, that is 50.
    """
    s = scan.select("symbol", "status", F.col("action").alias("s_action"), *[F.col(c).alias(f"s_{c}") for c in ("ncs", "bqs", "fws")], F.lit(True).alias("scanned"))
    d = s.join(analysed, "symbol", "full_outer").join(model, "symbol", "left")
    score = lambda c: F.coalesce(F.nullif(F.coalesce(f"h_{c}", f"s_{c}"), F.lit(0.0)), F.lit(50.0))
    rec, news = F.coalesce("recommendation", F.lit("hold")), F.coalesce("news_sentiment", F.lit("neutral"))
    by_rec = lookup(rec, {"strong_buy": 90.0, "buy": 70.0, "hold": 50.0, "sell": 30.0, "strong_sell": 10.0}, 50.0)
    given = F.coalesce("model_score", F.lit(50.0))
    status, act = F.coalesce("status", F.lit("UNKNOWN")), F.coalesce("s_action", "h_action", F.lit("CONDITIONAL"))
    regime = F.coalesce("h_regime", F.lit("SIDEWAYS"))
    d = d.withColumns({"ncs_score": score("ncs"), "bqs_score": score("bqs"), "fws_score": score("fws"), "model": F.when(given != 50.0, given).otherwise(by_rec),
                       "news_score": lookup(news, {"positive": 75.0, "neutral": 50.0, "negative": 25.0}, 50.0), "scan_status": status, "recommendation": rec, "regime": regime, "action_note": act, "news": news})
    clash = {"regime_bearish": ((F.col("regime") == "BEARISH") & F.col("recommendation").isin("buy", "strong_buy"), 15.0), "signal_conflict_news": ((F.col("scan_status") == "READY") & (F.col("news") == "negative"), 10.0),
             "fws_high": (F.col("action_note") == "AUTO_NO", 15.0)}
    warn = {"scan_blocked": (F.col("scan_status").isin("FAR", "EARNINGS_BLOCK"), 10.0), "low_confidence": (F.coalesce("confidence", F.lit("medium")) == "low", 8.0)}
    every = {**clash, **warn}
    entries = F.filter(F.array(*[F.when(flag(c), F.struct(F.lit(k).alias("key"), F.lit(v).alias("value"))) for k, (c, v) in every.items()]), lambda x: x.isNotNull())
    conflict = F.lit(False)
    for c, _v in clash.values():
        conflict = conflict | flag(c)
    total = F.least(sum((points(flag(c), v) for c, v in every.values()), F.lit(0.0)), F.lit(40.0))
    raw = F.col("model") * 0.40 + F.col("ncs_score") * 0.30 + F.col("bqs_score") * 0.15 + F.col("news_score") * 0.15
    d = d.withColumns({"penalties": F.map_from_entries(entries), "final_score": half_even(F.greatest(F.lit(0.0), F.least(F.lit(100.0), raw - total)), 1), "_raw": F.greatest(F.lit(0.0), F.least(F.lit(100.0), raw - total))})
    conf = F.when(conflict, "low").when((F.col("ncs_score") >= 70) & (F.col("fws_score") <= 30) & (F.col("scan_status") == "READY"), "high").when((F.col("ncs_score") >= 50) & (F.col("fws_score") <= 50), "medium").otherwise("low")
    label = bands("_raw", [(">=", 75, "STRONG_BUY"), (">=", 60, "BUY"), (">=", 40, "HOLD"), (">=", 25, "SELL")], "AVOID")
    return d.select("symbol", "final_score", label.alias("final_label"), conf.alias("confidence"), "scan_status", "recommendation", "regime", "action_note", "penalties", F.col("model").alias("model_score"), "ncs_score", "bqs_score", "fws_score", "news_score",
                    F.coalesce("scanned", F.lit(False)).alias("scanned")).orderBy(F.desc("final_score"), "symbol")


# -- confidence -------------------------------------------------------------------------------

def macro_regime(vix, vix_chg5, sp5, sp10, dxy5) -> dict[str, Column]:
    v, c, s5, s10, d = col(vix), col(vix_chg5), col(sp5), col(sp10), F.coalesce(col(dxy5), F.lit(0.0))
    flip = flag((s5 * s10 < 0) & (F.abs(s5) > 1.0))
    regime = (F.when(v.isNull() | s5.isNull(), "Neutral").when((v < 16) & (s5 > 1.0) & ~(d > 1.0), "Risk-On").when((v > 22) & (s5 < -1.0), "Risk-Off").when(flip | flag(F.abs(c) > 25), "Transition")
              .when((F.abs(s5) < 0.5) & (F.abs(d) < 0.5) & (v < 22), "Neutral").otherwise("Transition"))
    return {"macro_regime": regime, "macro_weight": lookup(regime, {"Risk-Off": -6, "Transition": -3}, 0)}


def present(*scores) -> Column:
    return F.filter(F.array(*[col(s) for s in scores]), lambda x: x.isNotNull())


def disagreement(scores: Column) -> dict[str, Column]:
    """Spread of the source scores, and the deduction and cap it brings."""
    spread = F.when(F.size(scores) >= 2, F.array_max(scores) - F.array_min(scores)).otherwise(0.0)
    return {"score_spread": spread, "spread_penalty": bands(spread, [(">", 50, 12), (">", 35, 7), (">", 25, 3)], 0), "spread_cap": bands(spread, [(">", 50, 55), (">", 35, 65), (">", 25, 75)], 100)}


def earnings_cap(days) -> Column:
    d = col(days)
    return F.when(d.isNull() | (d < 0), 100).when(d <= 1, 60).when(d <= 5, 70).otherwise(100)


def confidence_interval(confidence, scores: Column, macro, days) -> dict[str, Column]:
    n = F.size(scores)
    mean = F.aggregate(scores, F.lit(0.0), lambda a, x: a + x) / n
    std = F.sqrt(F.aggregate(scores, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean)) / n)
    spread = F.when(n >= 2, F.greatest(F.lit(0.0), F.least(F.lit(30.0), std * 1.2))).otherwise(0.0) + lookup(macro, {"Transition": 8.0, "Risk-Off": 6.0, "Risk-On": 2.0, "Neutral": 2.0}, 4.0)
    spread = spread + points(flag((col(days) >= 0) & (col(days) <= 5)), 6)
    spread = F.bround(F.greatest(F.lit(4.0), F.least(F.lit(45.0), spread)), 0)
    bound = lambda v: F.bround(F.greatest(F.lit(0.0), F.least(F.lit(100.0), v)), 0).cast("long")
    return {"interval_low": bound(col(confidence) - spread / 2), "interval_high": bound(col(confidence) + spread / 2), "interval_spread": spread.cast("long")}


def signal_confidence(df: DataFrame) -> DataFrame:
    """One confidence from ``technical, ai, sentiment, market`` and the adjustments
    ``macro_regime, macro_weight, sector_adjust, days_to_earnings, history_cap``."""
    tech = F.coalesce("technical", F.lit(50.0))
    ai, sent, mkt = F.coalesce("ai", tech), F.coalesce("sentiment", F.lit(50.0)), F.coalesce("market", F.lit(50.0))
    d = df.withColumn("weighted_score", ai * 0.30 + tech * 0.35 + sent * 0.15 + mkt * 0.20).withColumn("_scores", present(tech, sent, mkt, "ai"))
    w = F.col("weighted_score")
    d = d.withColumns({"signal": F.when(w >= 60, "BUY").when(w <= 40, "SELL").otherwise("NEUTRAL"), **disagreement(F.col("_scores"))})
    hist = F.when(F.col("history_cap") < 100, F.bround(F.greatest(F.lit(5.0), F.least(F.lit(95.0), F.col("history_cap").cast("double"))), 0)).otherwise(100.0)
    base = 50 + F.abs(w - 50) / 50.0 * 38 - F.col("spread_penalty") + F.coalesce("macro_weight", F.lit(0)) + F.coalesce("sector_adjust", F.lit(0))
    cap = F.least(F.col("spread_cap").cast("double"), earnings_cap("days_to_earnings").cast("double"), F.coalesce(hist, F.lit(100.0)))
    clamp = lambda v: F.greatest(F.lit(5.0), F.least(F.lit(95.0), v))
    d = d.withColumn("confidence", F.bround(clamp(F.least(clamp(base), cap)), 0).cast("long"))
    d = d.withColumns(confidence_interval("confidence", F.col("_scores"), F.coalesce("macro_regime", F.lit("Neutral")), "days_to_earnings"))
    limited = flag(F.col("history_cap") < 100)
    d = d.withColumns({"interval_high": F.when(limited, F.least(F.col("interval_high"), hist.cast("long"))).otherwise(F.col("interval_high")), "interval_low": F.when(limited, F.least(F.col("interval_low"), F.col("confidence"))).otherwise(F.col("interval_low"))})
    return d.withColumn("interval_spread", F.when(limited, F.greatest(F.lit(0), F.col("interval_high") - F.col("interval_low"))).otherwise(F.col("interval_spread"))).drop("_scores")


# -- price plans ------------------------------------------------------------------------------

# Priors per market and zone, take-profit multiples, base probabilities and days.
PRIORS = {
    "KRX": dict(avg_atr_pct=2.37, band_width=1.18, prob_adj=-0.06, target_adj=0.95),
    "US": dict(avg_atr_pct=1.83, band_width=0.92, prob_adj=0.05, target_adj=1.05),
}
ZONES = {"KRX": [("A", 0.25, 0.65, 0.495, 1.94, 3.36, 15.1), ("B", 0.65, 1.10, 0.604, 2.74, 5.68, 13.0), ("C", 1.10, 1.70, 0.743, 3.72, 11.21, 9.2)],
         "US": [("A", 0.25, 0.65, 0.594, 1.49, 3.07, 14.0), ("B", 0.65, 1.10, 0.663, 2.00, 4.86, 12.3), ("C", 1.10, 1.70, 0.752, 2.70, 9.18, 9.0)]}
RISK_MODEL = {"conservative": (0.85, [1.10, 1.65, 2.20]), "balanced": (1.20, [1.50, 2.30, 3.10]), "aggressive": (1.55, [2.00, 3.20, 4.60])}
TP_PROB = {"KRX": {"conservative": [0.62, 0.48, 0.34], "balanced": [0.56, 0.42, 0.29], "aggressive": [0.49, 0.35, 0.22]}, "US": {"conservative": [0.71, 0.58, 0.45], "balanced": [0.66, 0.53, 0.40], "aggressive": [0.61, 0.48, 0.35]}}
TP_DAYS = {"KRX": {"conservative": [7, 13, 20], "balanced": [9, 16, 24], "aggressive": [11, 20, 32]}, "US": {"conservative": [6, 11, 17], "balanced": [7, 14, 21], "aggressive": [9, 17, 27]}}
ALLOCATION = [10.0, 15.0, 20.0, 25.0, 30.0]


def prior(market, name: str) -> Column:
    return F.when(col(market) == "US", PRIORS["US"][name]).otherwise(PRIORS["KRX"][name])


def by_market(market, rows: dict) -> Column:
    """One of two literal arrays of structs."""
    make = lambda rs: F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in r.items()]) for r in rs])
    return F.when(col(market) == "US", make(rows["US"])).otherwise(make(rows["KRX"]))


def trend_score() -> Column:
    """Trend -1..1 of a panel row."""
    c, r = F.col("close"), F.coalesce("rsi", F.lit(50.0))
    s = (F.when(c > F.coalesce("ma20", c), 0.25).otherwise(-0.15) + F.when(c > F.coalesce("ma60", c), 0.25).otherwise(-0.15) + F.when(F.coalesce("macd", F.lit(0.0)) > F.coalesce("macd_signal", F.lit(0.0)), 0.20).otherwise(-0.10)
         + F.when((r >= 45) & (r <= 65), 0.15).when(r > 75, -0.20).when(r < 35, 0.05).otherwise(0.0) + F.when(F.coalesce("adx", F.lit(20.0)) >= 25, 0.15).otherwise(0.0))
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), s))


def composite_score(axes: dict[str, Column]) -> Column:
    """0..100 from four axes in -1..1: trend, momentum, volatility, volume."""
    w = {"trend": 35, "momentum": 30, "volatility": 20, "volume": 15}
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), 50 + sum((w[k] * v / 2 for k, v in axes.items()), F.lit(0.0))))


def similar_pattern_rate(p: DataFrame, horizon: int = 20, start: int = 59) -> DataFrame:
    """Share of past bars like today's (RSI within 8, ATR within 0.7 points) that then rose enough.

    Today's figures are one row per symbol joined to the symbol's own history. Below the least
    history, or without a match, the rate is 0.55 on no sample.
    """
    w = Window.partitionBy("symbol").orderBy("bar_idx")
    d = p.filter(F.col("bar_idx") >= start).select("symbol", "bar_idx", "n_bars", "close", "rsi", (F.col("atr") / F.col("close") * 100).alias("ap"), F.max("close").over(w.rowsBetween(1, horizon)).alias("best"))
    now = d.filter("bar_idx = n_bars - 1").select("symbol", F.col("rsi").alias("now_rsi"), F.col("ap").alias("now_ap"), (F.col("n_bars") - start).alias("_len"))
    j = d.join(now, "symbol").filter((F.col("bar_idx") - start >= 20) & (F.col("bar_idx") < F.col("n_bars") - horizon))
    like = j.filter((F.abs(F.col("rsi") - F.col("now_rsi")) <= 8) & (F.abs(F.col("ap") - F.col("now_ap")) <= 0.7) & (F.col("_len") >= horizon + 40))
    won = (F.col("best") / F.col("close") - 1 >= F.greatest(F.lit(0.012), F.col("now_ap") / 100 * 0.8)).cast("double")
    g = like.groupBy("symbol").agg(F.avg(won).alias("pattern_win"), F.count(F.lit(1)).alias("pattern_n"))
    return now.select("symbol").join(g, "symbol", "left").fillna({"pattern_win": 0.55, "pattern_n": 0})


def probability(base, atr_pct, market, trend, win, n, debt=None) -> Column:
    b, ratio = col(base), col(atr_pct) / prior(market, "avg_atr_pct")
    vol = -0.08 * F.greatest(F.lit(0.0), ratio - 1.0) + 0.03 * F.greatest(F.lit(0.0), 1.0 - ratio)
    debt_term = F.lit(0.0) if debt is None else F.when(col(debt) > 300, -0.12).when(col(debt) > 200, -0.07).when(col(debt) > 150, -0.03).otherwise(0.0)
    p = b + prior(market, "prob_adj") + vol + 0.10 * col(trend) + (col(win) - b) * 0.35 * F.least(col(n) / 12.0, F.lit(1.0)) + debt_term
    return half_even(F.greatest(F.lit(0.05), F.least(F.lit(0.92), p)) * 100, 1)


def plan_rows(p: DataFrame, markets: DataFrame) -> DataFrame:
    """What the price plan reads of the last panel row of each symbol, with trend and similar-pattern figures."""
    d = p.filter("bar_idx = n_bars - 1").join(markets, "symbol").join(similar_pattern_rate(p), "symbol")
    return d.withColumns({"trend": trend_score(), "atr_pct": F.col("atr") / F.col("close") * 100}).select(
        "symbol", "market", "bar_idx", "n_bars", "close", "atr", "atr_pct", "trend", "ma20", "bb_middle", "vwap", "fib_382", "strong_support", "support_zone", "pattern_win", "pattern_n")


def buy_bands(plan: DataFrame) -> DataFrame:
    """Bands A, B and C of two families: from the price, and from anchors below it."""
    zones = {m: [dict(band=z, d1=a, d2=b, base=w, expected_return_pct=e, sharpe=s, hold_days=h) for z, a, b, w, e, s, h in rows] for m, rows in ZONES.items()}
    c, a, f = F.col("close"), F.col("atr"), F.col("fib_382")
    anchors = F.filter(F.array(F.col("bb_middle") * 0.995, F.col("ma20") * 0.995, "vwap", F.when(f < c, f)), lambda x: x.isNotNull() & (x != 0))
    d = plan.withColumns({"w": prior("market", "band_width"), "anchor": F.aggregate(anchors, F.lit(0.0), lambda s, x: s + x) / F.size(anchors), "z": F.explode(by_market("market", zones))}).select("*", "z.*").drop("z")
    at = (F.when(F.col("band") == "A", F.col("anchor")).when(F.col("band") == "B", F.when(f < c, (F.col("anchor") + f) / 2).otherwise(F.col("anchor") - a * 0.35))
          .otherwise(F.when(F.col("strong_support").isNotNull(), (F.col("strong_support") + F.col("support_zone")) / 2).otherwise(F.col("anchor") - a * 0.85)))
    prob = probability("base", "atr_pct", "market", "trend", "pattern_win", "pattern_n")
    fam = lambda n, lo, hi: F.struct(F.lit(n).alias("family"), lo.alias("low"), hi.alias("high"))
    d = d.withColumns({"at": at, "win_pct": prob})
    aw = a * F.col("w")
    d = d.withColumn("f", F.explode(F.array(fam("aggressive", c - F.col("d2") * aw, c - F.col("d1") * aw), fam("recommended", F.col("at") - F.col("d2") * aw * 0.75, F.col("at") - F.col("d1") * aw * 0.45))))
    return d.select("symbol", "market", "close", "atr", "n_bars", "f.*", "band", "win_pct", (100 - F.col("win_pct")).alias("loss_pct"), "expected_return_pct", "sharpe", "hold_days")


def take_profit_levels(plan: DataFrame) -> DataFrame:
    """Three targets per risk profile with probabilities that fall by at least three points."""
    rows = {m: [dict(profile=k, stop_mul=RISK_MODEL[k][0], level=i + 1, mul=RISK_MODEL[k][1][i], base=TP_PROB[m][k][i], days=TP_DAYS[m][k][i]) for k in RISK_MODEL for i in range(3)] for m in TP_PROB}
    d = plan.withColumn("t", F.explode(by_market("market", rows))).select("symbol", "market", "bar_idx", "close", "atr", "atr_pct", "trend", "pattern_win", "pattern_n", "t.*")
    d = d.withColumn("p", probability("base", "atr_pct", "market", "trend", "pattern_win", "pattern_n"))
    # min over earlier levels of (p + 3 * level), less 3 * level, is the running cap of 3 points a level.
    w = Window.partitionBy("symbol", "bar_idx", "profile").orderBy("level").rowsBetween(Window.unboundedPreceding, 0)
    capped = F.min(F.col("p") + 3.0 * F.col("level")).over(w) - 3.0 * F.col("level")
    c, a = F.col("close"), F.col("atr")
    price = c + a * F.col("mul") * prior("market", "target_adj")
    stop = c - F.col("stop_mul") * a * prior("market", "band_width")
    extra = F.when(F.col("market") == "US", 0.96).otherwise(1.08)
    return d.withColumns({"price": price, "hit_prob_pct": half_even(capped, 1), "risk_reward": (price - c) / F.greatest(c - stop, F.lit(1e-9)), "return_pct": (price / c - 1) * 100,
                          "failed_loss_pct": -F.col("stop_mul") * F.col("atr_pct") * extra * (1 + 0.05 * (F.col("level") - 1))}).drop("p", "base", "mul")


def first_days(horizon: int):
    """For one segment of a symbol's bars and its rising depths: how many bars reach each depth first on each later day."""

    def run(past: pa.Table, asked: pa.Table) -> pa.Table:
        schema = pa.schema([("symbol", pa.int64()), ("at", pa.int32()), ("day", pa.int32()), ("n", pa.int64())])
        if not len(past) or not len(asked):
            return schema.empty_table()
        past = past.sort_by("bar_idx")
        low, close, asking = (past[c].to_numpy() for c in ("low", "close", "asking"))
        depths = asked["depths"][0].values.to_numpy(zero_copy_only=False)  # unknown ones come last
        own = np.flatnonzero(asking)  # each has all its later bars in the segment
        least, before, met = np.full(len(own), np.inf), np.zeros(len(depths), np.int64), []
        for day in range(1, horizon + 1):
            least = np.fmin(least, low[own + day])
            # depths 0 .. k-1 are reached by now, where k is their number up to the deepest drop
            drop = 1 - least / close[own]
            k = np.searchsorted(depths, np.where(np.isnan(drop), -np.inf, drop), "right")
            by_now = len(own) - np.cumsum(np.bincount(k, minlength=len(depths) + 1))[:-1]
            met.append(by_now - before)
            before = by_now
        day, at = np.nonzero(np.array(met))
        return pa.Table.from_arrays([pa.array(np.full(len(at), past["symbol"][0].as_py()), pa.int64()), pa.array(at, pa.int32()), pa.array(day + 1, pa.int32()), pa.array(np.array(met)[day, at], pa.int64())], schema=schema)

    return run


def band_steps(bands_: DataFrame, bars: DataFrame, horizon: int = 30, least: int = 40) -> DataFrame:
    """Five falling prices per band with rising shares, and how often and how fast such a depth was
    reached before. Without ``least`` past paths the figures stay NULL."""
    i = F.col("step")
    d = bands_.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(5)))).withColumn("price", F.col("high") - (F.col("high") - F.col("low")) * (i - 1) / 4)
    d = d.withColumns({"allocation_pct": F.element_at(F.array(*map(F.lit, ALLOCATION)), i), "depth": 1 - F.col("price") / F.col("close")})
    asks = d.groupBy("symbol").agg(F.array_sort(F.array_agg(F.struct("depth", "family", "band", "step"))).alias("asks"))  # thirty
    past = segmented(bars.select("symbol", "bar_idx", "n_bars", "low", "close"), 0, horizon).select("symbol", "seg", "bar_idx", "low", "close", (~F.col("context") & (F.col("bar_idx") < F.col("n_bars") - horizon)).alias("asking"))
    depths = bars.filter("bar_idx = n_bars - 1").select(F.col("symbol").alias("of"), F.explode(F.sequence(F.lit(0), F.floor(F.col("bar_idx") / SEGMENT).cast("int"))).alias("seg")).join(asks.select(F.col("symbol").alias("of"), F.transform("asks", lambda x: x["depth"]).alias("depths")), "of")
    days = past.groupBy("symbol", "seg").cogroup(depths.groupBy("of", "seg")).applyInArrow(first_days(horizon), "symbol long, at int, day int, n long")
    counts = days.join(asks, "symbol").select("symbol", "day", "n", F.get("asks", "at").alias("q")).select("symbol", "q.family", "q.band", "q.step", "day", "n")
    count = bars.groupBy("symbol").agg(F.greatest(F.max("n_bars") - horizon, F.lit(0)).alias("paths"))
    quarter = lambda p: F.percentile("day", F.lit(p), F.col("n"))
    g = counts.groupBy("symbol", "family", "band", "step").agg(F.sum("n").alias("reached"), quarter(0.25).alias("days_min"), quarter(0.75).alias("days_max"))
    d = d.join(count, "symbol", "left").join(g, ["symbol", "family", "band", "step"], "left")
    enough = flag(F.col("paths") >= least)
    return d.withColumns({"reach_pct": F.when(enough, F.coalesce("reached", F.lit(0)) / F.col("paths") * 100), "days_min": F.when(enough, F.col("days_min")), "days_max": F.when(enough, F.col("days_max"))})


# -- opening surge ----------------------------------------------------------------------------

def surge_score(turnover, rel_volume, change, trend, flow, intraday, rsi, cap: float = 25.0) -> dict[str, Column]:
    """Parts of the opening-surge score; -1 at or above the change limit. Flow counts only when observed intraday."""
    unit = lambda v: F.greatest(F.lit(0.0), F.least(F.lit(1.0), v))
    parts = {
        "turnover_pts": 25.0 * unit(col(turnover) / 100000.0), "volume_pts": 20.0 * unit((col(rel_volume) - 1.0) / 2.0), "change_pts": 20.0 * unit(col(change) / 8.0), "trend_pts": 15.0 * unit((col(trend) + 1) / 2),
        "flow_pts": F.when(flag(col(intraday)), 12.0 * unit(col(flow))).otherwise(0.0),
        "overheat": -F.least(F.lit(20.0), F.when(col(change) > 12, 10.0).otherwise(0.0) + F.when(col(rsi) > 75, 10.0).otherwise(0.0)),
    }
    total = sum(parts.values(), F.lit(0.0))
    return {**parts, "surge_score": F.when(col(change) >= cap, -1.0).otherwise(F.greatest(F.lit(0.0), total))}


def surge_eligible(price, limit: float = 20.0) -> Column:
    p = F.expr(f"try_cast({price} as double)") if isinstance(price, str) else price
    return flag(~F.isnan(p) & (p > 0) & (p < limit))


EXCLUSIONS = ["vi_active", "management", "warning", "short_overheat", "trading_halt"]


def exclusion_reasons(names: list[str] = EXCLUSIONS) -> Column:
    return F.filter(F.array(*[F.when(flag(F.col(n)), F.lit(n)) for n in names]), lambda x: x.isNotNull())


def security_status(notices: DataFrame) -> DataFrame:
    """The latest notice per symbol decides; halt and delisting block, management does not."""
    g = notices.groupBy("symbol").agg(F.max_by("status", F.struct("notice_ts", "notice_id")).alias("status"))
    return g.withColumn("blocked", F.col("status").isin("halt", "delisting"))


def halt_release(text, today) -> dict[str, Column]:
    """Release date and time named in a notice, if not in the past."""
    t = col(text)
    p = "(?:해제일시?|해제일)[^0-9]*(\\d{4})[년.-]\\s?(\\d{1,2})[월.-]\\s?(\\d{1,2})"
    g = lambda i: F.regexp_extract(t, p, i)
    d = F.when(g(1) != "", F.try_to_date(F.concat_ws("-", g(1), F.lpad(g(2), 2, "0"), F.lpad(g(3), 2, "0"))))
    ok = flag(d >= col(today))
    clock = F.regexp_extract(t, "(\\d{2}:\\d{2})", 1)
    return {"release_date": F.when(ok, d), "release_time": F.when(ok & (clock != ""), clock), "release_label": F.when(ok, "disclosed").otherwise("undetermined")}


# Price ticks by band.
TICKS = [(1_000, 1), (5_000, 5), (10_000, 10), (50_000, 50), (100_000, 100), (500_000, 500)]


def tick_size(price, board) -> Column:
    t = bands(price, [("<", b, v) for b, v in TICKS], 1000)
    return F.when(col(board) == "KOSDAQ", F.least(t, F.lit(100))).otherwise(t)


def snap(price, board, limit=None) -> Column:
    t = tick_size(price, board)
    p = F.floor(col(price) / t) * t
    return p if limit is None else F.least(p, F.floor(col(limit) / t) * t)


# -- index quotes -----------------------------------------------------------------------------

def validate_index(current, change_abs, change_pct, direction) -> dict[str, Column]:
    """Whether level, change and percentage agree within 0.05 points, and the previous close."""
    c, a, p, d = col(current), F.abs(col(change_abs)), F.abs(col(change_pct)), col(direction)
    sign = F.when(d == "up", 1.0).when(d == "down", -1.0).otherwise(0.0)
    prev = c - sign * a
    flat_ok = (sign != 0) | ((a <= 0.0001) & (p <= 0.0001))
    p0 = F.when(sign == 0, 0.0).otherwise(p)
    prev = F.when(sign == 0, c).otherwise(prev)
    ok = flag(~F.isnan(c) & ~F.isnan(a) & ~F.isnan(p) & (c > 0) & flat_ok & (prev > 0) & (F.abs(F.abs((c - prev) / prev * 100) - p0) <= 0.05))
    keep = lambda v: F.when(ok, v)
    return {"available": ok, "prev_close": keep(half_even(prev, 4)), "change_value": keep(half_even(sign * F.when(sign == 0, 0.0).otherwise(a), 4)), "pct_value": keep(half_even(sign * p0, 4))}


def parse_change(text, hint=None) -> dict[str, Column]:
    """``463.81 -6.37% 하락`` to absolute values and a direction; a hint wins over the word."""
    parts = F.split(F.trim(col(text)), "\\s+")
    word = F.get(parts, F.lit(2))
    d = F.when(word == "상승", "up").when(word == "하락", "down").otherwise("flat")
    d = d if hint is None else F.when(col(hint).isin("up", "down", "flat"), col(hint)).otherwise(d)
    num = lambda i: F.abs(F.regexp_replace(F.get(parts, F.lit(i)), "[,%]", "").try_cast("double"))
    two = F.size(parts) >= 2
    return {"abs_value": F.when(two, num(0)).otherwise(0.0), "pct_value": F.when(two, num(1)).otherwise(0.0), "direction": F.when(two, d).otherwise("flat")}


def text_direction(text) -> Column:
    t = F.trim(F.coalesce(col(text), F.lit("")))
    down = t.startswith("-") | F.contains(t, F.lit("▼")) | F.contains(t, F.lit("하락"))
    up = t.startswith("+") | F.contains(t, F.lit("▲")) | F.contains(t, F.lit("상승"))
    return F.when(down, "down").when(up, "up").otherwise("flat")
