"""Forward-looking back-tests: entry zones, target prices, the fractal-retest strategy."""

from __future__ import annotations

from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from barline.functions.numeric import bands, flag, half_even, lit, report
from barline.functions.scores import lookup
from barline.operators import indicators as ind
from barline.operators.aggregates import liquidity_terciles
from barline.operators.joins import forward_bars
from barline.operators.quantiles import exact_quantiles
from barline.operators.ranges import asked, blocks, extreme, first_touch
from barline.series import back, full, last, own_rows, segmented
from barline.session import written

# Fixed values of the strategy study.
ENTRY_DELAYS = (0, 1, 3, 5)
RETEST_LINES = (21, 50)
ATR_TOLERANCES = (0.15, 0.25, 0.35, 0.50)
PULLBACK_VOLUME_MAX = (None, 1.00, 0.85)
REBOUND_VOLUME_MIN = (None, 1.00, 1.15)
SLOPE_MIN = (None, 0.00, 0.10)
SLOPE_LEVELS = (-0.10, -0.05, 0.00, 0.05, 0.10, 0.15, 0.20, 0.25, 0.30)
MAX_HOLD, RISK_REWARD, MIN_TRADES = 20, 2.0, 30
TRAIN_BARS, TEST_BARS, WARMUP = 168, 84, 220
COST_PCT = {"KRX": 0.20, "US": 0.10}
SLIPPAGE_PCT = (0.00, 0.10, 0.25, 0.50)
QUARTERLY, MONTHLY = (189, 63), (231, 21)
PANEL_START = 59  # first bar with every indicator: the 60-bar mean


def panel(bars: DataFrame) -> DataFrame:
    """Bars with all indicators the back-tests read. One pass over one partitioning and one order.

    A frame of n bars costs n steps a row, so each aggregate of 20 bars is taken once; those of the bars before, and the
    means and extremes of 60 and 120 bars, are put together from its lagged values.
    """
    d = ind.with_tr(segmented(bars, 8000))
    w, traded = last(20), F.col("close") * F.col("volume")
    d = d.withColumns({
        "atr": ind.atr_warm(), "_sum": F.sum("close").over(w), "_n": F.count("close").over(w), "_sd": F.stddev_pop("close").over(w), "avg_vol20": F.avg("volume").over(w), "_vol": F.sum("volume").over(w),
        "_traded": F.sum(traded).over(w), "_worth": F.avg(traded).over(w), "high20": F.max("high").over(w), "low20": F.min("low").over(w), "prev_close": back("close"),
        "support_zone": ind.lowest_mean(30, 5), "strong_support": ind.lowest_mean(20, 3), "lower_fractal": ind.fractal("lower"),
    })

    def mean(n: int) -> Column:
        parts = lambda c: sum((F.coalesce(back(c, k), F.lit(0)) for k in range(20, n, 20)), F.col(c))
        return full(parts("_sum") / F.nullif(parts("_n"), F.lit(0)), n)

    ma20, vol, vol_before = F.col("_sum") / F.nullif(F.col("_n"), F.lit(0)), F.col("avg_vol20"), back("avg_vol20")
    hi, lo = (best(*[F.col(c), back(c, 20), back(c, 40)]) for best, c in ((F.greatest, "high20"), (F.least, "low20")))
    d = d.withColumns({
        "ma20": full(ma20, 20), "ma60": mean(60), "ma120": mean(120), "bb_middle": full(ma20, 20), "bb_upper": full(ma20 + 2.0 * F.col("_sd"), 20), "bb_lower": full(ma20 - 2.0 * F.col("_sd"), 20),
        "vr_prior": F.when((F.col("bar_idx") >= 20) & (vol_before > 0), F.col("volume") / vol_before).otherwise(1.0), "vr_incl": F.when((F.col("bar_idx") >= 19) & (vol > 0), F.col("volume") / vol).otherwise(1.0),
        "vwap": full(F.when(F.col("_vol") > 0, F.col("_traded") / F.col("_vol")), 20), "low20_prior": back("low20"), "turnover": F.coalesce(back("_worth"), F.lit(0.0)), "_hi60": hi, "_lo60": lo,
    }).drop("_sum", "_n", "_sd", "_vol", "_traded", "_worth")
    d = ind.with_smma(ind.with_macd(ind.with_rsi(ind.with_adx(d))), 21, 50, 200)
    d = d.withColumns({
        "expanding": ind.expanding_volatility("atr"), "ma20_old": back("ma20", 5), "slope": ind.smma_slope_pct(),
        "gap": F.col("smma21") - F.col("smma200"), **{f"fib_{int(r * 1000)}": F.col("_hi60") - r * (F.col("_hi60") - F.col("_lo60")) for r in (0.382, 0.5, 0.618)},
    }).withColumn("gap_old", back("gap", 5))
    return own_rows(d).drop("tr", "ema12", "ema26", "_hi60", "_lo60")


# -- entry zones ------------------------------------------------------------------------------

def downside_risk(market: Column | str = "market") -> dict[str, Column]:
    """Risk score of a panel row, its level, the depth it adds, and whether to hold."""
    c, pts = F.col("close"), lambda cond, v: F.when(flag(cond), v).otherwise(0)
    slope = F.when(F.col("ma20_old") > 0, (F.col("ma20") - F.col("ma20_old")) / F.col("ma20_old") * 100).otherwise(0.0)
    atr_pct, rsi = F.col("atr") / c * 100, F.col("rsi")
    hi, mid = F.when(lit(market if isinstance(market, Column) else F.col(market)) == "KRX", 5.5).otherwise(3.2), F.when((market if isinstance(market, Column) else F.col(market)) == "KRX", 4.0).otherwise(2.4)
    heavy = (F.col("avg_vol20") > 0) & (F.col("volume") >= F.col("avg_vol20") * 1.35) & (c < F.col("prev_close"))
    gap_down = (F.col("open") < F.col("prev_close") * 0.985) & (c <= F.col("open") * 1.01)
    adx = F.coalesce("adx", F.lit(20.0))
    terms = [
        pts(c < F.col("ma20"), 10), pts(c < F.col("ma60"), 12), pts(c < F.col("ma120"), 8), pts(slope < -0.6, 8), pts(F.col("macd") <= F.col("macd_signal"), 10),
        pts((adx >= 25) & (F.coalesce("minus_di", F.lit(0.0)) > F.coalesce("plus_di", F.lit(0.0))), 16), pts((rsi < 40) | (rsi > 70), 8),
        F.when(flag(atr_pct >= hi), 14).when(flag(atr_pct >= mid), 7).otherwise(0), pts(c < F.col("low20_prior"), 16),
        pts(c < F.coalesce("strong_support", "support_zone"), 12), pts(heavy, 10), pts((F.col("vr_incl") < 0.70) & (c < F.col("ma20")), 8), pts(gap_down, 10), pts(F.col("expanding"), 8),
    ]
    score = F.least(reduce(lambda a, b: a + b, terms), F.lit(100))
    level = bands(score, [(">=", 68, "severe"), (">=", 50, "high"), (">=", 30, "medium")], "low")
    return {"risk_score": score, "risk_level": level, "depth_shift": lookup(level, {"severe": 1.05, "high": 0.75, "medium": 0.45}, 0.20), "hold_signal": score >= 50}


def entry_bands(market: str = "market") -> Column:
    """Array of (logic, zone, low, high): the baseline and the current bands of a panel row that
    carries the columns of ``downside_risk``."""
    c, atr = F.col("close"), F.col("atr")
    krx = F.col(market) == "KRX"
    bw, base = F.when(krx, 1.18).otherwise(0.92), F.when(krx, 0.20).otherwise(0.15)
    deep, floor = F.least(atr, c * 0.15), c * 0.10
    shift, weak = F.col("depth_shift"), F.col("risk_level").isin("high", "severe") & flag(F.col("strong_support") != 0)
    out = []
    for zone, k1, k2 in (("primary", 0.25, 0.65), ("secondary", 0.65, 1.10)):
        mid, hw = c - (k1 + k2) / 2 * atr, (k2 - k1) * atr * bw * 0.5
        out.append(("baseline", zone, mid - hw, mid + hw))

    def floored(lo, hi):
        hi2 = F.greatest(hi, floor + deep * 0.05)
        return F.greatest(F.least(lo, hi2 - deep * 0.05), floor), hi2

    severe = F.col("risk_level") == "severe"
    k1, k2 = 0.25 + base + shift, 0.65 + base + shift
    k1, k2 = F.when(severe, F.greatest(k1, F.lit(1.55))).otherwise(k1), F.when(severe, F.greatest(k2, F.lit(2.15))).otherwise(k2)
    mid, hw = c - (k1 + k2) / 2 * deep, (0.65 - 0.25) * deep * bw * 0.5
    hi = F.when(weak, F.least(mid + hw, F.col("strong_support") - deep * 0.10)).otherwise(mid + hw)
    lo = F.when(weak, F.least(mid - hw, hi - deep * 0.20)).otherwise(mid - hw)
    out.append(("current", "primary", *floored(lo, hi)))

    lower = F.when(F.col("bb_lower") > 0, F.col("bb_lower"))
    vwap = F.coalesce(F.when(F.col("vwap") != 0, F.col("vwap")), c - 0.875 * deep)
    a = F.least(F.coalesce((vwap + F.col("bb_middle")) / 2, vwap), c - deep * (0.55 + base + shift))
    b = F.coalesce((lower + F.col("ma20")) / 2, lower, c - 1.10 * deep)
    b = F.least(b, a - deep * (0.35 + shift * 0.45))
    b = F.when(weak, F.least(b, F.col("strong_support") - deep * (0.75 + shift * 0.30))).otherwise(b)
    hw = deep * 0.35 * bw
    hi = F.least(b + hw, c - deep * 0.05)
    lo = F.least(b - hw, hi - deep * 0.05)
    out.append(("current", "secondary", *floored(lo, hi)))
    return F.array(*[F.struct(F.lit(x).alias("logic"), F.lit(z).alias("zone"), lo.alias("low"), hi.alias("high")) for x, z, lo, hi in out])


def sampled(p: DataFrame, reach: int, step: int, forward: int, least: int = 140, offset: int = PANEL_START) -> DataFrame:
    """Every ``step``-th panel row of the last ``reach`` that still has ``forward`` bars after it.
    Positions are counted from the first complete panel row."""
    j, n = F.col("bar_idx") - offset, F.col("n_bars") - offset
    start = F.greatest(F.lit(least), n - reach)
    return p.filter((j >= start) & (j < n - forward) & ((j - start) % step == 0))


def zone_trades(p: DataFrame, bars: DataFrame, markets: DataFrame, horizon: int = 20) -> DataFrame:
    """One row per signal, logic and zone: whether the band was touched within the fixed window,
    the entry, and what followed. ``p`` is the panel of ``bars``; ``markets`` has ``symbol, market``."""
    long_enough = p.filter(F.col("n_bars") - PANEL_START >= 260)
    s = sampled(long_enough, 190, 21, 21).join(markets, "symbol").withColumns(downside_risk())
    s = s.withColumn("band", F.explode(entry_bands())).select(
        "symbol", "market", "bar_idx", F.col("bar_date").alias("signal_date"), "close", "atr", "risk_score", "risk_level", "hold_signal", "band.*",
        half_even("vr_incl", 3).alias("vol_ratio"), (F.col("atr") / F.col("close") * 100).alias("atr_pct"))
    table = asked(blocks(bars.select("symbol", "bar_idx", "n_bars", "low", "high", "close", "bar_date"), horizon, ["close", "bar_date"]), s.withColumnRenamed("close", "signal_close"))
    a, b = (lambda x: x["bar_idx"] - F.col("first") + 1), (lambda x: F.least(x["bar_idx"] + horizon, F.col("last")) - F.col("first"))
    touch = F.transform("ask", lambda x: F.struct(x.alias("q"), first_touch(F.col("lows"), a(x), b(x), lambda v: v <= x["high"], horizon).alias("at"), b(x).alias("end")))
    told = F.transform(touch, lambda t: F.struct(
        t["q"].alias("q"), F.get("bar_date", t["at"]).alias("entry_date"), F.get("close", t["at"]).alias("hit_close"), F.when(t["at"].isNotNull(), F.get("close", t["end"])).alias("last_close"),
        extreme(F.col("lows"), t["at"], t["end"], F.least).alias("least"), extreme(F.col("highs"), t["at"], t["end"], F.greatest).alias("most")))
    d = table.select("symbol", F.explode(told).alias("t")).select("symbol", "t.q.*", "t.entry_date", "t.hit_close", "t.last_close", "t.least", "t.most").withColumnRenamed("signal_close", "close")
    got = F.col("hit_close").isNotNull()
    d = d.withColumn("entry_price", F.when(got, F.least(F.col("high"), F.greatest(F.col("low"), F.col("hit_close")))))
    prim, atr, entry, low = F.col("zone") == "primary", F.col("atr"), F.col("entry_price"), F.col("least")
    return d.withColumns({
        "entered": got, "stop_hit": F.when(got, low <= entry - atr * F.when(prim, 1.35).otherwise(1.75)), "bounce_success": F.when(got, F.col("most") >= entry + atr * F.when(prim, 1.15).otherwise(1.65)),
        "extra_drop": F.when(got, low <= entry - atr * 0.75), "return_pct": F.when(got, (F.col("last_close") - entry) / entry * 100), "mdd_pct": F.when(got, (low - entry) / entry * 100),
    }).drop("hit_close", "last_close", "least", "most")


def zone_summary(trades: DataFrame) -> DataFrame:
    """Per market, logic and zone: entry rate over signals, the rest over entries."""
    keys = ["market", "logic", "zone"]
    rate = lambda c: half_even(F.avg(F.col(c).cast("double")) * 100, 2)
    g = trades.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("signals"), F.count_if(F.col("entered")).alias("entries"), half_even(F.count_if(F.col("entered")) / F.count(F.lit(1)) * 100, 2).alias("entry_rate"),
        rate("bounce_success").alias("bounce_rate"), rate("stop_hit").alias("stop_rate"), rate("extra_drop").alias("extra_drop_rate"),
        half_even(F.avg("return_pct"), 3).alias("avg_return_pct"), half_even(F.avg("mdd_pct"), 3).alias("avg_mdd_pct"),
    ).filter("entries > 0")
    med = exact_quantiles(trades.filter("entered"), keys, {"atr_pct": F.col("atr_pct"), "vol_ratio": F.col("vol_ratio")}, [0.5])
    return g.join(med, keys).withColumns({"median_atr_pct": report("atr_pct_50", 3), "median_vol_ratio": report("vol_ratio_50", 3)}).drop("atr_pct_50", "vol_ratio_50")


def risk_gate_summary(trades: DataFrame) -> DataFrame:
    """Hold and severity rates over signals (each once), extra drop over entries at high risk."""
    cur = F.col("logic") == "current"
    once, high = cur & (F.col("zone") == "primary"), cur & F.col("entered") & (F.col("risk_score") >= 55)
    return trades.groupBy("market").agg(
        F.count_if(once).alias("risk_samples"), half_even(F.avg(F.when(once, F.col("hold_signal").cast("double"))) * 100, 2).alias("hold_rate"),
        half_even(F.avg(F.when(high, F.col("extra_drop").cast("double"))) * 100, 2).alias("high_risk_extra_drop_rate"), F.count_if(once & (F.col("risk_score") >= 68)).alias("severe_samples"))


# -- target prices ----------------------------------------------------------------------------

def pullback_targets() -> Column:
    """Array of (profile, target) of a pullback plan on a panel row: back to the 20-bar high (one ATR up at least), and
    .618 of the 20-bar range beyond it."""
    main = F.greatest(F.col("high20"), F.col("close") + F.col("atr"))
    ext = main + 0.618 * (F.col("high20") - F.col("low20"))
    return F.array(*[F.struct(F.lit(p).alias("profile"), t.alias("target")) for p, t in (("pullback_main", main), ("pullback_ext", ext))])


def target_hits(signals: DataFrame, bars: DataFrame, window: int = 90) -> DataFrame:
    """Whether and after how many bars each target was touched.

    ``signals`` has ``symbol, bar_idx, targets`` with targets an array of structs holding ``profile, target, ...``.
    """
    table = asked(blocks(bars, window), signals)
    a, b = (lambda x: x["bar_idx"] - F.col("first") + 1), (lambda x: F.least(x["bar_idx"] + window, F.col("last")) - F.col("first"))
    day = lambda x, t: first_touch(F.col("highs"), a(x), b(x), lambda v: v >= t["target"], window) - a(x) + 1
    told = F.transform("ask", lambda x: F.struct(x.alias("s"), F.transform(x["targets"], lambda t: F.struct(t.alias("t"), day(x, t).alias("days_to_hit"))).alias("ts")))
    d = table.select("symbol", F.explode(told).alias("r")).select("symbol", "r.s.*", F.explode("r.ts").alias("h")).drop("targets")
    return d.select(*[c for c in d.columns if c != "h"], "h.t.*", "h.days_to_hit").withColumn("hit", F.col("days_to_hit").isNotNull())


def target_summary(hits: DataFrame) -> DataFrame:
    keys = ["market", "profile"]
    g = hits.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_signals"), half_even(F.avg(F.col("hit").cast("double")) * 100, 1).alias("hit_rate_pct"), half_even(F.avg("needed_pct"), 2).alias("avg_needed_pct"))
    med = exact_quantiles(hits, keys, {"confidence": F.col("confidence"), "days": F.when(F.col("hit"), F.col("days_to_hit"))}, [0.5])
    return g.join(med, keys, "left").withColumn("median_confidence", half_even("confidence_50", 1)).withColumnRenamed("days_50", "median_days_to_hit").drop("confidence_50")


def calibration(hits: DataFrame) -> DataFrame:
    """Predicted against actual hit rate per profile and confidence bucket."""
    b = bands("confidence", [("<", 35, "low"), ("<", 60, "mid")], "high")
    d = hits.filter("confidence is not null").withColumn("bucket", b)
    actual, said = F.avg(F.col("hit").cast("double")) * 100, F.avg("confidence")
    return d.groupBy("profile", "bucket").agg(F.count(F.lit(1)).alias("n_signals"), half_even(said, 1).alias("predicted_pct"), half_even(actual, 1).alias("actual_pct"), half_even(actual - said, 1).alias("gap_pp"))


# -- fractal-retest strategy ------------------------------------------------------------------

def strategy_grid(spark: SparkSession) -> DataFrame:
    """The 864 settings: two lines, four delays, four tolerances, three limits each of volume and slope."""
    rows = [(i, *r) for i, r in enumerate(product(RETEST_LINES, ENTRY_DELAYS, ATR_TOLERANCES, PULLBACK_VOLUME_MAX, REBOUND_VOLUME_MIN, SLOPE_MIN))]
    return spark.createDataFrame(rows, "cfg int, line int, delay int, tolerance double, pullback_max double, rebound_min double, slope_min double")


def fold_table(spark: SparkSession, train: int, test: int, count: int = 1, check: bool = False) -> DataFrame:
    """Folds counted back from the end of the history; ``need`` is the least history of a fold."""
    rows = [(k + 1, (count - k - 1) * test, train, test, WARMUP + train + test if check else 0) for k in range(count)]
    return spark.createDataFrame(rows, "fold int, offset int, train int, test int, need int")


def setups(p: DataFrame, bars: DataFrame) -> DataFrame:
    """Confirmed lower fractals inside a widening fan of the three averages: one row per fractal
    with the next bars as ``path``. Few fractals pass, so everything later is small. ``p`` is the panel of ``bars``."""
    keep = ["close", "atr", "low", "smma21", "smma50", "smma200", "vr_prior", "lower_fractal"]
    w = Window.partitionBy("symbol").orderBy("bar_idx")
    d = p.select("symbol", "bar_date", "bar_idx", "n_bars", "slope", "gap", "gap_old", *keep, *[F.lag(c, 2).over(w).alias(f"p_{c}") for c in keep])
    fan = lambda x: (F.col(f"{x}smma21") > F.col(f"{x}smma50")) & (F.col(f"{x}smma50") > F.col(f"{x}smma200"))
    d = d.filter(flag(F.col("p_lower_fractal")) & flag(fan("p_") & fan("")) & flag(F.col("gap") > F.col("gap_old")) & (F.col("bar_idx") >= WARMUP))
    d = d.select("symbol", "bar_idx", F.struct(
        "n_bars", F.col("bar_idx").alias("confirmed"), F.col("bar_date").alias("signal_date"), F.col("close").alias("confirm_close"), F.col("p_low").alias("pivot_low"),
        (F.col("p_low") - 0.1 * F.col("p_atr")).alias("stop"), F.col("p_atr").alias("pivot_atr"), F.col("p_vr_prior").alias("pullback_ratio"), F.col("vr_prior").alias("rebound_ratio"), "slope",
        *[F.abs(F.col("p_low") - F.col(f"p_smma{k}")).alias(f"dist{k}") for k in RETEST_LINES], *[(F.col("close") > F.col(f"smma{k}")).alias(f"above{k}") for k in RETEST_LINES]).alias("s"))
    # a join of the fractals with their own paths would work the panel out twice
    d = forward_bars(d, bars, MAX_HOLD + max(ENTRY_DELAYS), start=0).groupBy("symbol", "bar_idx").agg(F.first("s").alias("s"), F.array_sort(F.collect_list(F.struct(
        (F.col("bar_idx") + F.col("step")).alias("idx"), F.col("f_open").alias("open"), F.col("f_high").alias("high"), F.col("f_low").alias("low"), F.col("f_close").alias("close"), F.col("f_bar_date").alias("date")))).alias("path"))
    return d.select("symbol", "s.*", "path")


def outcomes(s: DataFrame, folds: DataFrame, markets: DataFrame) -> DataFrame:
    """What each setup would have earned per fold and entry delay.

    The outcome depends on neither line nor filters, so it is computed once here and shared by all
    settings. First barrier wins; a gap fills at the open; stop before target on the same bar.
    """
    d = s.crossJoin(F.broadcast(folds)).withColumn("n_eff", F.col("n_bars") - F.col("offset")).filter("n_eff >= need")
    d = d.withColumns({"start": F.greatest(F.lit(WARMUP), F.col("n_eff") - F.col("train") - F.col("test")), "cut": F.col("n_eff") - F.col("test")})
    d = d.withColumn("split", F.when(F.col("confirmed") < F.col("cut"), "train").otherwise("test"))
    d = d.withColumn("until", F.when(F.col("split") == "train", F.col("cut")).otherwise(F.col("n_eff")))
    d = d.filter((F.col("confirmed") >= F.col("start")) & (F.col("confirmed") < F.col("until") - MAX_HOLD))
    d = d.withColumn("delay", F.explode(F.array(*map(F.lit, ENTRY_DELAYS)))).withColumn("entry_idx", F.col("confirmed") + F.col("delay"))
    d = d.filter((F.col("entry_idx") < F.col("until")) & (F.col("entry_idx") < F.col("n_eff") - 1))
    at = lambda i: F.get("path", i - F.col("confirmed"))
    d = d.withColumns({"entry": F.when(F.col("delay") == 0, F.col("confirm_close")).otherwise(at(F.col("entry_idx"))["open"]), "entry_date": at(F.col("entry_idx"))["date"],
                       "final": F.least(F.col("entry_idx") + MAX_HOLD, F.col("until") - 1, F.col("n_eff") - 1)})
    d = d.filter(F.col("entry") > F.col("stop")).withColumn("target", F.col("entry") + RISK_REWARD * (F.col("entry") - F.col("stop")))
    first = F.col("entry_idx") + F.when(F.col("delay") == 0, 1).otherwise(0)
    live = F.filter("path", lambda x: (x["idx"] >= first) & (x["idx"] <= F.col("final")))

    def judge(x):
        out = lambda price, why: F.struct(x["idx"].alias("idx"), price.alias("price"), F.lit(why).alias("reason"), x["date"].alias("date"))
        return (F.when(x["open"] <= F.col("stop"), out(x["open"], "stop_gap")).when(x["open"] >= F.col("target"), out(x["open"], "target_gap"))
                .when(x["low"] <= F.col("stop"), out(F.col("stop"), "stop")).when(x["high"] >= F.col("target"), out(F.col("target"), "target")))

    done = F.get(F.filter(F.transform(live, judge), lambda x: x.isNotNull()), F.lit(0))
    end = at(F.col("final"))
    timed = F.struct(end["idx"].alias("idx"), end["close"].alias("price"), F.lit("time").alias("reason"), end["date"].alias("date"))
    d = d.withColumn("exit", F.coalesce(done, timed)).drop("path").join(markets, "symbol")
    cost, e, x = lookup("market", COST_PCT, 0.10), F.col("entry"), F.col("exit.price")
    gross = (x - e) / e * 100
    return d.withColumns({
        "exit_idx": F.col("exit.idx"), "exit_date": F.col("exit.date"), "exit_price": half_even(x, 6), "exit_reason": F.col("exit.reason"), "gross_pct": half_even(gross, 6), "return_pct": half_even(gross - cost, 6),
        "r_multiple": half_even(((x - e) - e * cost / 100) / (e - F.col("stop")), 6), "win": gross - cost > 0, "open_gap_pct": half_even((e - F.col("confirm_close")) / F.col("confirm_close") * 100, 6),
    }).drop("exit", "start", "need", "train", "test", "offset", "n_eff")


def eligible(o: DataFrame, grid: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Outcomes that pass each setting: a theta join with the broadcast grid (864 rows, or a few per key)."""
    g = grid.withColumnRenamed("delay", "g_delay")
    for k in keys:
        g = g.withColumnRenamed(k, f"g_{k}")
    dist, above = F.when(F.col("line") == 21, F.col("dist21")).otherwise(F.col("dist50")), F.when(F.col("line") == 21, F.col("above21")).otherwise(F.col("above50"))
    cond = (F.col("delay") == F.col("g_delay")) & flag(dist <= F.col("tolerance") * F.col("pivot_atr")) & flag(above)
    for limit, test in (("pullback_max", F.col("pullback_ratio") <= F.col("pullback_max")), ("rebound_min", F.col("rebound_ratio") >= F.col("rebound_min")), ("slope_min", F.col("slope") >= F.col("slope_min"))):
        cond = cond & (F.col(limit).isNull() | test)
    for k in keys:
        cond = cond & (F.col(k) == F.col(f"g_{k}"))
    return o.join(F.broadcast(g), cond).drop("g_delay", *[f"g_{k}" for k in keys])


def apply_settings(o: DataFrame, grid: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Eligible outcomes, thinned so that trades of one symbol, setting, fold and split do not overlap."""
    hits = eligible(o, grid, keys)
    trade = ["confirmed", "exit_idx", "entry_idx", "signal_date", "entry_date", "exit_date", "entry", "stop", "target", "exit_price", "exit_reason", "gross_pct", "return_pct", "r_multiple", "win", "open_gap_pct", "pullback_ratio", "rebound_ratio", "slope"]
    # Within one group the entry delay is fixed, so the order of confirmation is the order of time.
    q = hits.groupBy("symbol", "market", "cfg", "fold", "split").agg(F.array_sort(F.collect_list(F.struct(*trade))).alias("all"))

    def step(acc, t):
        return F.when(t["confirmed"] >= F.element_at(acc, -1)["exit_idx"] + 1, F.concat(acc, F.array(t))).otherwise(acc)

    kept = F.aggregate(F.slice("all", F.lit(2), F.size("all")), F.slice("all", 1, 1), step)
    return q.withColumn("t", F.explode(kept)).select("symbol", "market", "cfg", "fold", "split", "t.*")


def summarize_trades(t: DataFrame, keys: list[str]) -> DataFrame:
    """Counts, rates, returns, R with its 95 % interval, profit factor and concentration."""
    r, n = F.col("return_pct"), F.count(F.lit(1))
    gain, lost = F.sum(F.when(r > 0, r)), F.sum(F.when(r < 0, r))
    sd_r = F.coalesce(F.stddev_samp("r_multiple"), F.lit(0.0))
    margin = 1.96 * sd_r / F.sqrt(n)
    rate = lambda c: report(F.avg(c.cast("double")) * 100, 2)
    g = t.groupBy(*keys).agg(
        n.alias("trades"), rate(r > 0).alias("win_rate_pct"), report(F.avg(r), 4).alias("avg_return_pct"), report(F.avg("r_multiple"), 4).alias("avg_r"),
        report(F.avg("r_multiple") - margin, 4).alias("r_ci_low"), report(F.avg("r_multiple") + margin, 4).alias("r_ci_high"), report(gain / F.abs(F.nullif(lost, F.lit(0.0))), 4).alias("pf0"),
        report(F.coalesce(F.stddev_samp(r), F.lit(0.0)), 4).alias("return_std"), report(F.max(F.when(r > 0, r)) / F.nullif(gain, F.lit(0.0)) * 100, 2).alias("largest_profit_share_pct"),
        report(F.avg("open_gap_pct"), 4).alias("avg_open_gap_pct"), rate(F.col("exit_reason").startswith("target")).alias("target_rate_pct"), rate(F.col("exit_reason").startswith("stop")).alias("stop_rate_pct"),
        F.count_if(r < 0).alias("_losses"), F.coalesce(gain, F.lit(0.0)).alias("_gain"),
    )
    pf = F.when(F.col("_losses") > 0, F.when(F.col("_gain") == 0, 0.0).otherwise(F.col("pf0")))
    med = exact_quantiles(t, keys, {"ret": r, "r": F.col("r_multiple")}, [0.5])
    g = g.withColumn("profit_factor", pf).drop("pf0", "_losses", "_gain")
    d = g.join(med, keys) if keys else g.crossJoin(F.broadcast(med))
    return d.withColumns({"median_return_pct": report("ret_50", 4), "median_r": report("r_50", 4)}).drop("ret_50", "r_50")


def objective() -> Column:
    """Value of a setting from its training summary; -999 below the least number of trades."""
    z = lambda c, d: F.coalesce(F.when(F.col(c) != 0, F.col(c)), F.lit(d))
    excess = F.greatest(F.lit(0.0), z("largest_profit_share_pct", 100.0) - 35.0) / 100.0
    v = (F.col("r_ci_low") + F.col("median_r") * 0.15 + F.least(F.coalesce("profit_factor", F.lit(0.0)), F.lit(2.0)) * 0.05 + F.col("win_rate_pct") / 100.0 * 0.03
         + F.log1p(F.col("trades").cast("double")) * 0.01 - excess * 0.10)
    return F.when(F.col("trades") >= MIN_TRADES, v).otherwise(-999.0)


def scored_settings(trades: DataFrame, grid: DataFrame, scopes: DataFrame) -> DataFrame:
    """Every setting in every scope (``market, fold``) with its training summary and objective."""
    train = summarize_trades(trades.filter("split = 'train'"), ["market", "fold", "cfg"])
    d = scopes.crossJoin(F.broadcast(grid)).join(train, ["market", "fold", "cfg"], "left").fillna(0, ["trades"])
    return d.withColumn("objective", objective())


def best_settings(scored: DataFrame) -> DataFrame:
    """Per market and fold the executable setting (delay of at least one bar) of the highest
    objective; where none has enough trades the one with most trades. Earlier settings win ties."""
    d = scored.filter("delay >= 1")
    good = F.col("objective") > -900
    key = F.struct((~good).cast("int").alias("a"), F.when(good, -F.col("objective")).otherwise(-F.col("trades").cast("double")).alias("b"), F.col("cfg").alias("c"))
    cols = [c for c in d.columns if c not in ("market", "fold")]
    return d.groupBy("market", "fold").agg(F.min_by(F.struct(*cols), key).alias("v")).select("market", "fold", "v.*")


def top_settings(scored: DataFrame, k: int = 10) -> DataFrame:
    w = Window.partitionBy("market", "fold").orderBy(F.desc("objective"), "cfg")
    return scored.filter("objective > -900").withColumn("place", F.row_number().over(w)).filter(F.col("place") <= k)


FACTORS = {"entry_delay": ["delay"], "retest_line": ["line"], "atr_tolerance": ["tolerance"], "volume_filter": ["pullback_max", "rebound_min"], "smma200_slope": ["slope_min"]}


def factor_analysis(scored: DataFrame, best: DataFrame) -> DataFrame:
    """Settings that differ from the best in one factor only, the best itself included."""
    dims = ["delay", "line", "tolerance", "pullback_max", "rebound_min", "slope_min"]
    b = best.select("market", "fold", *[F.col(c).alias(f"b_{c}") for c in dims])
    d = scored.join(F.broadcast(b), ["market", "fold"])
    same = {c: F.col(c).eqNullSafe(F.col(f"b_{c}")) for c in dims}
    hits = F.array(*[F.when(reduce(lambda a, x: a & x, [same[c] for c in dims if c not in free]), F.lit(f)) for f, free in FACTORS.items()])
    d = d.withColumn("factor", F.explode(F.filter(hits, lambda x: x.isNotNull())))
    return d.drop(*[f"b_{c}" for c in dims])


def slope_variants(best: DataFrame) -> DataFrame:
    """The best setting of each market at nine slope limits, as a grid keyed by market."""
    lv = F.array(*[F.struct(F.lit(i).alias("cfg"), F.lit(v).alias("slope_min")) for i, v in enumerate(SLOPE_LEVELS)])
    return best.select("market", "line", "delay", "tolerance", "pullback_max", "rebound_min", F.explode(lv).alias("v")).select("market", "line", "delay", "tolerance", "pullback_max", "rebound_min", "v.*")


def walk_forward(trades: DataFrame, scored: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Re-optimised folds: the chosen setting and its test summary per fold, and the test trades.

    Indicators only look back, so one set of outcomes serves every fold; ``trades`` and ``scored``
    carry the fold as a key.
    """
    best = written(best_settings(scored), "chosen")
    test = written(trades.filter("split = 'test'").join(F.broadcast(best.select("market", "fold", "cfg")), ["market", "fold", "cfg"]), "chosen-trades")  # summaries read their rows several times
    s = summarize_trades(test, ["market", "fold"])
    span = test.groupBy("market", "fold").agg(F.min("signal_date").alias("test_start"), F.max("exit_date").alias("test_end"))
    chosen = best.select("market", "fold", "cfg", "line", "delay", "tolerance", "pullback_max", "rebound_min", "slope_min", F.col("trades").alias("train_trades"), "objective")
    return chosen.join(s, ["market", "fold"], "left").join(span, ["market", "fold"], "left").fillna(0, ["trades"]), test


def positive_folds(folds: DataFrame) -> DataFrame:
    good = F.count_if(F.coalesce("avg_r", F.lit(0.0)) > 0)
    return folds.groupBy("market").agg(F.count(F.lit(1)).alias("folds"), good.alias("positive_folds"), half_even(good / F.count(F.lit(1)), 4).alias("positive_ratio"))


def cost_stress(trades: DataFrame) -> DataFrame:
    """Returns under added round-trip costs."""
    d = trades.withColumn("extra", F.explode(F.array(*map(F.lit, SLIPPAGE_PCT)))).withColumn("r", F.col("gross_pct") - lookup("market", COST_PCT, 0.10) - F.col("extra"))
    gain, lost, r = F.sum(F.when(F.col("r") > 0, F.col("r")).otherwise(0.0)), F.sum(F.when(F.col("r") < 0, F.col("r"))), F.col("r")
    return d.groupBy("market", "extra").agg(F.count(F.lit(1)).alias("trades"), half_even(F.avg(r), 4).alias("avg_return_pct"), half_even(F.avg((r > 0).cast("double")) * 100, 2).alias("win_rate_pct"),
                                            half_even(gain / F.abs(F.nullif(lost, F.lit(0.0))), 4).alias("profit_factor"))


def with_context(trades: DataFrame, p: DataFrame, regimes: DataFrame, distances: DataFrame) -> DataFrame:
    """Adds turnover before entry, the benchmark regime of the entry day and the distance to the next event."""
    t = trades.join(p.select("symbol", F.col("bar_idx").alias("entry_idx"), "turnover"), ["symbol", "entry_idx"], "left")
    t = t.join(F.broadcast(regimes.withColumnRenamed("bar_date", "entry_date")), "entry_date", "left").fillna("UNKNOWN", ["regime"])
    return t.join(distances.select("symbol", F.col("bar_idx").alias("entry_idx"), "event_distance"), ["symbol", "entry_idx"], "left")


def diagnostics(trades: DataFrame) -> DataFrame:
    """Summaries by regime, liquidity tercile and distance to earnings in one aggregation.

    Quantiles read their rows several times, and these are quantiles of rows with quantiles, so both are written."""
    t = written(liquidity_terciles(written(trades, "context"), ["market"], "turnover"), "terciles")
    near = F.when(F.col("event_distance").isNull(), "unavailable").when(F.abs("event_distance") <= 5, "within_5_bars").otherwise("outside_5_bars")
    pairs = [("market_regime", F.col("regime")), ("liquidity", F.col("liquidity")), ("earnings_proximity", near)]
    d = t.withColumn("a", F.explode(F.array(*[F.struct(F.lit(k).alias("attribute"), v.alias("value")) for k, v in pairs]))).select("*", "a.*").drop("a")
    return summarize_trades(d, ["market", "attribute", "value"])


def verdict(quality_ok: Column, latest: Column, rolling: Column, ratio: Column) -> Column:
    """accepted, provisional or rejected. ``latest`` and ``rolling`` are summary structs."""
    ok = lambda s: flag((s["trades"] >= MIN_TRADES) & (s["avg_r"] > 0) & (s["profit_factor"] > 1) & (s["r_ci_low"] > 0))
    return F.when(flag(quality_ok) & ok(latest) & ok(rolling) & flag(ratio >= 0.75), "accepted").when(flag(quality_ok) & ok(latest) & rolling.isNull(), "provisional").otherwise("rejected")


def fingerprint(df: DataFrame, *keys: str) -> DataFrame:
    """SHA-256 of a table, or of each group of ``keys``: the number of rows and the sums of four parts of their hashes.

    The order of rows does not matter, one changed member changes the result, and it is one mergeable aggregate: no
    rows are gathered. A row's hash is that of its columns by name as JSON, nulls included.
    """
    own = [c for c in sorted(df.columns) if c not in keys]
    h = F.sha2(F.to_json(F.struct(*own), {"ignoreNullFields": "false"}), 256)
    parts = [F.sum(F.conv(F.substring("_h", 15 * i + 1, 15), 16, 10).cast("decimal(38,0)")).cast("string") for i in range(4)]
    out = df.withColumn("_h", h).groupBy(*keys).agg(F.count("*").alias("members"), *[p.alias(f"_p{i}") for i, p in enumerate(parts)])
    return out.select(*keys, "members", F.sha2(F.concat_ws("|", F.col("members").cast("string"), *[f"_p{i}" for i in range(4)]), 256).alias("fingerprint"))


# -- return-series zones ----------------------------------------------------------------------

def zone_first_hit(series: DataFrame, keys: list[str], horizon: int = 20, warm: int = 30) -> DataFrame:
    """First-hit statistics of three ATR-deep entry zones on a return series.

    ``series`` has one row per key and day with ``bar_date, ret, atr`` (ATR as a share of price), so
    it is bounded by the calendar.
    """
    w = Window.partitionBy(*keys).orderBy("bar_date")
    fut = F.collect_list(F.log1p("ret")).over(w.rowsBetween(1, horizon))
    d = series.withColumns({"t": F.row_number().over(w) - 1, "f": fut}).filter((F.col("t") >= warm) & (F.size("f") == horizon))
    growth = F.transform(F.sequence(F.lit(1), F.lit(horizon)), lambda i: F.exp(F.aggregate(F.slice("f", 1, i), F.lit(0.0), lambda a, x: a + x)))
    zones = F.array(*[F.struct(F.lit(n).alias("zone"), F.lit((a + b) / 2).alias("k")) for n, a, b in (("A", 0.25, 0.65), ("B", 0.65, 1.10), ("C", 1.10, 1.70))])
    d = d.withColumn("g", growth).withColumn("z", F.explode(zones)).select(*keys, "atr", "g", "z.*")
    entry, atr, k = 1 - F.col("k") * F.col("atr"), F.col("atr"), F.col("k")
    tp, sl = 1 + (1.45 + 0.35 * k) * atr, 1 - (0.95 + 0.25 * k) * atr
    d = d.withColumns({"e": entry, "tp": tp, "sl": sl}).withColumn("rel", F.transform("g", lambda x: x / F.col("e")))
    pos = lambda cond: F.array_position(F.transform("rel", cond), F.lit(True))
    d = d.withColumns({"hit_tp": pos(lambda x: x >= F.col("tp")), "hit_sl": pos(lambda x: x <= F.col("sl"))})
    win = (F.col("hit_tp") > 0) & ((F.col("hit_sl") == 0) | (F.col("hit_tp") <= F.col("hit_sl")))
    d = d.withColumns({"win": win, "ret": F.when(win, F.col("tp") - 1).otherwise(F.element_at("rel", -1) - 1), "hold": F.when(win, F.col("hit_tp")).otherwise(horizon),
                       "lost": F.when(~win, F.least(F.lit(0.0), F.array_min("rel") - 1))})
    mean, hold = F.avg("ret"), F.avg("hold")
    return d.groupBy(*keys, "zone").agg(
        (F.avg(F.col("win").cast("double")) * 100).alias("win_prob"), (mean * 100).alias("expected_return_pct"), hold.alias("avg_hold_days"), (F.coalesce(F.avg("lost"), F.lit(0.0)) * 100).alias("avg_failed_loss_pct"),
        (mean / (F.stddev_pop("ret") + 1e-9) * F.sqrt(252 / F.greatest(hold, F.lit(1.0)))).alias("sharpe_proxy"))
