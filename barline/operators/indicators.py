"""Technical indicators as window expressions over a segmented bar frame.

Functions named ``with_*`` add columns to a frame from ``series.segmented``; the others return a
column. Everything stays in built-in expressions, and all windows share one partitioning and order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from barline.functions.numeric import all_of, finite, flag, half_even
from barline.operators.automaton import let, scanned
from barline.series import SEGMENT, ahead, back, by_symbol, ema, full, last, memory_of, own_rows, prior, segmented, smooth, wilder, wilder_sum

WILDER14 = memory_of(13 / 14)


# -- averages and ranges ----------------------------------------------------------------------

def sma(n: int, src: str = "close") -> Column:
    return full(F.avg(src).over(last(n)), n)


def true_range() -> Column:
    """NULL on the first bar, which has no previous close."""
    pc = back("close")
    return F.when(pc.isNotNull(), F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - pc), F.abs(F.col("low") - pc)))


def with_tr(df: DataFrame) -> DataFrame:
    return df.withColumn("tr", true_range())


def with_atr_wilder(df: DataFrame, n: int = 14, out: str = "atr_wilder") -> DataFrame:
    """Needs ``tr``. NULL below n + 1 bars."""
    return smooth(df, wilder("tr", out, n, start=1))


def with_atr_simple(df: DataFrame, n: int = 14, out: str = "atr_simple") -> DataFrame:
    """Trailing mean of true ranges with an expanding start. A bar that is not finite repeats
    the previous range, or 0 at the start."""
    pc = F.coalesce(finite(back("close")), F.col("close"))
    ok = all_of(*[finite(c).isNotNull() for c in ("high", "low", "close")])
    raw = F.when(ok, F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - pc), F.abs(F.col("low") - pc)))
    run = by_symbol().rowsBetween(Window.unboundedPreceding, 0)
    return (
        df.withColumn("_tr", raw)
        .withColumn("_tr", F.coalesce(F.last("_tr", ignorenulls=True).over(run), F.lit(0.0)))
        .withColumn(out, F.avg("_tr").over(last(n)))
        .drop("_tr")
    )


def atr_warm(n: int = 14) -> Column:
    """Mean of the last n true ranges, NULL for the first n - 1 bars. Needs ``tr``."""
    return full(F.avg(F.coalesce(F.col("tr"), F.col("high") - F.col("low"))).over(last(n)), n)


def index_volatility_pct(n: int = 14) -> Column:
    """Mean of the last n true ranges in per cent of the close. Needs ``tr`` and n + 1 bars."""
    v = F.avg("tr").over(last(n)) / F.col("close") * 100
    return F.when(F.col("bar_idx") >= n, F.when(F.col("close") > 0, v).otherwise(0.0))


def old_atr() -> Column:
    """Mean of the 14 true ranges that ended 20 bars ago; NULL below 35 bars. Needs ``tr``."""
    return F.when(F.col("bar_idx") >= 34, F.avg("tr").over(by_symbol().rowsBetween(-33, -20)))


def atr_spiking(atr: str = "atr_wilder", old: str = "old_atr") -> Column:
    return flag((F.col(old) > 0) & (F.col(atr) >= F.col(old) * 1.3))


def atr_collapsing(atr: str = "atr_wilder", old: str = "old_atr") -> Column:
    return flag((F.col(old) > 0) & (F.col(atr) <= F.col(old) * 0.5))


# -- direction and momentum -------------------------------------------------------------------

def with_adx(df: DataFrame, n: int = 14) -> DataFrame:
    """Adds ``plus_di, minus_di, adx``. Needs ``tr``.

    The three inputs are Wilder sums; ADX is the plain mean of the last n DX values that exist.
    A smoothed range of zero can only occur before the first move, so "the last n DX values"
    are the last n rows once all of these have one.
    """
    up, down = F.col("high") - back("high"), back("low") - F.col("low")
    df = df.withColumns(
        {
            "_up": F.when(back("high").isNotNull(), F.when((up > down) & (up > 0), up).otherwise(0.0)),
            "_dn": F.when(back("high").isNotNull(), F.when((down > up) & (down > 0), down).otherwise(0.0)),
        }
    )
    df = smooth(df, wilder_sum("tr", "_trs", n, 1), wilder_sum("_up", "_ups", n, 1), wilder_sum("_dn", "_dns", n, 1))
    has = F.col("_trs") != 0
    df = df.withColumns(
        {"_dip": F.when(has, 100 * F.col("_ups") / F.col("_trs")), "_dim": F.when(has, 100 * F.col("_dns") / F.col("_trs"))}
    )
    total = F.col("_dip") + F.col("_dim")
    dx = F.when(has, F.when(total != 0, 100 * F.abs(F.col("_dip") - F.col("_dim")) / total).otherwise(0.0))
    ready = F.count("_dx").over(last(n)) == n
    return (
        df.withColumn("_dx", dx)
        .withColumns(
            {
                "adx": F.when(ready, F.avg("_dx").over(last(n))),
                "plus_di": F.when(ready, F.col("_dip")),
                "minus_di": F.when(ready, F.col("_dim")),
            }
        )
        .drop("_up", "_dn", "_trs", "_ups", "_dns", "_dip", "_dim", "_dx")
    )


def with_rsi(df: DataFrame, n: int = 14, out: str = "rsi") -> DataFrame:
    d = F.col("close") - back("close")
    df = df.withColumns({"_gain": F.greatest(d, F.lit(0.0)), "_loss": F.greatest(-d, F.lit(0.0))})
    df = smooth(df, wilder("_gain", "_ag", n, 1), wilder("_loss", "_al", n, 1))
    value = F.when(F.col("_al") == 0, 100.0).otherwise(100 - 100 / (1 + F.col("_ag") / F.col("_al")))
    return df.withColumn(out, F.when(F.col("_al").isNotNull(), value)).drop("_gain", "_loss", "_ag", "_al")


def with_macd(df: DataFrame) -> DataFrame:
    df = smooth(df, ema("close", "ema12", 12), ema("close", "ema26", 26))
    df = df.withColumn("macd", F.col("ema12") - F.col("ema26"))
    return smooth(df, ema("macd", "macd_signal", 9, start=25))


def stochastic_k(n: int = 14) -> Column:
    lo, hi = F.min("low").over(last(n)), F.max("high").over(last(n))
    return full(F.when(hi != lo, 100 * (F.col("close") - lo) / (hi - lo)), n)


def stochastic_d(k: str = "stoch_k", n: int = 3) -> Column:
    return F.when(F.count(k).over(last(n)) == n, F.avg(k).over(last(n)))


def bollinger(n: int = 20, width: float = 2.0) -> dict[str, Column]:
    mid, sd = F.avg("close").over(last(n)), F.stddev_pop("close").over(last(n))
    return {
        "bb_middle": full(mid, n), "bb_upper": full(mid + width * sd, n), "bb_lower": full(mid - width * sd, n),
    }


def obv() -> Column:
    """Needs ``signed_volume``; see ``signed_volume``. The running sum spans the whole history."""
    return F.sum("signed_volume").over(Window.partitionBy("symbol").orderBy("bar_idx").rowsBetween(Window.unboundedPreceding, 0))


def signed_volume() -> Column:
    return F.coalesce(F.signum(F.col("close") - back("close")) * F.col("volume"), F.lit(0.0))


def aroon(n: int = 25) -> dict[str, Column]:
    w = last(n + 1)
    since_high = F.col("bar_idx") - F.max(F.struct("high", "bar_idx")).over(w)["bar_idx"]
    since_low = F.col("bar_idx") + F.min(F.struct("low", (-F.col("bar_idx")).alias("neg"))).over(w)["neg"]
    return {
        "aroon_up": full(100.0 * (n - since_high) / n, n + 1),
        "aroon_down": full(100.0 * (n - since_low) / n, n + 1),
    }


def buy_pressure(n: int = 14) -> Column:
    """Volume-weighted place of the close within the bar."""
    rng = F.col("high") - F.col("low")
    place = F.when(rng == 0, 0.5).otherwise((F.col("close") - F.col("low")) / rng)
    total = F.sum("volume").over(last(n))
    return full(F.when(total != 0, F.sum(F.col("volume") * place).over(last(n)) / total), n)


def parabolic_sar(bars: DataFrame, step: float = 0.02, limit: float = 0.20, size: int = SEGMENT) -> DataFrame:
    """``symbol, bar_idx, psar``: from the second bar on, rising at first.

    The state is the side, the stop, the extreme since the last turn, and the acceleration.
    """
    d = segmented(bars.select("symbol", "bar_idx", "n_bars", "high", "low"), 2)
    d = own_rows(d.withColumns({"h1": back("high"), "h2": back("high", 2), "l1": back("low"), "l2": back("low", 2)}))

    def state(up: Column, sar: Column, ep: Column, af: Column) -> Column:
        return F.struct(up.alias("up"), sar.alias("sar"), ep.alias("ep"), af.alias("af"))

    def start(x: Column) -> Column:
        return state(F.lit(True), F.coalesce(x["l1"], x["low"]), F.greatest(x["h1"], x["high"]), F.lit(step))

    def turned(s: Column, x: Column, sar: Column) -> Column:
        up, flip = s["up"], F.when(s["up"], x["low"] < sar).otherwise(x["high"] > sar)
        beyond = F.when(up, x["high"] > s["ep"]).otherwise(x["low"] < s["ep"])
        kept = state(up, sar, F.when(beyond, F.when(up, x["high"]).otherwise(x["low"])).otherwise(s["ep"]), F.when(beyond, F.least(s["af"] + step, F.lit(limit))).otherwise(s["af"]))
        return F.when(flip, state(~up, s["ep"], F.when(up, x["low"]).otherwise(x["high"]), F.lit(step))).otherwise(kept)

    def advance(s: Column, x: Column) -> Column:
        raw = s["sar"] + s["af"] * (s["ep"] - s["sar"])
        sar = F.when(s["up"], F.least(raw, x["l1"], x["l2"])).otherwise(F.greatest(raw, x["h1"], x["h2"]))
        return F.when(x["bar_idx"] < 2, start(x)).otherwise(let(sar, lambda v: turned(s, x, v)))

    out = scanned(d, "bar_idx", ["high", "low", "h1", "h2", "l1", "l2"], start, advance, "struct<up:boolean,sar:double,ep:double,af:double>", size=size)
    return out.select("symbol", "bar_idx", F.when(F.col("bar_idx") >= 1, F.col("state.sar")).alias("psar"))


# -- volume -----------------------------------------------------------------------------------

def volume_ratio_prior(n: int = 20) -> Column:
    """Volume against the mean of the n bars before it; 1 when too short or empty."""
    avg = F.avg("volume").over(prior(n))
    return F.when((F.col("bar_idx") >= n) & (avg > 0), F.col("volume") / avg).otherwise(1.0)


def volume_ratio_inclusive(n: int = 20) -> Column:
    """Volume against the mean of the last n bars, this one included; 1 when too short."""
    avg = F.avg("volume").over(last(n))
    return F.when((F.col("bar_idx") >= n - 1) & (avg > 0), F.col("volume") / avg).otherwise(1.0)


def volume_ratio_positive(n: int = 20) -> Column:
    """Volume against the mean of the positive volumes among the n bars before; NULL if none."""
    v = finite("volume")
    return F.try_divide(v, F.avg(F.when(v > 0, v)).over(prior(n)))


def volume_spike(times: float = 2.0) -> Column:
    avg = F.round(F.avg(F.when(F.col("volume") != 0, F.col("volume"))).over(last(20)))
    return flag((F.col("volume") > 0) & (avg > 0) & (F.try_divide("volume", avg) >= times))


def turnover_before(n: int = 20) -> Column:
    return F.coalesce(F.avg(F.col("close") * F.col("volume")).over(prior(n)), F.lit(0.0))


def vwap(n: int = 20) -> Column:
    vol = F.sum("volume").over(last(n))
    return full(F.when(vol > 0, F.sum(F.col("close") * F.col("volume")).over(last(n)) / vol), n)


# -- levels and shape -------------------------------------------------------------------------

def efficiency(n: int = 20) -> Column:
    """Net move over path length of the last n closes, 0..100. Needs ``abs_move``."""
    path = F.sum("abs_move").over(last(n - 1))
    net = F.abs(F.col("close") - back("close", n - 1))
    v = F.when(path == 0, 0.0).otherwise(F.least(net / path * 100, F.lit(100.0)))
    return F.when(F.col("bar_idx") >= n - 1, v).otherwise(0.0)


def abs_move() -> Column:
    return F.abs(F.col("close") - back("close"))


def high_of(n: int) -> Column:
    return F.max("high").over(last(n))


def distance_to_high_pct(high: str = "high_20") -> Column:
    c = F.col("close")
    return F.when(c > 0, F.greatest(F.lit(0.0), (F.col(high) - c) / c * 100)).otherwise(0.0)


def above_prior_high(n: int) -> Column:
    h = F.max("high").over(prior(n))
    return flag((F.col("bar_idx") >= n) & (h > 0) & (F.col("close") > h))


def chasing(flag_col: str, days: int = 5, need: int = 25) -> Column:
    """Whether the flag was set on one of the last ``days`` bars; false below ``need`` bars."""
    return flag(F.max(F.col(flag_col).cast("int")).over(last(days)) == 1) & (F.col("bar_idx") >= need - 1)


def change_pct(k: int) -> Column:
    base = back("close", k)
    return F.when(base != 0, (F.col("close") - base) / base * 100)


def with_year_range(df: DataFrame, n: int = 252, part: int = 21) -> DataFrame:
    """Adds the range of the last n bars and the place of the close in it. A frame of n bars costs n steps a row, so the
    extremes are put together from those of ``part`` bars, a divisor of n, and their lagged values."""
    df = df.withColumns({"_hi": F.max("high").over(last(part)), "_lo": F.min("low").over(last(part))})
    hi, lo = (best(*[back(c, k) if k else F.col(c) for k in range(0, n, part)]) for best, c in ((F.greatest, "_hi"), (F.least, "_lo")))
    df = df.withColumns({"high_52w": hi, "low_52w": lo, "_first20": F.first("close").over(last(20))})
    hi, lo, first20 = F.col("high_52w"), F.col("low_52w"), F.col("_first20")
    return df.withColumns({
        "pos_52w_pct": F.when(hi > lo, (F.col("close") - lo) / (hi - lo) * 100),
        "change_20d_pct": F.when((F.col("bar_idx") >= 1) & (first20 != 0), (F.col("close") - first20) / first20 * 100),
        "from_high_pct": F.when(hi != 0, (F.col("close") - hi) / hi * 100),
    }).drop("_hi", "_lo", "_first20")


def lowest_mean(window: int, k: int) -> Column:
    """Mean of the k lowest positive lows of the last ``window`` bars; NULL if fewer than k."""
    lows = F.sort_array(F.filter(F.collect_list("low").over(last(window)), lambda x: x > 0))
    total = F.aggregate(F.slice(lows, 1, k), F.lit(0.0), lambda a, x: a + x)
    return F.when(F.size(lows) >= k, total / k)


def expanding_volatility(atr: str) -> Column:
    """Mean ATR of the last 5 bars above 1.3 times that of the 15 bars before."""
    old = F.avg(atr).over(by_symbol().rowsBetween(-19, -5))
    return flag((F.count(atr).over(last(20)) == 20) & (old > 0) & (F.try_divide(F.avg(atr).over(last(5)), old) > 1.3))


def fibonacci(n: int = 60) -> dict[str, Column]:
    hi, lo = F.max("high").over(last(n)), F.min("low").over(last(n))
    return {f"fib_{int(r * 1000)}": hi - r * (hi - lo) for r in (0.382, 0.5, 0.618)}


def pivot_levels() -> dict[str, Column]:
    h, lo, c = back("high"), back("low"), back("close")
    p = (h + lo + c) / 3
    return {"pivot": p, "r1": 2 * p - lo, "s1": 2 * p - h, "r2": p + (h - lo), "s2": p - (h - lo)}


def fractal(side: str) -> Column:
    """Strict five-bar extreme; known two bars later."""
    c = "high" if side == "upper" else "low"
    others = [back(c, 2), back(c, 1), ahead(c, 1), ahead(c, 2)]
    tests = [F.col(c) > o if side == "upper" else F.col(c) < o for o in others]
    return flag(all_of(*tests))


def with_smma(df: DataFrame, *periods: int) -> DataFrame:
    return smooth(df, *[wilder("close", f"smma{n}", n) for n in periods])


def smma_slope_pct(col: str = "smma200", k: int = 20) -> Column:
    """Change over k bars in per cent, 0 where the older value is missing or not positive."""
    old = back(col, k)
    return F.when(flag(old > 0) & F.col(col).isNotNull(), (F.col(col) - old) / old * 100).otherwise(0.0)


def trend_regime(slope: str = "smma200_slope") -> Column:
    """BULL, BEAR or SIDEWAYS from close, SMMA200 and its slope; NULL during warm-up."""
    c, s = F.col("close"), F.col("smma200")
    bull, bear = (c > s) & (F.col(slope) > 0.10), (c < s) & (F.col(slope) < -0.10)
    return F.when(s.isNotNull() & (F.col("bar_idx") >= 20), F.when(bull, "BULL").when(bear, "BEAR").otherwise("SIDEWAYS"))


def breakout_integrity(avg_volume: str = "avg_volume_10") -> Column:
    """Candle score 0..15 from body share, volume against the prior mean, and close location."""
    rng = F.col("high") - F.col("low")
    body = F.try_divide(F.abs(F.col("close") - F.col("open")), rng)
    place = F.try_divide(F.col("close") - F.col("low"), rng)
    vol = F.when(F.col(avg_volume) > 0, F.col("volume") / F.col(avg_volume))
    return (
        F.when((rng > 0) & (body > 0.6), 5).when((rng > 0) & (body >= 0.4), 2).otherwise(0)
        + F.when(vol > 1.5, 5).when(vol >= 1.0, 2).otherwise(0)
        + F.when((rng > 0) & (place >= 0.7), 5).when((rng > 0) & (place >= 0.3), 2).otherwise(0)
    )


def avg_volume_prior(n: int = 10) -> Column:
    return F.when(F.col("bar_idx") >= n, F.avg("volume").over(prior(n))).otherwise(0.0)


def with_ema20(df: DataFrame) -> DataFrame:
    return smooth(df, ema("close", "ema20", 20))


def history_stage() -> dict[str, Column]:
    """How far a listing's price history carries: stage and the cap it puts on confidence."""
    n = F.col("bar_count")
    return {
        "stage": F.when(n < 20, "new").when(n < 60, "short").when(n < 120, "limited").otherwise("sufficient"),
        "confidence_cap": F.when(n < 20, 45).when(n < 60, 60).when(n < 120, 75).otherwise(90),
    }


def rounded(c: str, digits: int) -> Column:
    return half_even(c, digits)
