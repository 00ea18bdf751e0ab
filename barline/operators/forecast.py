"""Forecasts from the end of each symbol's history, and the choice of look-back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from barline.series import SEGMENT

def linear_trend(bars: DataFrame, window: int = 60, least: int = 20) -> DataFrame:
    """OLS of the close on time over the last ``window`` bars: level at the last bar, slope, residual std."""
    x = (F.col("bar_idx") - F.col("n_bars") + 1).cast("double")
    d = bars.filter(F.col("bar_idx") >= F.col("n_bars") - window).withColumn("x", x)
    slope = F.regr_slope("close", "x")
    sse = F.regr_syy("close", "x") - slope * F.regr_sxy("close", "x")
    n = F.count(F.lit(1))
    return d.groupBy("symbol").agg(
        F.max("close").alias("_c"), F.when(n >= least, F.regr_intercept("close", "x")).alias("level"),
        F.when(n >= least, slope).alias("slope"),
        F.when(n >= least, F.sqrt(F.greatest(sse, F.lit(0.0)) / n)).alias("resid_std"),
    ).drop("_c")


def holt(bars: DataFrame, alpha: float = 0.3, beta: float = 0.1, size: int = SEGMENT) -> DataFrame:
    """Double exponential smoothing: ``holt_level`` and ``holt_trend`` at the last bar, from the whole history.

    A bar maps (level, trend) affinely, and such maps compose: each block of bars becomes one matrix and one vector, and
    the blocks of a symbol, a few numbers each, are applied in order to the state of its first two bars.
    """
    a, b = alpha, alpha * beta

    def after(level: Column, trend: Column, x: Column | float) -> tuple[Column, Column]:
        return (1 - a) * level + (1 - a) * trend + a * x, -b * level + (1 - b) * trend + b * x

    def composed(m: Column, s: Column) -> Column:
        p, q = after(m["v0"], m["v1"], s["close"])
        (aa, ca), (ab, cb) = (after(m[f"m0{k}"], m[f"m1{k}"], 0.0) for k in (0, 1))
        return F.struct(aa.alias("m00"), ab.alias("m01"), ca.alias("m10"), cb.alias("m11"), p.alias("v0"), q.alias("v1"))

    one = F.struct(*[F.lit(float(v)).alias(c) for c, v in (("m00", 1), ("m01", 0), ("m10", 0), ("m11", 1), ("v0", 0), ("v1", 0))])
    blk = F.floor(F.col("bar_idx") / size).alias("blk")
    closes = F.array_sort(F.collect_list(F.when(F.col("bar_idx") >= 1, F.struct("bar_idx", "close"))))
    at = lambda i: F.max(F.when(F.col("bar_idx") == i, F.col("close")))
    blocks = bars.groupBy("symbol", blk).agg(closes.alias("xs"), at(0).alias("c0"), at(1).alias("c1"))
    maps = blocks.select("symbol", "c0", "c1", F.struct("blk", F.aggregate("xs", one, composed).alias("m")).alias("b"))
    rows = maps.groupBy("symbol").agg(F.max("c0").alias("c0"), F.max("c1").alias("c1"), F.array_sort(F.collect_list("b")).alias("bs")).where("c1 is not null")
    start = F.struct(F.col("c0").alias("level"), (F.col("c1") - F.col("c0")).alias("trend"))

    def applied(s: Column, x: Column) -> Column:
        m = x["m"]
        return F.struct(*[(m[f"m{i}0"] * s["level"] + m[f"m{i}1"] * s["trend"] + m[f"v{i}"]).alias(c) for i, c in enumerate(("level", "trend"))])

    state = F.aggregate("bs", start, applied)
    return rows.select("symbol", state["level"].alias("holt_level"), state["trend"].alias("holt_trend"))


def forecast(bars: DataFrame, horizon: int = 30) -> DataFrame:
    """Linear, Holt and ensemble forecasts 1..horizon bars ahead with the 95 % band of the line."""
    h = F.col("step")
    line = F.col("level") + F.col("slope") * h
    smooth = F.col("holt_level") + F.col("holt_trend") * h
    return (
        linear_trend(bars).join(holt(bars), "symbol")
        .withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
        .select(
            "symbol", "step", line.alias("linear"), (line - 1.96 * F.col("resid_std")).alias("lower"),
            (line + 1.96 * F.col("resid_std")).alias("upper"), smooth.alias("holt"), ((line + smooth) / 2).alias("ensemble"),
        )
    )


def best_lookback(bars: DataFrame, points: int = 12, longest: int = 120) -> DataFrame:
    """The look-back (20, 25, ... up to ``longest``) with the least mean one-step OLS error.

    Sums over any look-back are differences of two running sums, so a candidate costs one step
    per validation point. Arrays hold at most ``longest + points`` closes.
    """
    keep = longest + points
    w = Window.partitionBy("symbol").orderBy("bar_idx")
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    d = bars.filter(F.col("bar_idx") >= F.col("n_bars") - keep).withColumn("j", F.row_number().over(w))
    d = d.withColumns({"sy": F.sum("close").over(run), "sxy": F.sum(F.col("j") * F.col("close")).over(run)})
    rows = d.groupBy("symbol").agg(
        F.array_sort(F.collect_list(F.struct("j", "close", "sy", "sxy"))).alias("s"), F.max("n_bars").alias("n_bars")
    ).filter(F.col("n_bars") >= 20 + points)
    zero = F.array(F.struct(F.lit(0).alias("j"), F.lit(0.0).alias("close"), F.lit(0.0).alias("sy"), F.lit(0.0).alias("sxy")))
    rows = rows.withColumn("m", F.size("s")).withColumn("s", F.concat(zero, "s"))
    rows = rows.withColumn(
        "lookback", F.explode(F.sequence(F.lit(20), F.least(F.lit(longest), (F.col("n_bars") - points).cast("int")), F.lit(5)))
    )

    def error(p):
        lb = F.col("lookback")
        sy = F.col("s")[p - 1]["sy"] - F.col("s")[p - lb - 1]["sy"]
        sxy = F.col("s")[p - 1]["sxy"] - F.col("s")[p - lb - 1]["sxy"]
        mid = p - (lb + 1) / 2.0
        slope = (sxy - mid * sy) / (lb * (lb * lb - 1) / 12.0)
        return F.abs(sy / lb + slope * (p - mid) - F.col("s")[p]["close"])

    total = F.aggregate(F.sequence(F.col("m") - (points - 1), F.col("m")), F.lit(0.0), lambda a, p: a + error(p))
    err = F.round(total / points, 9)
    return rows.withColumn("err", err).groupBy("symbol").agg(
        F.min(F.struct("err", "lookback")).alias("best")
    ).select("symbol", F.col("best.lookback").alias("lookback"), F.col("best.err").alias("error"))
