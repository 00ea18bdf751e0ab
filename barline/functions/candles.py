"""Candlestick patterns as boolean expressions.

A suffix k names the value k bars back: ``c1`` is the previous close. ``avgb`` is the mean body
of the ten bars before; where it is missing, a test that uses it fails.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from barline.series import back, prior

BASE = {
    "o": "open", "h": "high", "l": "low", "c": "close",
    "body": "abs(close - open)", "rng": "high - low",
    "up": "high - greatest(open, close)", "dn": "least(open, close) - low",
    "bull": "close > open", "bear": "close < open", "mid": "(open + close) / 2",
    "dj": "high > low and abs(close - open) < 0.1 * (high - low)",
}
SIZED = {"big": "body > avgb", "small": "body < 0.5 * avgb"}

# name: (direction, confidence, test). Directions and confidences are given.
ONE_BAR = {
    "doji": ("neutral", 70, "dj"),
    "hammer": ("bullish", 80, "dn >= 2 * body and up <= 0.3 * body and body > 0 and c1 < c5"),
    "shooting_star": ("bearish", 80, "up >= 2 * body and dn <= 0.3 * body and body > 0 and c1 > c5"),
    "marubozu_bull": ("bullish", 80, "big and up <= 0.05 * rng and dn <= 0.05 * rng and bull"),
    "marubozu_bear": ("bearish", 80, "big and up <= 0.05 * rng and dn <= 0.05 * rng and bear"),
}
TWO_BAR = {
    "bullish_engulfing": ("bullish", 85, "bear1 and bull and o <= c1 and c >= o1 and body > body1"),
    "bearish_engulfing": ("bearish", 85, "bull1 and bear and o >= c1 and c <= o1 and body > body1"),
    "bullish_harami": ("bullish", 70, "bear1 and big1 and bull and greatest(o, c) < o1 and least(o, c) > c1 and not dj"),
    "bearish_harami": ("bearish", 70, "bull1 and big1 and bear and greatest(o, c) < c1 and least(o, c) > o1 and not dj"),
    "harami_cross_bull": ("bullish", 80, "bear1 and big1 and dj and greatest(o, c) < o1 and least(o, c) > c1"),
    "harami_cross_bear": ("bearish", 80, "bull1 and big1 and dj and greatest(o, c) < c1 and least(o, c) > o1"),
    "piercing_line": ("bullish", 80, "bear1 and big1 and bull and o < c1 and c > mid1 and c < o1"),
    "dark_cloud_cover": ("bearish", 80, "bull1 and big1 and bear and o > c1 and c < mid1 and c > o1"),
}
THREE_BAR = {
    "morning_star": ("bullish", 90, "bear2 and big2 and small1 and bull and c > mid2"),
    "evening_star": ("bearish", 90, "bull2 and big2 and small1 and bear and c < mid2"),
    "three_white_soldiers": ("bullish", 90, "bull2 and bull1 and bull and c1 > c2 and c > c1 and o1 > o2 and o1 < c2 and o > o1 and o < c1 and not small2 and not small1 and not small"),
    "three_black_crows": ("bearish", 90, "bear2 and bear1 and bear and c1 < c2 and c < c1 and o1 < o2 and o1 > c2 and o < o1 and o > c1 and not small2 and not small1 and not small"),
    "three_inside_up": ("bullish", 85, "bear2 and big2 and bull1 and greatest(o1, c1) < o2 and least(o1, c1) > c2 and not dj1 and c > o2"),
    "three_inside_down": ("bearish", 85, "bull2 and big2 and bear1 and greatest(o1, c1) < c2 and least(o1, c1) > o2 and not dj1 and c < o2"),
    "three_outside_up": ("bullish", 88, "bear2 and bull1 and o1 <= c2 and c1 >= o2 and body1 > body2 and c > c1"),
    "three_outside_down": ("bearish", 88, "bull2 and bear1 and o1 >= c2 and c1 <= o2 and body1 > body2 and c < c1"),
}
_INSIDE4 = " and ".join(f"h{k} <= h4 and l{k} >= l4" for k in (3, 2, 1))
MULTI_BAR = {
    "rising_three_methods": ("bullish", 90, f"big4 and bull4 and small3 and bear3 and small2 and bear2 and small1 and bear1 and {_INSIDE4} and big and bull and c > c4"),
    "falling_three_methods": ("bearish", 90, f"big4 and bear4 and small3 and bull3 and small2 and bull2 and small1 and bull1 and {_INSIDE4} and big and bear and c < c4"),
    "abandoned_baby_bull": ("bullish", 92, "bear2 and big2 and dj1 and h1 < l2 and bull and l > h1"),
    "abandoned_baby_bear": ("bearish", 92, "bull2 and big2 and dj1 and l1 > h2 and bear and h < l1"),
    "hikkake_bull": ("bullish", 82, "h2 < h3 and l2 > l3 and h1 < h2 and l1 < l2 and c > h2"),
    "hikkake_bear": ("bearish", 82, "h2 < h3 and l2 > l3 and h1 > h2 and l1 > l2 and c < l2"),
    "mat_hold": ("bullish", 85, "big4 and bull4 and o3 > c4 and small3 and small2 and small1 and l3 > o4 and l2 > o4 and l1 > o4 and bull and c > greatest(h3, h2, h1)"),
}
PATTERNS = {**ONE_BAR, **TWO_BAR, **THREE_BAR, **MULTI_BAR}


def with_candle_parts(df: DataFrame, depth: int = 5) -> DataFrame:
    """Adds the named parts and their lagged values to a segmented frame."""
    df = df.withColumns({k: F.expr(v) for k, v in BASE.items()})
    df = df.withColumn("avgb", F.when(F.col("bar_idx") >= 10, F.avg("body").over(prior(10))))
    df = df.withColumns({k: F.expr(v) for k, v in SIZED.items()})
    return df.withColumns({f"{k}{i}": back(k, i) for k in (*BASE, *SIZED) for i in range(1, depth + 1)})


def candlesticks(df: DataFrame, names: list[str] | None = None) -> DataFrame:
    """One row per bar and pattern found: ``pattern, direction, confidence``.

    Needs a segmented frame with at least 16 bars of context.
    """
    hits = [
        F.when(F.expr(test), F.struct(F.lit(n).alias("pattern"), F.lit(d).alias("direction"), F.lit(conf).cast("long").alias("confidence")))
        for n, (d, conf, test) in PATTERNS.items() if names is None or n in names
    ]
    parts = with_candle_parts(df).withColumn("_hit", F.filter(F.array(*hits), lambda x: x.isNotNull()))
    return parts.withColumn("_hit", F.explode("_hit")).select(*df.columns, "_hit.*")
