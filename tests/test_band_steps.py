"""Steps of the buy bands: how often and how fast their depths were reached before."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from barline.operators import decisions as D
from test_scale import plan_of
from tests_common import bars_of, path


def bands_of(bars, low):
    end = bars.filter("bar_idx = n_bars - 1")
    return end.select("symbol", "close", F.lit("aggressive").alias("family"), F.lit("A").alias("band"), (F.col("close") * 0.99).alias("high"), (F.col("close") * low).alias("low"))


def by_hand(low, close, depth, horizon=30):
    days = []
    for i in range(len(low) - horizon):
        hit = [j for j in range(1, horizon + 1) if low[i + j] is not None and close[i] is not None and 1 - low[i + j] / close[i] >= depth]
        days += hit[:1]
    return len(days) / (len(low) - horizon) * 100, *(np.percentile(days, p) if days else None for p in (25, 75))


@pytest.mark.parametrize("size", [4096, 64])
def test_band_steps_by_brute_force(spark, monkeypatch, size):
    monkeypatch.setattr(D, "SEGMENT", size)
    monkeypatch.setattr(D.segmented, "__defaults__", (0, 0, size))
    o, h, lo, c, v = path(300)
    bars = bars_of(spark, (o, h, lo, c, v), path(10)).withColumn("low", F.when((F.col("symbol") > 0) | (F.col("bar_idx") != 100), F.col("low"))).withColumn("close", F.when((F.col("symbol") > 0) | (F.col("bar_idx") != 120), F.col("close")))
    got = {(r.symbol, r.step): r for r in D.band_steps(bands_of(bars, 0.85), bars).collect()}
    low, close = ([None if i == at else float(x) for i, x in enumerate(xs)] for xs, at in ((lo, 100), (c, 120)))
    assert len(got) == 10
    for step in range(1, 6):
        r = got[0, step]
        want = by_hand(low, close, r.depth)
        assert [r.reach_pct, r.days_min, r.days_max] == [pytest.approx(x) if x is not None else None for x in want]
        assert got[1, step].reach_pct is None


def test_bands_without_prices_are_never_reached(spark):
    bars = bars_of(spark, path(100))
    bands = bands_of(bars, 0.9).withColumn("high", F.lit(None).cast("double"))
    assert {(r.reach_pct, r.days_min) for r in D.band_steps(bands, bars).collect()} == {(0.0, None)}


def test_later_lows_are_not_folded_bar_by_bar(spark):
    bars = bars_of(spark, path(100))
    assert "collect_list(low" not in plan_of(D.band_steps(bands_of(bars, 0.9), bars))
