"""First touches and range extremes over blocks against plain scans."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from barline.operators import backtest as B, ranges as R
from tests_common import bars_of, path


@pytest.mark.parametrize("size,horizon", [(4096, 20), (64, 7), (16, 90), (5, 1)])
def test_first_touch_and_extremes(spark, size, horizon):
    series = [path(300), path(40, 4), path(1, 5), path(2, 6)]
    bars = bars_of(spark, *series)
    asks = bars.select("symbol", "bar_idx", (F.col("close") * 0.97).alias("level"), (F.col("close") * 1.03).alias("goal"))
    d = R.asked(R.blocks(bars, horizon, size=size), asks, size=size)
    a, b = (lambda x: x["bar_idx"] - F.col("first") + 1), (lambda x: F.least(x["bar_idx"] + horizon, F.col("last")) - F.col("first"))
    told = F.transform("ask", lambda x: F.struct(
        x["bar_idx"].alias("i"), (R.first_touch(F.col("lows"), a(x), b(x), lambda v: v <= x["level"], horizon) + F.col("first")).alias("down"),
        (R.first_touch(F.col("highs"), a(x), b(x), lambda v: v >= x["goal"], horizon) + F.col("first")).alias("up"),
        R.extreme(F.col("lows"), a(x), b(x), F.least).alias("least"), R.extreme(F.col("highs"), a(x), b(x), F.greatest).alias("most")))
    got = {(r.symbol, r.i): (r.down, r.up, r.least, r.most) for r in d.select("symbol", F.explode(told).alias("t")).select("symbol", "t.*").collect()}
    assert len(got) == sum(len(s[3]) for s in series)
    for s, (_, h, lo, c, _) in enumerate(series):
        for i in range(len(c)):
            later = range(i + 1, min(i + horizon, len(c) - 1) + 1)
            down = next((j for j in later if lo[j] <= c[i] * 0.97), None)
            up = next((j for j in later if h[j] >= c[i] * 1.03), None)
            assert got[s, i] == (down, up, min((lo[j] for j in later), default=None), max((h[j] for j in later), default=None))


def test_targets_of_long_windows(spark):
    p = path(9000)
    bars = bars_of(spark, p)
    sig = bars.where("bar_idx % 50 = 49").select("symbol", "bar_idx", F.array(*[F.struct(F.lit(f"x{k}").alias("profile"), (F.col("close") * k).alias("target")) for k in (1.02, 1.1, 9.0)]).alias("targets"))
    rows = B.target_hits(sig, bars).collect()
    assert len(rows) == 3 * 180
    for r in rows:
        touched = np.flatnonzero(p[1][r.bar_idx + 1 : r.bar_idx + 91] >= r.target)
        assert r.days_to_hit == (touched[0] + 1 if len(touched) else None) and r.hit == bool(len(touched))
