"""State machines and compositions over blocks against plain loops."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barline.operators import forecast, indicators as ind, patterns as P
from tests_common import bars_of, path


def long_bars(spark, series):
    """Bars of long series by way of a file, quicker than rows."""
    frames = [pd.DataFrame({"symbol": s, "bar_idx": np.arange(len(p[3])), "n_bars": len(p[3]), **dict(zip(("open", "high", "low", "close", "volume"), p))}) for s, p in enumerate(series)]
    d = spark.createDataFrame(pd.concat(frames)).withColumn("bar_idx", F.col("bar_idx").cast("int"))
    return d.withColumn("bar_date", F.date_add(F.lit("1400-01-01").cast("date"), F.col("bar_idx")))


def plain_sar(h, lo, step=0.02, limit=0.20):
    out = [None] * len(h)
    up, af = True, step
    if len(h) > 1:
        sar, ep = lo[0], max(h[0], h[1])
        out[1] = sar
    for i in range(2, len(h)):
        sar = sar + af * (ep - sar)
        sar = min(sar, lo[i - 1], lo[i - 2]) if up else max(sar, h[i - 1], h[i - 2])
        if (lo[i] < sar) if up else (h[i] > sar):
            up, sar, af = not up, ep, step
            ep = h[i] if up else lo[i]
        elif (h[i] > ep) if up else (lo[i] < ep):
            ep = h[i] if up else lo[i]
            af = min(af + step, limit)
        out[i] = sar
    return out


def rising(n):
    """No turn ever: blocks differ from their guesses all along, so the rounds go on to the last block."""
    c = 100 * 1.001 ** np.arange(n)
    return c, c * 1.0005, c * 0.9995, c, np.ones(n)


@pytest.mark.parametrize("n,size", [(200_000, 4096), (5000, 64)])
def test_parabolic_sar_of_long_series(spark, n, size):
    series = [path(n), path(1, 5), path(2, 6), path(300, 7), rising(4 * size + 1)]
    got = ind.parabolic_sar(long_bars(spark, series), size=size).orderBy("symbol", "bar_idx").toPandas()
    assert len(got) == sum(len(p[3]) for p in series)
    for s, p in enumerate(series):
        own = got[got.symbol == s]
        want = plain_sar(p[1], p[2])
        assert own.bar_idx.tolist() == list(range(len(want)))
        assert [None if np.isnan(x) else x for x in own.psar] == want


def plain_pivots(raw, gap):
    kept = []
    for idx, side, price in raw:
        if kept and kept[-1][1] == side:
            if (price > kept[-1][2]) if side == 1 else (price < kept[-1][2]):
                kept[-1] = (idx, side, price)
        elif not kept or idx - kept[-1][0] >= gap:
            kept.append((idx, side, price))
    return kept


@pytest.mark.parametrize("n,size", [(200_000, 4096), (3000, 40)])
def test_pivots_of_long_series(spark, n, size):
    o = P.Options()
    bars = long_bars(spark, [path(n), path(500, 9), rising(300)])
    raw = P.raw_pivots(P.pattern_bars(bars, o)).select("symbol", "p.idx", "p.side", "p.price").orderBy("symbol", "idx", "side").toPandas()
    got = P.confirmed_pivots(bars, o, size=size).orderBy("symbol", "idx").toPandas()
    assert (got.confirmed_idx == got.idx + o.pivot_window).all()
    for s in range(3):
        want = plain_pivots([(r.idx, r.side, r.price) for r in raw[raw.symbol == s].itertuples()], o.min_gap)
        assert [(r.idx, r.side, r.price) for r in got[got.symbol == s].itertuples()] == want
    assert len(got) > n // 50


def plain_holt(c, a, b):
    level, trend = c[0], c[1] - c[0]
    for x in c[1:]:
        new = a * x + (1 - a) * (level + trend)
        level, trend = new, b * (new - level) + (1 - b) * trend
    return level, trend


@pytest.mark.parametrize("alpha,beta", [(0.3, 0.1), (0.9, 0.8), (0.001, 0.002)])
@pytest.mark.parametrize("size", [4096, 100])
def test_holt_over_the_whole_history(spark, alpha, beta, size):
    series = [path(20_000), path(2, 4), path(1, 5), path(101, 6)]
    got = {r.symbol: (r.holt_level, r.holt_trend) for r in forecast.holt(long_bars(spark, series), alpha, beta, size=size).collect()}
    assert set(got) == {0, 1, 3}
    for s in got:
        assert np.allclose(got[s], plain_holt(series[s][3], alpha, beta), rtol=1e-9, atol=1e-12)
