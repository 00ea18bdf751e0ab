"""Segments, smoothing, indicators: against plain recursions, and stable under cut-off and segmentation."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from barline.operators import indicators as ind
from barline.series import ema, memory_of, own_rows, segmented, smooth, wilder
from tests_common import bars_of, path


def column(df, name, symbol=0):
    return [r[0] for r in df.filter(F.col("symbol") == symbol).orderBy("bar_idx").select(name).collect()]


def plain_smooth(x, n, decay, gain):
    out, y = [None] * len(x), None
    for i in range(len(x)):
        y = np.mean(x[:n]) if i == n - 1 else None if i < n - 1 else decay * y + gain * x[i]
        out[i] = y
    return out


@pytest.mark.parametrize("size", [4096, 256])
def test_smoothing_equals_the_recursion(spark, size):
    p = path(1500)
    d = segmented(bars_of(spark, p), memory_of(20 / 21) + 20, size=size)
    got = column(own_rows(smooth(d, ema("close", "e", 12), wilder("close", "w", 21))), "e")
    want = plain_smooth(p[3], 12, 1 - 2 / 13, 2 / 13)
    assert got[:11] == [None] * 11
    assert np.allclose(got[11:], want[11:], rtol=1e-12)


def test_segments_do_not_change_windows(spark):
    b = bars_of(spark, path(900), path(300, 5))
    f = lambda size: own_rows(segmented(b, 210, 2, size=size).withColumns({"m": ind.sma(200), "e": ind.fractal("upper"), "h": ind.high_of(55)}))
    cols = ["symbol", "bar_idx", "m", "e", "h"]
    whole = {(r.symbol, r.bar_idx): (r.m, r.e, r.h) for r in f(4096).select(cols).collect()}
    cut = f(128).select(cols).collect()
    assert len(cut) == len(whole) == 1200
    for r in cut:
        m, e, h = whole[(r.symbol, r.bar_idx)]
        assert r.e == e and r.h == h and ((m is None and r.m is None) or abs(m - r.m) < 1e-9)


def test_results_do_not_look_ahead(spark):
    p = path(400)
    short = tuple(x[:300] for x in p)
    f = lambda b: own_rows(ind.with_macd(ind.with_rsi(ind.with_adx(ind.with_tr(segmented(b, 800)))))).select("symbol", "bar_idx", "adx", "rsi", "macd_signal")
    a = f(bars_of(spark, p)).filter("bar_idx < 300").orderBy("bar_idx").toPandas()
    b = f(bars_of(spark, short)).orderBy("bar_idx").toPandas()
    assert np.allclose(a.fillna(-1).to_numpy(), b.fillna(-1).to_numpy(), rtol=1e-12)


def test_indicators_scale_with_price(spark):
    p = path(260)
    big = (*[x * 10 for x in p[:4]], p[4])
    d = own_rows(ind.with_adx(ind.with_tr(segmented(bars_of(spark, p, big), 700))).withColumn("e", F.lit(0)))
    assert np.allclose(column(d, "adx", 0)[30:], column(d, "adx", 1)[30:], rtol=1e-9)


def test_flat_series_has_no_adx_and_full_rsi(spark):
    c = np.full(60, 50.0)
    d = own_rows(ind.with_rsi(ind.with_adx(ind.with_tr(segmented(bars_of(spark, (c, c, c, c, c)), 700)))))
    assert column(d, "adx")[-1] is None
    assert column(d, "rsi")[-1] == 100.0


def test_fractals_are_strict_and_late(spark):
    h = np.array([1, 2, 5, 2, 1, 3, 3, 1, 1.0])
    d = own_rows(segmented(bars_of(spark, (h, h, h, h, h)), 2, 2).withColumn("u", ind.fractal("upper")))
    assert [i for i, u in enumerate(column(d, "u")) if u] == [2]


@pytest.mark.parametrize("size", [256, 4096, 1 << 20])
def test_chained_smoothing_of_long_histories(spark, size):
    p = path(20_000)
    b = bars_of(spark, p)
    d = own_rows(ind.with_smma(ind.with_macd(ind.with_adx(ind.with_tr(segmented(b, 8000, size=size)))), 200))
    close = p[3]
    e12, e26 = plain_smooth(close, 12, 1 - 2 / 13, 2 / 13), plain_smooth(close, 26, 1 - 2 / 27, 2 / 27)
    macd = [x - y for x, y in zip(e12[25:], e26[25:])]
    signal = plain_smooth(macd, 9, 0.8, 0.2)
    rows = d.select("bar_idx", "macd", "macd_signal", "smma200", "adx").orderBy("bar_idx").collect()
    assert np.allclose([r.macd for r in rows[25:]], macd, rtol=1e-9, atol=1e-9)
    assert np.allclose([r.macd_signal for r in rows[33:]], signal[8:], rtol=1e-9, atol=1e-9)
    assert np.allclose([r.smma200 for r in rows[199:]], plain_smooth(close, 200, 199 / 200, 1 / 200)[199:], rtol=1e-9)
    assert all(r.adx is not None and 0 <= r.adx <= 100 for r in rows[27:])
