"""Series that several tests use."""

import numpy as np
from pyspark.sql import functions as F


def path(n, seed=3):
    r = np.random.default_rng(seed)
    c = 100 * np.exp(np.cumsum(r.normal(0, 0.02, n)))
    o = c * (1 + r.normal(0, 0.005, n))
    return o, np.maximum(o, c) * 1.004, np.minimum(o, c) * 0.996, c, r.integers(1, 50, n).astype(float)


def bars_of(spark, *series):
    rows = []
    for s, (o, h, lo, c, v) in enumerate(series):
        rows += [(s, i, len(c), float(o[i]), float(h[i]), float(lo[i]), float(c[i]), float(v[i])) for i in range(len(c))]
    d = spark.createDataFrame(rows, "symbol long, bar_idx int, n_bars long, open double, high double, low double, close double, volume double")
    return d.withColumn("bar_date", F.date_add(F.lit("2000-01-01").cast("date"), F.col("bar_idx")))
