"""Two rescaled-range estimates of the Hurst exponent."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from barline.functions.numeric import half_even


def _rescaled(values: DataFrame, least_chunks: int) -> DataFrame:
    """Mean rescaled range per (symbol, size) from rows (symbol, size, chunk, pos, v)."""
    chunk = Window.partitionBy("symbol", "size", "chunk")
    v = values.withColumns({"mean": F.avg("v").over(chunk), "sd": F.stddev_pop("v").over(chunk)})
    run = chunk.orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    v = v.withColumn("dev", F.sum(F.col("v") - F.col("mean")).over(run))
    ranges = v.groupBy("symbol", "size", "chunk").agg(
        (F.max("dev") - F.min("dev")).alias("range"), F.max("sd").alias("sd")
    )
    rs = F.when(F.col("sd") > 0, F.col("range") / F.col("sd"))
    out = ranges.groupBy("symbol", "size").agg(F.avg(F.when(rs > 0, rs)).alias("rs"), F.count(F.lit(1)).alias("chunks"))
    return out.filter(F.col("rs").isNotNull() & (F.col("chunks") >= least_chunks))


def _slope(rs: DataFrame, value: Column) -> DataFrame:
    rs = rs.withColumns({"x": F.log("size"), "y": F.log("rs")})
    return rs.groupBy("symbol").agg(F.when(F.count(F.lit(1)) >= 3, value).alias("hurst"))


def hurst_prices(bars: DataFrame, lags: tuple[int, int] = (2, 20)) -> DataFrame:
    """On prices, lags 2..19. A full chunk that ends exactly at the last bar is left out."""
    lo, hi = lags
    rows = bars.filter(F.col("n_bars") >= hi * 2).withColumn("size", F.explode(F.sequence(F.lit(lo), F.lit(hi - 1))))
    chunk = F.floor(F.col("bar_idx") / F.col("size"))
    rows = rows.select("symbol", "size", chunk.alias("chunk"), F.col("bar_idx").alias("pos"), F.col("close").alias("v"), "n_bars")
    rows = rows.filter(F.col("chunk") * F.col("size") < F.col("n_bars") - F.col("size"))
    return _slope(_rescaled(rows, 2), half_even(F.regr_slope("y", "x"), 4))


def chunk_sizes(limit: int = 1 << 40) -> list[int]:
    """8, 12, 18, 27, ...; some 60 sizes reach beyond any history."""
    out, s = [], 8
    while s <= limit:
        out.append(s)
        s = max(s + 1, int(s * 1.5))
    return out


def hurst_returns(bars: DataFrame, least: int = 50) -> DataFrame:
    """On log returns, sizes 8, 12, 18, 27, ... up to half the history, clamped to 0..1."""
    w = Window.partitionBy("symbol").orderBy("bar_idx")
    prev = F.lag("close").over(w)
    r = bars.filter(F.col("n_bars") >= least).withColumn(
        "v", F.when((prev > 0) & (F.col("close") > 0), F.log(F.col("close") / prev))
    ).filter("v is not null")
    r = r.withColumns({"pos": F.row_number().over(w) - 1, "n": F.count(F.lit(1)).over(Window.partitionBy("symbol"))})
    sizes = F.array(*[F.lit(s) for s in chunk_sizes()])
    r = r.filter(F.col("n") >= least - 1).withColumn("size", F.explode(F.filter(sizes, lambda s: s <= F.floor(F.col("n") / 2))))
    chunk = F.floor(F.col("pos") / F.col("size"))
    r = r.select("symbol", "size", chunk.alias("chunk"), "pos", "v", "n")
    r = r.filter((F.col("chunk") + 1) * F.col("size") <= F.col("n"))
    clamped = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.regr_slope("y", "x")))
    return _slope(_rescaled(r, 1), clamped)
