"""Per-symbol bar series: segments, windows and exponential smoothing.

A bar frame has ``symbol, bar_date, bar_idx, n_bars, open, high, low, close, volume``; it is unique
per (symbol, bar_date), so a symbol can hold at most one row per calendar interval. Long
(intraday) histories are further cut into segments of ``SEGMENT`` bars. Every row is copied
into the neighbouring segments that need it as context, so each window expression stays exact
while one symbol spreads over many tasks. Daily histories fit one segment and are not copied.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

SEGMENT = 4096
BLOCK = 2000  # bars; all windows of a series are ordered by (blk, bar_idx), so that those inside a block need no sort of their own
_TAIL = 40.0  # e**-40 is far below the resolution of a double
_RANGE = 600.0  # e**600 is within the range of a double


def memory_of(decay: float) -> int:
    """Bars after which a smoothing with this decay has forgotten its past."""
    return math.ceil(_TAIL / -math.log(decay))


def segmented(bars: DataFrame, lookback: int = 0, lookahead: int = 0, size: int = SEGMENT) -> DataFrame:
    """Adds ``seg``, ``context`` (true for rows copied from a neighbouring segment) and ``blk``, the block of ``BLOCK`` bars."""
    first = F.greatest(F.lit(0), F.floor((F.col("bar_idx") - lookahead) / size))
    last = F.least(F.floor((F.col("bar_idx") + lookback) / size), F.floor((F.col("n_bars") - 1) / size))
    home = F.floor(F.col("bar_idx") / size)
    return (
        bars.withColumn("seg", F.explode(F.sequence(first.cast("int"), last.cast("int"))))
        .withColumns({"context": F.col("seg") != home, "blk": block_of()})
    )


def block_of() -> Column:
    return F.floor(F.col("bar_idx") / BLOCK).cast("int")


def tail(bars: DataFrame, k: int, size: int = SEGMENT) -> DataFrame:
    """The last k bars of each symbol as one segment, for results at the end of the history."""
    return bars.filter(F.col("bar_idx") >= F.col("n_bars") - k).withColumns(
        {"seg": F.floor((F.col("n_bars") - 1) / size), "context": F.lit(False), "blk": block_of()}
    )


def own_rows(df: DataFrame) -> DataFrame:
    """Drops the context copies again."""
    return df.filter(~F.col("context")).drop("seg", "context", "blk")


def by_symbol():
    return Window.partitionBy("symbol", "seg").orderBy("blk", "bar_idx")


def last(n: int):
    """The current bar and the n-1 before it."""
    return by_symbol().rowsBetween(-(n - 1), 0)


def prior(n: int):
    """The n bars before the current one."""
    return by_symbol().rowsBetween(-n, -1)


def back(c: str, k: int = 1) -> Column:
    return F.lag(c, k).over(by_symbol())


def ahead(c: str, k: int = 1) -> Column:
    return F.lead(c, k).over(by_symbol())


def full(value: Column, n: int) -> Column:
    """``value`` once n bars of history exist, else NULL."""
    return F.when(F.col("bar_idx") >= n - 1, value)


class Smooth:
    """One seeded exponential smoothing.

    y = mean of the first n inputs, then decay * y + gain * x. ``start`` is the first bar that
    has an input. With ``total=True`` the seed is the sum of the first n inputs.
    """

    def __init__(self, src: str, out: str, n: int, decay: float, gain: float, start: int = 0, total: bool = False):
        self.src, self.out, self.n = src, out, n
        self.decay, self.gain, self.start, self.total = decay, gain, start, total

    @property
    def first(self) -> int:
        return self.start + self.n - 1


def ema(src: str, out: str, n: int, start: int = 0) -> Smooth:
    k = 2.0 / (n + 1)
    return Smooth(src, out, n, 1 - k, k, start)


def wilder(src: str, out: str, n: int, start: int = 0) -> Smooth:
    return Smooth(src, out, n, (n - 1) / n, 1 / n, start)


def wilder_sum(src: str, out: str, n: int, start: int = 0) -> Smooth:
    return Smooth(src, out, n, (n - 1) / n, 1.0, start, total=True)


def smooth(df: DataFrame, *specs: Smooth) -> DataFrame:
    """Adds each smoothing as a column of a segmented frame, which must hold its memory as context.

    The recursion is a weighted sum, y_t = sum of decay**(t-i) * u_i, so it runs as ordinary window aggregates in linear
    time. Weights are taken relative to the start of a block of bars: y is the sum inside the own block and the decayed
    sums of as many blocks before as the memory reaches into; what is older is below the resolution of a double. So
    weights stay in range however long the history is. Blocks are those of ``blk`` and share its order; only a smoothing
    whose weights would leave the range of a double within one has blocks of its own, which are sorted again.
    """
    seeds, terms, outs, blocks = {}, {}, {}, {}
    for s in specs:
        need = max(memory_of(s.decay), s.n)
        shared = -math.log(s.decay) * BLOCK < _RANGE
        size = BLOCK if shared else need
        blk, q = "blk" if shared else f"_blk_{size}", F.col("bar_idx") % size
        if not shared:
            blocks[blk] = F.floor(F.col("bar_idx") / size).cast("int")
        # read at the first bar alone: a running aggregate of the first inputs, not one over n bars for every bar
        agg = F.sum if s.total else F.avg
        begun = F.col("bar_idx").between(s.start, s.first)
        seeds[f"_seed_{s.out}"] = agg(F.when(begun, F.col(s.src))).over(by_symbol().rowsBetween(Window.unboundedPreceding, 0))
        u = (
            F.when(F.col("bar_idx") > s.first, F.col(s.src) * s.gain)
            .when(F.col("bar_idx") == s.first, F.col(f"_seed_{s.out}"))
            .otherwise(0.0)
        )
        decay = F.lit(s.decay)
        terms[f"_in_{s.out}"] = u * F.pow(decay, -q)
        terms[f"_end_{s.out}"] = u * F.pow(decay, F.lit(size - 1) - q)
        inside = Window.partitionBy("symbol", "seg", blk).orderBy("bar_idx").rowsBetween(Window.unboundedPreceding, 0)
        y = F.sum(f"_in_{s.out}").over(inside) * F.pow(decay, q)
        for k in range(math.ceil(need / size)):
            before = Window.partitionBy("symbol", "seg").orderBy(blk).rangeBetween(-k - 1, -k - 1)
            y = y + F.coalesce(F.sum(f"_end_{s.out}").over(before), F.lit(0.0)) * F.pow(decay, q + 1 + k * size)
        outs[s.out] = F.when(F.col("bar_idx") >= s.first, y)
    return df.withColumns(seeds | blocks).withColumns(terms).withColumns(outs).drop(*seeds, *terms, *blocks)
