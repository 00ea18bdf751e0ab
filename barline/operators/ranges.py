"""Range minima and maxima over later bars, and first touches, without a row for each later bar.

The bars of a symbol are cut into blocks that also hold the bars a question may reach. A block is one row with a sparse
table: for each k the least low and the greatest high of every 2**k bars in a row. A range takes two lookups; the first
bar that touches a level is found by binary descent, one lookup for each power of two.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from barline.operators.automaton import let
from barline.series import SEGMENT, segmented


def blocks(bars: DataFrame, horizon: int, columns: list[str] | None = None, size: int = SEGMENT) -> DataFrame:
    """``symbol, seg, first, last, lows, highs`` and an array for each of ``columns``.

    ``first`` and ``last`` are the positions of the block's bars, those up to ``horizon`` after its own among them.
    ``lows[k][j]`` is the least low of the 2**k bars from the block's j-th on, ``highs`` likewise.
    """
    columns = columns or []
    d = segmented(bars.select("symbol", "bar_idx", "n_bars", "low", "high", *columns), 0, horizon, size)
    rows = F.array_sort(F.collect_list(F.struct("bar_idx", "low", "high", *columns)))
    d = d.groupBy("symbol", "seg").agg(rows.alias("b"), F.min("bar_idx").alias("first"), F.max("bar_idx").alias("last"))
    d = d.withColumns({c: F.col(f"b.{c}") for c in ("low", "high", *columns)}).drop("b")
    levels = max(horizon, 1).bit_length()

    def table(c: str, best) -> Column:
        def doubled(t: Column, k: Column) -> Column:
            step = F.call_function("shiftleft", F.lit(1), k)
            row = F.element_at(t, -1)
            longer = F.transform(row, lambda x, j: best(x, F.get(row, j + step)))  # past the end: what there is
            return F.concat(t, F.array(longer))

        return F.aggregate(F.array(*[F.lit(k) for k in range(levels - 1)]) if levels > 1 else F.expr("cast(array() as array<int>)"), F.array(F.col(c)), doubled)

    d = d.withColumns({"lows": table("low", F.least), "highs": table("high", F.greatest)})
    return d.drop("low", "high")


def extreme(table: Column, a: Column, b: Column, best) -> Column:
    """Least or greatest of the block's bars a..b (positions in the block)."""
    k = F.floor(F.log2((b - a + 1).cast("double"))).cast("int")
    row = F.get(table, k)
    return F.when(b >= a, best(F.get(row, a), F.get(row, b - F.call_function("shiftleft", F.lit(1), k) + 1)))


def first_touch(table: Column, a: Column, b: Column, touches, horizon: int) -> Column:
    """The first of the block's bars a..b whose value ``touches``; NULL if none does.

    A range touches if its extreme does. ``horizon`` is the most bars that a..b may hold.
    """
    levels = range(max(horizon, 1).bit_length() - 1, -1, -1)

    def passed(at: Column, k: Column) -> Column:
        width = F.call_function("shiftleft", F.lit(1), k)
        return F.when((at + width - 1 <= b) & ~touches(F.get(F.get(table, k), at)), at + width).otherwise(at)

    return let(F.aggregate(F.array(*map(F.lit, levels)), a, passed), lambda at: F.when((at <= b) & touches(F.get(F.get(table, F.lit(0)), at)), at))


def asked(table: DataFrame, questions: DataFrame, size: int = SEGMENT) -> DataFrame:
    """The blocks with ``ask``, an array of the rows of ``questions`` (with ``symbol, bar_idx``) about their own bars."""
    rest = [c for c in questions.columns if c != "symbol"]
    q = questions.groupBy("symbol", F.floor(F.col("bar_idx") / size).cast("int").alias("seg")).agg(F.collect_list(F.struct(*rest)).alias("ask"))
    return table.join(q, ["symbol", "seg"])
