"""Ordered state machines over long series, in bounded blocks.

A rule whose next state depends on the last one has no window form. The rows of a series are cut into blocks that are
folded side by side, each from a guess of the state it is entered with. A guess matters only until the run from it meets
the true one, and most blocks are left in the same state either way. Blocks that were entered with another state than
the one their predecessor was left in are folded again from that, in rounds, until all agree: the states are then those
of one pass over the whole series. Folds run in the JVM; no task holds more than one block.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from barline.series import SEGMENT
from barline.session import written

Step = Callable[[Column, Column], Column]


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _states(entry: Column, start: Callable[[Column], Column], step: Step, kind: str) -> Column:
    """The state after each of ``xs``; without an entry state the first row starts anew."""

    def grown(done: Column, x: Column) -> Column:
        before = F.coalesce(F.try_element_at(done, F.lit(-1)), entry)
        return F.concat(done, F.array(let(before, lambda s: F.when(s.isNull(), start(x)).otherwise(step(s, x)))))

    return F.aggregate("xs", F.expr(f"cast(array() as array<{kind}>)"), grown)


def scanned(rows: DataFrame, place: str, inputs: list[str], start: Callable[[Column], Column], step: Step, kind: str, key: str = "symbol", size: int = SEGMENT, order: list[str] | None = None) -> DataFrame:
    """``key``, ``place``, ``inputs`` and ``state``: what the machine is in after each row.

    ``place`` is a row's position in its series, blocks are ``size`` positions long; ``order`` sorts rows of one position.
    ``start(x)`` is the state after the first row, and the guess for a block's first; ``step(state, x)`` the one after a
    later row; ``kind`` the state's type. Rounds write tables under the shared folder.
    """
    first = [place, *[c for c in order or [] if c != place]]
    fields = first + [c for c in inputs if c not in first]
    blocks = rows.groupBy(key, F.floor(F.col(place) / size).alias("blk")).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("xs"))
    nothing = F.lit(None).cast(kind)
    done = blocks.withColumns({"used": nothing, "states": _states(nothing, start, step, kind)}).withColumn("left", F.element_at("states", -1))
    done = written(done, "scan")
    while True:
        seq = Window.partitionBy(key).orderBy("blk")
        ends = done.select(key, "blk", "used", F.lag("left").over(seq).alias("entry")).where(~F.col("entry").eqNullSafe(F.col("used"))).drop("used")
        if ends.isEmpty():
            break
        again = done.join(ends, [key, "blk"], "left")
        stale = F.col("entry").isNotNull()
        again = again.withColumn("states", F.when(stale, _states(F.col("entry"), start, step, kind)).otherwise(F.col("states")))
        done = written(again.select(key, "blk", "xs", F.coalesce("entry", "used").alias("used"), "states", F.element_at("states", -1).alias("left")), "scan")
    each = done.select(key, F.explode(F.arrays_zip("xs", "states")).alias("e"))
    return each.select(key, *[F.col(f"e.xs.{c}").alias(c) for c in fields], F.col("e.states").alias("state"))
