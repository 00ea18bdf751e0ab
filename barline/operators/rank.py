"""Top-k, distinct, sampling and set operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from barline.session import written


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int, place: str = "place") -> DataFrame:
    """First k rows per key. Spark cuts each partition to k rows per key before the shuffle, so a
    hot key never moves whole."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(place, F.row_number().over(w)).filter(F.col(place) <= k)


def first_per(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row per key in the given order, as an aggregation with map-side combine."""
    rest = [c for c in df.columns if c not in keys]
    best = F.min_by(F.struct(*rest), F.struct(*order)).alias("_b")
    return df.groupBy(*keys).agg(best).select(*keys, "_b.*")


def screener(df: DataFrame, column: str, descending: bool = True, ties: str = "symbol") -> DataFrame:
    """All rows sorted by any column, NULLs last."""
    if column not in df.columns:
        raise ValueError(f"unknown column: {column}")
    c = F.col(column)
    return df.orderBy(c.desc_nulls_last() if descending else c.asc_nulls_last(), F.col(ties))


def only_in(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    return left.join(right.select(*keys).distinct(), keys, "left_anti")


def in_both(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    return left.join(right.select(*keys).distinct(), keys, "left_semi")


def evenly_spaced(df: DataFrame, order: str, k: int) -> DataFrame:
    """k rows spread evenly over the sorted rows, first and last included.

    Positions come from ranges of rows and their counts; no task sees all rows.
    """
    ranked = positions(df, order)
    n = F.broadcast(df.agg(F.count(F.lit(1)).alias("_n")))
    want = n.withColumn("_i", F.explode(F.sequence(F.lit(0), F.least(F.lit(k), F.col("_n").cast("int")) - 1)))
    steps = F.greatest(F.least(F.lit(k), F.col("_n").cast("int")) - 1, F.lit(1))
    want = want.select(F.floor((F.col("_n") - 1) * F.col("_i") / steps).alias("pos")).distinct()
    return ranked.join(F.broadcast(want), "pos")


def positions(df: DataFrame, order: str) -> DataFrame:
    """0-based position ``pos`` of each row in the global order of a column.

    Rows are dealt out by ranges of the column, found by sampling, and sorted and numbered in place; the rows of the
    ranges before are added. The numbered rows are written, so that the counts belong to the same ranges; only those
    counts, one for each range, meet in one task. Equal values lie in one range, in any order.
    """
    numbered = df.repartitionByRange(order).sortWithinPartitions(order).withColumn("_id", F.monotonically_increasing_id())
    placed = written(numbered, "positions").withColumns({"_p": F.shiftright("_id", 33), "_r": F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))})
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy("_p").agg(F.count("*").alias("_c")).select("_p", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_off"))
    return placed.join(F.broadcast(offsets), "_p").withColumn("pos", F.col("_r") + F.col("_off")).drop("_p", "_r", "_off", "_id")
