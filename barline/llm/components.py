"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barline.llm.store import saved


def _star(both: DataFrame) -> DataFrame:
    """Every (u, v) with m: the smallest of u and all its v."""
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label): the smallest node that each node of ``edges`` reaches.

    Edges go either way; loops and repeated edges do no harm, a null end drops its edge, no edges give no rows. Each
    round is a grouping and a join of the edges, and is written to the shared folder; the number of rounds grows with
    the logarithm of a component's size. Nothing is gathered but one row of checks.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where((F.col(a) != F.col(b)) & F.col(a).isNotNull() & F.col(b).isNotNull()).distinct()
    e, before = saved(e, "edges"), None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _star(both).where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = _star(large)
        e = saved(small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v"))).where(F.col("u") != F.col("v")).distinct(), "edges")
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    nodes = e.select(F.col("u").alias("node"), F.col("v").alias("label"))
    return nodes.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
