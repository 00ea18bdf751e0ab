"""Exact quantiles of groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

_ACCURACY = 10000
_MARGIN = 2.5 / _ACCURACY


def exact_quantiles(df: DataFrame, keys: list[str], values: dict[str, Column], probs: list[float]) -> DataFrame:
    """Linear-interpolated quantiles per key, one row per key with columns ``<value>_<per cent>``.

    Edges from a mergeable sketch cut each group into slots, narrow ones around each quantile. The slots' exact counts
    say which slot holds which rank, whatever the sketch's error; only the different values of these slots are ranked,
    about 0.05 % of a large group for each quantile. No task sees a whole group. NULLs are left out.
    """
    g = [*keys, "_m"]
    items = F.array(*[F.struct(F.lit(n).alias("_m"), v.cast("double").alias("_v")) for n, v in values.items()])
    long = df.select(*keys, F.explode(items).alias("_s")).select(*keys, "_s.*").filter("_v is not null")
    at = sorted({min(max(p + d, 0.0), 1.0) for p in probs for d in (-_MARGIN, _MARGIN)})
    edges = long.groupBy(*g).agg(F.percentile_approx("_v", at, _ACCURACY).alias("_e"))
    same = [F.col(f"l.{c}").eqNullSafe(F.col(f"e.{c}")) for c in g]
    # a value's slot: how many edges are below it
    slotted = long.alias("l").join(edges.alias("e"), same).select(*[F.col(f"l.{c}") for c in g], "_v", F.size(F.filter("_e", lambda e: e < F.col("_v"))).alias("_slot"))
    counts = slotted.groupBy(*g, "_slot").agg(F.count(F.lit(1)).alias("_c"))
    run = Window.partitionBy(*g).orderBy("_slot")
    held = counts.withColumns({"_to": F.sum("_c").over(run.rowsBetween(Window.unboundedPreceding, 0)), "_n": F.sum("_c").over(Window.partitionBy(*g))})
    pos = {p: (F.col("_n") - 1) * F.lit(p) for p in probs}
    ranks = F.array(*[F.struct(F.lit(name(p)).alias("_p"), end(x).cast("long").alias("_rank"), (x - F.floor(x)).alias("_f")) for p, x in pos.items() for end in (F.floor, F.ceil)])
    inside = F.filter(ranks, lambda r: (F.col("_to") - F.col("_c") <= r["_rank"]) & (r["_rank"] < F.col("_to")))
    wanted = held.select(*g, "_slot", (F.col("_to") - F.col("_c")).alias("_before"), inside.alias("_ranks")).filter(F.size("_ranks") > 0)
    met = [F.col(f"s.{c}").eqNullSafe(F.col(f"w.{c}")) for c in [*g, "_slot"]]
    near = slotted.alias("s").join(wanted.alias("w"), met).groupBy(*[F.col(f"s.{c}") for c in [*g, "_slot"]], "_v").agg(F.count(F.lit(1)).alias("_c"), F.first("_before").alias("_before"), F.first("_ranks").alias("_ranks"))
    run = Window.partitionBy(*g, "_slot").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = near.withColumn("_to", F.col("_before") + F.sum("_c").over(run))
    hit = F.filter("_ranks", lambda r: (F.col("_to") - F.col("_c") <= r["_rank"]) & (r["_rank"] < F.col("_to")))
    found = ranked.select(*g, "_v", F.explode(hit).alias("_r")).select(*g, "_v", "_r._p", "_r._f")

    def quantile(v: str, p: float) -> Column:  # the values of the two ranks beside it, often one and the same
        of = lambda c: F.when((F.col("_m") == v) & (F.col("_p") == name(p)), F.col(c))
        low, high = F.min(of("_v")), F.max(of("_v"))
        return (low + (high - low) * F.max(of("_f"))).alias(f"{v}_{name(p)}")

    return found.groupBy(*keys).agg(*[quantile(v, p) for v in values for p in probs])


def name(p: float) -> str:
    return f"{p * 100:g}".replace(".", "_")
