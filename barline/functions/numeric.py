"""Small numeric column functions shared by the scoring operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F


def lit(v) -> Column:
    return v if isinstance(v, Column) else F.lit(v)


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def half_even(x, digits: int = 0) -> Column:
    """Rounding with ties to the even neighbour."""
    scale = float(10**digits)
    return F.bround(col(x) * scale, 0) / F.lit(scale)


def report(x, digits: int = 4) -> Column:
    """Rounding for output: ties always go up, and values within 1e-6 of a tie count as ties,
    so that the last bit of a sum cannot change the printed figure."""
    scale = float(10**digits)
    return F.floor(col(x) * scale + F.lit(0.500001)).cast("double") / F.lit(scale)


def finite(x) -> Column:
    """NULL for NaN and infinities."""
    x = col(x).cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def safe(x, default: float = 0.0) -> Column:
    return F.coalesce(finite(x), F.lit(float(default)))


def clamp(x, lo: float = 0.0, hi: float = 100.0) -> Column:
    """Bounds a value; NULL and NaN become the lower bound. Infinities are taken out by ``safe``
    where inputs enter, so the value is written once: nested clamps must not multiply an expression."""
    low = F.lit(float(lo))
    return F.greatest(low, F.least(F.lit(float(hi)), F.nanvl(F.coalesce(col(x).cast("double"), low), low)))


def bands(x, steps: list[tuple[str, float, object]], otherwise) -> Column:
    """First matching step wins. A step is (operator, bound, value)."""
    x = col(x)
    test = {
        "<": lambda b: x < b, "<=": lambda b: x <= b, ">": lambda b: x > b, ">=": lambda b: x >= b,
    }
    out = None
    for op, bound, value in steps:
        c = test[op](bound)
        out = F.when(c, lit(value)) if out is None else out.when(c, lit(value))
    return out.otherwise(lit(otherwise))


def all_of(*conds: Column) -> Column:
    return reduce(lambda a, b: a & b, conds)


def flag(c: Column) -> Column:
    """A condition with NULL read as false."""
    return F.coalesce(c, F.lit(False))


def points(c: Column, value: float) -> Column:
    return F.when(c, F.lit(float(value))).otherwise(F.lit(0.0))
