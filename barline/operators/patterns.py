"""Chart patterns over confirmed pivots: reversals, triangles and wedges, continuations."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from barline.functions.numeric import finite, half_even, lit
from barline.operators import indicators as ind
from barline.operators.automaton import scanned
from barline.series import SEGMENT, by_symbol, own_rows, segmented

FIXED_TOLERANCE, MIN_TOLERANCE, MAX_TOLERANCE = 0.015, 0.008, 0.045
TOLERANCE_MODES = ("fixed", "atr", "hybrid")
RECENT = 14

# Timeframe parameters.
_FIELDS = ("min_bars", "max_bars", "pivot_window", "min_gap", "confirm_bars", "volume_period", "atr_period", "valid_bars", "dedupe_window", "target_horizon", "atr_multiplier", "breakout_atr")
TIMEFRAMES = {
    "5M": (12, 180, 3, 2, 3, 36, 21, 36, 8, 72, 0.65, 0.25),
    "15M": (10, 160, 3, 2, 2, 32, 18, 30, 7, 60, 0.70, 0.22),
    "30M": (10, 140, 3, 2, 2, 26, 16, 26, 6, 48, 0.75, 0.20),
    "1H": (10, 120, 3, 2, 2, 20, 14, 24, 6, 40, 0.80, 0.18),
    "1D": (12, 150, 4, 3, 1, 20, 14, 30, 8, 60, 0.85, 0.15),
    "1W": (8, 104, 2, 2, 1, 13, 14, 12, 4, 26, 1.00, 0.12),
}
PERIODS = {"1d": "5M", "3d": "15M", "1wk": "30M", "2wk": "1H", "1mo": "1H", "6mo": "1D", "1y": "1D", "2y": "1D", "5y": "1D"}
STATUS_RANK = {"confirmed": 4, "awaiting_breakout": 3, "forming": 2, "invalidated": 1, "expired": 0}


def resolve_timeframe(name: str | None) -> str:
    key = (name or "1D").strip()
    if key.upper() in TIMEFRAMES:
        return key.upper()
    if key.lower() in PERIODS:
        return PERIODS[key.lower()]
    raise ValueError(f"unknown period or timeframe: {name}")


@dataclass(frozen=True)
class Options:
    timeframe: str = "1D"
    tolerance_mode: str = "hybrid"
    fixed_tolerance: float = FIXED_TOLERANCE
    min_tolerance: float = MIN_TOLERANCE
    max_tolerance: float = MAX_TOLERANCE
    include_forming: bool = True

    def __post_init__(self):
        if self.timeframe not in TIMEFRAMES:
            raise ValueError(f"unknown timeframe: {self.timeframe}")
        if self.tolerance_mode not in TOLERANCE_MODES:
            raise ValueError(f"unknown tolerance mode: {self.tolerance_mode}")
        if not 0 < self.min_tolerance <= self.max_tolerance:
            raise ValueError("tolerance bounds must satisfy 0 < min <= max")

    def __getattr__(self, field):
        if field in _FIELDS:
            return TIMEFRAMES[self.timeframe][_FIELDS.index(field)]
        raise AttributeError(field)


def timeframe_table(spark) -> DataFrame:
    return spark.createDataFrame([(k, *map(float, v)) for k, v in TIMEFRAMES.items()], ["timeframe", *_FIELDS])


# -- geometry ---------------------------------------------------------------------------------

def tolerance(a: Column, b: Column, atr: Column, o: Options) -> tuple[Column, Column, Column]:
    """Whether two prices are alike, their relative difference, and the tolerance that applied."""
    ref = (F.abs(a) + F.abs(b)) / 2
    diff = F.abs(a - b) / ref
    by_atr = F.abs(F.coalesce(atr, F.lit(0.0))) * o.atr_multiplier / ref
    if o.tolerance_mode == "fixed":
        tol = F.lit(o.fixed_tolerance)
    elif o.tolerance_mode == "atr":
        tol = by_atr
    else:
        tol = F.least(F.greatest(F.lit(o.fixed_tolerance), by_atr, F.lit(o.min_tolerance)), F.lit(o.max_tolerance))
    usable = finite(ref).isNotNull() & (ref > 0)
    return F.coalesce(usable & (diff <= tol + 1e-12), F.lit(False)), F.when(usable, half_even(diff, 8)), F.when(usable, half_even(tol, 8))


def tolerance_struct(a: Column, b: Column, atr: Column, o: Options) -> Column:
    ok, diff, tol = tolerance(a, b, atr, o)
    return F.struct(ok.alias("ok"), diff.alias("diff"), tol.alias("tol"))


def line_at(x1, y1, x2, y2, x) -> Column:
    """Price of the line through two points; their mean where both share one position."""
    x1, y1, x2, y2, x = map(lit, (x1, y1, x2, y2, x))
    return F.when(x1 == x2, (y1 + y2) / 2).otherwise(y1 + (y2 - y1) / F.nullif(x2 - x1, F.lit(0)) * (x - x1))


def completion(pivots, geometry, timing, volume_ratio, distance) -> Column:
    unit = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), lit(c)))
    volume = F.coalesce(unit(volume_ratio / 1.5), F.lit(0.5)) if isinstance(volume_ratio, Column) else F.lit(0.5)
    volume = F.when(volume_ratio.isNull(), 0.5).otherwise(unit(volume_ratio / 1.5)) if isinstance(volume_ratio, Column) else volume
    ready = unit(1.0 - F.abs(lit(distance)))
    return half_even(100.0 * (0.30 * unit(pivots) + 0.30 * unit(geometry) + 0.15 * unit(timing) + 0.10 * volume + 0.15 * ready), 1)


def overlap(a0, a1, b0, b1) -> Column:
    """Shared share of two index intervals."""
    inter = F.greatest(F.lit(0), F.least(a1, b1) - F.greatest(a0, b0) + 1)
    union = F.greatest(a1, b1) - F.least(a0, b0) + 1
    return F.when(union > 0, inter / union).otherwise(0.0)


# -- pivots -----------------------------------------------------------------------------------

def pattern_bars(bars: DataFrame, o: Options) -> DataFrame:
    """Bars with the ATR and volume ratio the detectors use, and the raw pivot marks."""
    w = o.pivot_window
    d = segmented(bars, max(o.atr_period, o.volume_period) + 1, w)
    d = ind.with_atr_simple(d, o.atr_period, "atr")
    frame = by_symbol().rowsBetween(-w, w)
    inner = (F.col("bar_idx") >= w) & (F.col("bar_idx") < F.col("n_bars") - w)
    d = d.withColumns({
        "vr": ind.volume_ratio_positive(o.volume_period),
        "is_high": F.coalesce(inner & (finite("high") >= F.max(finite("high")).over(frame)), F.lit(False)),
        "is_low": F.coalesce(inner & (finite("low") <= F.min(finite("low")).over(frame)), F.lit(False)),
    })
    return own_rows(d)


def raw_pivots(pb: DataFrame) -> DataFrame:
    """One row per raw pivot (side 0 low, 1 high); plateaus give several."""
    p = lambda side, price: F.struct(F.col("bar_idx").alias("idx"), F.lit(side).alias("side"), F.col(price).alias("price"), F.col("atr"))
    both = F.filter(F.array(F.when(F.col("is_low"), p(0, "low")), F.when(F.col("is_high"), p(1, "high"))), lambda x: x.isNotNull())
    return pb.filter("is_high or is_low").select("symbol", "n_bars", F.explode(both).alias("p"))


_PIVOT = "struct<idx:int,side:int,price:double,atr:double>"


def recent_pivots(pb: DataFrame, o: Options, keep: int = RECENT) -> DataFrame:
    """Per symbol the last ``keep`` alternating pivots as array ``pv``.

    Of neighbours of one kind the more extreme stays; an opposite pivot too close to the last
    one is dropped. The rule depends on order, so it is a fold; it carries at most ``keep`` pivots.
    """
    raw = raw_pivots(pb).groupBy("symbol").agg(F.array_sort(F.collect_list("p")).alias("raw"), F.max("n_bars").alias("n_bars"))

    def step(acc, x):
        prev = F.try_element_at(acc, F.lit(-1))
        better = F.when(x["side"] == 1, x["price"] > prev["price"]).otherwise(x["price"] < prev["price"])
        swapped = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(x))
        grown = F.concat(F.when(F.size(acc) >= keep, F.slice(acc, 2, keep - 1)).otherwise(acc), F.array(x))
        return (
            F.when(F.size(acc) == 0, F.array(x)).when(prev["side"] == x["side"], F.when(better, swapped).otherwise(acc))
            .when(x["idx"] - prev["idx"] < o.min_gap, acc).otherwise(grown)
        )

    return raw.select("symbol", "n_bars", F.aggregate("raw", F.expr(f"cast(array() as array<{_PIVOT}>)"), step).alias("pv"))


def confirmed_pivots(bars: DataFrame, o: Options = Options(), size: int = SEGMENT) -> DataFrame:
    """All alternating pivots, each known ``pivot_window`` bars later.

    The same rule as ``recent_pivots``. The state is the pivot kept last; it is final where the next one kept is of the
    other kind.
    """
    raw = raw_pivots(pattern_bars(bars, o)).select("symbol", "p.idx", "p.side", "p.price")
    pivot = lambda x: F.struct(*[x[c].alias(c) for c in ("idx", "side", "price")])

    def step(s, x):
        better = F.when(x["side"] == 1, x["price"] > s["price"]).otherwise(x["price"] < s["price"])
        return F.when(F.when(s["side"] == x["side"], better).otherwise(x["idx"] - s["idx"] >= o.min_gap), pivot(x)).otherwise(s)

    d = scanned(raw, "idx", ["side", "price"], pivot, step, "struct<idx:int,side:int,price:double>", size=size, order=["side"])
    after = F.lead("state.side").over(Window.partitionBy("symbol").orderBy("idx", "side"))
    d = d.withColumn("after", after).where(F.col("after").isNull() | (F.col("after") != F.col("state.side")))
    return d.select("symbol", "state.*").withColumn("confirmed_idx", F.col("idx") + o.pivot_window)


# -- candidates -------------------------------------------------------------------------------

def _points(*ps: Column) -> Column:
    return F.array(*[F.struct(p["idx"].alias("idx"), p["price"].alias("price"), p["side"].alias("side")) for p in ps])


def _candidate(cond: Column, **f) -> Column:
    spec = {
        "pattern": "string", "family": "string", "direction": "string", "ord": "int", "points": None, "x1": "int", "y1": "double", "x2": "int", "y2": "double",
        "after": "int", "atr_v": "double", "geometry": "double", "timing": "double", "invalidation": "double", "floor": "double", "height": "double",
        "at_now": "boolean", "band": "double", "early": "double", "fixed_score": "double", "next_side": "int",
    }
    vals = []
    for k, t in spec.items():
        v = lit(f.get(k))
        vals.append((v if t is None else v.cast(t)).alias(k))
    return F.when(cond, F.struct(*vals))


def reversal_candidates(pivots: DataFrame, o: Options) -> DataFrame:
    """Head-and-shoulders (complete and forming), double and triple reversals from the recent pivots."""
    d = pivots.select("symbol", "n_bars", "pv", F.posexplode("pv").alias("i", "p0"))
    d = d.withColumns({f"p{k}": F.get("pv", F.col("i") + k) for k in range(1, 5)})
    p = [F.col(f"p{k}") for k in range(5)]
    for name, a, b in (("s", 0, 4), ("n", 1, 3), ("e", 0, 2)):
        # The third comparison of a triple equals the shoulder comparison ("s").
        d = d.withColumn("_t", tolerance_struct(p[a]["price"], p[b]["price"], p[b]["atr"], o)).withColumnRenamed("_t", f"t_{name}")
    d = d.withColumns({"bull": F.col("p0.side") == 0, **{f"span{k}": p[k]["idx"] - p[0]["idx"] for k in (2, 3, 4)}, **{f"at{k}": F.greatest(p[k]["atr"], F.lit(1e-12)) for k in (2, 3, 4)}})
    d = d.withColumns({"head": F.when(F.col("bull"), F.col("p2.price") < F.col("p0.price")).otherwise(F.col("p2.price") > F.col("p0.price")), "left": F.greatest(F.lit(1), p[2]["idx"] - p[0]["idx"]), "right": F.greatest(F.lit(1), p[4]["idx"] - p[2]["idx"])})
    bull = F.col("bull")
    direction = F.when(bull, "bullish").otherwise("bearish")
    pick = lambda a, b: F.when(bull, a).otherwise(b)
    span = lambda k: F.col(f"span{k}").between(o.min_bars, o.max_bars)
    at = lambda k: F.col(f"at{k}")
    head = F.col("head")
    off = lambda price, atr: pick(price - atr * 0.25, price + atr * 0.25)

    ok_s, diff_s, tol_s = (F.col(f"t_s.{c}") for c in ("ok", "diff", "tol"))
    diff_n, tol_n = F.col("t_n.diff"), F.col("t_n.tol")
    depth = pick(F.least(p[0]["price"], p[4]["price"]) - p[2]["price"], p[2]["price"] - F.greatest(p[0]["price"], p[4]["price"]))
    fit = lambda diff, tol: F.greatest(F.lit(0.0), 1.0 - diff / F.greatest(tol, F.lit(1e-12)))
    left, right = F.col("left"), F.col("right")
    neck_at_head = line_at(p[1]["idx"], p[1]["price"], p[3]["idx"], p[3]["price"], p[2]["idx"])
    hs = dict(pattern=pick(F.lit("inverse_head_shoulders"), F.lit("head_shoulders_top")), family="head_shoulders", direction=direction)
    line13 = dict(x1=p[1]["idx"], y1=p[1]["price"], x2=p[3]["idx"], y2=p[3]["price"])
    found = [_candidate(
        p[4].isNotNull() & head & span(4) & ok_s & (depth >= at(4) * 0.55), **hs, **line13, ord=pick(0, 100) + F.col("i"), points=_points(*p), after=p[4]["idx"], atr_v=at(4),
        geometry=0.7 * fit(diff_s, tol_s) + 0.3 * fit(diff_n, tol_n), timing=F.least(left, right) / F.greatest(left, right), invalidation=off(p[4]["price"], at(4)),
        floor=85.0, height=F.abs(neck_at_head - p[2]["price"]), at_now=False, band=0.25, early=0.65,
    )]
    if o.include_forming:
        for size, base in ((4, 20), (3, 40)):
            found.append(_candidate(
                p[size - 1].isNotNull() & head & span(size - 1), **hs, ord=pick(base, 100 + base) + F.col("i"), points=_points(*p[:size]), after=p[size - 1]["idx"],
                atr_v=p[size - 1]["atr"], invalidation=p[2]["price"], fixed_score=completion(size / 5.0, 0.65, 0.65, None, 1.0),
                next_side=p[0]["side"] if size == 4 else 1 - p[0]["side"],
            ))
    ok2, diff2, tol2 = (F.col(f"t_e.{c}") for c in ("ok", "diff", "tol"))
    ok4, diff4, tol4 = ok_s, diff_s, tol_s
    ratio = lambda diff, tol: diff / F.greatest(tol, F.lit(1e-12))
    avg2, avg3 = (p[0]["price"] + p[2]["price"]) / 2, (p[0]["price"] + p[2]["price"] + p[4]["price"]) / 3
    now = F.col("n_bars") - 1
    found.append(_candidate(
        p[2].isNotNull() & span(2) & ok2, pattern=pick(F.lit("double_bottom"), F.lit("double_top")), family="double_reversal", direction=direction, ord=pick(200, 300) + F.col("i"),
        points=_points(*p[:3]), x1=p[1]["idx"], y1=p[1]["price"], x2=p[2]["idx"], y2=p[1]["price"], after=p[2]["idx"], atr_v=at(2), geometry=1.0 - ratio(diff2, tol2), timing=1.0,
        invalidation=off(avg2, at(2)), floor=84.0, height=F.abs(p[1]["price"] - avg2), at_now=False, band=0.25, early=0.65,
    ))
    found.append(_candidate(
        p[4].isNotNull() & span(4) & ok2 & ok4, pattern=pick(F.lit("triple_bottom"), F.lit("triple_top")), family="triple_reversal", direction=direction, ord=pick(400, 500) + F.col("i"),
        points=_points(*p), **line13, after=p[4]["idx"], atr_v=at(4), geometry=1.0 - (ratio(diff2, tol2) + ratio(diff4, tol4)) / 2, timing=F.least(left, right) / F.greatest(left, right),
        invalidation=off(avg3, at(4)), floor=84.0, height=F.abs(line_at(p[1]["idx"], p[1]["price"], p[3]["idx"], p[3]["price"], now) - avg3), at_now=False, band=0.25, early=0.65,
    ))
    each = F.filter(F.array(*found), lambda x: x.isNotNull())
    return d.select("symbol", "n_bars", F.explode(each).alias("c")).select("symbol", "n_bars", "c.*")


def _ols(ps: Column) -> tuple[Column, Column]:
    """Slope and intercept of price on index for an array of three pivots."""
    n = 3.0
    total = lambda f: F.aggregate(ps, F.lit(0.0), lambda a, x: a + f(x))
    mx, my = total(lambda x: x["idx"].cast("double")) / n, total(lambda x: x["price"]) / n
    sxy = F.aggregate(ps, F.lit(0.0), lambda a, x: a + (x["idx"] - mx) * (x["price"] - my))
    sxx = F.aggregate(ps, F.lit(0.0), lambda a, x: a + (x["idx"] - mx) * (x["idx"] - mx))
    slope = sxy / F.nullif(sxx, F.lit(0.0))
    return slope, my - slope * mx


def triangle_candidates(pivots: DataFrame, ends: DataFrame, o: Options) -> DataFrame:
    """Triangles and wedges from the last three highs and lows. A symmetrical triangle gives an
    upward and a downward candidate and a neutral one; ``settle`` keeps the right one."""
    last10 = F.when(F.size("pv") > 10, F.slice("pv", -10, 10)).otherwise(F.col("pv"))
    side = lambda s: F.filter(last10, lambda x: x["side"] == s)
    d = pivots.join(ends, "symbol").withColumns({"hi_all": side(1), "lo_all": side(0)}).filter((F.size("hi_all") >= 3) & (F.size("lo_all") >= 3))
    d = d.withColumns({"hi": F.slice("hi_all", -3, 3), "lo": F.slice("lo_all", -3, 3)})
    hs, hb = _ols(F.col("hi"))
    ls, lb = _ols(F.col("lo"))
    now = F.col("n_bars") - 1
    d = d.withColumns({"hs": hs, "ls": ls, "upper": hb + hs * now, "lower": lb + ls * now, "flat": F.greatest(F.abs("close"), F.lit(1e-12)) * 0.0005,
                       "first": F.least(F.get("hi", F.lit(0))["idx"], F.get("lo", F.lit(0))["idx"]), "end": F.greatest(F.get("hi", F.lit(2))["idx"], F.get("lo", F.lit(2))["idx"])})
    d = d.filter((F.col("end") - F.col("first")).between(o.min_bars, o.max_bars))
    h, lw, f = F.col("hs"), F.col("ls"), F.col("flat")
    kind = (
        F.when((h < -f) & (lw > f), "symmetrical_triangle").when((F.abs(h) <= f) & (lw > f), "ascending_triangle")
        .when((h < -f) & (F.abs(lw) <= f), "descending_triangle").when((h < -f) & (lw < -f) & (lw > h), "falling_wedge").when((h > f) & (lw > f) & (h > lw), "rising_wedge")
    )
    a = F.greatest(F.col("atr_last"), F.lit(1e-12))
    d = d.withColumn("kind", kind).filter("kind is not null").withColumn("width", F.greatest(F.col("upper") - F.col("lower"), a * 0.5))
    hi0, hi2, lo0, lo2 = F.get("hi", F.lit(0)), F.get("hi", F.lit(2)), F.get("lo", F.lit(0)), F.get("lo", F.lit(2))
    conv = F.least(F.lit(1.0), F.greatest(F.lit(0.0), 1.0 - F.col("width") / F.greatest(F.abs(hi0["price"] - lo0["price"]), a)))
    joined = F.array_sort(F.transform(F.concat("hi", "lo"), lambda x: F.struct(x["idx"].alias("idx"), x["side"].alias("side"), x["price"].alias("price"))),
                          lambda x, y: F.when(x["idx"] != y["idx"], (x["idx"] - y["idx"]).cast("int")).otherwise((y["side"] - x["side"]).cast("int")))
    pts = F.transform(F.slice(joined, -5, 5), lambda x: F.struct(x["idx"].alias("idx"), x["price"].alias("price"), x["side"].alias("side")))
    both = dict(pattern=F.col("kind"), family="triangle_wedge", points=pts, after=F.col("end"), atr_v=a, geometry=0.7 + conv * 0.3, timing=0.75, floor=82.0, height=F.col("width"), at_now=True, band=0.25, early=0.60)
    upline = dict(x1=hi0["idx"], y1=hi0["price"], x2=hi2["idx"], y2=hi2["price"])
    downline = dict(x1=lo0["idx"], y1=lo0["price"], x2=lo2["idx"], y2=lo2["price"])
    k = F.col("kind")
    nearest = F.least(F.abs(F.col("upper") - F.col("close")), F.abs(F.col("close") - F.col("lower"))) / a
    each = F.array(
        _candidate(k.isin("symmetrical_triangle", "ascending_triangle", "falling_wedge"), **both, **upline, direction="bullish", ord=600, invalidation=F.col("lower") - a * 0.25),
        _candidate(k.isin("symmetrical_triangle", "descending_triangle", "rising_wedge"), **both, **downline, direction="bearish", ord=601, invalidation=F.col("upper") + a * 0.25),
        _candidate(k == "symmetrical_triangle", **{**both, "height": None}, **upline, direction="neutral", ord=602, fixed_score=completion(1.0, 0.7 + conv * 0.3, 0.75, None, nearest)),
    )
    return d.select("symbol", "n_bars", F.explode(F.filter(each, lambda x: x.isNotNull())).alias("c")).select("symbol", "n_bars", "c.*")


def consolidation_candidates(pb: DataFrame, o: Options) -> DataFrame:
    """A strong move followed by a tight range at the end of the history (flag, pennant, rectangle)."""
    k = max(8, o.min_bars // 2)
    back = F.col("n_bars") - F.col("bar_idx")  # 1 for the last bar
    last = pb.filter((back <= 2 * k) & (F.col("n_bars") >= 2 * k + 2)).withColumns({"back": back, "x": (F.lit(k) - back).cast("double")})
    body = (F.col("back") <= k) & (F.col("back") >= 2)
    only = lambda cond, c: F.max(F.when(cond, F.col(c)))
    b = lambda c: F.when(body, F.col(c))
    g = last.groupBy("symbol", "n_bars").agg(
        *[only(F.col("back") == at, c).alias(f"{c}_{n}") for n, at in (("start", 2 * k), ("stop", k + 1), ("last", 1)) for c in ("close", "high", "low", "atr")],
        F.max(b("high")).alias("rhi"), F.min(b("low")).alias("rlo"), F.regr_slope(b("high"), F.col("x")).alias("sh"), F.regr_slope(b("low"), F.col("x")).alias("sl"),
        F.min(F.when(body, F.struct((-F.col("high")).alias("v"), "bar_idx"))).alias("top"), F.min(F.when(body, F.struct(F.col("low").alias("v"), "bar_idx"))).alias("bottom"),
    )
    a = F.greatest(F.col("atr_last"), F.abs("close_last") * 0.002, F.lit(1e-12))
    g = g.withColumns({"a": a, "move": F.col("close_stop") - F.col("close_start")}).withColumn("need", F.greatest(F.col("a") * 2.0, F.abs("close_start") * 0.03))
    g = g.filter(F.col("rhi") - F.col("rlo") <= F.col("a") * 4.0)
    lim = F.col("a") * 0.30
    n = F.col("n_bars")
    pt = lambda idx, price, side: F.struct(lit(idx).cast("int").alias("idx"), lit(price).alias("price"), F.lit(side).alias("side"))
    common = dict(family="continuation_consolidation", atr_v=F.col("a"), x1=n - k, x2=n - 2, after=n - o.confirm_bars - 1, timing=0.8, floor=82.0, height=F.abs("move"), at_now=False, band=0.35, early=0.60,
                  geometry=F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1.0 - (F.col("rhi") - F.col("rlo")) / F.greatest(F.col("a") * 4.0, F.lit(1e-12)))))
    up = _candidate(
        (F.col("move") >= F.col("need")) & (F.col("sh") <= lim) & (F.col("sl") <= lim), **common, pattern="bullish_consolidation", direction="bullish", ord=700, y1=F.col("rhi"), y2=F.col("rhi"),
        invalidation=F.col("rlo") - F.col("a") * 0.25,
        points=F.array(pt(n - 2 * k, F.col("low_start"), 0), pt(n - k - 1, F.col("high_stop"), 1), pt(F.col("bottom.bar_idx"), F.col("bottom.v"), 0), pt(n - 1, F.col("close_last"), 1)))
    down = _candidate(
        (F.col("move") <= -F.col("need")) & (F.col("sh") >= -lim) & (F.col("sl") >= -lim), **common, pattern="bearish_consolidation", direction="bearish", ord=800, y1=F.col("rlo"), y2=F.col("rlo"),
        invalidation=F.col("rhi") + F.col("a") * 0.25,
        points=F.array(pt(n - 2 * k, F.col("high_start"), 1), pt(n - k - 1, F.col("low_stop"), 0), pt(F.col("top.bar_idx"), -F.col("top.v"), 1), pt(n - 1, F.col("close_last"), 0)))
    each = F.filter(F.array(up, down), lambda x: x.isNotNull())
    return g.select("symbol", "n_bars", F.explode(each).alias("c")).select("symbol", "n_bars", "c.*")


# -- confirmation, lifecycle, score -----------------------------------------------------------

def settle(cands: DataFrame, pb: DataFrame, o: Options) -> DataFrame:
    """Confirmation, lifecycle, completion score and target of each candidate."""
    need = o.confirm_bars
    reach = F.col("n_bars") - 1 - F.col("after")
    open_ended = cands.filter("fixed_score is null")
    probe = open_ended.select("symbol", "ord", "direction", "x1", "y1", "x2", "y2", "after", "invalidation", F.col("after").alias("bar_idx"), "n_bars")
    steps = probe.withColumn("step", F.explode(F.sequence(F.lit(2 - need), reach.cast("int"))))
    at = pb.select("symbol", F.col("bar_idx").alias("at"), F.col("close").alias("c"), F.col("atr").alias("a"), "vr")
    rows = steps.withColumn("at", F.col("after") + F.col("step")).join(at, ["symbol", "at"])
    rows = rows.withColumn("line", line_at(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"), F.col("at")))
    line = F.col("line")
    bull, buf = F.col("direction") == "bullish", F.col("a") * o.breakout_atr
    rows = rows.withColumns({
        "clear": F.when(bull, F.col("c") > line + buf).otherwise(F.col("c") < line - buf).cast("int"),
        "gone": F.when(bull, F.col("c") < F.col("invalidation")).otherwise(F.col("c") > F.col("invalidation")),
        "retest": F.when(bull, F.col("c") < line - buf).otherwise(F.col("c") > line + buf),
    })
    per = Window.partitionBy("symbol", "ord")
    held = (F.min("clear").over(per.orderBy("at").rowsBetween(-(need - 1), 0)) == 1) & (F.col("at") >= F.greatest(F.col("after") + 1, F.lit(need - 1)))
    rows = rows.withColumn("held_at", F.when(held, F.col("at"))).withColumn("breakout", F.min("held_at").over(per))
    since = F.col("at") >= F.coalesce(F.col("breakout"), F.col("structure_end")) + 1
    rows = rows.join(open_ended.select("symbol", "ord", F.element_at("points", -1)["idx"].alias("last_point"), "family"), ["symbol", "ord"])
    end = F.when(F.col("family") == "continuation_consolidation", F.col("n_bars") - 2).otherwise(F.col("after"))
    rows = rows.withColumn("structure_end", end)
    judged = rows.groupBy("symbol", "ord").agg(
        F.max("breakout").alias("breakout_idx"), F.max(F.when(F.col("at") == F.col("breakout"), F.col("vr"))).alias("volume_ratio"),
        F.max("structure_end").alias("structure_end"),
        F.coalesce(F.bool_or(since & (F.col("gone") | (F.col("breakout").isNotNull() & F.col("retest")))), F.lit(False)).alias("broken"),
    )
    now, last_close = F.col("n_bars") - 1, pb.filter("bar_idx = n_bars - 1").select("symbol", F.col("close").alias("last_close"))
    d = cands.join(judged, ["symbol", "ord"], "left").join(last_close, "symbol")
    d = d.withColumn("here", line_at(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"), now))
    here = F.col("here")
    conf = F.col("breakout_idx").isNotNull()
    score = completion(F.lit(1.0), F.col("geometry"), F.col("timing"), F.col("volume_ratio"), (here - F.col("last_close")) / F.col("atr_v"))
    base = F.when(F.col("fixed_score").isNotNull(), F.when(F.col("direction") == "neutral", "awaiting_breakout").otherwise("forming")).when(conf, "confirmed").otherwise("awaiting_breakout")
    old = (base == "awaiting_breakout") & (now - F.col("structure_end") > o.valid_bars) & F.col("fixed_score").isNull()
    d = d.withColumns({"raw_score": score, "base_status": base})
    score, base = F.col("raw_score"), F.col("base_status")
    d = d.withColumns({
        "neckline": F.when(F.col("x1").isNotNull(), here),
        "status": F.when(F.coalesce("broken", F.lit(False)), "invalidated").when(old, "expired").otherwise(base),
        "score": F.coalesce("fixed_score", F.when(conf, F.greatest(score, F.col("floor"))).otherwise(score)),
        "start_idx": F.element_at("points", 1)["idx"], "end_idx": F.element_at("points", -1)["idx"], "n_points": F.size("points"),
    })
    # Of a symmetrical triangle the confirmed side stays, upward first, else the neutral form.
    tri = F.col("pattern") == "symmetrical_triangle"
    sides = d.filter(tri).groupBy("symbol").agg(
        F.coalesce(F.min(F.when(F.col("breakout_idx").isNotNull(), F.col("ord"))), F.lit(602)).alias("keep_ord"))
    d = d.join(sides, "symbol", "left").filter(~tri | (F.col("ord") == F.col("keep_ord"))).drop("keep_ord")
    sign = F.when(F.col("direction") == "bullish", 1.0).otherwise(-1.0)
    from_idx = F.when(F.col("at_now"), now).otherwise(F.coalesce("breakout_idx", "after"))
    d = d.withColumn("from_idx", from_idx)
    d = d.withColumn("target", F.when(F.col("height").isNotNull(), line_at(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"), F.col("from_idx")) + sign * F.col("height")))
    target = F.col("target")
    trust = F.col("score") * F.when(F.col("base_status") == "confirmed", 1.0).otherwise(F.col("early"))
    trust = F.when(F.col("family") == "head_shoulders", F.least(F.lit(95.0), trust)).otherwise(trust)
    return d.withColumns({
        "target_low": target - F.col("atr_v") * F.col("band"), "target_high": target + F.col("atr_v") * F.col("band"),
        "target_confidence": F.when(target.isNotNull(), half_even(trust, 1)), "status_rank": rank(F.col("status")),
        "expected_low": F.when(F.col("base_status") == "forming", F.get("points", F.lit(0))["price"] - F.col("atr_v") * 0.75),
        "expected_high": F.when(F.col("base_status") == "forming", F.get("points", F.lit(0))["price"] + F.col("atr_v") * 0.75),
    }).select("symbol", "n_bars", "expected_low", "expected_high", "pattern", "family", "direction", "ord", "status", "status_rank", "score", "points", "n_points", "start_idx", "end_idx", "neckline", "breakout_idx",
              "invalidation", "target", "target_low", "target_high", "target_confidence", "next_side")


def rank(c: Column) -> Column:
    out = F.when(c == "confirmed", 4)
    for k in ("awaiting_breakout", "forming", "invalidated"):
        out = out.when(c == k, STATUS_RANK[k])
    return out.otherwise(0)


def deduplicate(patterns: DataFrame, window: int) -> DataFrame:
    """Keeps one representative of like patterns, with the names of those it stands for in ``related``.

    Only patterns of one symbol, family and direction can be alike; such a group has at most a few
    dozen members (three kinds over fourteen pivots), and the greedy choice is a fold over it.
    """
    order = F.struct((-F.col("n_points")).alias("k1"), (-F.col("status_rank")).alias("k2"), (-F.col("score")).alias("k3"), F.col("ord").alias("k4"))
    rest = [c for c in patterns.columns if c not in ("symbol", "family", "direction")]
    item = F.struct(*rest, F.transform("points", lambda x: x["idx"]).alias("at"), F.expr("cast(array() as array<string>)").alias("related"))
    g = patterns.groupBy("symbol", "family", "direction").agg(F.array_sort(F.collect_list(F.struct(order.alias("k"), item.alias("v")))).alias("all"))
    g = g.withColumn("all", F.transform("all", lambda x: x["v"]))

    def alike(c, e):
        share = overlap(c["start_idx"], c["end_idx"], e["start_idx"], e["end_idx"])
        near = F.abs(c["end_idx"] - e["end_idx"]) <= window
        subset = (F.size(F.array_except(c["at"], e["at"])) == 0) & (F.size(F.array_except(e["at"], c["at"])) > 0)
        neck = F.coalesce((c["neckline"] != 0) & (e["neckline"] != 0) & (F.abs(c["neckline"] - e["neckline"]) / F.greatest(F.abs(e["neckline"]), F.lit(1e-12)) <= 0.015), F.lit(False))
        return subset | (share >= 0.75) | (near & ((share >= 0.60) | neck))

    fields = [*rest, "at", "related"]

    def step(acc, c):
        hit = F.array_position(F.transform(acc, lambda e: alike(c, e)), F.lit(True))
        noted = lambda e: F.struct(*[(F.array_union(e["related"], F.array(c["pattern"])) if f == "related" else e[f]).alias(f) for f in fields])
        marked = F.transform(acc, lambda e, i: F.when((i + 1) == hit, noted(e)).otherwise(e))
        return F.when(hit == 0, F.concat(acc, F.array(c))).otherwise(marked)

    kept = F.aggregate(F.slice("all", F.lit(2), F.size("all")), F.slice("all", 1, 1), step)
    return g.select("symbol", "family", "direction", F.explode(kept).alias("v")).select("symbol", "family", "direction", "v.*").drop("at")


def _as_is(df: DataFrame, name: str) -> DataFrame:
    return df


def find_candidates(bars: DataFrame, o: Options, keep=_as_is) -> tuple[DataFrame, DataFrame]:
    pb = keep(pattern_bars(bars, o).filter(F.col("n_bars") >= o.min_bars), "bars")
    pivots = recent_pivots(pb, o)
    ends = pb.filter("bar_idx = n_bars - 1").select("symbol", "close", F.col("atr").alias("atr_last"))
    c = reversal_candidates(pivots, o).unionByName(triangle_candidates(pivots, ends, o)).unionByName(consolidation_candidates(pb, o))
    return keep(c, "candidates"), pb


def chart_patterns(bars: DataFrame, o: Options = Options(), dedupe: bool = True, keep=_as_is) -> DataFrame:
    """All patterns at the end of each symbol's history, latest and best first.

    ``keep(df, name)`` may write an intermediate frame and return it read back: the prepared bars
    are used five times and the candidates twice.
    """
    c, pb = find_candidates(bars, o, keep)
    d = keep(settle(c, pb, o), "settled")
    if dedupe:
        d = deduplicate(d, o.dedupe_window)
    return d.orderBy("symbol", F.desc("end_idx"), F.desc("status_rank"), F.desc("score"), F.desc("n_points"), "ord")


def first_per_type(patterns: DataFrame) -> DataFrame:
    """The first pattern of each kind in final order."""
    w = Window.partitionBy("symbol", "pattern").orderBy(F.desc("end_idx"), F.desc("status_rank"), F.desc("score"), F.desc("n_points"), "ord")
    return patterns.withColumn("_k", F.row_number().over(w)).filter("_k = 1").drop("_k")


def merge_targets(levels: DataFrame, patterns: DataFrame, state: DataFrame, direction: str = "bullish") -> tuple[DataFrame, DataFrame]:
    """Credits pattern targets to the nearest take-profit level.

    ``levels`` has ``symbol, level, price, prob_pct``; ``state`` has ``symbol, current_price, atr``.
    Returns the levels with raised probabilities, and every target with its level or a rejection.
    """
    ahead = F.col("target") > F.col("current_price") if direction == "bullish" else F.col("target") < F.col("current_price")
    t = patterns.join(state, "symbol").filter((F.col("direction") == direction) & F.col("target").isNotNull() & ahead)
    conf = F.col("status") == "confirmed"
    t = t.select("symbol", "pattern", "ord", "status", "target", (~conf).alias("provisional"), half_even(F.col("score") / 100.0 * F.when(conf, 1.0).otherwise(0.55), 3).alias("weight"),
                 F.greatest(F.abs("atr") * 0.75, F.abs("current_price") * 0.005).alias("limit"))
    near = t.join(levels.select("symbol", "level", "price"), "symbol", "left").withColumn("dist", F.abs(F.col("price") - F.col("target")))
    near = near.groupBy("symbol", "pattern", "ord", "status", "target", "provisional", "weight", "limit").agg(F.min(F.struct("dist", "level")).alias("b"))
    judged = near.withColumn("accepted", F.coalesce(F.col("b.dist") <= F.col("limit"), F.lit(False)))
    judged = judged.select("symbol", "pattern", "ord", "status", "target", "provisional", "weight", F.when(F.col("accepted"), F.col("b.level")).alias("level"), F.col("b.dist").alias("distance"), "accepted")
    credit = judged.filter("accepted").groupBy("symbol", "level").agg(
        F.count(F.lit(1)).alias("matches"), F.count_if(~F.col("provisional") & (F.col("weight") >= 0.70)).alias("raises"))
    out = levels.join(credit, ["symbol", "level"], "left").fillna(0, ["matches", "raises"])
    raised = half_even(F.least(F.lit(97.0), F.col("prob_pct") + 2.0 * F.col("raises")), 1)
    return out.withColumn("prob_pct", F.when(F.col("raises") > 0, raised).otherwise(F.col("prob_pct"))).withColumn("pattern_confluence", F.col("matches") > 0), judged
