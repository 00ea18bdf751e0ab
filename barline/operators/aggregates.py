"""Market, sector, peer and portfolio aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from barline.functions.numeric import bands, flag, half_even
from barline.operators.quantiles import exact_quantiles

DIRECTIONS = ["up", "down", "flat"]


# -- sectors and moods ------------------------------------------------------------------------

def overnight_signal(proxies: DataFrame, changes: DataFrame, limit: float = 0.7) -> DataFrame:
    """Mean change of each symbol's proxies and its direction. ``proxies`` has ``symbol, proxies``
    (array); ``changes`` has ``proxy, change_pct``. Unknown proxies are skipped."""
    e = proxies.select("symbol", F.explode_outer("proxies").alias("proxy")).join(changes, "proxy", "left")
    a = e.groupBy("symbol").agg(F.avg("change_pct").alias("avg_raw"), F.count("change_pct").alias("proxy_count"))
    direction = F.when(F.col("avg_raw").isNull(), "").otherwise(bands("avg_raw", [(">", limit, "up"), ("<", -limit, "down")], "neutral"))
    return a.select("symbol", "proxy_count", half_even("avg_raw", 2).alias("avg_pct"), direction.alias("overnight"))


def majority(up: Column, down: Column) -> Column:
    return F.when(up > down, "up").when(down > up, "down").otherwise("flat")


def sector_flow(stocks: DataFrame) -> DataFrame:
    """Per sector: counts, majority direction, mean change, overnight direction and mood.

    ``stocks`` has ``sector, direction, change_pct, overnight``. All measures combine map-side.
    """
    n = lambda c, v: F.count_if(F.col(c) == v)
    g = stocks.withColumn("sector", F.coalesce("sector", F.lit("OTHER"))).groupBy("sector").agg(
        F.count(F.lit(1)).alias("stock_count"), n("direction", "up").alias("up"), n("direction", "down").alias("down"),
        half_even(F.avg("change_pct"), 2).alias("avg_change_pct"),
        n("overnight", "up").alias("_ou"), n("overnight", "down").alias("_od"), F.count_if(F.col("overnight").isin("up", "down", "neutral")).alias("_ot"),
    )
    over = F.when(F.try_divide("_ou", "_ot") > 0.6, "up").when(F.try_divide("_od", "_ot") > 0.6, "down").otherwise("neutral")
    g = g.withColumns({"price_direction": majority(F.col("up"), F.col("down")), "overnight": over})
    pos = (F.col("price_direction") == "up").cast("int") + (F.col("overnight") == "up").cast("int")
    neg = (F.col("price_direction") == "down").cast("int") + (F.col("overnight") == "down").cast("int")
    return g.withColumn("mood", F.when(pos > neg, "positive").when(neg > pos, "negative").otherwise("neutral")).drop("_ou", "_od", "_ot")


def direction_pivot(stocks: DataFrame) -> DataFrame:
    """Up, down and flat counts per sector, and in total (sector NULL)."""
    d = stocks.withColumn("direction", F.when(F.col("direction").isin(*DIRECTIONS), F.col("direction")).otherwise("flat"))
    by_sector = d.groupBy("sector").pivot("direction", DIRECTIONS).count().fillna(0, DIRECTIONS)
    total = by_sector.agg(*[F.sum(c).alias(c) for c in DIRECTIONS]).select(F.lit(None).cast("string").alias("sector"), *DIRECTIONS)
    return by_sector.unionByName(total)


def mood(average: Column, limit: float = 0.3) -> Column:
    return F.when(average > limit, "positive").when(average < -limit, "negative").otherwise("neutral")


KEY_FOREIGN = ["S&P 500", "나스닥", "^GSPC", "^IXIC"]
US_KEYS = ["S&P 500", "나스닥", "다우", "^GSPC", "^IXIC", "^DJI", "DOW"]


def market_moods(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Overall, domestic and US mood per briefing.

    ``rows`` has ``kind`` ('index' or 'overnight'), ``name``, ``direction``, ``available``. Key
    foreign markets count 1.5 in the overall mood; unavailable indices and the volatility index do not count.
    """
    score = F.when(F.col("direction") == "up", 1.0).when(F.col("direction") == "down", -1.0).otherwise(0.0)
    has = lambda names: F.array_contains(F.transform(F.array(*[F.lit(k) for k in names]), lambda k: F.contains(F.col("name"), k)), True)
    index = (F.col("kind") == "index") & F.coalesce(F.col("available"), F.lit(True))
    night = F.col("kind") == "overnight"
    major = night & has(KEY_FOREIGN)
    us = night & has(US_KEYS) & ~F.contains(F.col("name"), F.lit("VIX"))
    return rows.groupBy(*keys).agg(
        mood(F.avg(F.when(index, score).when(major, score * 1.5))).alias("market_mood"),
        mood(F.avg(F.when(index, score))).alias("kr_mood"), mood(F.avg(F.when(us, score))).alias("us_mood"),
        F.count_if(index).alias("available_indices"),
    )


def fear_signal(vix) -> Column:
    v = F.col(vix) if isinstance(vix, str) else vix
    return F.when(v >= 30, "extreme_fear").when(v >= 20, "fear").when(v <= 13, "complacency").when(v.isNotNull(), "normal")


def core_summary(rows: DataFrame, items: DataFrame, keys: list[str]) -> DataFrame:
    """One row per briefing: moods, fear signal, state of the index data, and counts of the news by impact.

    ``rows`` has the keys, ``kind, name, direction, available, value, as_of, place``; ``items`` the keys and ``impact``.
    The fear signal reads the first volatility index by ``place``; ``as_of`` is that of the first available index. A
    briefing without news has zero counts.
    """
    index = (F.col("kind") == "index") & F.coalesce("available", F.lit(True))
    vix = (F.col("kind") == "overnight") & F.contains("name", F.lit("VIX"))
    first = lambda c, cond: F.min_by(F.when(cond, F.col(c)), F.when(cond, F.col("place")))
    facts = rows.groupBy(*keys).agg(first("value", vix).alias("_vix"), first("as_of", index).alias("as_of"), F.count_if(F.col("kind") == "index").alias("expected_indices"), F.count_if(F.col("kind") == "overnight").alias("overnight_markets"))
    n = lambda v: F.count_if(F.col("impact") == v).alias(f"{v}_news")
    counts = items.groupBy(*keys).agg(n("positive"), n("negative"), n("neutral"))
    d = market_moods(rows, keys).join(facts, keys).join(counts, keys, "left").fillna(0, ["positive_news", "negative_news", "neutral_news"])
    return d.withColumn("vix_signal", fear_signal("_vix")).drop("_vix")


def advance_decline(moves: DataFrame, keys: list[str]) -> DataFrame:
    up, down = F.count_if(F.col("ret") > 0), F.count_if(F.col("ret") < 0)
    return moves.groupBy(*keys).agg(up.alias("advances"), down.alias("declines"), (up / F.nullif(down, F.lit(0))).alias("ad_ratio"))


def peer_outlook(members: DataFrame) -> DataFrame:
    """Each member against the other members of its industry.

    ``members`` has ``symbol, industry, ret_5, ret_20, rsi``. The others' means come from the
    industry sums less the member's own value, so no pairs are formed.
    """
    mom = (F.col("ret_5") + F.col("ret_20")) / 2
    d = members.withColumn("momentum", mom)
    g = d.groupBy("industry").agg(
        F.sum("momentum").alias("_sm"), F.count("momentum").alias("_nm"), F.sum("rsi").alias("_sr"), F.count("rsi").alias("_nr"),
        F.count(F.lit(1)).alias("_n"),
    )
    own_m, own_r = F.col("momentum"), F.col("rsi")
    n_m, n_r = F.col("_nm") - own_m.isNotNull().cast("int"), F.col("_nr") - own_r.isNotNull().cast("int")
    peers_m = (F.col("_sm") - F.coalesce(own_m, F.lit(0.0))) / F.nullif(n_m, F.lit(0))
    peers_r = (F.col("_sr") - F.coalesce(own_r, F.lit(0.0))) / F.nullif(n_r, F.lit(0))
    up = F.when(peers_m.isNotNull(), F.bround(F.greatest(F.lit(5.0), F.least(F.lit(95.0), 50 + 2 * peers_m)), 0))
    return d.join(g, "industry").select(
        "symbol", "industry", (F.col("_n") - 1).alias("peer_count"), "momentum", peers_m.alias("peer_momentum"), peers_r.alias("peer_rsi"),
        (own_m - peers_m).alias("relative_momentum"), up.alias("up_pct"), (100 - up).alias("down_pct"),
    )


def dilution(filings: DataFrame, as_of: str | Column) -> DataFrame:
    """Overhang and dilution per symbol.

    ``filings`` has ``symbol, kind, shares, outstanding, countable, expiry``. Registered existing
    shares add supply without dilution; only countable warrants dilute.
    """
    day = F.to_date(F.lit(as_of)) if isinstance(as_of, str) else as_of
    total = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("shares"))), F.lit(0.0))
    reg, war = F.col("kind") == "registration", (F.col("kind") == "warrant") & F.col("countable")
    left = F.min(F.when((F.col("kind") == "lockup") & (F.col("expiry") >= day), F.datediff("expiry", day)))
    out = F.max("outstanding")
    return filings.groupBy("symbol").agg(
        total(reg).alias("registered"), total(war).alias("countable_warrants"), (total(reg) / F.nullif(out, F.lit(0.0)) * 100).alias("overhang_pct"),
        (total(war) / F.nullif(out, F.lit(0.0)) * 100).alias("dilution_pct"), left.alias("lockup_days_left"),
    )


def source_breakdown(items: DataFrame, keys: list[str], approximate: bool = False) -> DataFrame:
    d = items.groupBy(*keys).agg(F.count(F.lit(1)).alias("items"), *([F.approx_count_distinct("symbol").alias("symbols")] if approximate else []))
    if approximate:
        return d
    # Distinct pairs first, so a hot source is counted by many tasks.
    s = items.select(*keys, "symbol").distinct().groupBy(*keys).agg(F.count("symbol").alias("symbols"))
    return d.join(s, keys)


# -- portfolios -------------------------------------------------------------------------------

def with_position_figures(p: DataFrame) -> DataFrame:
    price = F.when(F.col("current_price") > 0, F.col("current_price")).otherwise(F.col("entry_price"))
    per = F.greatest(F.col("entry_price") - F.col("stop_price"), F.lit(0.01))
    closed = (F.col("status") == "CLOSED") & (F.col("close_price") > 0)
    r = F.try_divide((F.col("close_price") - F.col("entry_price")) * F.col("shares"), per * F.col("shares"))
    return p.withColumns({
        "risk_per_share": per, "value": F.col("shares") * price, "open_risk": F.greatest(price - F.col("stop_price"), F.lit(0.0)) * F.col("shares"),
        "has_stop": (F.col("stop_price") > 0) & (F.col("stop_price") < F.col("entry_price")),
        "r_multiple": F.when(closed, half_even(r, 2)),
        "unrealized_pnl_pct": F.when((F.col("entry_price") > 0) & (F.col("current_price") > 0), half_even((F.col("current_price") / F.col("entry_price") - 1) * 100, 2)).otherwise(0.0),
        "stop_distance_pct": F.when(price > 0, half_even((price - F.col("stop_price")) / price * 100, 2)).otherwise(0.0),
    })


def portfolio_state(figures: DataFrame, keys: list[str], equity: Column) -> DataFrame:
    """Market value, open risk, risk level, missing stops and expectancy per portfolio."""
    is_open = F.col("status") == "OPEN"
    g = figures.groupBy(*keys).agg(
        F.count_if(is_open).alias("open_positions"), F.coalesce(F.sum(F.when(is_open, F.col("value"))), F.lit(0.0)).alias("market_value"),
        F.coalesce(F.sum(F.when(is_open, F.col("open_risk"))), F.lit(0.0)).alias("open_risk"),
        F.count_if(is_open & ~F.col("has_stop")).alias("missing_stops"), half_even(F.avg("r_multiple"), 3).alias("expectancy"),
    ).withColumn("equity", equity)
    pct = F.when(F.col("equity") > 0, half_even(F.col("open_risk") / F.col("equity") * 100, 2)).otherwise(0.0)
    g = g.withColumn("open_risk_pct", pct)
    level = F.when((F.col("missing_stops") > 0) | (F.col("open_risk_pct") > 8.0), "HIGH").when(F.col("open_risk_pct") > 5.0, "MEDIUM").otherwise("LOW")
    return g.withColumn("risk_level", level)


def concentration(figures: DataFrame, keys: list[str], item: str = "symbol") -> DataFrame:
    """Share of each item in its portfolio's open value. Totals are joined back, not windowed, so a
    large portfolio is not gathered in one task."""
    v = figures.filter("status = 'OPEN'").groupBy(*keys, item).agg(F.sum("value").alias("value"))
    t = v.groupBy(*keys).agg(F.sum("value").alias("_t"))
    return v.join(t, keys).withColumn("weight_pct", F.when(F.col("_t") > 0, half_even(F.col("value") / F.col("_t") * 100, 1)).otherwise(0.0)).drop("_t")


def exposure(figures: DataFrame, keys: list[str], equity: Column) -> DataFrame:
    """Open value per cluster (or sector) in per cent of equity."""
    g = figures.filter("status = 'OPEN'").groupBy(*keys).agg(F.sum("value").alias("value")).withColumn("_e", equity)
    return g.withColumn("exposure_pct", F.col("value") / F.nullif(F.col("_e"), F.lit(0.0)) * 100).drop("_e")


# -- return distributions ---------------------------------------------------------------------

def equal_weight(moves: DataFrame, keys: list[str], date: str = "bar_date") -> DataFrame:
    """Mean return of all symbols per date: at most one row per key and calendar day."""
    return moves.filter("ret is not null").groupBy(*keys, date).agg(F.avg("ret").alias("ret"))


def drawdown(series: DataFrame, keys: list[str], date: str = "bar_date") -> DataFrame:
    """Adds ``equity`` and ``drawdown`` to a return series (one row per key and date)."""
    run = Window.partitionBy(*keys).orderBy(date).rowsBetween(Window.unboundedPreceding, 0)
    s = series.withColumn("equity", F.exp(F.sum(F.log1p("ret")).over(run)))
    return s.withColumn("drawdown", F.col("equity") / F.max("equity").over(run) - 1)


def return_distribution(series: DataFrame, keys: list[str], date: str = "bar_date") -> DataFrame:
    """Annual-style return, volatility, drawdown and quantiles of daily and 5-bar returns."""
    w = Window.partitionBy(*keys).orderBy(date)
    d = drawdown(series, keys, date).withColumn("week", F.floor((F.row_number().over(w) - 1) / 5))
    sd = F.stddev_pop("ret")
    base = d.groupBy(*keys).agg(
        (F.max_by("equity", date) - 1).alias("total_return"), F.avg("ret").alias("mean"), sd.alias("std"),
        (sd * F.sqrt(F.lit(252.0))).alias("annual_vol"), F.min("drawdown").alias("mdd"),
    )
    weekly = d.groupBy(*keys, "week").agg((F.exp(F.sum(F.log1p("ret"))) - 1).alias("wret"))
    probs = [0.05, 0.25, 0.5, 0.75, 0.95]
    dq = exact_quantiles(d, keys, {"day": F.col("ret")}, probs)
    wq = exact_quantiles(weekly, keys, {"week": F.col("wret")}, probs)
    return base.join(dq, keys).join(wq, keys)


def run_lengths(series: DataFrame, keys: list[str], date: str = "bar_date") -> DataFrame:
    """Mean and upper-quartile length of rising (>= 0) and falling runs."""
    w = Window.partitionBy(*keys).orderBy(date)
    up = F.col("ret") >= 0
    d = series.withColumn("up", up).withColumn("_new", F.coalesce((F.col("up") != F.lag("up").over(w)).cast("int"), F.lit(1)))
    d = d.withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    runs = d.groupBy(*keys, "up", "_run").agg(F.count(F.lit(1)).alias("length"))
    g = [*keys, "up"]
    return runs.groupBy(*g).agg(F.count(F.lit(1)).alias("runs"), F.avg("length").alias("avg_length")).join(
        exact_quantiles(runs, g, {"length": F.col("length")}, [0.75]), g
    )


def liquidity_terciles(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Adds ``liquidity``: low, mid or high by the one-third and two-thirds quantiles of positive values."""
    qs = exact_quantiles(rows.filter(F.col(value) > 0), keys, {"q": F.col(value)}, [1 / 3, 2 / 3])
    lo, hi = [c for c in qs.columns if c not in keys]
    d = rows.join(qs, keys, "left") if keys else rows.crossJoin(F.broadcast(qs))
    return d.withColumn("liquidity", F.when(F.col(value) <= F.col(lo), "low").when(F.col(value) <= F.col(hi), "mid").otherwise("high")).drop(lo, hi)


def flagged(c: Column) -> Column:
    return flag(c)


def assess_trades(proposals: DataFrame, state: DataFrame, sector_values: DataFrame, keys: list[str], risk_pct: float = 1.0) -> DataFrame:
    """Whether each proposed trade fits its portfolio: seven hard rules and two warnings.

    ``proposals`` has ``entry_price, stop_price, sector, sleeve``; ``state`` comes from
    ``portfolio_state`` with ``cash`` added; ``sector_values`` has ``sector, sector_value``.
    """
    from barline.functions.scores import SLEEVE_MAX_PCT, lookup

    d = proposals.join(state, keys).join(sector_values, [*keys, "sector"], "left").fillna(0.0, ["sector_value"])
    e, s, eq, cash = (F.col(c) for c in ("entry_price", "stop_price", "equity", "cash"))
    per = F.greatest(e - s, F.lit(0.01))
    d = d.withColumns({"risk_per_share": per, "stop_distance_pct": per / e * 100})
    want = F.floor(F.least(eq * (risk_pct / 100.0), cash) / F.col("risk_per_share"))
    cap = eq * lookup("sleeve", SLEEVE_MAX_PCT, 15.0) / 100
    shares = F.least(F.when(want * e > cap, F.floor(cap / e)).otherwise(want), F.floor(cash / e))
    d = d.withColumn("shares", shares.cast("double"))
    d = d.withColumns({"position_value": F.col("shares") * e, "risk_per_trade": F.col("shares") * F.col("risk_per_share")})
    d = d.withColumn("risk_after_pct", F.when(eq > 0, (F.col("open_risk") + F.col("risk_per_trade")) / eq * 100).otherwise(0.0))
    total = F.col("market_value") + F.col("position_value")
    hard = {
        "STOP_BELOW_ENTRY": s >= e, "MIN_SHARES": F.col("shares") < 1, "MAX_OPEN_RISK": F.col("risk_after_pct") > 10.0, "MAX_POSITIONS": F.col("open_positions") >= 6, "STOP_DISTANCE": F.col("stop_distance_pct") > 10.0,
        "CONCENTRATION": F.when(total > 0, F.col("position_value") / total * 100).otherwise(0.0) > 25.0, "SECTOR_CONCENTRATION": (F.col("sector_value") + F.col("position_value")) / eq * 100 > 40.0,
    }
    soft = {"MISSING_STOPS": F.col("missing_stops") > 0, "LOW_CASH": F.col("position_value") > cash * 0.9}
    names = lambda rules: F.filter(F.array(*[F.when(flag(c), F.lit(n)) for n, c in rules.items()]), lambda x: x.isNotNull())
    d = d.withColumns({"violations": names(hard), "warnings": names(soft)})
    return d.withColumn("approved", F.size("violations") == 0)
