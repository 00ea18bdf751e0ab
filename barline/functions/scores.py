"""Row-wise scores of a snapshot: breakout quality, weaknesses, penalties, composite and gates.

Column functions over a snapshot row. The first scoring version is suffixed ``_v1``; version two
takes chasing flags, weekly ADX and quality into account.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from barline.functions.numeric import all_of, bands, clamp, col, flag, half_even, points, safe

# Fixed values of the scan.
STOP_ATR = 1.5
EXT_ATR_LIMIT = 0.8
PULLBACK_ATR = 0.25
SLEEVE_PRIORITY = {"CORE": 40.0, "ETF": 20.0, "HIGH_RISK": 10.0, "HEDGE": 5.0}
TIER_MULTIPLIER = {"high": 1.0, "medium": 0.75, "low": 0.0, "junk": 0.0, "unknown": 0.5}
SLEEVE_MAX_PCT = {"CORE": 15.0, "ETF": 20.0, "HIGH_RISK": 8.0, "HEDGE": 10.0}
FINANCIAL_SECTORS = ["Financial Services", "Real Estate", "금융", "부동산", "Finance"]


def lookup(c, table: dict, otherwise) -> Column:
    out = None
    for k, v in table.items():
        out = F.when(col(c) == k, F.lit(v)) if out is None else out.when(col(c) == k, F.lit(v))
    return out.otherwise(F.lit(otherwise))


# -- regime -----------------------------------------------------------------------------------

def regime_points(price, ma200, adx, plus_di, minus_di, vix=None, advance_decline=None) -> dict[str, Column]:
    price, ma200, adx, pdi, mdi = map(col, (price, ma200, adx, plus_di, minus_di))
    has_ma = flag(ma200 > 0)
    bull = points(has_ma & (price > ma200), 3)
    bear = points(has_ma & ~(price > ma200), 3)
    has = adx.isNotNull()
    strong, up = flag(has & (adx >= 25)), flag(has & (pdi > mdi))
    bull = bull + points(strong & up, 1) + points(up, 2)
    bear = bear + points(strong & ~up, 1) + points(has & ~up, 2)
    if vix is not None:
        bull, bear = bull + points(flag(col(vix) < 20), 1), bear + points(flag(col(vix) >= 30), 1)
    if advance_decline is not None:
        ad = col(advance_decline)
        bull, bear = bull + points(flag(ad > 1.2), 1), bear + points(flag(ad < 0.8), 1)
    chop = has_ma & flag((price >= ma200 * 0.98) & (price <= ma200 * 1.02))
    regime = F.when(chop, "SIDEWAYS").when(bull >= 5, "BULLISH").when(bear >= 5, "BEARISH").otherwise("SIDEWAYS")
    return {"regime": regime, "bull_pts": bull.cast("long"), "bear_pts": bear.cast("long"), "chop_band": chop}


def volatility_regime(atr_pct) -> Column:
    return bands(atr_pct, [("<", 1.0, "LOW_VOL"), ("<=", 2.0, "NORMAL_VOL")], "HIGH_VOL")


def dual_regime_v1(regime, vol_regime) -> Column:
    return (
        F.when(col(regime) == "BEARISH", -10.0).when(col(regime) == "SIDEWAYS", 0.0)
        .when(col(vol_regime) == "HIGH_VOL", 10.0).when(col(vol_regime) == "NORMAL_VOL", 15.0).otherwise(20.0)
    )


def dual_regime_v2(regime, vol_regime, aligned) -> Column:
    r, v = F.upper(col(regime)), F.upper(col(vol_regime))
    return (
        F.when(r == "BEARISH", -10.0).when(r != "BULLISH", 0.0).when(v == "HIGH_VOL", 10.0)
        .when(flag(col(aligned)), F.when(v == "LOW_VOL", 20.0).otherwise(15.0)).otherwise(10.0)
    )


# -- entry ------------------------------------------------------------------------------------

def entry_buffer(atr_pct, vol_regime) -> Column:
    """Share of an ATR put above the high: 20 % at ATR 2 %, falling to 5 % at 6 %, times the regime factor."""
    a = col(atr_pct)
    base = F.when(a <= 2.0, 0.20).when(a >= 6.0, 0.05).otherwise(0.20 + (a - 2.0) / 4.0 * (0.05 - 0.20))
    return base * lookup(vol_regime, {"LOW_VOL": 0.8, "NORMAL_VOL": 1.0, "HIGH_VOL": 1.3}, 1.0)


def entry_levels(high, atr, atr_pct, vol_regime) -> dict[str, Column]:
    buf = entry_buffer(atr_pct, vol_regime)
    trigger = col(high) + buf * col(atr)
    return {
        "entry_trigger": half_even(trigger, 4), "stop_price": half_even(trigger - STOP_ATR * col(atr), 4),
        "buffer_pct": half_even(buf * 100, 2),
    }


def extension(price, trigger, atr) -> Column:
    return F.try_divide(col(price) - col(trigger), col(atr))


def anti_chase_v1(price, trigger, atr, monday=False) -> dict[str, Column]:
    """``ext_atr, chasing, wait_pullback``; neutral where there is no positive ATR."""
    has, ext = flag(col(atr) > 0), extension(price, trigger, atr)
    limit = F.when(F.lit(monday) if isinstance(monday, bool) else col(monday), 3.0).otherwise(4.0)
    gap = flag((col(price) >= col(trigger)) & ((F.try_divide(col(price), col(trigger)) - 1) * 100 > limit))
    wait = has & flag(ext > EXT_ATR_LIMIT)
    return {
        "ext_atr": F.when(has, half_even(ext, 3)).otherwise(0.0), "chasing": wait | (has & gap), "wait_pullback": wait,
    }


def anti_chase_v2(price, trigger, atr, monday=False) -> dict[str, Column]:
    """``chase_ok`` and the reason code."""
    has, ext = flag(col(atr) > 0), extension(price, trigger, atr)
    limit = F.when(F.lit(monday) if isinstance(monday, bool) else col(monday), 3.0).otherwise(4.0)
    above = F.when(col(trigger) > 0, (col(price) / col(trigger) - 1) * 100).otherwise(0.0)
    gap = (col(price) >= col(trigger)) & (above > limit)
    reason = F.when(~has, "NO_ATR").when(flag(ext > EXT_ATR_LIMIT), "WAIT_PULLBACK").when(flag(gap), "GAP_CHASE").otherwise("OK")
    return {"chase_ok": reason.isin("NO_ATR", "OK"), "chase_reason": reason, "chase_ext_atr": F.when(has, half_even(ext, 3)).otherwise(0.0)}


def pullback_entry(price, high20, ema20, atr, low) -> Column:
    """Struct of the continuation signal (anchor, zone, entry, stop) or NULL."""
    a, anchor = col(atr), F.greatest(col(high20), col(ema20))
    lo, hi = anchor - PULLBACK_ATR * a, anchor + PULLBACK_ATR * a
    hit = flag((anchor > 0) & (a > 0) & (col(low) <= hi) & (col(price) >= hi))
    parts = {"anchor": anchor, "zone_low": lo, "zone_high": hi, "entry_price": hi, "stop_price": lo - a * 0.5}
    return F.when(hit, F.struct(*[half_even(v, 4).alias(k) for k, v in parts.items()]))


def candidate_status(price, trigger) -> Column:
    dist = F.try_divide(col(trigger) - col(price), col(price)) * 100
    return F.when(col(trigger) <= 0, "FAR").otherwise(bands(dist, [("<=", 2.0, "READY"), ("<=", 3.0, "WATCH")], "FAR"))


def technical_filters(price, sleeve, mode: str = "FULL") -> dict[str, Column]:
    """The six filters, the soft Hurst warning, and whether all six pass."""
    ma, adx = F.col("ma200"), F.col("adx")
    f = {
        "price_above_ma200": flag((ma > 0) & (col(price) > ma)),
        "adx_above_20": flag(adx >= 20.0),
        "plus_di_above_minus": flag(F.col("plus_di") > F.col("minus_di")),
        "atr_pct_below_cap": flag(F.col("atr_pct") < F.when(col(sleeve) == "HIGH_RISK", 12.0).otherwise(8.0)),
        "data_quality": flag((ma > 0) & (adx > 0)),
        "efficiency_above_30": flag(F.col("efficiency") >= 30.0),
    }
    warn = flag(F.col("hurst") < 0.5) if mode == "FULL" else F.lit(False)
    return {**f, "hurst_warn": warn, "passes_all": all_of(*f.values())}


# -- quality ----------------------------------------------------------------------------------

def quality(roe="roe", growth="revenue_growth", debt="debt_to_equity", roa="return_on_assets", sector="sector") -> dict[str, Column]:
    """Tier from three yes/no tests; a missing figure counts one half, ties of the sum round to even."""
    fin = flag(col(sector).isin(FINANCIAL_SECTORS))
    part = lambda c, ok: F.when(col(c).isNull(), 0.5).when(ok, 1.0).otherwise(0.0)
    third = F.when(fin, part(roa, col(roa) > 0.01)).otherwise(part(debt, col(debt) < 1.5))
    score = part(roe, col(roe) > 0.10) + part(growth, col(growth) > 0) + third
    third_missing = F.when(fin, col(roa).isNull()).otherwise(col(debt).isNull())
    none = col(roe).isNull() & col(growth).isNull() & third_missing
    complete = ~(col(roe).isNull() | col(growth).isNull() | third_missing)
    step = F.bround(score, 0)
    tier = F.when(none, "unknown").when(step >= 3, "high").when(step >= 2, "medium").when(step >= 1, "low").otherwise("junk")
    return {
        "quality_tier": tier, "quality_score": F.when(none, 0.0).otherwise(score), "is_financial": fin,
        "data_complete": complete, "pass_filter": tier.isin("unknown", "high", "medium"),
        "quality_multiplier": lookup(tier, TIER_MULTIPLIER, 0.5),
    }


def conviction_bonus(tier, converged) -> Column:
    return F.when(flag(col(converged)), lookup(tier, {"high": 0.15, "medium": 0.05}, 0.0)).otherwise(0.0)


# -- breakout quality and weakness ------------------------------------------------------------

def _volatility_health(a) -> Column:
    return (
        F.when(a < 1.0, 15.0 * clamp(a, 0.0, 1.0)).when(a <= 4.0, 15.0)
        .when(a <= 6.0, 15.0 * clamp(1.0 - (a - 4.0) / 2.0, 0.0, 1.0)).otherwise(0.0)
    )


def _hurst_bonus(h) -> Column:
    return F.when(h >= 0.7, 8.0).when(h >= 0.6, 5.0).when(h >= 0.5, 2.0).otherwise(0.0)


def _volume_bonus(v) -> Column:
    return F.when(v > 1.2, 5.0 * clamp((v - 1.2) / 0.6, 0.0, 1.0)).otherwise(0.0)


def bqs_v1(adx, plus_di, minus_di, atr_pct, dist, regime, vol_regime, rs, vol_ratio, hurst, bis) -> Column:
    total = (
        25.0 * clamp((col(adx) - 15.0) / 20.0, 0, 1) + 10.0 * clamp((col(plus_di) - col(minus_di)) / 25.0, 0, 1)
        + _volatility_health(col(atr_pct)) + 15.0 * clamp(1.0 - col(dist) / 3.0, 0, 1)
        + dual_regime_v1(regime, vol_regime) + 15.0 * clamp((col(rs) + 5.0) / 20.0, 0, 1)
        + _volume_bonus(col(vol_ratio)) + _hurst_bonus(col(hurst)) + F.least(col(bis), F.lit(15)).cast("double")
    )
    return half_even(clamp(total), 2)


def fws_v1(vol_ratio, ext_atr, adx, spiking, collapsing, stable) -> Column:
    total = (
        30.0 * clamp(1.0 - (col(vol_ratio) - 0.6) / 0.6, 0, 1)
        + bands(ext_atr, [(">", 0.8, 25.0), (">", 0.4, 15.0)], 0.0)
        + bands(adx, [("<", 20, 10.0), ("<", 25, 7.0), ("<", 30, 3.0)], 0.0)
        + points(flag(col(spiking)) | flag(col(collapsing)), 10) + points(~flag(col(stable)), 10)
    )
    return half_even(clamp(total), 2)


def bqs_v2() -> dict[str, Column]:
    """Ten components and their clamped sum, from snapshot columns."""
    h, w = safe("hurst"), safe("weekly_adx")
    parts = {
        "bqs_trend": 25.0 * clamp((safe("adx") - 15.0) / 20.0, 0, 1),
        "bqs_direction": 10.0 * clamp((safe("plus_di") - safe("minus_di")) / 25.0, 0, 1),
        "bqs_volatility": _volatility_health(safe("atr_pct")),
        "bqs_proximity": 15.0 * clamp(1.0 - safe("distance_to_high_pct") / 3.0, 0, 1),
        "bqs_tailwind": dual_regime_v2("regime", "vol_regime", "dual_aligned"),
        "bqs_rs": 15.0 * clamp((safe("rs") + 5.0) / 20.0, 0, 1),
        "bqs_vol_bonus": _volume_bonus(safe("vol_ratio", 1.0)),
        "bqs_weekly_adx": F.when(w == 0, 0.0).when(w >= 30, 10.0).when(w >= 25, 5.0).when(w < 20, -5.0).otherwise(0.0),
        "bqs_bis": safe("bis"),
        "bqs_hurst": _hurst_bonus(h),
    }
    total = sum(parts.values(), F.lit(0.0))
    return {**{k: half_even(v, 2) for k, v in parts.items()}, "bqs": half_even(clamp(total), 2)}


def fws_v2() -> dict[str, Column]:
    c20, c55 = flag(F.col("chasing_20")), flag(F.col("chasing_55"))
    parts = {
        "fws_volume": 30.0 * clamp(1.0 - (safe("vol_ratio", 1.0) - 0.6) / 0.6, 0, 1),
        "fws_extension": F.when(c20 & c55, 25.0).when(c20 | c55, 15.0).otherwise(0.0),
        "fws_marginal_trend": bands(safe("adx"), [("<", 20, 10.0), ("<=", 25, 7.0), ("<=", 30, 3.0)], 0.0),
        "fws_vol_shock": points(flag(F.col("atr_spiking")) | flag(F.col("atr_collapsing")), 10),
        "fws_regime_instability": points(~F.coalesce(F.col("regime_stable"), F.lit(True)), 10),
    }
    total = sum(parts.values(), F.lit(0.0))
    return {**{k: half_even(v, 2) for k, v in parts.items()}, "fws": half_even(clamp(total), 2)}


def earnings_penalty(days, within_5d=None) -> Column:
    soon = F.lit(0.0) if within_5d is None else points(flag(col(within_5d)), 12)
    return F.when(col(days).isNotNull(), bands(days, [("<=", 1, 20.0), ("<=", 3, 15.0), ("<=", 5, 10.0)], 0.0)).otherwise(soon)


def concentration_penalty(exposure, limit, ramp: float, over: float) -> Column:
    """0 up to 80 % of the limit, a linear ramp to the limit, then steeper beyond."""
    x = F.try_divide(safe(exposure), safe(limit))
    v = F.when(x <= 0.8, 0.0).when(x <= 1.0, ramp * (x - 0.8) / 0.2).otherwise(ramp + over * (x - 1.0))
    return F.when(safe(limit) <= 0, 0.0).otherwise(v)


def penalties() -> dict[str, Column]:
    return {
        "earnings_penalty": half_even(earnings_penalty("days_to_earnings"), 2),
        "cluster_penalty": half_even(concentration_penalty("cluster_exposure_pct", "max_cluster_pct", 20.0, 30.0), 2),
        "super_cluster_penalty": half_even(
            concentration_penalty("super_cluster_exposure_pct", "max_super_cluster_pct", 25.0, 40.0), 2
        ),
    }


def ncs(bqs="bqs", fws="fws", penalty=None) -> Column:
    total = F.lit(0.0) if penalty is None else col(penalty)
    return half_even(clamp(clamp(col(bqs) - 0.8 * col(fws) + 10.0) - F.least(total, F.lit(40.0))), 2)


def action(ncs_="ncs", fws="fws") -> Column:
    return F.when(col(fws) > 65.0, "AUTO_NO").when((col(ncs_) >= 70.0) & (col(fws) <= 30.0), "AUTO_YES").otherwise("CONDITIONAL")


def rank_score(sleeve, status, bqs) -> Column:
    s = col(status)
    total = (
        lookup(sleeve, SLEEVE_PRIORITY, 0.0) + F.when(s == "READY", 30.0).when(s.isin("WATCH", "WAIT_PULLBACK"), 10.0).otherwise(0.0)
        + col(bqs) * 0.5 + F.least(F.col("adx"), F.lit(50.0)) * 0.3 + F.least(F.col("vol_ratio"), F.lit(3.0)) * 5.0
        + F.least(F.col("efficiency"), F.lit(100.0)) * 0.2 + F.least(F.col("rs"), F.lit(100.0)) * 0.1
    )
    return half_even(total, 2)


# -- sizing and gates -------------------------------------------------------------------------

def position_size(equity, entry, stop, sleeve, risk_pct: float = 1.0) -> Column:
    """Struct of shares, risk and cost: risk budget over the stop distance, capped per sleeve."""
    e, s, eq = col(entry), col(stop), col(equity)
    bad = (e <= 0) | (s >= e)
    per = e - s
    want = eq * (risk_pct / 100.0) / per
    cap = eq * (lookup(sleeve, SLEEVE_MAX_PCT, 15.0) / 100.0)
    over = want * e > cap
    shares = F.when(over, cap / e).otherwise(want)
    cost = F.when(over, cap).otherwise(want * e)
    risk = shares * per
    zero = lambda v: F.when(bad, 0.0).otherwise(v)
    return F.struct(
        zero(half_even(shares, 4)).alias("shares"), zero(half_even(risk, 2)).alias("risk_amount"),
        zero(F.when(eq > 0, half_even(risk / eq * 100, 3)).otherwise(0.0)).alias("risk_pct"),
        zero(half_even(cost, 2)).alias("total_cost"),
    )


def risk_gates(sleeve, cost, risk, equity, sector_value, open_risk) -> Column:
    """Array of (name, passed): position size, sector concentration, open risk."""
    pct = lambda v: F.when(col(equity) > 0, v / col(equity) * 100).otherwise(0.0)
    gates = [
        ("position_size_cap", pct(col(cost)) <= lookup(sleeve, SLEEVE_MAX_PCT, 15.0)),
        ("sector_concentration", pct(col(sector_value) + col(cost)) <= 40.0),
        ("open_risk_cap", pct(col(open_risk) + col(risk)) <= 6.0),
    ]
    return F.array(*[F.struct(F.lit(n).alias("name"), p.alias("passed")) for n, p in gates])
