"""Chart patterns on the other five timeframes, over bars that are rolled up level by level."""

from __future__ import annotations

from pyspark.sql import functions as F

from barline.functions.numeric import report
from barline.operators import patterns as P
from barline.plans.indicators import over
from barline.plans.patternplans import keeper
from barline.plans.registry import cte, he, q, query
from barline.plans.sourceplans import _BUCKET

_LEVELS = {"5M": "quotes", "15M": "5M", "30M": "15M", "1H": "30M", "1W": "1D"}
_unit = lambda x: f"greatest(0.0, least(1.0, {x}))"
_sql_bucket = lambda f, ts: _BUCKET[f].replace("quote_ts", ts)
_KEY = "symbol, family, direction"


def _bars_sql(f: str) -> str:
    """The bars of a timeframe straight from ticks or daily bars, not from the level below."""
    if f == "1W":
        rows, first, volume = "(SELECT symbol, bar_date AS ts, open, high, low, close, volume FROM bars)", "ts", "sum(volume)"
    else:
        rows, first, volume = "(SELECT symbol, quote_ts AS ts, event_id, price AS open, price AS high, price AS low, price AS close FROM quotes)", "row(ts, event_id)", "CAST(count(*) AS DOUBLE)"
    return f"""SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY b) - 1 AS idx, count(*) OVER (PARTITION BY symbol) AS n FROM (
  SELECT symbol, {_sql_bucket(f, 'ts')} AS b, min_by(open, {first}) AS open, max(high) AS high, min(low) AS low, max_by(close, {first}) AS close, {volume} AS volume FROM {rows} GROUP BY symbol, b)"""


def _alike(a: str, b: str, atr: str, name: str, o: P.Options) -> str:
    mean = f"((abs({a}) + abs({b})) / 2)"
    return f"""round_even(abs({a} - {b}) / {mean} * 1e8, 0) / 1e8 AS d{name}, greatest(round_even(least(greatest({o.fixed_tolerance}, {atr} * {o.atr_multiplier} / {mean}), {o.max_tolerance}) * 1e8, 0) / 1e8, 1e-12) AS t{name},
  abs({a} - {b}) / {mean} <= least(greatest({o.fixed_tolerance}, {atr} * {o.atr_multiplier} / {mean}), {o.max_tolerance}) + 1e-12 AS ok{name}"""


def _score(geo: str, tim: str, vr: str, distance: str, pivots: str = "1.0") -> str:
    return he(f"100.0 * (0.30 * {pivots} + 0.30 * {_unit(geo)} + 0.15 * {_unit(tim)} + 0.10 * CASE WHEN {vr} IS NULL THEN 0.5 ELSE {_unit(f'{vr} / 1.5')} END + 0.15 * {_unit(f'1 - abs({distance})')})", 1)


def pattern_tables(f: str) -> str:
    """Registers the tables of one timeframe and gives the name of the last one."""
    o, t = P.Options(timeframe=f), f.lower()
    w, need, buffer = o.pivot_window, o.confirm_bars, o.breakout_atr
    span = lambda k: f"i{k} - i0 BETWEEN {o.min_bars} AND {o.max_bars}"

    def table(name: str, needs: str, body: str) -> str:
        cte(f"{name}_{t}", " ".join(needs.split()), body)
        return f"{name}_{t}"

    bars = table("tfb", "bars" if f == "1W" else "quotes", _bars_sql(f))
    pb = table("pb", bars, f"""SELECT *, avg(rg) {over(o.atr_period)} AS atr, volume / avg(CASE WHEN volume > 0 THEN volume END) OVER (PARTITION BY symbol ORDER BY idx ROWS BETWEEN {o.volume_period} PRECEDING AND 1 PRECEDING) AS vr, max(high) OVER c AS mh, min(low) OVER c AS ml
  FROM (SELECT *, greatest(high - low, abs(high - pc), abs(low - pc)) AS rg FROM (SELECT *, lag(close) OVER (PARTITION BY symbol ORDER BY idx) AS pc FROM {bars} WHERE n >= {o.min_bars})) WINDOW c AS (PARTITION BY symbol ORDER BY idx ROWS BETWEEN {w} PRECEDING AND {w} FOLLOWING)""")
    raw = table("rawp", pb, f"""SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY idx, side) AS k FROM (
  SELECT symbol, idx, 0 AS side, low AS price, atr FROM {pb} WHERE low <= ml AND idx >= {w} AND idx < n - {w} UNION ALL SELECT symbol, idx, 1, high, atr FROM {pb} WHERE high >= mh AND idx >= {w} AND idx < n - {w})""")
    pick = lambda c: f"CASE WHEN take THEN r.{c} ELSE w.{c} END"
    walk = table("walkp", raw, f"""SELECT symbol, k, idx, side, price, atr, 1 AS place FROM {raw} WHERE k = 1
  UNION ALL SELECT r.symbol, r.k, {pick('idx')}, {pick('side')}, {pick('price')}, {pick('atr')}, w.place + CASE WHEN take AND r.side <> w.side THEN 1 ELSE 0 END FROM (
  SELECT w.*, CASE WHEN r.side = w.side THEN CASE WHEN r.side = 1 THEN r.price > w.price ELSE r.price < w.price END ELSE r.idx - w.idx >= {o.min_gap} END AS take FROM walkp_{t} w JOIN {raw} r ON r.symbol = w.symbol AND r.k = w.k + 1) w JOIN {raw} r ON r.symbol = w.symbol AND r.k = w.k + 1""")
    piv = table("pivs", walk, f"SELECT symbol, place, max_by(idx, k) AS idx, max_by(side, k) AS side, max_by(price, k) AS price, max_by(atr, k) AS atr FROM {walk} GROUP BY symbol, place")
    leads = ", ".join(f"lead({c}, {k}) OVER w AS {c[0]}{k}" for k in range(1, 5) for c in ("idx", "price", "atr"))
    seq = table("sq", f"{piv} {pb}", f"""SELECT *, {_alike('p0', 'p4', 'a4', 's', o)}, {_alike('p1', 'p3', 'a3', 'n', o)}, {_alike('p0', 'p2', 'a2', 'e', o)}, CASE WHEN side = 0 THEN 1 ELSE -1 END AS sg, CASE WHEN side = 0 THEN p2 < p0 ELSE p2 > p0 END AS head, CASE WHEN side = 0 THEN 'bullish' ELSE 'bearish' END AS dir,
  least(greatest(1, i2 - i0), greatest(1, i4 - i2)) / greatest(greatest(1, i2 - i0), greatest(1, i4 - i2)) AS tim FROM (SELECT symbol, side, n, i, idx AS i0, price AS p0, {leads} FROM (
  SELECT p.*, b.n, place - greatest(0, max(place) OVER (PARTITION BY p.symbol) - {P.RECENT}) - 1 AS i FROM {piv} p JOIN (SELECT DISTINCT symbol, n FROM {pb}) b USING (symbol)) WINDOW w AS (PARTITION BY symbol ORDER BY idx)) WHERE i >= 0""")
    fit = lambda x: f"greatest(0, 1 - d{x} / t{x})"
    shoulders = "CASE WHEN side = 0 THEN 'inverse_head_shoulders' ELSE 'head_shoulders_top' END"
    end = "CASE WHEN side = 0 THEN '_bottom' ELSE '_top' END"
    reversal = f"""SELECT symbol, n, {shoulders} AS pattern, 'head_shoulders' AS family, dir AS direction, 100 * side + i AS ord, sg, i0 AS s, i4 AS e, i4 AS after, i4 AS fin, i1 AS x1, p1 AS y1, i3 AS x2, p3 AS y2, a4 AS av, 0.7 * {fit('s')} + 0.3 * {fit('n')} AS geo, tim, p4 - sg * a4 * 0.25 AS inv, 85.0 AS floor_, abs(p1 + (p3 - p1) / (i3 - i1) * (i2 - i1) - p2) AS ht, FALSE AS now_, 5 AS np, [i0, i1, i2, i3, i4] AS ats
  FROM {seq} WHERE head AND {span(4)} AND oks AND CASE WHEN side = 0 THEN least(p0, p4) - p2 ELSE p2 - greatest(p0, p4) END >= a4 * 0.55
  UNION ALL SELECT symbol, n, 'double' || {end}, 'double_reversal', dir, 200 + 100 * side + i, sg, i0, i2, i2, i2, i1, p1, i2, p1, a2, 1 - de / te, 1.0, (p0 + p2) / 2 - sg * a2 * 0.25, 84.0, abs(p1 - (p0 + p2) / 2), FALSE, 3, [i0, i1, i2] FROM {seq} WHERE {span(2)} AND oke
  UNION ALL SELECT symbol, n, 'triple' || {end}, 'triple_reversal', dir, 400 + 100 * side + i, sg, i0, i4, i4, i4, i1, p1, i3, p3, a4, 1 - (de / te + ds / ts) / 2, tim, (p0 + p2 + p4) / 3 - sg * a4 * 0.25, 84.0, abs(p1 + (p3 - p1) / (i3 - i1) * (n - 1 - i1) - (p0 + p2 + p4) / 3), FALSE, 5, [i0, i1, i2, i3, i4] FROM {seq} WHERE {span(4)} AND oke AND oks"""
    # the last three highs and lows among the ten latest pivots
    at = lambda side, r, c: f"max(CASE WHEN side = {side} AND r = {r} THEN {c} END)"
    fitted = ", ".join(f"{g}(price, idx) FILTER (side = {s}) AS {c}{x}" for s, c in ((1, "h"), (0, "l")) for g, x in (("regr_slope", "s"), ("regr_intercept", "b")))
    tri = table("trs", f"{piv} {pb}", f"""SELECT *, greatest(h2, l2) AS fin, hb + hs * (n - 1) AS up, lb + ls * (n - 1) AS dn, CASE WHEN hs < -f AND ls > f THEN 'symmetrical_triangle' WHEN abs(hs) <= f AND ls > f THEN 'ascending_triangle' WHEN hs < -f AND abs(ls) <= f THEN 'descending_triangle'
  WHEN hs < -f AND ls < -f AND ls > hs THEN 'falling_wedge' WHEN hs > f AND ls > f AND hs > ls THEN 'rising_wedge' END AS kind FROM (SELECT symbol, n, cl, greatest(al, 1e-12) AS a, abs(cl) * 0.0005 AS f, {at(1, 3, 'idx')} AS h0, {at(1, 3, 'price')} AS hp0, {at(1, 1, 'idx')} AS h2, {at(1, 1, 'price')} AS hp2, {at(0, 3, 'idx')} AS l0, {at(0, 3, 'price')} AS lp0, {at(0, 1, 'idx')} AS l2, {at(0, 1, 'price')} AS lp2, {fitted}, list_sort(list(idx))[-5] AS s5
  FROM (SELECT p.*, b.n, b.close AS cl, b.atr AS al, row_number() OVER (PARTITION BY p.symbol, side ORDER BY place DESC) AS r FROM (SELECT *, max(place) OVER (PARTITION BY symbol) - place AS back FROM {piv}) p JOIN {pb} b ON b.symbol = p.symbol AND b.idx = b.n - 1 WHERE back < 10) WHERE r <= 3 GROUP BY symbol, n, cl, al HAVING count(*) = 6) WHERE greatest(h2, l2) - least(h0, l0) BETWEEN {o.min_bars} AND {o.max_bars}""")
    tri = table("trw", tri, f"SELECT *, greatest(up - dn, a * 0.5) AS wd, least(1.0, greatest(0.0, 1 - greatest(up - dn, a * 0.5) / greatest(abs(hp0 - lp0), a))) AS conv FROM {tri} WHERE kind IS NOT NULL")
    sides = [(1, "bullish", 600, "h0, hp0, h2, hp2", "dn - a * 0.25", "'ascending_triangle', 'falling_wedge'"), (-1, "bearish", 601, "l0, lp0, l2, lp2", "up + a * 0.25", "'descending_triangle', 'rising_wedge'")]
    triangles = " UNION ALL ".join(f"SELECT symbol, n, kind, 'triangle_wedge', '{d}', {k}, {g}, s5, fin, fin, fin, {line}, a, 0.7 + conv * 0.3, 0.75, {inv}, 82.0, wd, TRUE, 5, [s5] FROM {tri} WHERE kind IN ('symmetrical_triangle', {own})" for g, d, k, line, inv, own in sides)
    k = max(8, o.min_bars // 2)
    body = f"idx BETWEEN n - {k} AND n - 2"
    con = table("cns", pb, f"""SELECT *, CASE WHEN mv > 0 THEN 1 ELSE -1 END AS sg, greatest(al, abs(cl) * 0.002, 1e-12) AS a FROM (SELECT symbol, n, max(CASE WHEN idx = n - {k + 1} THEN close END) - max(CASE WHEN idx = n - {2 * k} THEN close END) AS mv, max(CASE WHEN idx = n - {2 * k} THEN close END) AS cs, max(CASE WHEN idx = n - 1 THEN close END) AS cl, max(CASE WHEN idx = n - 1 THEN atr END) AS al,
  max(CASE WHEN {body} THEN high END) AS rh, min(CASE WHEN {body} THEN low END) AS rl, regr_slope(CASE WHEN {body} THEN high END, idx) AS sh, regr_slope(CASE WHEN {body} THEN low END, idx) AS sl FROM {pb} WHERE idx >= n - {2 * k} AND n >= {2 * k + 2} GROUP BY symbol, n)""")
    consolidation = f"""SELECT symbol, n, CASE WHEN sg = 1 THEN 'bullish' ELSE 'bearish' END || '_consolidation', 'continuation_consolidation', CASE WHEN sg = 1 THEN 'bullish' ELSE 'bearish' END, CASE WHEN sg = 1 THEN 700 ELSE 800 END, sg, n - {2 * k}, n - 1, n - {need + 1}, n - 2, n - {k}, CASE WHEN sg = 1 THEN rh ELSE rl END, n - 2, CASE WHEN sg = 1 THEN rh ELSE rl END, a, {_unit('1 - (rh - rl) / (a * 4)')}, 0.8, CASE WHEN sg = 1 THEN rl - a * 0.25 ELSE rh + a * 0.25 END, 82.0, abs(mv), FALSE, 4, [n - 1]
  FROM {con} WHERE abs(mv) >= greatest(a * 2, abs(cs) * 0.03) AND rh - rl <= a * 4 AND sg * sh <= a * 0.3 AND sg * sl <= a * 0.3"""
    cand = table("cnd", f"{seq} {tri} {con}", f"{reversal}\n  UNION ALL {triangles}\n  UNION ALL {consolidation}")
    line = lambda x: f"y1 + (y2 - y1) / (x2 - x1) * ({x} - x1)"
    # the first bar that ends a run of ``need`` bars beyond the line
    steps = table("stp", f"{cand} {pb}", f"""SELECT *, coalesce(bo, fin) + 1 AS since FROM (SELECT *, min(CASE WHEN held AND bi >= greatest(after + 1, {need - 1}) THEN bi END) OVER (PARTITION BY symbol, ord) AS bo FROM (SELECT *, min(CAST(sg * bc > sg * ln + ba * {buffer} AS INTEGER)) OVER (PARTITION BY symbol, ord ORDER BY bi ROWS BETWEEN {need - 1} PRECEDING AND CURRENT ROW) = 1 AS held FROM (
  SELECT c.symbol, ord, sg, after, fin, inv, b.idx AS bi, b.close AS bc, b.atr AS ba, b.vr AS bv, {line('b.idx')} AS ln FROM {cand} c JOIN (SELECT symbol AS s2, idx, close, atr, vr FROM {pb}) b ON b.s2 = c.symbol AND b.idx >= after + {2 - need})))""")
    judged = table("jdg", steps, f"SELECT symbol, ord, any_value(bo) AS bo, max(bv) FILTER (bi = bo) AS vr, coalesce(bool_or(sg * bc < sg * inv OR bo IS NOT NULL AND sg * bc < sg * ln - ba * {buffer}) FILTER (bi >= since), FALSE) AS broken FROM {steps} GROUP BY symbol, ord")
    forming = " UNION ALL ".join(f"SELECT symbol, {shoulders}, 'head_shoulders', dir, {base} + 100 * side + i, 'forming', {_score('0.65', '0.65', 'CAST(NULL AS DOUBLE)', '1.0', f'{size} / 5.0')}, i0, i{size - 1}, {size}, NULL, NULL, [{', '.join(f'i{j}' for j in range(size))}], NULL FROM {seq} WHERE head AND {span(size - 1)}" for size, base in ((4, 20), (3, 40)))
    neutral = f"SELECT symbol, kind, 'triangle_wedge', 'neutral', 602, 'awaiting_breakout', {_score('0.7 + conv * 0.3', '0.75', 'CAST(NULL AS DOUBLE)', 'least(abs(up - cl), abs(cl - dn)) / a')}, s5, fin, 5, hp0 + (hp2 - hp0) / (h2 - h0) * (n - 1 - h0), NULL, [s5], NULL FROM {tri} WHERE kind = 'symmetrical_triangle'"
    settled = table("stl", f"{cand} {judged} {pb} {seq} {tri}", f"""SELECT * FROM (SELECT symbol, pattern, family, direction, ord, CASE WHEN broken THEN 'invalidated' WHEN bo IS NOT NULL THEN 'confirmed' WHEN n - 1 - fin > {o.valid_bars} THEN 'expired' ELSE 'awaiting_breakout' END AS status, CASE WHEN bo IS NOT NULL THEN greatest(raw, floor_) ELSE raw END AS score, s, e, np, nk AS neck, bo, ats, {line('CASE WHEN now_ THEN n - 1 ELSE coalesce(bo, after) END')} + sg * ht AS target FROM (
  SELECT *, {_score('geo', 'tim', 'vr', '(nk - cl) / av')} AS raw FROM (SELECT c.*, j.bo, j.vr, coalesce(j.broken, FALSE) AS broken, {line('c.n - 1')} AS nk, b.close AS cl FROM {cand} c LEFT JOIN {judged} j ON j.symbol = c.symbol AND j.ord = c.ord JOIN {pb} b ON b.symbol = c.symbol AND b.idx = b.n - 1))
  UNION ALL {forming} UNION ALL {neutral}) QUALIFY pattern <> 'symmetrical_triangle' OR ord = coalesce(min(CASE WHEN pattern = 'symmetrical_triangle' AND bo IS NOT NULL THEN ord END) OVER (PARTITION BY symbol), 602)""")
    ranked = table("rkd", settled, f"SELECT *, row_number() OVER (PARTITION BY {_KEY} ORDER BY np DESC, CASE status WHEN 'confirmed' THEN 4 WHEN 'awaiting_breakout' THEN 3 WHEN 'forming' THEN 2 WHEN 'invalidated' THEN 1 ELSE 0 END DESC, score DESC, ord) AS k FROM {settled}")
    like = table("lks", ranked, f"""SELECT {_KEY}, k, any_value(pattern) AS pattern, coalesce(list(j) FILTER (list_has_all(eats, ats) AND NOT list_has_all(ats, eats) OR share >= 0.75 OR abs(e - ee) <= {o.dedupe_window} AND (share >= 0.60 OR coalesce(neck <> 0 AND eneck <> 0 AND abs(neck - eneck) / greatest(abs(eneck), 1e-12) <= 0.015, FALSE))), []) AS js
  FROM (SELECT c.*, x.k AS j, x.ats AS eats, x.e AS ee, x.neck AS eneck, greatest(0, least(c.e, x.e) - greatest(c.s, x.s) + 1) / (greatest(c.e, x.e) - least(c.s, x.s) + 1) AS share FROM {ranked} c LEFT JOIN {ranked} x ON x.symbol = c.symbol AND x.family = c.family AND x.direction = c.direction AND x.k < c.k) GROUP BY {_KEY}, k""")
    kept = table("grd", like, f"""SELECT {_KEY}, k, [k] AS kept FROM {like} WHERE k = 1 UNION ALL SELECT l.symbol, l.family, l.direction, l.k, CASE WHEN list_has_any(g.kept, l.js) THEN g.kept ELSE list_append(g.kept, l.k) END FROM grd_{t} g JOIN {like} l ON l.symbol = g.symbol AND l.family = g.family AND l.direction = g.direction AND l.k = g.k + 1""")
    return table("unq", f"{ranked} {like} {kept}", f"""SELECT p.*, related FROM {ranked} p JOIN (SELECT {_KEY}, rep AS k, count(DISTINCT pattern) FILTER (k <> rep) AS related FROM (
  SELECT l.*, CASE WHEN list_contains(kept, k) THEN k ELSE list_min(list_intersect(kept, js)) END AS rep FROM {like} l JOIN (SELECT {_KEY}, max_by(kept, k) AS kept FROM {kept} GROUP BY ALL) g USING ({_KEY})) GROUP BY {_KEY}, rep) r USING ({_KEY}, k)""")


for _f in _LEVELS:
    def _patterns(m, f=_f):
        o = P.Options(timeframe=f)
        d = P.chart_patterns(m.timeframe_bars(f), o, True, keeper(m, o))
        return d.select("symbol", "pattern", "direction", "status", report("score", 1).alias("score"), *[F.col(c).cast("long").alias(c) for c in ("start_idx", "end_idx")], report("neckline").alias("neckline"), F.col("breakout_idx").cast("double").alias("breakout_idx"), report("target").alias("target"), F.size("related").cast("long").alias("related"))

    _last = pattern_tables(_f)
    query(f"chart_patterns_{_f.lower()}", _last, f"SELECT symbol, pattern, direction, status, {q('score', 1)} AS score, CAST(s AS BIGINT) AS start_idx, CAST(e AS BIGINT) AS end_idx, {q('neck')} AS neckline, CAST(bo AS DOUBLE) AS breakout_idx, {q('target')} AS target, related FROM {_last}")(_patterns)
