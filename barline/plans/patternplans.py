"""Pivots and chart patterns."""

import hashlib

from pyspark.sql import Window, functions as F

from barline.functions.numeric import report
from barline.operators import decisions as D, patterns as P
from barline.plans.decisionplans import plan
from barline.plans.indicators import over
from barline.plans.registry import cte, he, q, query
from barline.session import stored

O = P.Options()


def keeper(m, o=O):
    tag = hashlib.sha256(repr(o).encode()).hexdigest()[:10]  # all options
    return lambda df, name: stored(df, f"pattern_{name}_{tag}".lower(), m.path, ["symbol"], ["symbol"])


cte("pbar", "tr", f"SELECT *, avg(coalesce(tr, high - low)) {over(14)} AS atr, volume / avg(CASE WHEN volume > 0 THEN volume END) OVER (PARTITION BY symbol ORDER BY idx ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS vr, max(high) OVER c AS mh, min(low) OVER c AS ml FROM tr WINDOW c AS (PARTITION BY symbol ORDER BY idx ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING)")
cte("rawpiv", "pbar", """SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY idx, side) AS k FROM (SELECT symbol, n, idx, 0 AS side, low AS price, atr FROM pbar WHERE low <= ml AND idx >= 4 AND idx < n - 4 UNION ALL SELECT symbol, n, idx, 1, high, atr FROM pbar WHERE high >= mh AND idx >= 4 AND idx < n - 4)""")
# Walks the raw pivots; a row says which pivot is the latest kept one, and whether it opened a new place.
cte("walk", "rawpiv", """SELECT symbol, k, idx, side, price, atr, 1 AS place FROM rawpiv WHERE k = 1
  UNION ALL SELECT r.symbol, r.k, CASE WHEN take THEN r.idx ELSE w.idx END, CASE WHEN take THEN r.side ELSE w.side END, CASE WHEN take THEN r.price ELSE w.price END, CASE WHEN take THEN r.atr ELSE w.atr END, w.place + CASE WHEN take AND r.side <> w.side THEN 1 ELSE 0 END
  FROM (SELECT w.*, CASE WHEN r.side = w.side THEN CASE WHEN r.side = 1 THEN r.price > w.price ELSE r.price < w.price END ELSE r.idx - w.idx >= 3 END AS take FROM walk w JOIN rawpiv r ON r.symbol = w.symbol AND r.k = w.k + 1) w JOIN rawpiv r ON r.symbol = w.symbol AND r.k = w.k + 1""")
cte("piv", "walk", "SELECT symbol, place, max_by(idx, k) AS idx, max_by(side, k) AS side, max_by(price, k) AS price, max_by(atr, k) AS atr FROM walk GROUP BY symbol, place")


@query("confirmed_pivots", "piv", "SELECT symbol, CAST(idx AS BIGINT) AS idx, CAST(side AS BIGINT) AS side, price, CAST(idx + 4 AS BIGINT) AS confirmed_idx FROM piv")
def _pivots(m):
    d = P.confirmed_pivots(m.bars)
    return d.select("symbol", *[F.col(c).cast("long").alias(c) for c in ("idx", "side", "confirmed_idx")], "price")


def tol(a: str, b: str, atr: str, n: str) -> str:
    return f"abs({a} - {b}) / ((abs({a}) + abs({b})) / 2) AS d{n}, least(greatest(0.015, {atr} * 0.85 / ((abs({a}) + abs({b})) / 2)), 0.045) AS t{n}"


_lead = ", ".join(f"lead({c}, {k}) OVER w AS {c[0]}{k}" for k in range(1, 5) for c in ("idx", "price", "atr"))
cte("seqs", "piv bars", f"""SELECT *, {tol('p0', 'p4', 'a4', 's')}, {tol('p1', 'p3', 'a3', 'n')}, {tol('p0', 'p2', 'a2', 'e')} FROM (SELECT symbol, side, n, last_close, i, idx AS i0, price AS p0, {_lead} FROM (
  SELECT p.*, b.n, b.close AS last_close, place - greatest(0, max(place) OVER (PARTITION BY p.symbol) - 14) - 1 AS i FROM piv p JOIN bars b ON b.symbol = p.symbol AND b.idx = b.n - 1) WINDOW w AS (PARTITION BY symbol ORDER BY i0)) WHERE i >= 0""".replace("ORDER BY i0", "ORDER BY idx"))
_b = "side = 0"
_fit = lambda n: f"greatest(0, 1 - round_even(d{n} * 1e8, 0) / 1e8 / greatest(round_even(t{n} * 1e8, 0) / 1e8, 1e-12))"
_rat = lambda n: f"(round_even(d{n} * 1e8, 0) / 1e8 / greatest(round_even(t{n} * 1e8, 0) / 1e8, 1e-12))"
_sgn = "CASE WHEN side = 0 THEN 1.0 ELSE -1.0 END"
_tim = "least(greatest(1, i2 - i0), greatest(1, i4 - i2)) / greatest(greatest(1, i2 - i0), greatest(1, i4 - i2))"
cte("revcand", "seqs", f"""
SELECT symbol, side, n, last_close, 'hs' AS kind, i, i0, i4 AS iend, i1 AS x1, p1 AS y1, i3 AS x2, p3 AS y2, a4 AS av, 0.7 * {_fit('s')} + 0.3 * {_fit('n')} AS geo, {_tim} AS tim, p4 - {_sgn} * a4 * 0.25 AS inv, 85.0 AS fl, abs(p1 + (p3 - p1) / (i3 - i1) * (i2 - i1) - p2) AS ht FROM seqs
  WHERE i4 IS NOT NULL AND CASE WHEN {_b} THEN p2 < p0 ELSE p2 > p0 END AND i4 - i0 BETWEEN 12 AND 150 AND ds <= ts + 1e-12 AND CASE WHEN {_b} THEN least(p0, p4) - p2 ELSE p2 - greatest(p0, p4) END >= a4 * 0.55
UNION ALL SELECT symbol, side, n, last_close, 'double', i, i0, i2, i1, p1, i2, p1, a2, 1 - {_rat('e')}, 1.0, (p0 + p2) / 2 - {_sgn} * a2 * 0.25, 84.0, abs(p1 - (p0 + p2) / 2) FROM seqs WHERE i2 IS NOT NULL AND i2 - i0 BETWEEN 12 AND 150 AND de <= te + 1e-12
UNION ALL SELECT symbol, side, n, last_close, 'triple', i, i0, i4, i1, p1, i3, p3, a4, 1 - ({_rat('e')} + {_rat('s')}) / 2, {_tim}, (p0 + p2 + p4) / 3 - {_sgn} * a4 * 0.25, 84.0, abs(p1 + (p3 - p1) / (i3 - i1) * (n - 1 - i1) - (p0 + p2 + p4) / 3) FROM seqs
  WHERE i4 IS NOT NULL AND i4 - i0 BETWEEN 12 AND 150 AND de <= te + 1e-12 AND ds <= ts + 1e-12""")
cte("revbars", "revcand pbar", f"""SELECT c.*, b.idx AS bi, b.close AS bc, b.atr AS ba, b.vr AS bv, y1 + (y2 - y1) / (x2 - x1) * (b.idx - x1) AS ln FROM revcand c JOIN (SELECT symbol AS s2, idx, close, atr, vr FROM pbar) b ON b.s2 = c.symbol AND b.idx > c.iend""")
cte("revconf", "revbars", f"SELECT symbol, kind, i, min(bi) FILTER ({_sgn} * bc > {_sgn} * ln + ba * 0.15) AS bo FROM revbars GROUP BY symbol, kind, i")
cte("revjudge", "revbars revconf", f"""SELECT b.symbol, b.kind, b.i, any_value(c.bo) AS bo, max(bv) FILTER (bi = c.bo) AS vr, coalesce(bool_or(({_sgn} * bc < {_sgn} * inv) OR (c.bo IS NOT NULL AND {_sgn} * bc < {_sgn} * ln - ba * 0.15)) FILTER (bi > coalesce(c.bo, iend)), FALSE) AS broken FROM revbars b JOIN revconf c USING (symbol, kind, i) GROUP BY ALL""")
_unit = lambda x: f"greatest(0.0, least(1.0, {x}))"
cte("reversals", "revcand revjudge", f"""SELECT *, CASE WHEN broken THEN 'invalidated' WHEN bo IS NOT NULL THEN 'confirmed' WHEN n - 1 - iend > 30 THEN 'expired' ELSE 'awaiting_breakout' END AS status, CASE WHEN bo IS NOT NULL THEN greatest(raw, fl) ELSE raw END AS score,
  y1 + (y2 - y1) / (x2 - x1) * (coalesce(bo, iend) - x1) + {_sgn} * ht AS target FROM (SELECT c.*, j.bo, j.vr, j.broken, nk, {he(f"100.0 * (0.30 + 0.30 * {_unit('geo')} + 0.15 * {_unit('tim')} + 0.10 * CASE WHEN vr IS NULL THEN 0.5 ELSE {_unit('vr / 1.5')} END + 0.15 * {_unit('1 - abs((nk - last_close) / av)')})", 1)} AS raw
  FROM (SELECT *, y1 + (y2 - y1) / (x2 - x1) * (n - 1 - x1) AS nk FROM revcand) c JOIN revjudge j USING (symbol, kind, i))""")
_name = "CASE kind WHEN 'hs' THEN CASE WHEN side = 0 THEN 'inverse_head_shoulders' ELSE 'head_shoulders_top' END ELSE kind || CASE WHEN side = 0 THEN '_bottom' ELSE '_top' END END"


@query("reversal_patterns", "reversals", f"SELECT symbol, {_name} AS pattern, status, {q('score', 1)} AS score, i0 AS start_idx, iend AS end_idx, {q('nk')} AS neckline, CAST(bo AS DOUBLE) AS breakout_idx, {q('inv')} AS invalidation, {q('target')} AS target FROM reversals")
def _rev(m):
    d = P.chart_patterns(m.bars, O, False, keeper(m)).filter("family in ('head_shoulders', 'double_reversal', 'triple_reversal') and target is not null")
    return shown(d)


@query("interval_overlap", "reversals", f"""SELECT symbol, {_name} AS pattern, i0 AS start_idx, iend AS end_idx, {q('CASE WHEN p0 IS NULL THEN NULL ELSE greatest(0, least(iend, p1) - greatest(i0, p0) + 1) / (greatest(iend, p1) - least(i0, p0) + 1) END')} AS overlap FROM (
  SELECT *, lag(i0) OVER w AS p0, lag(iend) OVER w AS p1 FROM reversals WINDOW w AS (PARTITION BY symbol ORDER BY i0, iend, {_name}))""")
def _overlap(m):
    """Of each reversal the shared part of its bars and those of the one before it; a symbol has a few dozen at most."""
    d = P.chart_patterns(m.bars, O, False, keeper(m)).filter("family in ('head_shoulders', 'double_reversal', 'triple_reversal') and target is not null")
    w = Window.partitionBy("symbol").orderBy("start_idx", "end_idx", "pattern")
    d = d.select("symbol", "pattern", "start_idx", "end_idx", F.lag("start_idx").over(w).alias("p0"), F.lag("end_idx").over(w).alias("p1"))
    share = F.when(F.col("p0").isNotNull(), P.overlap(F.col("start_idx"), F.col("end_idx"), F.col("p0"), F.col("p1")))
    return d.select("symbol", "pattern", F.col("start_idx").cast("long").alias("start_idx"), F.col("end_idx").cast("long").alias("end_idx"), report(share).alias("overlap"))


def shown(d):
    return d.select("symbol", "pattern", "status", report("score", 1).alias("score"), F.col("start_idx").cast("long").alias("start_idx"), F.col("end_idx").cast("long").alias("end_idx"), report("neckline").alias("neckline"),
                    F.col("breakout_idx").cast("double").alias("breakout_idx"), report("invalidation").alias("invalidation"), report("target").alias("target"))


cte("consol", "pbar", """SELECT *, CASE WHEN mv > 0 THEN 1 ELSE -1 END AS sg, greatest(al, abs(cl) * 0.002, 1e-12) AS a FROM (SELECT symbol, n, max(CASE WHEN idx = n - 9 THEN close END) - max(CASE WHEN idx = n - 16 THEN close END) AS mv, max(CASE WHEN idx = n - 16 THEN close END) AS cs, max(CASE WHEN idx = n - 1 THEN close END) AS cl, max(CASE WHEN idx = n - 1 THEN atr END) AS al,
  max(CASE WHEN idx = n - 1 THEN vr END) AS vl, max(CASE WHEN idx BETWEEN n - 8 AND n - 2 THEN high END) AS rh, min(CASE WHEN idx BETWEEN n - 8 AND n - 2 THEN low END) AS rl, regr_slope(CASE WHEN idx BETWEEN n - 8 AND n - 2 THEN high END, idx) AS sh, regr_slope(CASE WHEN idx BETWEEN n - 8 AND n - 2 THEN low END, idx) AS sl
  FROM pbar WHERE idx >= n - 16 GROUP BY symbol, n)""")


cte("consol1", "consol", f"""SELECT *, sg * cl > sg * bd + al * 0.15 AS ok, NOT (sg * cl > sg * bd + al * 0.15) AND sg * cl < sg * inv AS bad,
  {he(f"100.0 * (0.30 + 0.30 * {_unit('1 - (rh - rl) / (a * 4)')} + 0.15 * 0.8 + 0.10 * CASE WHEN sg * cl > sg * bd + al * 0.15 AND vl IS NOT NULL THEN {_unit('vl / 1.5')} ELSE 0.5 END + 0.15 * {_unit('1 - abs(bd - cl) / a')})", 1)} AS raw FROM (
  SELECT *, CASE WHEN sg = 1 THEN rh ELSE rl END AS bd, CASE WHEN sg = 1 THEN rl - a * 0.25 ELSE rh + a * 0.25 END AS inv FROM consol WHERE abs(mv) >= greatest(a * 2, abs(cs) * 0.03) AND rh - rl <= a * 4 AND sg * sh <= a * 0.3 AND sg * sl <= a * 0.3)""")


@query("consolidation_patterns", "consol1", f"""SELECT symbol, CASE WHEN sg = 1 THEN 'bullish_consolidation' ELSE 'bearish_consolidation' END AS pattern, CASE WHEN bad THEN 'invalidated' WHEN ok THEN 'confirmed' ELSE 'awaiting_breakout' END AS status, {q('CASE WHEN ok THEN greatest(82.0, raw) ELSE raw END', 1)} AS score, n - 16 AS start_idx, n - 1 AS end_idx, {q('bd')} AS neckline,
  CAST(CASE WHEN ok THEN n - 1 END AS DOUBLE) AS breakout_idx, {q('inv')} AS invalidation, {q('bd + sg * abs(mv)')} AS target FROM consol1""")
def _cons(m):
    return shown(P.chart_patterns(m.bars, O, False, keeper(m)).filter("family = 'continuation_consolidation'"))


cte("tri0", "piv bars pbar", """SELECT symbol, n, cl, al, max(CASE WHEN side = 1 AND r = 3 THEN idx END) AS h0, max(CASE WHEN side = 1 AND r = 3 THEN price END) AS hp0, max(CASE WHEN side = 1 AND r = 1 THEN idx END) AS h2, max(CASE WHEN side = 1 AND r = 1 THEN price END) AS hp2,
  max(CASE WHEN side = 0 AND r = 3 THEN idx END) AS l0, max(CASE WHEN side = 0 AND r = 3 THEN price END) AS lp0, max(CASE WHEN side = 0 AND r = 1 THEN idx END) AS l2, max(CASE WHEN side = 0 AND r = 1 THEN price END) AS lp2,
  regr_slope(price, idx) FILTER (side = 1) AS hs, regr_intercept(price, idx) FILTER (side = 1) AS hb, regr_slope(price, idx) FILTER (side = 0) AS ls, regr_intercept(price, idx) FILTER (side = 0) AS lb, list_sort(list(idx))[-5] AS s5 FROM (
  SELECT p.*, b.n, b.close AS cl, b.atr AS al, row_number() OVER (PARTITION BY p.symbol, side ORDER BY place DESC) AS r FROM (SELECT *, max(place) OVER (PARTITION BY symbol) - place AS back FROM piv) p JOIN pbar b ON b.symbol = p.symbol AND b.idx = b.n - 1 WHERE back < 10) WHERE r <= 3 GROUP BY symbol, n, cl, al
  HAVING count(*) FILTER (side = 1) = 3 AND count(*) FILTER (side = 0) = 3""")
cte("tri1", "tri0", """SELECT *, greatest(h2, l2) AS en, CASE WHEN hs < -f AND ls > f THEN 'symmetrical_triangle' WHEN abs(hs) <= f AND ls > f THEN 'ascending_triangle' WHEN hs < -f AND abs(ls) <= f THEN 'descending_triangle' WHEN hs < -f AND ls < -f AND ls > hs THEN 'falling_wedge'
  WHEN hs > f AND ls > f AND hs > ls THEN 'rising_wedge' END AS kind, hb + hs * (n - 1) AS up, lb + ls * (n - 1) AS dn FROM (SELECT *, abs(cl) * 0.0005 AS f FROM tri0) WHERE greatest(h2, l2) - least(h0, l0) BETWEEN 12 AND 150""")
cte("tri2", "tri1", """SELECT symbol, n, cl, al, en, s5, kind, up, dn, hp0, lp0, 1 AS sg, h0 AS x1, hp0 AS y1, h2 AS x2, hp2 AS y2, dn - al * 0.25 AS inv FROM tri1 WHERE kind IN ('symmetrical_triangle', 'ascending_triangle', 'falling_wedge')
  UNION ALL SELECT symbol, n, cl, al, en, s5, kind, up, dn, hp0, lp0, -1, l0, lp0, l2, lp2, up + al * 0.25 FROM tri1 WHERE kind IN ('symmetrical_triangle', 'descending_triangle', 'rising_wedge')
  UNION ALL SELECT symbol, n, cl, al, en, s5, kind, up, dn, hp0, lp0, 0, h0, hp0, h2, hp2, NULL FROM tri1 WHERE kind = 'symmetrical_triangle'""")
cte("tri3", "tri2 pbar", """SELECT t.*, b.idx AS bi, b.close AS bc, b.atr AS ba, b.vr AS bv, y1 + (y2 - y1) / (x2 - x1) * (b.idx - x1) AS ln FROM tri2 t JOIN (SELECT symbol AS s2, idx, close, atr, vr FROM pbar) b ON b.s2 = t.symbol AND b.idx > t.en""")
cte("tri4", "tri3", "SELECT symbol, sg, min(bi) FILTER (sg <> 0 AND sg * bc > sg * ln + ba * 0.15) AS bo FROM tri3 GROUP BY symbol, sg")
cte("tri5", "tri3 tri4", """SELECT t.symbol, t.sg, any_value(c.bo) AS bo, max(bv) FILTER (bi = c.bo) AS vr, coalesce(bool_or((t.sg * bc < t.sg * inv) OR (c.bo IS NOT NULL AND t.sg * bc < t.sg * ln - ba * 0.15)) FILTER (t.sg <> 0 AND bi > coalesce(c.bo, en)), FALSE) AS broken
  FROM tri3 t JOIN tri4 c USING (symbol, sg) GROUP BY t.symbol, t.sg""")
cte("tri6", "tri2 tri5", f"""SELECT *, 100.0 * (0.30 + 0.30 * {_unit('0.7 + conv * 0.3')} + 0.15 * 0.75 + 0.10 * CASE WHEN vr IS NULL THEN 0.5 ELSE {_unit('vr / 1.5')} END + 0.15 * {_unit("1 - CASE WHEN sg = 0 THEN least(abs(up - cl), abs(cl - dn)) ELSE abs(nk - cl) END / al")}) AS raw0 FROM (
  SELECT t.*, j.bo, j.vr, j.broken, y1 + (y2 - y1) / (x2 - x1) * (n - 1 - x1) AS nk, greatest(up - dn, al * 0.5) AS wd, least(1.0, greatest(0.0, 1 - greatest(up - dn, al * 0.5) / greatest(abs(hp0 - lp0), al))) AS conv FROM tri2 t JOIN tri5 j USING (symbol, sg))""")


@query("triangle_patterns", "tri6", f"""SELECT symbol, kind AS pattern, CASE WHEN broken THEN 'invalidated' WHEN bo IS NOT NULL THEN 'confirmed' WHEN sg <> 0 AND n - 1 - en > 30 THEN 'expired' ELSE 'awaiting_breakout' END AS status, {q("CASE WHEN bo IS NOT NULL THEN greatest(82.0, " + he('raw0', 1) + ") ELSE " + he('raw0', 1) + " END", 1)} AS score,
  CAST(s5 AS BIGINT) AS start_idx, en AS end_idx, {q('nk')} AS neckline, CAST(bo AS DOUBLE) AS breakout_idx, {q('inv')} AS invalidation, CASE WHEN sg <> 0 THEN {q('nk + sg * wd')} END AS target
  FROM (SELECT *, CASE WHEN kind <> 'symmetrical_triangle' THEN 1 ELSE row_number() OVER (PARTITION BY symbol ORDER BY CASE WHEN sg = 0 THEN 1 WHEN bo IS NULL THEN 2 ELSE 0 END, sg DESC) END AS pick FROM tri6) WHERE pick = 1""")
def _tri(m):
    return shown(P.chart_patterns(m.bars, O, False, keeper(m)).filter("family = 'triangle_wedge'"))


_dir = "CASE WHEN side = 0 THEN 'bullish' ELSE 'bearish' END"
_hs = "CASE WHEN side = 0 THEN 'inverse_head_shoulders' ELSE 'head_shoulders_top' END"
_score = lambda size: he(f"100.0 * (0.30 * {size} / 5.0 + 0.30 * 0.65 + 0.15 * 0.65 + 0.10 * 0.5)", 1)
_form = lambda size, base: f"""SELECT symbol, n, side, i, {size} AS np, {base} + 100 * side + i AS ord, i0, i{size - 1} AS iend, p0, a{size - 1} AS av, {_score(size)} AS score, [{', '.join(f'i{k}' for k in range(size))}] AS ats, {'side' if size == 4 else '1 - side'} AS next_side
  FROM seqs WHERE CASE WHEN side = 0 THEN p2 < p0 ELSE p2 > p0 END AND i{size - 1} - i0 BETWEEN 12 AND 150"""  # noqa: E731
cte("forming", "seqs", _form(4, 20) + "\nUNION ALL " + _form(3, 40))


@query("forming_patterns", "forming", f"SELECT symbol, {_hs} AS pattern, CAST(np AS BIGINT) AS points, {q('score', 1)} AS score, CAST(i0 AS BIGINT) AS start_idx, CAST(iend AS BIGINT) AS end_idx, CAST(next_side AS BIGINT) AS next_side, {q('p0 - av * 0.75')} AS expected_low, {q('p0 + av * 0.75')} AS expected_high FROM forming")
def _forming(m):
    """Head-and-shoulders of three or four pivots, with the side and the price range of the pivot that they wait for."""
    d = P.chart_patterns(m.bars, O, False, keeper(m)).filter("status = 'forming'")
    return d.select("symbol", "pattern", F.col("n_points").cast("long").alias("points"), report("score", 1).alias("score"), *[F.col(c).cast("long").alias(c) for c in ("start_idx", "end_idx", "next_side")], report("expected_low").alias("expected_low"), report("expected_high").alias("expected_high"))


_rank = "CASE status WHEN 'confirmed' THEN 4 WHEN 'awaiting_breakout' THEN 3 WHEN 'forming' THEN 2 WHEN 'invalidated' THEN 1 ELSE 0 END"
cte("allpat", "reversals seqs forming tri6 consol1", f"""SELECT *, {_rank} AS srank FROM (
  SELECT r.symbol, {_name.replace("kind", "r.kind").replace("side", "r.side")} AS pattern, CASE kind WHEN 'hs' THEN 'head_shoulders' ELSE kind || '_reversal' END AS family, {_dir.replace("side", "r.side")} AS direction, CASE kind WHEN 'hs' THEN 0 WHEN 'double' THEN 200 ELSE 400 END + 100 * r.side + r.i AS ord, status, score, r.i0 AS s, iend AS e, CASE kind WHEN 'double' THEN 3 ELSE 5 END AS np,
  nk AS neck, CASE kind WHEN 'double' THEN [q.i0, i1, i2] ELSE [q.i0, i1, i2, i3, i4] END AS ats, target FROM reversals r JOIN seqs q ON q.symbol = r.symbol AND q.i = r.i
  UNION ALL SELECT symbol, {_hs}, 'head_shoulders', {_dir}, ord, 'forming', score, i0, iend, np, NULL, ats, NULL FROM forming
  UNION ALL SELECT symbol, kind, 'triangle_wedge', CASE sg WHEN 1 THEN 'bullish' WHEN -1 THEN 'bearish' ELSE 'neutral' END, CASE sg WHEN 1 THEN 600 WHEN -1 THEN 601 ELSE 602 END, CASE WHEN broken THEN 'invalidated' WHEN bo IS NOT NULL THEN 'confirmed' WHEN sg <> 0 AND n - 1 - en > 30 THEN 'expired' ELSE 'awaiting_breakout' END,
  CASE WHEN bo IS NOT NULL THEN greatest(82.0, {he('raw0', 1)}) ELSE {he('raw0', 1)} END, s5, en, 5, nk, [s5], CASE WHEN sg <> 0 THEN nk + sg * wd END FROM (SELECT *, CASE WHEN kind <> 'symmetrical_triangle' THEN 1 ELSE row_number() OVER (PARTITION BY symbol ORDER BY CASE WHEN sg = 0 THEN 1 WHEN bo IS NULL THEN 2 ELSE 0 END, sg DESC) END AS pick FROM tri6) WHERE pick = 1
  UNION ALL SELECT symbol, CASE WHEN sg = 1 THEN 'bullish_consolidation' ELSE 'bearish_consolidation' END, 'continuation_consolidation', CASE WHEN sg = 1 THEN 'bullish' ELSE 'bearish' END, CASE WHEN sg = 1 THEN 700 ELSE 800 END, CASE WHEN bad THEN 'invalidated' WHEN ok THEN 'confirmed' ELSE 'awaiting_breakout' END, CASE WHEN ok THEN greatest(82.0, raw) ELSE raw END, n - 16, n - 1, 4, bd, [n - 1], bd + sg * abs(mv) FROM consol1)""")
# Like patterns: which earlier ones (by points, status and score) each is like, and a walk that keeps those like none kept before.
cte("patk", "allpat", "SELECT *, row_number() OVER (PARTITION BY symbol, family, direction ORDER BY np DESC, srank DESC, score DESC, ord) AS k FROM allpat")
cte("likes", "patk", """SELECT symbol, family, direction, k, any_value(pattern) AS pattern, coalesce(list(j) FILTER (list_has_all(eats, ats) AND NOT list_has_all(ats, eats) OR share >= 0.75 OR abs(e - ee) <= 8 AND (share >= 0.60 OR coalesce(neck <> 0 AND eneck <> 0 AND abs(neck - eneck) / greatest(abs(eneck), 1e-12) <= 0.015, FALSE))), []) AS js
  FROM (SELECT c.*, x.k AS j, x.ats AS eats, x.e AS ee, x.neck AS eneck, greatest(0, least(c.e, x.e) - greatest(c.s, x.s) + 1) / (greatest(c.e, x.e) - least(c.s, x.s) + 1) AS share FROM patk c LEFT JOIN patk x ON x.symbol = c.symbol AND x.family = c.family AND x.direction = c.direction AND x.k < c.k) GROUP BY symbol, family, direction, k""")
cte("greedy", "likes", """SELECT symbol, family, direction, k, [k] AS kept FROM likes WHERE k = 1
  UNION ALL SELECT l.symbol, l.family, l.direction, l.k, CASE WHEN list_has_any(g.kept, l.js) THEN g.kept ELSE list_append(g.kept, l.k) END FROM greedy g JOIN likes l ON l.symbol = g.symbol AND l.family = g.family AND l.direction = g.direction AND l.k = g.k + 1""")
cte("reps", "likes greedy", """SELECT l.symbol, l.family, l.direction, l.k, l.pattern, CASE WHEN list_contains(kept, k) THEN k ELSE list_min(list_intersect(kept, js)) END AS rep FROM likes l JOIN (SELECT symbol, family, direction, max_by(kept, k) AS kept FROM greedy GROUP BY ALL) g USING (symbol, family, direction)""")
cte("uniq", "patk reps", """SELECT p.*, r.related FROM patk p JOIN (SELECT symbol, family, direction, rep AS k, count(DISTINCT pattern) FILTER (k <> rep) AS related FROM reps GROUP BY symbol, family, direction, rep) r USING (symbol, family, direction, k)""")


@query("chart_patterns", "uniq", f"SELECT symbol, pattern, direction, status, {q('score', 1)} AS score, CAST(e AS BIGINT) AS end_idx, related FROM uniq")
def _chart(m):
    d = P.chart_patterns(m.bars, O, True, keeper(m))
    return d.select("symbol", "pattern", "direction", "status", report("score", 1).alias("score"), F.col("end_idx").cast("long").alias("end_idx"), F.size("related").cast("long").alias("related"))


@query("first_patterns", "uniq", f"SELECT symbol, pattern, status, {q('score', 1)} AS score FROM uniq QUALIFY row_number() OVER (PARTITION BY symbol, pattern ORDER BY e DESC, srank DESC, score DESC, np DESC, ord) = 1")
def _firstp(m):
    d = P.first_per_type(P.chart_patterns(m.bars, O, True, keeper(m)))
    return d.select("symbol", "pattern", "status", report("score", 1).alias("score"))


cte("ptarget", "uniq plan tp", f"""SELECT symbol, level, count(*) AS matches, count(*) FILTER (status = 'confirmed' AND weight >= 0.70) AS raises FROM (
  SELECT t.symbol, t.ord, t.status, t.weight, t.reach, min_by(l.level, (d, l.level)) AS level, min(d) AS dist FROM (SELECT u.symbol, u.ord, u.status, u.target, {he("score / 100.0 * CASE WHEN status = 'confirmed' THEN 1.0 ELSE 0.55 END", 3)} AS weight, greatest(abs(p.atr) * 0.75, abs(p.close) * 0.005) AS reach FROM uniq u JOIN plan p USING (symbol) WHERE u.direction = 'bullish' AND u.target > p.close) t
  JOIN (SELECT symbol, profile || '-' || CAST(lvl AS VARCHAR) AS level, price FROM tp) l ON l.symbol = t.symbol, LATERAL (SELECT abs(l.price - t.target) AS d) GROUP BY t.symbol, t.ord, t.status, t.weight, t.reach) WHERE dist <= reach GROUP BY symbol, level""")


@query("pattern_targets", "ptarget tp", f"""SELECT symbol, level, {q('price')} AS price, CASE WHEN raises > 0 THEN {q(he('least(97.0, cp + 2.0 * raises)', 1), 1)} ELSE {q('cp', 1)} END AS prob_pct, coalesce(matches, 0) AS matches, coalesce(matches, 0) > 0 AS pattern_confluence
  FROM (SELECT symbol, profile || '-' || CAST(lvl AS VARCHAR) AS level, price, cp FROM tp) LEFT JOIN ptarget USING (symbol, level)""")
def _targets(m):
    p = plan(m)
    levels = D.take_profit_levels(p).select("symbol", F.concat_ws("-", "profile", F.col("level").cast("string")).alias("level"), "price", F.col("hit_prob_pct").alias("prob_pct"))
    state = p.select("symbol", F.col("close").alias("current_price"), "atr")
    out, _judged = P.merge_targets(levels, P.chart_patterns(m.bars, O, True, keeper(m)), state)
    return out.select("symbol", "level", report("price").alias("price"), report("prob_pct", 1).alias("prob_pct"), F.col("matches").cast("long").alias("matches"), "pattern_confluence")


@query("price_tolerance", "pbar", f"SELECT symbol, idx AS bar_idx, {q('round_even(d1 * 1e8, 0) / 1e8', 6)} AS difference, {q('round_even(t1 * 1e8, 0) / 1e8', 6)} AS tolerance, d1 <= t1 + 1e-12 AS alike FROM (SELECT symbol, idx, {tol('close', 'p', 'atr', '1')} FROM (SELECT *, lag(close, 5) OVER (PARTITION BY symbol ORDER BY idx) AS p FROM pbar) WHERE p IS NOT NULL)")
def _tol(m):
    from barline.operators import indicators as ind
    from barline.series import back, own_rows, segmented

    d = own_rows(ind.with_atr_simple(segmented(m.bars, 30), 14, "atr").withColumn("p", back("close", 5))).filter("p is not null")
    d = d.withColumn("t", P.tolerance_struct(F.col("close"), F.col("p"), F.col("atr"), O))
    return d.select("symbol", F.col("bar_idx").cast("long").alias("bar_idx"), report("t.diff", 6).alias("difference"), report("t.tol", 6).alias("tolerance"), F.col("t.ok").alias("alike"))
