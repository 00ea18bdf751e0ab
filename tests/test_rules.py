"""Row rules at their edges."""

import pytest
from pyspark.sql import Row, functions as F

from barline.functions import calendar as C, scores as S, text as T
from barline.operators import decisions as D, patterns as P
from barline.operators.quantiles import exact_quantiles
from barline.operators.rank import evenly_spaced, screener
from barline.sources import readers as R


def one(spark, **cols):
    names = {k: v for k, v in cols.items()}
    return spark.createDataFrame([Row(x=1)]).select(*[v.alias(k) for k, v in names.items()]).first()


def test_quality_ties_round_to_even(spark):
    rows = [(None, None, 2.0, "low?"), (0.2, None, 2.0, None), (0.2, 0.1, None, None), (None, None, None, None)]
    d = spark.createDataFrame([(i, r[0], r[1], r[2], 0.0, "Tech") for i, r in enumerate(rows)], "i int, roe double, revenue_growth double, debt_to_equity double, return_on_assets double, sector string")
    t = [r.quality_tier for r in d.withColumns(S.quality()).orderBy("i").collect()]
    # 1.0 -> low, 1.5 -> 2 medium, 2.5 -> 2 medium, nothing known -> unknown
    assert t == ["low", "medium", "medium", "unknown"]


def test_financials_use_return_on_assets(spark):
    d = spark.createDataFrame([(0.2, 0.1, 9.0, 0.02, "Real Estate")], "roe double, revenue_growth double, debt_to_equity double, return_on_assets double, sector string")
    assert d.withColumns(S.quality()).first().quality_tier == "high"


def test_zero_scores_read_as_missing(spark):
    scan = spark.createDataFrame([(1, "READY", "CONDITIONAL", 0.0, 60.0, 20.0)], "symbol long, status string, action string, ncs double, bqs double, fws double")
    an = spark.createDataFrame([(1, "neutral", "hold", "medium", None, None, None, None, None)], "symbol long, news_sentiment string, recommendation string, confidence string, h_ncs double, h_bqs double, h_fws double, h_regime string, h_action string")
    model = spark.createDataFrame([(1, 50.0)], "symbol long, model_score double")
    r = D.cross_reference(scan, an, model).first()
    assert r.ncs_score == 50.0 and r.model_score == 50.0 and r.penalties == {}


def test_same_bar_stop_before_target_and_gap_fills(spark):
    assert one(spark, t=S.candidate_status(F.lit(100.0), F.lit(102.0)), w=S.candidate_status(F.lit(100.0), F.lit(103.0)), f=S.candidate_status(F.lit(100.0), F.lit(103.1))) == Row(t="READY", w="WATCH", f="FAR")


@pytest.mark.parametrize("utc,want", [
    ("2026-07-06 13:29:00", "pre_market"), ("2026-07-06 13:30:00", "regular"), ("2026-07-03 15:00:00", "closed"), ("2026-11-27 18:30:00", "after_hours"), ("2026-11-27 17:59:00", "regular"),
    ("2026-07-06 04:30:00", "overnight"), ("2026-07-05 05:00:00", "closed"), ("2026-07-11 05:00:00", "overnight"), ("2026-01-06 14:29:00", "pre_market"),
])
def test_sessions(spark, utc, want):
    assert one(spark, s=C.session(F.to_timestamp(F.lit(utc)))).s == want


def test_session_projection_skips_holidays(spark):
    d = spark.createDataFrame([("2026-07-24", 172)], "s string, k int").withColumn("s", F.to_date("s"))
    assert str(C.project_sessions(d, "s", "k").first().session_date) == "2027-04-01"


def test_ticks(spark):
    cases = [(999, "KOSPI", 1), (1000, "KOSPI", 5), (5000, "KOSPI", 10), (10000, "KOSPI", 50), (50000, "KOSPI", 100), (100000, "KOSPI", 500), (500000, "KOSPI", 1000), (500000, "KOSDAQ", 100)]
    d = spark.createDataFrame([(i, float(p), b) for i, (p, b, _) in enumerate(cases)], "i int, p double, b string").withColumn("t", D.tick_size("p", "b"))
    assert [r.t for r in d.orderBy("i").collect()] == [w for *_x, w in cases]


def test_tolerance_edges(spark):
    o = P.Options()
    f = lambda a, b, atr, o=o: P.tolerance_struct(F.lit(a), F.lit(b), F.lit(atr), o)
    r = one(spark, a=f(100.0, 101.0, 0.1), b=f(100.0, 102.0, 0.1), c=f(100.0, 102.0, 2.0), d=f(100.0, 104.9, 100.0), z=f(0.0, 0.0, 1.0))
    assert r.a.ok and not r.b.ok and not r.c.ok and not r.d.ok and not r.z.ok
    assert r.a.tol == 0.015 and r.d.tol == 0.045
    with pytest.raises(ValueError):
        P.Options(timeframe="2D")
    with pytest.raises(ValueError):
        P.Options(tolerance_mode="loose")
    assert P.resolve_timeframe("6mo") == "1D" and P.resolve_timeframe("15m") == "15M"
    with pytest.raises(ValueError):
        P.resolve_timeframe("9y")


def test_sentiment_flip_and_negation(spark):
    texts = ["우려 해소 기대", "not strong growth", "earnings beat, record high", "plain words", None]
    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, title string")
    s = [r.score for r in T.with_sentiment(d, "title").orderBy("i").collect()]
    assert s[0] > 0 and s[1] < 0 and s[2] == 1.0 and s[3] == 0.0 and s[4] == 0.0


def test_news_times(spark):
    raw = ["Mon, 02 Jun 2025 09:00:00 GMT", "2025.06.02 09:00", "2025-06-02 09:00:00", "2025.06.02", "later"]
    d = spark.createDataFrame([(i, t) for i, t in enumerate(raw)], "i int, t string").withColumn("p", T.parse_time("t"))
    assert [str(r.p) for r in d.orderBy("i").collect()] == ["2025-06-02 09:00:00"] * 3 + ["2025-06-02 00:00:00", "None"]


def test_interval_and_caps(spark):
    sc = F.array(F.lit(20.0), F.lit(90.0))
    r = one(spark, **D.disagreement(sc), cap=D.earnings_cap(F.lit(1)), none=D.earnings_cap(F.lit(None).cast("int")))
    assert (r.spread_penalty, r.spread_cap, r.cap, r.none) == (12, 55, 60, 100)


def test_surge_needs_intraday_flow(spark):
    f = lambda intraday, change=3.0: D.surge_score(F.lit(1e5), F.lit(2.0), F.lit(change), F.lit(0.5), F.lit(1.0), F.lit(intraday), F.lit(60.0))
    assert one(spark, **f(False)).flow_pts == 0 and one(spark, **f(True)).flow_pts == 12
    assert one(spark, **f(True, 25.0)).surge_score == -1


def test_quantiles_of_large_skewed_group(spark):
    import numpy as np

    n = 120_000
    d = spark.range(n).select((F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 7)).alias("k"), F.pow(F.rand(5), 9.0).alias("v"))
    d = d.cache()
    got = {r.k: r for r in exact_quantiles(d, ["k"], {"v": F.col("v")}, [0.0, 0.05, 1 / 3, 0.5, 1.0]).collect()}
    pdf = d.toPandas()
    for k, g in pdf.groupby("k"):
        want = np.quantile(g.v, [0.0, 0.05, 1 / 3, 0.5, 1.0])
        row = got[k]
        assert np.allclose([row.v_0, row.v_5, row["v_33_3333"], row.v_50, row.v_100], want, rtol=1e-12)


def test_quantiles_of_a_hot_group(spark):
    n = 10_000_000
    d = spark.range(n).select(F.lit(1).alias("k"), ((F.col("id") * 2654435761) % n).cast("double").alias("v"))  # every number below n once
    row = exact_quantiles(d, ["k"], {"v": F.col("v")}, [0.25, 0.5, 0.999]).first()
    assert [row.v_25, row.v_50, row["v_99_9"]] == [pytest.approx((n - 1) * p, rel=1e-12) for p in (0.25, 0.5, 0.999)]


def test_rolled_up_bars_equal_bars_of_the_ticks(spark):
    t = F.timestamp_seconds(F.lit(1_700_000_000) + (F.col("id") * 7919) % 400_000)
    ticks = spark.range(3000).select((F.col("id") % 3).alias("symbol"), t.alias("quote_ts"), ((F.col("id") * 37) % 101).cast("double").alias("price"), F.col("id").alias("event_id"))
    bars = R.build_bars(ticks, "5M")
    for freq in ("15M", "30M", "1H"):
        bars = R.roll_up(bars, freq)
        assert sorted(bars.collect()) == sorted(R.build_bars(ticks, freq).collect())


def test_quantiles_of_small_groups_ties_and_nulls(spark):
    import numpy as np

    rows = [(k, v, w) for k in (1, 2, 3, 4, 10, 57, None) for v, w in [(float((i * 7919) % 5 if (k or 0) > 9 else i * i), None if k == 3 else float(i)) for i in range(k or 6)]]
    probs = [0.0, 0.1, 0.25, 0.5, 2 / 3, 0.9, 1.0]
    names = ["0", "10", "25", "50", "66_6667", "90", "100"]
    d = spark.createDataFrame(rows, "k int, v double, w double")
    got = {r.k: r for r in exact_quantiles(d, ["k"], {"v": F.col("v"), "w": F.col("w")}, probs).collect()}
    assert set(got) == {r[0] for r in rows}
    for k, row in got.items():
        for c, i in (("v", 1), ("w", 2)):
            of = [r[i] for r in rows if r[0] == k and r[i] is not None]
            want = np.quantile(of, probs) if of else [None] * len(probs)
            assert [row[f"{c}_{n}"] for n in names] == [x if x is None else pytest.approx(x, rel=1e-12) for x in want]
    all_of = exact_quantiles(d, [], {"v": F.col("v")}, [0.5]).first()
    assert all_of.v_50 == np.quantile([r[1] for r in rows], 0.5)


def test_screener_and_even_sample(spark):
    d = spark.createDataFrame([(i, float(i % 4) if i % 5 else None) for i in range(40)], "symbol long, v double")
    assert screener(d, "v").first().v == 3.0
    assert [r.symbol for r in evenly_spaced(d.select("symbol"), "symbol", 4).orderBy("symbol").collect()] == [0, 13, 26, 39]
    with pytest.raises(ValueError):
        screener(d, "nope")


def test_journal_and_report_round_trip(spark, tmp_path):
    j = spark.createDataFrame([("prediction", "a|1", "a", "US", 100.0, 2.0, 40)], "type string, id string, symbol string, market string, current double, atr double, risk_score long")
    j = j.withColumn("signal_date", F.to_date(F.lit("2026-01-05"))).withColumn("bands", F.struct(F.array(F.lit(90.0), F.lit(95.0)).alias("primary"), F.array(F.lit(80.0), F.lit(85.0)).alias("secondary")))
    for _ in range(2):
        R.append_journal(j, str(tmp_path / "j"))
    back = R.read_journal(spark, str(tmp_path / "j"))
    assert back.count() == 2 and back.first().bands.primary == [90.0, 95.0]
    R.write_report(j.drop("bands"), str(tmp_path / "r"), "csv")
    assert (tmp_path / "r" / "market=US").exists()
    bars = spark.createDataFrame([("A", 1.0, 2.0, 0.5, 1.5, 9.0), ("B", None, 2.0, 0.5, 1.5, 9.0)], "symbol string, Open double, High double, Low double, Close double, Volume double")
    bars.write.parquet(str(tmp_path / "b"))
    assert [r.symbol for r in R.read_bars(spark, str(tmp_path / "b")).collect()] == ["A"]
    with pytest.raises(ValueError):
        R.bucket_start(F.lit(1), "2H")


def test_stored_patterns_tell_options_apart(spark):
    from types import SimpleNamespace

    from barline.operators.patterns import Options
    from barline.plans.patternplans import keeper

    m = SimpleNamespace(path="/options")
    rows = [keeper(m, Options(fixed_tolerance=t))(spark.createDataFrame([(1, t)], "symbol long, t double"), "frame").collect() for t in (0.01, 0.02)]
    assert [r[0].t for r in rows] == [0.01, 0.02]
