"""A stream ends with the rows of its batch form, but for windows still open behind the watermark."""

from datetime import timedelta

import pytest
from pyspark.sql import Row, functions as F

from barline.streaming import live as L

from tables import SF


@pytest.fixture(scope="module")
def feed(spark, tmp_path_factory):
    """The ticks in three files, in order of time."""
    folder = tmp_path_factory.mktemp("feed")
    e = spark.read.parquet(f"{SF}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    for i, (a, b) in enumerate((("2024-01-01", "2024-01-11"), ("2024-01-11", "2024-01-21"), ("2024-01-21", "2024-02-05"))):
        e.filter((F.col("ts") >= a) & (F.col("ts") < b)).coalesce(1).write.parquet(str(folder / f"part{i}"))
        for f in (folder / f"part{i}").glob("*.parquet"):
            f.rename(folder / f"events{i}.parquet")
    return str(folder)


def run(df, name, mode="append"):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    return df.sparkSession.table(name)


def rows(df):
    return sorted(map(str, df.collect()))


def batch(spark, feed):
    return L.ticks(spark.read.parquet(f"{feed}/events*.parquet"))


@pytest.mark.parametrize("name,op,end", [
    ("s_bars", L.live_bars, "bar_ts + interval 1 hour"), ("s_slide", L.sliding_turnover, "window_start + interval 4 hours"), ("s_sess", L.activity_sessions, "session_end"),
])
def test_window_twins(spark, feed, name, op, end):
    got = run(op(L.tick_stream(spark, feed)), name)
    t = batch(spark, feed)
    limit = t.agg(F.max("quote_ts") - F.expr("interval 10 minutes")).first()[0]
    # A window that ends just behind the last watermark may still be open. The filter is applied to the
    # collected rows: Spark pushes a filter on a session's end below the merging of sessions.
    every = op(t).select(*got.columns, F.expr(end).alias("_end")).collect()
    names = got.columns

    def done(minutes):
        rows_ = [r for r in every if r["_end"] <= limit - timedelta(minutes=minutes)]
        return {str(Row(**{c: r[c] for c in names})) for r in rows_}

    have = rows(got)
    assert done(5) <= set(have) <= done(0) and len(have) == len(set(have)) > 100


def test_records_once(spark, feed):
    got = run(L.record_once(L.recommendations(L.tick_stream(spark, feed))), "s_once")
    want = L.record_once(L.recommendations(batch(spark, feed)))
    assert rows(got.select("rec_id")) == rows(want.select("rec_id"))


def test_checkpoint_twin(spark, feed):
    got = run(L.checkpoints(L.recommendations(L.tick_stream(spark, feed)), L.tick_stream(spark, feed)), "s_check").toPandas()
    want = L.checkpoints(L.recommendations(batch(spark, feed)), batch(spark, feed)).toPandas()
    key = ["rec_id", "checkpoint", "status", "seen_ts", "return_pct"]
    a, b = set(map(str, got[key].itertuples(index=False, name=None))), set(map(str, want[key].itertuples(index=False, name=None)))
    assert a <= b and len(a) > 0.9 * len(b)


def test_stateless_twins(spark, feed):
    flags = spark.createDataFrame([(1, True), (2, False)], "symbol long, blocked boolean")
    f = lambda t: L.tagged(L.with_flags(t, flags)).select("event_id", "session", "blocked")
    assert rows(run(f(L.tick_stream(spark, feed)), "s_tag")) == rows(f(batch(spark, feed)))


def test_ledger_twin(spark, feed):
    got = run(L.live_ledger(L.ledger_events(L.tick_stream(spark, feed))), "s_ledger", "update").toPandas()
    final = got.groupby("position_id").tail(1).set_index("position_id")
    want = L.ledger(L.ledger_events(batch(spark, feed))).toPandas().set_index("position_id")
    assert set(want.index) == set(final[final.status != "NONE"].index)
    for i, r in want.iterrows():
        g = final.loc[i]
        assert (g.entry_price, g.status, g.updates) == (r.entry_price, r.status, r.updates)
        for c in ("stop_price", "last_price", "close_price"):
            assert g[c] == r[c] or (g[c] != g[c] and r[c] != r[c])


def test_closed_positions_leave_the_state(spark, feed):
    left = {}
    for days in (1, 365):
        df = L.live_ledger(L.ledger_events(L.tick_stream(spark, feed)), keep_days=days)
        q = df.writeStream.outputMode("update").format("memory").queryName(f"s_ledger_{days}").trigger(availableNow=True).start()
        assert q.awaitTermination(120)
        left[days] = q.lastProgress["stateOperators"][0]["numRowsTotal"]
    assert spark.table("s_ledger_365").where("status = 'CLOSED'").count() > 0
    assert left[1] < left[365]


def test_running_summary_updates(spark, feed):
    done = batch(spark, feed).select(F.when(F.col("event_type") == "error", "unobservable").otherwise("completed").alias("status"), F.lit("m30").alias("checkpoint"), F.col("price").alias("return_pct"), "quote_ts")
    live = L.tick_stream(spark, feed).select(F.when(F.col("event_type") == "error", "unobservable").otherwise("completed").alias("status"), F.lit("m30").alias("checkpoint"), F.col("price").alias("return_pct"))
    got = run(L.running_summary(live), "s_sum", "update").toPandas().tail(1)
    want = L.running_summary(done).toPandas()
    assert got.completed.iloc[0] == want.completed.iloc[0] and got.unobservable.iloc[0] == want.unobservable.iloc[0]
