"""Joins of bars with benchmarks, calendars, dimensions and later bars."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def history_ends(bars: DataFrame, k: int) -> DataFrame:
    """First, last and k-from-last close per symbol (k counted as ``n_bars - k``)."""
    return bars.groupBy("symbol").agg(
        F.max(F.when(F.col("bar_idx") == F.col("n_bars") - 1, F.col("close"))).alias("c_last"),
        F.max(F.when(F.col("bar_idx") == F.greatest(F.col("n_bars") - k, F.lit(0)), F.col("close"))).alias("c_back"),
        F.max(F.when(F.col("bar_idx") == 0, F.col("close"))).alias("c_first"),
        F.max("n_bars").alias("n_bars"),
    )


def relative_strength(bars: DataFrame, benchmark: DataFrame, period: int = 63) -> DataFrame:
    """Return of a symbol less that of the benchmark: over ``period`` bars, and over all history.

    The benchmark side is a single row, so it is broadcast whatever the data size.
    """
    b = history_ends(benchmark, period + 1).select(
        F.col("c_last").alias("b_last"), F.col("c_back").alias("b_back"), F.col("c_first").alias("b_first")
    )
    s = history_ends(bars, period + 1).crossJoin(F.broadcast(b))
    return s.select(
        "symbol",
        (((F.col("c_last") / F.col("c_back") - 1) - (F.col("b_last") / F.col("b_back") - 1)) * 100).alias("rs_63"),
        (((F.col("c_last") / F.col("c_first") - 1) - (F.col("b_last") / F.col("b_first") - 1)) * 100).alias("rs_all"),
    )


# -- as-of joins ------------------------------------------------------------------------------

def on_calendar(series: DataFrame, value: str = "close", date: str = "bar_date") -> DataFrame:
    """One series spread over every calendar day: the last value on or before the day and the one before that.

    The result has one row per day from the first to the last day of the series whatever the data size.
    """
    w = Window.partitionBy(F.lit(0)).orderBy(date)
    d = series.select(date, F.col(value).alias("asof_value"), F.lag(value).over(w).alias("asof_prev"), F.lead(date).over(w).alias("_next"))
    until = F.coalesce(F.date_sub("_next", 1), F.col(date))
    return d.withColumn("day", F.explode(F.sequence(F.col(date), until))).select("day", F.col(date).alias("asof_date"), "asof_value", "asof_prev")


def asof_series(rows: DataFrame, series: DataFrame, on: str = "bar_date", value: str = "close") -> DataFrame:
    """Adds the last value of one shared series on or before each row's date."""
    cal = on_calendar(series, value)
    end = series.agg(F.max("bar_date").alias("_end"))  # one row; later days read the last value
    d = rows.crossJoin(F.broadcast(end)).withColumn("_day", F.least(on, "_end"))
    return d.join(F.broadcast(cal), d["_day"] == cal["day"], "left").drop("day", "_day", "_end")


def next_event_days(bars: DataFrame, events: DataFrame) -> DataFrame:
    """Days from each bar to the symbol's next event on or after it; NULL where none follows."""
    e = events.select("symbol", F.col("event_date").alias("at"), F.lit(None).cast("int").alias("bar_idx"), F.col("event_date").alias("ev"))
    b = bars.select("symbol", F.col("bar_date").alias("at"), "bar_idx", F.lit(None).cast("date").alias("ev"))
    # Later days come first, so the frame only grows and each row is added once.
    later = Window.partitionBy("symbol").orderBy(F.col("at").desc()).rangeBetween(Window.unboundedPreceding, 0)
    # A range frame over dates needs a number: days since the epoch.
    u = b.unionByName(e).withColumn("at", F.datediff("at", F.to_date(F.lit("1970-01-01"))))
    d = u.withColumn("next_event", F.min("ev").over(later)).filter("bar_idx is not null")
    days = F.datediff("next_event", F.lit("1970-01-01")) - F.col("at")
    return d.select("symbol", "bar_idx", "next_event", days.alias("days_to_event"))


def event_distance(bars: DataFrame, events: DataFrame) -> DataFrame:
    """Signed distance in bars to the nearest event; of two equally near the earlier one.

    An event belongs to the first bar on or after its date; events outside the history are
    taken to its nearest end.
    """
    b = bars.select("symbol", F.col("bar_date").alias("at"), "bar_idx", "n_bars")
    e = events.select("symbol", F.col("event_date").alias("at"), F.lit(None).cast("int").alias("bar_idx"), F.lit(None).cast("long").alias("n_bars"))
    by_day = Window.partitionBy("symbol").orderBy(F.col("at").desc())
    u = b.unionByName(e).withColumn("at", F.datediff("at", F.to_date(F.lit("1970-01-01"))))
    later = by_day.rangeBetween(Window.unboundedPreceding, 0)
    last_bar = F.max("bar_idx").over(Window.partitionBy("symbol"))
    placed = u.withColumns({"pos": F.coalesce(F.min("bar_idx").over(later), last_bar)})
    marks = placed.filter("bar_idx is null and pos is not null").select("symbol", F.col("pos").alias("bar_idx")).distinct().withColumn("mark", F.lit(True))
    m = bars.select("symbol", "bar_idx").join(marks, ["symbol", "bar_idx"], "left").withColumn("p", F.when(F.col("mark"), F.col("bar_idx")))
    w, down = (Window.partitionBy("symbol").orderBy(o).rowsBetween(Window.unboundedPreceding, 0) for o in (F.col("bar_idx"), F.col("bar_idx").desc()))
    before = F.last("p", ignorenulls=True).over(w) - F.col("bar_idx")
    after = F.last("p", ignorenulls=True).over(down) - F.col("bar_idx")
    near = F.when(after.isNull() | (F.abs(before) <= after), before).otherwise(after)
    return m.select("symbol", "bar_idx", F.coalesce(near, after).alias("event_distance"))


# -- later bars -------------------------------------------------------------------------------

def forward_bars(signals: DataFrame, bars: DataFrame, n, start: int = 1) -> DataFrame:
    """Each signal with its next n bars: ``step`` 1..n and the bar's columns prefixed ``f_``.

    The interval join is an equi-join on (symbol, bar_idx) after each signal is expanded to the
    positions it needs, so its cost is signals times n and it runs in place on bucketed bars.
    """
    reach = n if not isinstance(n, int) else F.lit(n)
    s = signals.withColumn("step", F.explode(F.sequence(F.lit(start), reach))).withColumn("_at", F.col("bar_idx") + F.col("step"))
    f = bars.select("symbol", F.col("bar_idx").alias("_at"), *[F.col(c).alias(f"f_{c}") for c in ("bar_date", "open", "high", "low", "close")])
    return s.join(f, ["symbol", "_at"]).drop("_at")


# -- dimensions and sources -------------------------------------------------------------------

def resolve_symbols(requests: DataFrame, lineage: DataFrame) -> DataFrame:
    """Replaces renamed symbols and drops retired ones. ``lineage`` has ``symbol, action, successor``."""
    d = requests.join(lineage, "symbol", "left").filter("action is null or action <> 'exclude'")
    return d.withColumn("resolved", F.coalesce(F.when(F.col("action") == "replace", F.col("successor")), F.col("symbol"))).drop("action", "successor")


def first_sufficient(sources: list[DataFrame], least: int) -> DataFrame:
    """Per symbol all rows of the first source that has at least ``least`` of them."""
    rows = None
    for i, s in enumerate(sources):
        s = s.withColumn("provider", F.lit(i))
        rows = s if rows is None else rows.unionByName(s)
    counts = rows.groupBy("symbol", "provider").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= least)
    chosen = counts.groupBy("symbol").agg(F.min("provider").alias("provider"))
    return rows.join(chosen, ["symbol", "provider"])


def cross_validate(primary: DataFrame, secondary: DataFrame, window: int = 120, least: int = 20, limit: float = 1.0) -> DataFrame:
    """Median and largest close difference over the last common dates of two providers."""
    j = primary.select("symbol", "bar_date", F.col("close").alias("p")).join(
        secondary.select("symbol", "bar_date", F.col("close").alias("s")), ["symbol", "bar_date"]
    ).filter("p is not null and s is not null")
    w = Window.partitionBy("symbol").orderBy(F.desc("bar_date"))
    j = j.withColumn("k", F.row_number().over(w)).filter(F.col("k") <= window)
    diff = F.abs(F.col("p") / F.nullif(F.col("s"), F.lit(0.0)) - 1) * 100
    g = j.withColumn("d", diff).groupBy("symbol").agg(
        F.count(F.lit(1)).alias("overlap"), F.median("d").alias("median_diff"), F.max("d").alias("max_diff")
    )
    status = F.when(F.col("overlap") < least, "insufficient_overlap").when(F.col("median_diff") <= limit, "passed").otherwise("mismatch")
    all_symbols = primary.select("symbol").distinct().join(g, "symbol", "left").fillna(0, ["overlap"])
    shown = F.col("overlap") >= least
    return all_symbols.select("symbol", "overlap", status.alias("status"), F.when(shown, F.col("median_diff")).alias("median_diff"), F.when(shown, F.col("max_diff")).alias("max_diff"))


def freshest_quote(quotes: DataFrame, as_of, max_age_min: int = 480, candle_age_min: int = 120, candle_source: int = 5) -> DataFrame:
    """Per symbol the quote of the best source that is fresh enough; later quotes win within a source."""
    age = (F.unix_micros(as_of) - F.unix_micros("quote_ts")) / 60e6
    limit = F.when(F.col("source_priority") == candle_source, candle_age_min).otherwise(max_age_min)
    ok = quotes.withColumn("age_min", age).filter((F.col("age_min") >= 0) & (F.col("age_min") <= limit))
    best = F.min_by(F.struct("event_id", "quote_ts", "price", "source_priority", "age_min"), F.struct("source_priority", "age_min", "event_id"))
    return ok.groupBy("symbol").agg(best.alias("b")).select("symbol", "b.*")


def sector_relative(signals: DataFrame, sector_etf: DataFrame, etf_changes: DataFrame) -> DataFrame:
    """Confidence adjustment from the symbol's sector fund.

    ``signals`` has ``symbol, signal, change_5``; ``sector_etf`` maps ``symbol, etf``; ``etf_changes``
    has ``etf, etf_name, etf_change``. Symbols without a fund are left unadjusted.
    """
    d = signals.join(sector_etf, "symbol", "left").join(etf_changes, "etf", "left")
    e, known = F.col("etf_change"), F.col("etf_change").isNotNull()
    rising, falling = e > 1.0, e < -1.0
    buy, sell = F.col("signal") == "BUY", F.col("signal") == "SELL"
    with_it, against = (buy & rising) | (sell & falling), (buy & falling) | (sell & rising)
    stock = F.coalesce("change_5", F.lit(0.0))
    score = F.greatest(F.lit(-100.0), F.least(F.lit(100.0), (stock - e) * 10)).cast("long")
    return d.withColumns({
        "sector_relative_score": F.when(known, score).otherwise(0), "adjust": F.when(known & with_it, 3).when(known & against, -6).otherwise(0),
        "aligned": F.when(known & with_it, True).when(known & against, False),
    })
