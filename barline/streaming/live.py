"""Live operators. Each takes a batch or a streaming frame of ticks ``symbol, quote_ts, price, event_id``
(plus what it names) and has the same meaning on both; watermarks are ignored in batch.

Output modes: append for windows, sessions, checkpoints and once-only records; update for the
running summary and the ledger. State is kept per key and dropped behind the watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StatefulProcessor

from barline.functions.calendar import session
from barline.sources.readers import _SIZES

DELAY = "10 minutes"


def tick_stream(spark: SparkSession, folder: str, files: str = "events*.parquet", per_trigger: int = 1) -> DataFrame:
    """Ticks from event files as they arrive. Stored times without zone are cast: a watermark needs a timestamp."""
    schema = spark.read.parquet(f"{folder.rstrip('/')}/{files}").schema
    raw = spark.readStream.schema(schema).option("pathGlobFilter", files).option("maxFilesPerTrigger", per_trigger).parquet(folder)
    return ticks(raw)


def ticks(events: DataFrame) -> DataFrame:
    return events.filter("value > 0").select(F.col("user_id").alias("symbol"), F.col("ts").cast("timestamp").alias("quote_ts"), F.col("value").alias("price"), "event_id", "event_type")


def live_bars(t: DataFrame, freq: str = "1H", delay: str = DELAY) -> DataFrame:
    """Tumbling bars of 5M to 1H."""
    if freq not in _SIZES:
        raise ValueError(f"unknown live frequency: {freq}")
    at = F.struct("quote_ts", "event_id")
    g = t.withWatermark("quote_ts", delay).groupBy("symbol", F.window("quote_ts", _SIZES[freq]).alias("w"))
    return g.agg(F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", at).alias("close"), F.count(F.lit(1)).alias("volume")).select(
        "symbol", F.col("w.start").alias("bar_ts"), "open", "high", "low", "close", "volume")


def sliding_turnover(t: DataFrame, size: str = "4 hours", slide: str = "1 hour", recent: str = "1 hour", delay: str = DELAY) -> DataFrame:
    """Sliding windows: turnover, and the share of it in the last ``recent`` of the window."""
    late = F.expr(f"quote_ts >= w.end - interval {recent}")
    d = t.withWatermark("quote_ts", delay).withColumn("w", F.window("quote_ts", size, slide)).withColumn("late", F.when(late, F.col("price")).otherwise(0.0))
    a = d.groupBy("symbol", "w").agg(F.sum("price").alias("turnover"), F.sum("late").alias("recent_turnover"), F.count(F.lit(1)).alias("n"))
    return a.select("symbol", F.col("w.start").alias("window_start"), "n", "turnover", (F.col("recent_turnover") / F.col("turnover")).alias("recent_share"))


def activity_sessions(t: DataFrame, gap: str = "6 hours", delay: str = DELAY) -> DataFrame:
    """Windows of activity per symbol, closed by a gap.

    Filter the result on its bounds only after it has been written: Spark moves a filter on a
    session's end below the merging of sessions, which changes the sessions.
    """
    g = t.withWatermark("quote_ts", delay).groupBy("symbol", F.session_window("quote_ts", gap).alias("w"))
    return g.agg(F.count(F.lit(1)).alias("n"), F.max("price").alias("high"), F.min("price").alias("low")).select("symbol", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n", "high", "low")


def recommendations(t: DataFrame) -> DataFrame:
    """Purchases read as recommendations, one identity per symbol and day."""
    d = t.filter("event_type = 'purchase'")
    key = F.concat_ws("|", F.col("symbol").cast("string"), F.date_format("quote_ts", "yyyy-MM-dd"))
    return d.select(key.alias("rec_id"), "symbol", F.col("quote_ts").alias("rec_ts"), F.col("price").alias("rec_price"))


def record_once(recs: DataFrame, delay: str = "1 day") -> DataFrame:
    """The first record per identity; repeats within the watermark are dropped."""
    if recs.isStreaming:
        return recs.withWatermark("rec_ts", delay).dropDuplicatesWithinWatermark(["rec_id"])
    return recs.groupBy("rec_id").agg(F.min_by(F.struct("symbol", "rec_ts", "rec_price"), F.struct("rec_ts", "rec_price")).alias("r")).select("rec_id", "r.*")


CHECKPOINTS = {"m30": 30, "m60": 60, "close": 390}


def checkpoints(recs: DataFrame, t: DataFrame, wait: str = "6 hours", delay: str = DELAY) -> DataFrame:
    """Per recommendation and checkpoint the first quote at or after the due time; unobservable if
    none comes within ``wait``. A time-bounded join, so state is bounded too."""
    due = F.array(*[F.struct(F.lit(k).alias("checkpoint"), F.lit(v).alias("minutes")) for k, v in CHECKPOINTS.items()])
    r = recs.withColumn("c", F.explode(due)).select("rec_id", "symbol", "rec_price", "c.checkpoint", (F.col("rec_ts") + F.make_dt_interval(mins=F.col("c.minutes"))).alias("due_ts"))
    r = r.withWatermark("due_ts", delay)
    q = t.withWatermark("quote_ts", delay).select(F.col("symbol").alias("q_symbol"), "quote_ts", "price", "event_id")
    cond = (F.col("symbol") == F.col("q_symbol")) & (F.col("quote_ts") >= F.col("due_ts")) & (F.col("quote_ts") <= F.col("due_ts") + F.expr(f"interval {wait}"))
    j = r.join(q, cond, "leftOuter")
    g = j.groupBy(F.window("due_ts", "1 second").alias("_w"), "rec_id", "checkpoint", "rec_price").agg(F.min_by("price", F.struct("quote_ts", "event_id")).alias("price"), F.min("quote_ts").alias("seen_ts"))
    status = F.when(F.col("price").isNull(), "unobservable").otherwise("completed")
    return g.select("rec_id", "checkpoint", status.alias("status"), "seen_ts", ((F.col("price") / F.col("rec_price") - 1) * 100).alias("return_pct"))


def fresh(t: DataFrame, arrival: str, limits: dict[str, int], default: int = 480) -> DataFrame:
    """Quotes no older on arrival than their source allows (minutes)."""
    limit = F.lit(default)
    for k, v in limits.items():
        limit = F.when(F.col("event_type") == k, v).otherwise(limit)
    age = (F.unix_micros(arrival) - F.unix_micros("quote_ts")) / 60e6
    return t.withColumn("age_min", age).filter((F.col("age_min") >= 0) & (F.col("age_min") <= limit))


def tagged(t: DataFrame) -> DataFrame:
    return t.withColumn("session", session("quote_ts"))


def running_summary(done: DataFrame) -> DataFrame:
    """Completed, unobservable and mean return per checkpoint; update mode on a stream."""
    return done.groupBy("checkpoint").agg(F.count_if(F.col("status") == "completed").alias("completed"), F.count_if(F.col("status") == "unobservable").alias("unobservable"), F.avg("return_pct").alias("avg_return_pct"))


def with_flags(t: DataFrame, flags: DataFrame) -> DataFrame:
    """Ticks with the static risk flags of their symbol; symbols without flags are tradable."""
    return t.join(flags, "symbol", "left").withColumn("blocked", F.coalesce("blocked", F.lit(False)))


# -- position ledger --------------------------------------------------------------------------

def ledger(events: DataFrame) -> DataFrame:
    """State of each position from its events (batch form).

    ``events`` has ``position_id, at, seq, kind, value`` with kinds open, stop, price, close. The stop
    only rises, so it is the largest seen while open; events before the opening or after the close do
    not count. Everything merges, so a much-traded position is combined before the shuffle.
    """
    at = F.struct("at", "seq")
    only = lambda k, v: F.when(F.col("kind") == k, v)
    opened = events.groupBy("position_id").agg(F.min(only("open", at)).alias("o")).filter("o is not null")
    live = events.join(opened, "position_id").filter(at >= F.col("o"))
    closed = live.groupBy("position_id").agg(F.min(only("close", at)).alias("c"))
    d = live.join(closed, "position_id").filter(F.col("c").isNull() | (at <= F.col("c")))
    g = d.groupBy("position_id").agg(
        F.min_by("value", F.when(F.col("kind") == "open", at)).alias("entry_price"), F.max(only("stop", F.col("value"))).alias("stop_price"),
        F.max_by("value", only("price", at)).alias("last_price"), F.max(only("close", F.col("value"))).alias("close_price"), F.count_if(F.col("kind") == "price").alias("updates"))
    return g.select("position_id", "entry_price", "stop_price", F.coalesce("last_price", "entry_price").alias("last_price"), "close_price", F.when(F.col("close_price").isNull(), "OPEN").otherwise("CLOSED").alias("status"), "updates")


LEDGER = T.StructType([T.StructField("position_id", T.LongType()), T.StructField("entry_price", T.DoubleType()), T.StructField("stop_price", T.DoubleType()), T.StructField("last_price", T.DoubleType()), T.StructField("close_price", T.DoubleType()), T.StructField("status", T.StringType()), T.StructField("updates", T.LongType())])
_STATE = T.StructType([f for f in LEDGER.fields if f.name != "position_id"])


class _Position(StatefulProcessor):
    """One position's state; a closed one is forgotten by an event-time timer."""

    def __init__(self, keep_ms: int):
        self.keep_ms = keep_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.position = handle.getValueState("position", _STATE)

    def handleInputRows(self, key, rows, timerValues):
        import pandas as pd

        entry, stop, last, close, status, n = self.position.get() if self.position.exists() else (None, None, None, None, "NONE", 0)
        events = pd.concat(list(rows)).sort_values(["at", "seq"])
        for at, kind, value in events[["at", "kind", "value"]].itertuples(index=False):
            if status == "NONE" and kind == "open":
                entry, last, status = value, value, "OPEN"
            elif status == "OPEN" and kind == "stop":
                stop = value if stop is None else max(stop, value)
            elif status == "OPEN" and kind == "price":
                last, n = value, n + 1
            elif status == "OPEN" and kind == "close":
                close, status = value, "CLOSED"
                self.handle.registerTimer(int(pd.Timestamp(at).timestamp() * 1000) + self.keep_ms)
        if status != "NONE":  # what was never opened leaves no state
            self.position.update((entry, stop, last, close, status, n))
            yield pd.DataFrame([(key[0], entry, stop, last, close, status, n)], columns=LEDGER.names)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        import pandas as pd

        self.position.clear()
        yield pd.DataFrame(columns=LEDGER.names)

    def close(self) -> None:
        pass


def live_ledger(events: DataFrame, delay: str = DELAY, keep_days: float = 365) -> DataFrame:
    """The ledger on a stream: per position the state after each batch of events, in update mode.

    Events of one position must arrive in order, as from one partition of a log. A position's state goes ``keep_days`` of
    event time after its close; events of the same id after that would open a new one. Needs the RocksDB state store.
    """
    processor = _Position(int(keep_days * 86_400_000))
    return events.withWatermark("at", delay).groupBy("position_id").transformWithStateInPandas(processor, LEDGER, "Update", "EventTime")


def ledger_events(t: DataFrame) -> DataFrame:
    """Ticks read as position events: signup opens, error moves the stop, view and click price, purchase closes."""
    kind = F.when(F.col("event_type") == "signup", "open").when(F.col("event_type") == "error", "stop").when(F.col("event_type") == "purchase", "close").otherwise("price")
    return t.select(F.col("symbol").alias("position_id"), F.col("quote_ts").alias("at"), F.col("event_id").alias("seq"), kind.alias("kind"), F.col("price").alias("value"))

