"""Readers, normalisers and sinks. Schemas are explicit; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from barline.functions.numeric import half_even
from barline.functions.text import parse_time

OHLCV = T.StructType([T.StructField("symbol", T.StringType()), T.StructField("bar_date", T.DateType())] + [T.StructField(c, T.DoubleType()) for c in ("open", "high", "low", "close", "volume")])
NEWS = T.StructType([T.StructField(c, T.StringType()) for c in ("title", "source", "source_type", "date", "published", "pubDate")] + [T.StructField("symbol", T.StringType()), T.StructField("age_hours", T.DoubleType()), T.StructField("published_ts", T.DoubleType())])
QUOTE = T.StructType([
    T.StructField("closePrice", T.StringType()), T.StructField("compareToPreviousClosePrice", T.StringType()),
    T.StructField("compareToPreviousPrice", T.StructType([T.StructField("code", T.StringType())])), T.StructField("tradeVolume", T.StringType()),
])
JOURNAL = T.StructType([
    T.StructField("type", T.StringType()), T.StructField("id", T.StringType()), T.StructField("symbol", T.StringType()), T.StructField("market", T.StringType()), T.StructField("signal_date", T.DateType()),
    T.StructField("current", T.DoubleType()), T.StructField("atr", T.DoubleType()), T.StructField("risk_score", T.LongType()),
    T.StructField("bands", T.StructType([T.StructField(k, T.ArrayType(T.DoubleType())) for k in ("primary", "secondary")])),
])


def read_bars(spark: SparkSession, path: str, fmt: str = "parquet", schema: T.StructType = OHLCV) -> DataFrame:
    """Bars from parquet, CSV or JSON with lower-case names; rows without open, high, low or close are dropped."""
    reader = spark.read.format(fmt)
    if fmt != "parquet":
        reader = reader.schema(schema)
    if fmt == "csv":
        reader = reader.option("header", True)
    return normalized_bars(reader.load(path))


def normalized_bars(df: DataFrame) -> DataFrame:
    names = {c: c.strip().lower().replace(" ", "_") for c in df.columns}
    return df.withColumnsRenamed(names).dropna(subset=["open", "high", "low", "close"])


_TRUNC = {"1D": "day", "1W": "week"}
_SIZES = {"5M": "5 minutes", "15M": "15 minutes", "30M": "30 minutes", "1H": "1 hour"}


def bucket_start(ts: Column, freq: str) -> Column:
    if freq in _TRUNC:
        return F.date_trunc(_TRUNC[freq], ts)
    if freq in _SIZES:
        return F.window(ts, _SIZES[freq])["start"]
    raise ValueError(f"unknown frequency: {freq}")


def build_bars(ticks: DataFrame, freq: str, ts: str = "quote_ts", price: str = "price", tie: str = "event_id", volume: Column | None = None) -> DataFrame:
    """Ticks to bars of 5M to 1W. All measures merge, so a busy symbol is combined before the shuffle."""
    vol = F.lit(1.0) if volume is None else volume
    d = ticks.withColumn("bar_ts", bucket_start(F.col(ts), freq))
    first = F.struct(ts, tie)
    return d.groupBy("symbol", "bar_ts").agg(
        F.min_by(price, first).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, first).alias("close"), F.sum(vol).alias("volume"))


def roll_up(bars: DataFrame, freq: str, ts: str = "bar_ts") -> DataFrame:
    """Bars of a timeframe whose buckets hold whole buckets of the bars given (5M, 15M, 30M, 1H; 1D, 1W)."""
    d = bars.withColumn("_b", bucket_start(F.col(ts), freq))
    return d.groupBy("symbol", F.col("_b").alias("bar_ts")).agg(
        F.min_by("open", ts).alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", ts).alias("close"), F.sum("volume").alias("volume"))


def adjust_prices(raw: DataFrame) -> DataFrame:
    """Open to close scaled by adjusted close over close; volume is kept."""
    ratio = F.coalesce(F.col("adj_close") / F.nullif(F.col("close"), F.lit(0.0)), F.lit(1.0))
    return raw.withColumns({c: F.col(c) * ratio for c in ("open", "high", "low", "close")})


def parse_quotes(df: DataFrame, column: str = "json") -> DataFrame:
    """Quote JSON with comma numbers and a direction code ('5' down) to numbers. Rows without a
    price are dropped."""
    q = F.from_json(column, QUOTE)
    num = lambda c: F.regexp_replace(c, ",", "").try_cast("double")
    d = df.withColumn("_q", q)
    diff = F.coalesce(num(F.col("_q.compareToPreviousClosePrice")), F.lit(0.0))
    diff = F.when(F.col("_q.compareToPreviousPrice.code") == "5", -diff).otherwise(diff)
    d = d.withColumns({"price": num(F.col("_q.closePrice")), "diff": diff, "volume": num(F.col("_q.tradeVolume"))}).filter("price is not null")
    prev = F.col("price") - F.col("diff")
    return d.withColumns({
        "prev_close": prev, "change_pct": half_even(F.when(prev != 0, F.col("diff") / prev * 100).otherwise(0.0), 2),
        "direction": F.when(F.col("diff") > 0, "up").when(F.col("diff") < 0, "down").otherwise("flat"),
    }).drop("_q")


def read_news(spark: SparkSession, path: str, as_of: Column) -> DataFrame:
    """News JSON lines with any of the known time fields; adds ``published_at`` and ``age_hours``."""
    return dated_news(spark.read.schema(NEWS).json(path), as_of)


def dated_news(df: DataFrame, as_of: Column) -> DataFrame:
    stamp = F.coalesce(F.timestamp_seconds("published_ts"), parse_time("published"), parse_time("date"), parse_time("pubDate"))
    age = F.greatest(F.lit(0.0), (F.unix_micros(as_of) - F.unix_micros("published_at")) / 3.6e9)
    return df.withColumn("published_at", stamp).withColumn("age_hours", F.coalesce("age_hours", age))


def clean_text(c) -> Column:
    """NULL for the empty markers of text feeds."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(~F.trim(c).isin("None", "-", ""), c)


def normalize_fundamentals(df: DataFrame) -> DataFrame:
    """Text ratios to doubles; a debt ratio above 10 is read as per cent."""
    num = lambda c: clean_text(c).try_cast("double")
    finite = lambda v: F.when(~F.isnan(v) & (F.abs(v) != float("inf")), v)
    d = finite(num("debt_to_equity"))
    return df.withColumns({**{c: finite(num(c)) for c in ("roe", "revenue_growth", "return_on_assets")}, "debt_to_equity": F.when(F.abs(d) > 10, d / 100.0).otherwise(d)})


def recent_earnings(df: DataFrame, keep: int = 4) -> DataFrame:
    """The last quarters per symbol."""
    w = Window.partitionBy("symbol").orderBy(F.desc("fiscal_date"), "report_id")
    return df.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= keep)


def write_report(df: DataFrame, path: str, fmt: str = "parquet", by: str | None = "market") -> None:
    """A report table, one folder per market."""
    w = df.write.mode("overwrite").format(fmt)
    if fmt == "csv":
        w = w.option("header", True)
    (w.partitionBy(by) if by else w).save(path)


def append_journal(df: DataFrame, path: str) -> None:
    """Appends prediction events as JSON lines."""
    df.write.mode("append").json(path)


def read_journal(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(JOURNAL).json(path)


def prediction_events(trades: DataFrame) -> DataFrame:
    """Journal events from entry-zone bands (``logic = 'current'`` rows of both zones)."""
    pair = lambda z: F.array(F.max(F.when(F.col("zone") == z, F.col("low"))), F.max(F.when(F.col("zone") == z, F.col("high"))))
    g = trades.filter("logic = 'current'").groupBy("symbol", "market", "signal_date", "close", "atr", "risk_score").agg(F.struct(pair("primary").alias("primary"), pair("secondary").alias("secondary")).alias("bands"))
    key = F.concat_ws("|", F.col("symbol").cast("string"), F.col("signal_date").cast("string"), F.format_string("%.2f", "close"))
    return g.select(F.lit("prediction").alias("type"), key.alias("id"), F.col("symbol").cast("string").alias("symbol"), "market", "signal_date", F.col("close").alias("current"), "atr", F.col("risk_score").cast("long").alias("risk_score"), "bands")


def output_contract(bands: DataFrame, levels: DataFrame) -> DataFrame:
    """One JSON document per symbol with its buy bands and take-profit levels.

    A symbol has six bands and nine levels, so the lists are of fixed length.
    """
    band = F.struct("band", F.array("low", "high").alias("price_range"), "expected_return_pct", F.col("win_pct").alias("win_probability_pct"), F.col("loss_pct").alias("loss_probability_pct"))
    fam = lambda f: F.array_sort(F.collect_list(F.when(F.col("family") == f, band)))
    b = bands.groupBy("symbol").agg(F.max("close").alias("current"), F.struct(fam("aggressive").alias("bands")).alias("aggressive"), F.struct(fam("recommended").alias("bands")).alias("recommended"))
    tp = F.struct("profile", "level", "price", "return_pct", "hit_prob_pct", F.col("days").alias("avg_days_to_hit"), "failed_loss_pct", "risk_reward")
    t = levels.groupBy("symbol").agg(F.array_sort(F.collect_list(tp)).alias("tp_levels"))
    doc = F.struct(F.struct("current", "aggressive", "recommended").alias("buy_price"), F.struct("tp_levels").alias("risk_scenarios"))
    return b.join(t, "symbol").select("symbol", F.to_json(doc).alias("document"))


def corporate_actions(raw: DataFrame, adjusted: DataFrame) -> DataFrame:
    """Overnight gap and SMMA200 jump on dividend and split days, raw and adjusted.

    ``raw`` has ``dividend, split, smma200``; both frames share ``symbol, bar_idx``.
    """
    w = Window.partitionBy("symbol").orderBy("bar_idx")
    gap = (F.col("open") / F.lag("close").over(w) - 1) * 100
    jump = (F.col("smma200") / F.lag("smma200").over(w) - 1) * 100
    a = adjusted.select("symbol", "bar_idx", gap.alias("adj_gap"), jump.alias("adj_jump"))
    r = raw.withColumns({"raw_gap": gap, "raw_jump": jump}).filter("(dividend <> 0 or split <> 0) and bar_idx >= 1")
    d = r.join(a, ["symbol", "bar_idx"])
    return d.select("symbol", "bar_idx", "dividend", "split", "raw_gap", "adj_gap", (F.abs("raw_gap") - F.abs("adj_gap")).alias("gap_reduction"), "raw_jump", "adj_jump", (F.abs("raw_jump") - F.abs("adj_jump")).alias("jump_reduction"))
