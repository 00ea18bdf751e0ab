"""Market inputs derived from the trading tables: bars, universe, fundamentals, benchmark, quotes."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from barline.session import sized, stored, written

# Order keys per block. A block of one symbol and day holds a bounded number of rows however
# many trades a symbol has, so no window below ever sees a whole hot symbol.
ORDER_BLOCK = 1 << 24


def walk_bars(lineitem: DataFrame) -> DataFrame:
    """Daily bars of the integer random walk carried by ``l_discount``.

    The walk is a running sum over all trades of a symbol. It is taken in two levels: inside
    blocks of (symbol, day, order-key range), then over the block totals. Trades are shuffled
    once, on the block key; everything after works on block totals.
    """
    step = F.round((F.col("l_discount") - 0.05) * 4000).cast("long")
    trades = lineitem.select(
        F.col("l_suppkey").cast("long").alias("symbol"), F.col("l_shipdate").alias("ts"),
        F.floor(F.col("l_orderkey") / ORDER_BLOCK).alias("block"),
        "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice",
        F.col("l_quantity").alias("qty"), F.col("l_tax").alias("tax"), step.alias("d"),
    )
    in_block = Window.partitionBy("symbol", "ts", "block").orderBy(
        "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"
    )
    trades = trades.withColumn(
        "w", F.sum("d").over(in_block.rowsBetween(Window.unboundedPreceding, 0))
    ).withColumn("rn", F.row_number().over(in_block))
    px = trades.withColumn("c", F.exp(F.col("w") / 10000.0)).withColumn(
        "o", F.exp((F.col("w") - F.col("d")) / 10000.0) * (1 + (F.col("qty") - 25) * 0.0008)
    )
    blocks = px.groupBy("symbol", "ts", "block").agg(
        F.sum("d").alias("step"),
        F.min_by("o", "rn").alias("o"),
        F.max(F.greatest("o", "c") * (1 + F.col("tax") * 0.1)).alias("h"),
        F.min(F.least("o", "c") * (1 - F.col("qty") * 0.00016)).alias("l"),
        F.max_by("c", "rn").alias("c"),
        F.sum("qty").alias("volume"),
    )
    before = Window.partitionBy("symbol").orderBy("ts", "block").rowsBetween(Window.unboundedPreceding, -1)
    base = 100 * F.exp(F.coalesce(F.sum("step").over(before), F.lit(0)) / 10000.0)
    blocks = blocks.withColumn("base", base)
    daily = blocks.groupBy("symbol", F.col("ts").cast("date").alias("bar_date")).agg(
        F.round(F.min_by(F.col("base") * F.col("o"), F.struct("ts", "block")), 4).alias("open"),
        F.round(F.max(F.col("base") * F.col("h")), 4).alias("high"),
        F.round(F.min(F.col("base") * F.col("l")), 4).alias("low"),
        F.round(F.max_by(F.col("base") * F.col("c"), F.struct("ts", "block")), 4).alias("close"),
        F.sum("volume").alias("volume"),
    )
    return indexed(daily)


def indexed(bars: DataFrame) -> DataFrame:
    """Adds the 0-based position ``bar_idx`` and the length ``n_bars`` of each symbol's history."""
    w = Window.partitionBy("symbol")
    return bars.withColumn("bar_idx", F.row_number().over(w.orderBy("bar_date")) - 1).withColumn(
        "n_bars", F.count(F.lit(1)).over(w)
    )


class Market:
    """The derived inputs for one data folder."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}.parquet")

    @cached_property
    def bars(self) -> DataFrame:
        trades = self.table("lineitem")
        sized(self.spark, self.path, trades.count())
        return stored(walk_bars(trades), "bars", self.path, ["symbol"], ["symbol", "bar_idx"])

    def timeframe_bars(self, freq: str) -> DataFrame:
        """Bars of 5M to 1H of the ticks, or of 1W of the daily bars, each level from the one below it."""
        from barline.sources.readers import build_bars, roll_up

        if freq == "1D":
            return self.bars
        below = {"15M": "5M", "30M": "15M", "1H": "30M", "1W": "1D"}.get(freq)
        d = build_bars(self.quotes, freq) if below is None else roll_up(self.timeframe_bars(below).withColumnRenamed("bar_date", "bar_ts"), freq)
        return stored(indexed(d.withColumnRenamed("bar_ts", "bar_date")), f"bars_{freq.lower()}", self.path, ["symbol"], ["symbol", "bar_idx"])

    @cached_property
    def universe(self) -> DataFrame:
        s, n, r = self.table("supplier"), self.table("nation"), self.table("region")
        key = F.col("s_suppkey")
        sleeve = F.element_at(
            F.array(*[F.lit(v) for v in ("CORE", "ETF", "HIGH_RISK", "HEDGE")]), (key % 4 + 1).cast("int")
        )
        return (
            s.join(n, s.s_nationkey == n.n_nationkey)
            .join(r, n.n_regionkey == r.r_regionkey)
            .select(
                key.alias("symbol"), F.col("s_name").alias("name"), F.col("n_name").alias("sector"),
                F.col("r_name").alias("cluster"),
                F.when(F.col("r_regionkey") % 2 == 0, "KRX").otherwise("US").alias("market"),
                sleeve.alias("sleeve"),
                F.when(key % 5 != 0, ((key * 7) % 30).cast("int")).alias("days_to_earnings"),
            )
        )

    @cached_property
    def fundamentals(self) -> DataFrame:
        key = F.col("s_suppkey")
        return self.table("supplier").select(
            key.alias("symbol"),
            F.when(key % 7 != 0, F.round(F.col("s_acctbal") / 50000.0, 4)).alias("roe"),
            F.when(key % 11 != 0, (key % 40) / 10.0).alias("debt_to_equity"),
            F.when(key % 13 != 0, ((key * 3) % 50 - 20) / 100.0).alias("revenue_growth"),
            (((key * 5) % 40 - 5) / 1000.0).alias("return_on_assets"),
        )

    @cached_property
    def benchmark(self) -> DataFrame:
        """One index series: at most one row per calendar day."""
        li = self.table("lineitem")
        daily = li.groupBy(F.col("l_shipdate").cast("date").alias("bar_date")).agg(
            F.round(F.avg((F.col("l_discount") - 0.05) * 4000)).cast("long").alias("step"),
            F.sum("l_quantity").alias("volume"),
        ).withColumn("symbol", F.lit(0).cast("long"))
        run = Window.partitionBy("symbol").orderBy("bar_date").rowsBetween(Window.unboundedPreceding, 0)
        close = F.round(1000 * F.exp(F.sum("step").over(run) / 10000.0), 4)
        return stored(
            indexed(daily.select("symbol", "bar_date", close.alias("close"), "volume")).withColumns(
                {"open": F.col("close"), "high": F.col("close"), "low": F.col("close")}
            ),
            "bench", self.path, ["symbol"], ["symbol", "bar_idx"],
        )

    @cached_property
    def snapshots(self) -> DataFrame:
        from barline.operators.scan import snapshots

        return stored(snapshots(self.bars, self.benchmark), "snapshots", self.path, ["symbol"], ["symbol"])

    @cached_property
    def panel(self) -> DataFrame:
        """The bars with the indicators of the back-tests."""
        from barline.operators.backtest import panel

        return stored(panel(self.bars), "panel", self.path, ["symbol"], ["symbol", "bar_idx"])

    def panel_view(self) -> DataFrame:
        """The panel for a query that reads it once. Where it is not written yet, only the indicators that the query reads are worked out."""
        from barline.operators.backtest import panel

        return self.panel if "panel" in self.__dict__ else panel(self.bars)

    def panel_ends(self) -> DataFrame:
        """The last row of each symbol in ``panel_view``."""
        return self.panel_view().filter("bar_idx = n_bars - 1")

    def snapshot_ends(self) -> DataFrame:
        """The snapshots without ``rs`` and ``hurst``, for queries that read neither. Where no snapshots are written yet,
        only the features that the query reads are worked out, and those from last bars."""
        from barline.operators.scan import end_features

        return self.snapshots.drop("rs", "hurst") if "snapshots" in self.__dict__ else end_features(self.bars)

    @cached_property
    def zone_trades(self) -> DataFrame:
        """The outcomes of the entry zones, which several reports read."""
        from barline.operators.backtest import zone_trades

        return written(zone_trades(self.panel_view(), self.bars, self.universe.select("symbol", "market")), "zones")

    @cached_property
    def moves(self) -> DataFrame:
        """Every bar with its change on the previous one and the dimensions of its symbol."""
        w = Window.partitionBy("symbol").orderBy("bar_idx")
        prev = F.lag("close").over(w)
        b = self.bars.select("symbol", "bar_date", "bar_idx", "n_bars", "close", "volume", (F.col("close") / prev - 1).alias("ret"))
        return b.join(self.universe, "symbol")

    @cached_property
    def latest_moves(self) -> DataFrame:
        """The last move of each symbol: ``change_pct`` and its direction."""
        d = self.moves.filter(F.col("bar_idx") == F.col("n_bars") - 1).withColumn("change_pct", F.col("ret") * 100)
        up = F.when(F.col("change_pct") > 0, "up").when(F.col("change_pct") < 0, "down").otherwise("flat")
        return d.withColumn("direction", up)

    @cached_property
    def holdings(self) -> DataFrame:
        """Trades read as positions: one per line item, seven accounts. No join."""
        entry = F.col("l_extendedprice") / F.col("l_quantity")
        closed = F.col("l_returnflag") == "R"
        return self.table("lineitem").select(
            F.col("l_linenumber").alias("account"), F.col("l_suppkey").alias("symbol"), "l_orderkey", "l_partkey",
            F.col("l_shipdate").cast("date").alias("entry_date"), entry.alias("entry_price"),
            F.when(F.col("l_tax") == 0, 0.0).otherwise(entry * (0.98 - F.col("l_tax"))).alias("stop_price"),
            F.col("l_quantity").alias("shares"), (entry * (0.95 + F.col("l_discount"))).alias("current_price"),
            F.when(closed, "CLOSED").otherwise("OPEN").alias("status"),
            F.when(closed, entry * (0.90 + 2 * F.col("l_discount"))).otherwise(0.0).alias("close_price"),
        )

    @cached_property
    def positions(self) -> DataFrame:
        """Holdings with the groups of their symbols."""
        return self.holdings.join(self.universe.select("symbol", "sector", "cluster", "market", "sleeve"), "symbol")

    @cached_property
    def quotes(self) -> DataFrame:
        e = self.table("events")
        rank = (
            F.when(F.col("event_type") == "purchase", 1).when(F.col("event_type") == "click", 2)
            .when(F.col("event_type") == "view", 3).when(F.col("event_type") == "signup", 4).otherwise(5)
        )
        return e.filter("value > 0").select(
            "event_id", F.col("user_id").alias("symbol"), F.col("ts").cast("timestamp").alias("quote_ts"),
            F.col("value").alias("price"), rank.alias("source_priority"), "event_type", "props",
        )

    @cached_property
    def event_dates(self) -> DataFrame:
        return (
            self.table("orders")
            .filter((F.col("o_orderpriority") == "1-URGENT") & (F.col("o_custkey") % 10 == 0))
            .select((F.col("o_custkey") % 100).alias("symbol"), F.col("o_orderdate").cast("date").alias("event_date"))
            .distinct()
        )


# Headline texts put on the events, so that news has the words the scorers look for.
HEADLINES = [
    "Shares surge after earnings beat, record high in sight", "Profit warning: maker cuts guidance as demand falls", "No risk of bankruptcy, lender says",
    "Chip stocks slightly rise on strong demand", "급등 마감, 사상 최대 실적에 목표가 상향", "우려 해소에 반등, 리스크 완화 기대", "적자전환 쇼크에 급락 ▼ ", "소폭 상승, 대규모 수주 기대감",
    "Analysts avoid buy rating despite massive growth", "Regulator opens fraud lawsuit, shares plunge sharply", "배당 확대 및 자사주 매입 결정", "영업이익 증가, 성장 지속", "과징금 제재로 손실 우려 확대",
    "Company holds annual meeting on Tuesday", "Not a crisis but a modest recovery, says chief", "신저가 경신, 유상증자 부담", "경고: 소송 조사 착수 📉", "골든크로스 돌파 🚀 매수 추천",
    "Guidance cut fails to stop the rally", "Steady trading in quiet session",
]
SOURCES = [("wire", "Newswire"), ("", "DART 공시"), ("blog", "Personal blog"), ("", "Google News"), ("news", "Daily"), ("", "Naver"), ("rss", "Feed"), ("", "Unknown")]


def news(m: Market) -> DataFrame:
    """One news item per event: a headline, a signed move, and a source."""
    e = m.table("events")
    pick = lambda values, k: F.element_at(F.array(*[F.lit(v) for v in values]), (k % len(values) + 1).cast("int"))
    i = F.col("event_id")
    move = F.concat(F.when(i % 3 == 0, "+").when(i % 3 == 1, "-").otherwise(""), F.floor("value").cast("long").cast("string"), F.lit("%"))
    ts = F.col("ts").cast("timestamp")
    return e.select(
        i.alias("news_id"), F.col("user_id").alias("symbol"), ts.alias("published"), F.concat(pick(HEADLINES, i * 7 + F.col("user_id")), F.lit(" "), move).alias("title"),
        pick([s for s, _ in SOURCES], i).alias("source_type"), pick([s for _, s in SOURCES], i).alias("source"), "event_type", "value",
    )
