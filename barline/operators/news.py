"""News aggregates per symbol."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from barline.operators.rank import first_per, top_k
from barline.functions import text as T
from barline.functions.numeric import half_even


def scored_news(items: DataFrame, lexicon: T.Lexicon = T.Lexicon()) -> DataFrame:
    """Adds ``score, label, cred, weight`` to items with ``title, age_hours, source, source_type``."""
    d = T.with_sentiment(items, "title", "score", lexicon).withColumns({"cred": T.credibility("source_type", "source")})
    return d.withColumns({"label": T.sentiment_label("score"), "weight": T.recency_weight("age_hours") * F.col("cred")})


def news_sentiment(items: DataFrame, keys: list[str], order: str, keep: int = 12, lexicon: T.Lexicon = T.Lexicon()) -> DataFrame:
    """Weighted sentiment 0..100 per key over the ``keep`` most credible items, with its quality.

    The items to keep are chosen before they are scored. Spark cuts to ``keep`` rows per key on
    each side of the shuffle, so a much-covered symbol costs no more than others.
    """
    d = items.withColumn("cred", T.credibility("source_type", "source"))
    w = Window.partitionBy(*keys).orderBy(F.desc("cred"), order)
    d = d.withColumn("_k", F.row_number().over(w)).filter(F.col("_k") <= keep).drop("_k")
    d = scored_news(d, lexicon)
    n = lambda v: F.count_if(F.col("label") == v)
    sw, sw2 = F.sum("weight"), F.sum(F.col("weight") * F.col("weight"))
    sws, sws2 = F.sum(F.col("weight") * F.col("score")), F.sum(F.col("weight") * F.col("score") * F.col("score"))
    g = d.groupBy(*keys).agg(
        sw.alias("_w"), sw2.alias("_w2"), sws.alias("_ws"), sws2.alias("_ws2"), n("positive").alias("positive_count"), n("negative").alias("negative_count"), n("neutral").alias("neutral_count"),
        T.dominant_language(T.share(T.has_hangul("title"))).alias("language"), F.coalesce(F.bool_or(F.col("age_hours") > 1), F.lit(False)).alias("decay_applied"),
    )
    avg = F.when(F.col("_w") > 0, F.col("_ws") / F.col("_w")).otherwise(0.0)
    g = g.withColumns({"avg_score": avg, "effective_n": F.when(F.col("_w2") > 0, F.col("_w") * F.col("_w") / F.col("_w2")).otherwise(0.0)})
    var = F.greatest(F.try_divide("_ws2", "_w") - F.col("avg_score") * F.col("avg_score"), F.lit(0.0))
    agree = F.when(F.col("_w") > 0, 1.0 - F.least(F.lit(1.0), var)).otherwise(0.5)
    quality = (1.0 - F.exp(-F.col("effective_n") / 4.0)) * (0.6 + 0.4 * agree)
    return g.withColumns({
        "sentiment_score": half_even((F.col("avg_score") + 1) * 50), "overall": T.sentiment_label("avg_score"), "quality": F.greatest(F.lit(0.0), F.least(F.lit(1.0), quality)),
    }).drop("_w", "_w2", "_ws", "_ws2")


def impact_balance(items: DataFrame, keys: list[str]) -> DataFrame:
    """Positive, negative and neutral counts, and the class by the share of positives (0.6 and 0.3)."""
    n = lambda v: F.count_if(F.col("impact") == v)
    g = items.groupBy(*keys).agg(n("positive").alias("positive"), n("negative").alias("negative"), n("neutral").alias("neutral"))
    ratio = F.col("positive") / F.nullif(F.col("positive") + F.col("negative"), F.lit(0))
    return g.withColumn("news_sentiment", F.when(ratio >= 0.6, "positive").when(ratio <= 0.3, "negative").otherwise("neutral"))


def recent(items: DataFrame, stamp: str, as_of, hours: float = 24) -> DataFrame:
    """Items of the last ``hours``; items without a readable time are dropped."""
    return items.filter(F.col(stamp) >= as_of - F.expr(f"interval {int(hours * 3600)} seconds"))


def recent_disclosures(items: DataFrame, as_of, days: int = 90, keep: int = 5, kind: str = "dart") -> DataFrame:
    """The latest disclosures per symbol within the window, tagged with their source type."""
    d = items.filter((F.col("published") >= as_of - F.expr(f"interval {days} days")) & F.col("title").isNotNull())
    w = Window.partitionBy("symbol").orderBy(F.desc("published"), "news_id")
    return d.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= keep).withColumn("source_type", F.lit(kind))


def with_latest(stocks: DataFrame, items: DataFrame, keys: list[str]) -> DataFrame:
    """``stocks`` with ``news_count`` and the latest item's ``latest_at, latest_title, latest_impact``.

    ``items`` has the keys, ``published, title, impact, news_id``; of items of one moment the first id stands. One
    aggregate, combined before the shuffle; stocks without items stay.
    """
    newest = F.struct(F.unix_micros("published").alias("at"), (-F.col("news_id")).alias("id"))
    latest = items.groupBy(*keys).agg(F.count(F.lit(1)).alias("news_count"), F.max_by(F.struct("published", "title", "impact"), newest).alias("_n"))
    d = stocks.join(latest, keys, "left").fillna(0, ["news_count"])
    return d.withColumns({"latest_at": F.col("_n.published"), "latest_title": F.col("_n.title"), "latest_impact": F.col("_n.impact")}).drop("_n")


def sector_headlines(items: DataFrame, keep: int = 5) -> DataFrame:
    """Per sector the latest ``keep`` headlines, each title once (that of the smallest symbol, then id).

    ``items`` has ``sector, symbol, news_id, published, title, impact``. A sector is never gathered: titles combine
    before the shuffle, and each task passes on ``keep`` rows per sector.
    """
    named = items.withColumn("sector", F.coalesce("sector", F.lit("OTHER")))
    once = first_per(named, ["sector", "title"], ["symbol", "news_id"])
    return top_k(once, ["sector"], [F.desc("published"), F.asc("news_id")], keep)
