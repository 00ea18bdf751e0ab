"""Quality rules by the frequency of lines across documents.

Every line is normalised and hashed; distinct texts that hold it are counted per host. Lines above the limits are
boilerplate and go; a document that then has too little left is rejected. All column expressions.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 5
_BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
_OWN = [*_BASE, "removed_words", "n_removed_lines", "kept"]


@dataclass(frozen=True)
class Limits:
    """A line is boilerplate of a host from ``least`` distinct texts on that are more than ``share`` of the host's texts.

    A document is depleted if over ``depleted`` of its words go, or if it loses some and fewer than ``words`` stay.
    """

    least: int = 20
    share: float = 0.1
    depleted: float = 0.6
    words: int = 10
    repeated: float = 0.2


def words_of(text: Column) -> Column:
    inner = F.btrim(text, F.lit(SPACE))
    return F.when(F.length(inner) > 0, F.split(inner, r"[\x20\x09-\x0D]+")).otherwise(F.array().cast("array<string>"))


def _line_words(line: Column) -> Column:
    inner = F.btrim(line, F.lit(SPACE))
    return F.when(F.length(inner) > 0, F.size(F.split(inner, r"[\x20\x09-\x0D]+"))).otherwise(0)


def normalised(line: Column) -> Column:
    """Lower case, words joined by one space."""
    return F.lower(F.regexp_replace(F.btrim(line, F.lit(SPACE)), r"[\x20\x09-\x0D]+", " "))


def base_measures(docs: DataFrame, text: str = "text", limits: Limits = Limits()) -> DataFrame:
    """``docs`` and the base measures. A null text has no words."""
    t = F.coalesce(F.col(text), F.lit(""))
    d = docs.withColumn("__words", words_of(t))
    d = d.withColumn("__h", F.transform("__words", lambda w: F.xxhash64(w)))
    n = F.size("__words")
    at = F.when(n >= WINDOW, F.sequence(F.lit(0), n - WINDOW)).otherwise(F.array().cast("array<int>"))
    d = d.withColumn("__win", F.transform(at, lambda i: F.xxhash64(*[F.get("__h", i + j) for j in range(WINDOW)])))
    d = d.withColumn("__again", F.size(F.array_distinct("__win")) < F.size("__win"))
    # only texts with a repeated window are sorted
    d = d.withColumn("__sorted", F.when(F.col("__again"), F.array_sort(F.transform("__win", lambda h, i: F.struct(h.alias("h"), i.cast("int").alias("i"))))))
    d = d.withColumn(
        "__starts",
        F.when(
            F.col("__again"),
            F.array_sort(
                F.filter(
                    F.transform("__sorted", lambda x, k: F.when((F.get("__sorted", k - 1)["h"] == x["h"]) | (F.get("__sorted", k + 1)["h"] == x["h"]), x["i"])),
                    lambda i: i.isNotNull(),
                )
            ),
        ),
    )
    covered = F.aggregate(
        F.transform("__starts", lambda i, k: F.least(F.lit(WINDOW), F.coalesce(F.get("__starts", k + 1) - i, F.lit(WINDOW)))), F.lit(0).cast("long"), lambda s, x: s + x
    )
    lines = F.filter(F.split(t, "\n"), lambda x: F.length(F.btrim(x, F.lit(SPACE))) > 0)
    d = d.withColumn("__lines", lines)
    # a filter on the measures must not be pushed below them: it would repeat their steps within one another
    stay = F.spark_partition_id() >= 0
    n_words, repeat = F.when(stay, n.cast("long")), F.when(stay, F.coalesce(covered, F.lit(0).cast("long")))
    d = d.withColumns({
        "n_words": n_words,
        "word_chars": F.aggregate("__words", F.lit(0).cast("long"), lambda s, w: s + F.length(w)),
        "n_symbols": F.length(F.regexp_replace(t, r"[^#*$%&|<>]+", "")).cast("long"),
        "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
        "n_repeat_words": repeat,
    })
    failed = (F.col("n_words") < limits.words) | (100 * F.col("n_repeat_words") > round(100 * limits.repeated) * F.col("n_words"))
    return d.withColumn("base_failed", failed).drop("__words", "__h", "__win", "__again", "__sorted", "__starts", "__lines")


def frequent_lines(docs: DataFrame, text: str = "text", host: str = "source", limits: Limits = Limits()) -> DataFrame:
    """(host, line): hashes of the lines of each host above the limits. Equal texts count once; a null host is a host of its own."""
    t = F.coalesce(F.col(text), F.lit(""))
    d = docs.select(F.coalesce(F.col(host).cast("string"), F.lit("")).alias("__host"), F.xxhash64(t).alias("__text"), _hashes(t).alias("__all"))
    texts = d.groupBy("__host", "__text").agg(F.lit(1)).groupBy("__host").agg(F.count("*").alias("__texts"))
    seen = d.select("__host", "__text", F.explode("__all").alias("__line")).groupBy("__host", "__line", "__text").agg(F.lit(1))
    counts = seen.groupBy("__host", "__line").agg(F.count("*").alias("__n")).where(F.col("__n") >= limits.least)
    return counts.join(texts, "__host").where(F.col("__n") > limits.share * F.col("__texts")).select("__host", "__line")


def _hashes(text: Column) -> Column:
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.btrim(x, F.lit(SPACE))) > 0)
    return F.array_distinct(F.transform(lines, lambda x: F.xxhash64(normalised(x))))


def quality(docs: DataFrame, text: str = "text", host: str = "source", key: str = "doc_id", limits: Limits = Limits()) -> DataFrame:
    """``docs`` with the base measures, removed_words, n_removed_lines, kept, and ``text`` without its frequent lines.

    kept is false if base_failed, else unless the document is depleted. A null or empty text has no words and fails.
    A null host is a host of its own; null keys match one another; repeated rows are judged alike, and equal texts
    count once in a host. Input columns named like an output column are replaced. An empty table gives no rows.
    """
    docs = docs.select([c for c in docs.columns if c not in _OWN])
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: F.length(F.btrim(x, F.lit(SPACE))) > 0)
    placed = F.transform(lines, lambda x, i: F.struct(F.xxhash64(normalised(x)).alias("h"), i.alias("i"), _line_words(x).alias("w")))
    exploded = docs.select(
        F.col(key).alias("__key"), F.xxhash64(t).alias("__text"), F.coalesce(F.col(host).cast("string"), F.lit("")).alias("__host"), F.explode(placed).alias("__l")
    ).select("__key", "__text", "__host", F.col("__l.h").alias("__line"), F.struct("__l.i", "__l.w").alias("__at"))
    found = exploded.join(frequent_lines(docs, text, host, limits), ["__host", "__line"])
    # a set of places, so that repeated rows don't add up
    hits = found.groupBy("__key", "__text").agg(F.collect_set("__at").alias("__at"), F.collect_set("__line").alias("__gone"))
    hits = hits.select(
        F.col("__key").alias("__k2"), F.col("__text").alias("__t2"), "__gone",
        F.size("__at").cast("long").alias("n_removed_lines"), F.aggregate("__at", F.lit(0).cast("long"), lambda s, x: s + x["w"]).alias("removed_words"),
    )
    d = base_measures(docs, text, limits).withColumn("__text", F.xxhash64(t))
    d = d.join(hits, F.col(key).eqNullSafe(F.col("__k2")) & (F.col("__text") == F.col("__t2")), "left").fillna(0, ["n_removed_lines", "removed_words"])
    left = F.array_join(F.filter(F.split(t, "\n"), lambda x: ~(F.array_contains("__gone", F.xxhash64(normalised(x))) & (F.length(F.btrim(x, F.lit(SPACE))) > 0))), "\n")
    depleted = (F.col("removed_words") > limits.depleted * F.col("n_words")) | ((F.col("removed_words") > 0) & (F.col("n_words") - F.col("removed_words") < limits.words))
    d = d.withColumns({"kept": ~F.col("base_failed") & ~depleted, text: F.when(F.col("__gone").isNotNull(), left).otherwise(F.col(text))})
    return d.drop("__text", "__k2", "__t2", "__gone")
