"""Headlines, sentiment and disclosures."""

from pyspark.sql import functions as F

from barline.functions import text as T
from barline.functions.numeric import report
from barline.operators import news as N
from barline.plans.markets import overnight
from barline.plans.registry import cte, q, query
from barline.sources import readers as R
from barline.sources.market import HEADLINES, SOURCES, news

AS_OF = "2024-01-31 00:00:00"


def s(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def arr(xs) -> str:
    return "[" + ", ".join(s(x) for x in xs) + "]"


def pick(xs, k: str) -> str:
    return f"list_extract({arr(xs)}, CAST({k} % {len(xs)} + 1 AS INT))"


cte("news", "", f"""SELECT event_id AS news_id, user_id AS symbol, ts AS published, {pick(HEADLINES, '(event_id * 7 + user_id)')} || ' ' || CASE event_id % 3 WHEN 0 THEN '+' WHEN 1 THEN '-' ELSE '' END || CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) || '%' AS title,
  {pick([a for a, _ in SOURCES], 'event_id')} AS source_type, {pick([b for _, b in SOURCES], 'event_id')} AS source, event_type, value, date_diff('microsecond', ts, TIMESTAMP '{AS_OF}') / 3.6e9 AS age FROM events""")


def dated(m):
    return news(m).withColumn("as_of", F.to_timestamp(F.lit(AS_OF))).withColumn("age_hours", T.age_hours("published", "as_of"))


def impact_sql(variant: str) -> str:
    p, n = ("|".join(x) for x in T.IMPACT[variant])
    return f"CASE WHEN regexp_matches(title, {s(p)}) AND NOT regexp_matches(title, {s(n)}) THEN 'positive' WHEN regexp_matches(title, {s(n)}) AND NOT regexp_matches(title, {s(p)}) THEN 'negative' ELSE 'neutral' END"


@query("headline_impact", "news", "SELECT news_id, " + ", ".join(f"{impact_sql(v)} AS {v}_impact" for v in T.IMPACT) + ", regexp_matches(title, '[가-힣ㄱ-㆏]') AS hangul FROM news")
def _impact(m):
    return news(m).select("news_id", *[T.impact("title", v).alias(f"{v}_impact") for v in T.IMPACT], T.has_hangul("title").alias("hangul"))


@query("news_impact_counts", "news", f"""SELECT symbol, positive, negative, neutral, CASE WHEN positive + negative = 0 THEN 'neutral' WHEN positive / (positive + negative) >= 0.6 THEN 'positive' WHEN positive / (positive + negative) <= 0.3 THEN 'negative' ELSE 'neutral' END AS news_sentiment FROM (
  SELECT symbol, count(*) FILTER (i = 'positive') AS positive, count(*) FILTER (i = 'negative') AS negative, count(*) FILTER (i = 'neutral') AS neutral FROM (SELECT symbol, {impact_sql('stock')} AS i FROM news) GROUP BY symbol)""")
def _counts(m):
    return N.impact_balance(news(m).withColumn("impact", T.impact("title")), ["symbol"])


def contains_any(x: str, words) -> str:
    return "(" + " OR ".join(f"contains({x}, {s(w)})" for w in words) + ")"


def sentiment_ctes(name: str, source: str, key: str, text: str, lex: T.Lexicon) -> None:
    """Token, word and phrase scores from rows of their own, summed per text."""
    cte(f"{name}_tok", source, f"""SELECT {key}, unnest(string_split_regex(lower({text}), '[^\\pL\\pN_]+')) AS t, generate_subscripts(string_split_regex(lower({text}), '[^\\pL\\pN_]+'), 1) AS i FROM {source}""")
    cte(f"{name}_en", f"{name}_tok", f"""SELECT {key}, sum(CASE WHEN v > 0 THEN v ELSE 0 END) AS p, sum(CASE WHEN v < 0 THEN -v ELSE 0 END) AS n FROM (
      SELECT {key}, b * coalesce(lag(m, 3) OVER w, 1) * coalesce(lag(m, 2) OVER w, 1) * coalesce(lag(m) OVER w, 1) * coalesce(lag(g, 3) OVER w, 1) * coalesce(lag(g, 2) OVER w, 1) * coalesce(lag(g) OVER w, 1) AS v FROM (
        SELECT {key}, i, CASE WHEN t IN {tuple(lex.bullish)} THEN 1.0 WHEN t IN {tuple(lex.bearish)} THEN -1.0 ELSE 0.0 END::DOUBLE AS b, (CASE WHEN t IN {tuple(lex.intense)} THEN 1.5 ELSE 1.0 END * CASE WHEN t IN {tuple(lex.mild)} THEN 0.6 ELSE 1.0 END)::DOUBLE AS m,
          CASE WHEN t IN ({', '.join(s(x) for x in lex.negators)}) THEN -1.0 ELSE 1.0 END::DOUBLE AS g FROM {name}_tok) WINDOW w AS (PARTITION BY {key} ORDER BY i)) GROUP BY {key}""")
    words = " UNION ALL ".join(f"SELECT {s(w)} AS w, {b}::DOUBLE AS b" for b, ws in ((1.0, T.KR_BULLISH), (-1.0, T.KR_BEARISH)) for w in ws)
    cte(f"{name}_kw", source, f"""SELECT {key}, x, w, b, 1 + strpos(x, w) - 1 AS ax FROM (SELECT {key}, {text} AS x FROM {source}), ({words}) WHERE contains(x, w)
      UNION ALL SELECT {key}, x, w, b, ax + length(w) + strpos(substr(x, ax + length(w)), w) - 1 FROM {name}_kw WHERE contains(substr(x, ax + length(w)), w)""")
    cte(f"{name}_kr", f"{name}_kw", f"""SELECT {key}, sum(CASE WHEN v > 0 THEN v ELSE 0 END) AS p, sum(CASE WHEN v < 0 THEN -v ELSE 0 END) AS n FROM (SELECT {key}, CASE WHEN b < 0 AND {contains_any('af', T.KR_FLIP_AFTER)} THEN abs(v) * 0.8 ELSE v END AS v FROM (
      SELECT {key}, b, af, b * (CASE WHEN {contains_any('be', T.KR_INTENSE)} THEN 1.5 ELSE 1.0 END)::DOUBLE * (CASE WHEN {contains_any('be', T.KR_MILD)} THEN 0.6 ELSE 1.0 END)::DOUBLE AS v FROM (
        SELECT *, substr(x, greatest(ax - 4, 1), least(ax - 1, 4)) AS be, substr(x, ax + length(w), 6) AS af FROM {name}_kw))) GROUP BY {key}""")
    phr = lambda d: " + ".join(f"CASE WHEN contains(lower({text}), {s(k)}) OR contains({text}, {s(k)}) THEN {v} ELSE 0 END" for k, v in d.items())
    pct = lambda sg: f"coalesce(list_sum(list_transform(list_filter(regexp_extract_all({text}, '{T.PERCENT}'), lambda z: z[1] = '{sg}'), lambda z: least(1.2, 0.3 + CAST(regexp_extract(z, '{T.PERCENT}', 2) AS DOUBLE) / 15.0))), 0)"
    cte(name, f"{source} {name}_en {name}_kr", f"""SELECT a.*, greatest(-1.0, least(1.0, ((({phr(T.PHRASES_POSITIVE)})::DOUBLE + CASE WHEN {contains_any(text, T.SIGNS_UP)} THEN 0.7 ELSE 0 END + {pct('+')} + coalesce(k.p, 0) + coalesce(e.p, 0))
      - (({phr(T.PHRASES_NEGATIVE)})::DOUBLE + CASE WHEN {contains_any(text, T.SIGNS_DOWN)} THEN 0.7 ELSE 0 END + {pct('-')} + coalesce(k.n, 0) + coalesce(e.n, 0))) / 3.0)) AS score
      FROM {source} a LEFT JOIN {name}_en e USING ({key}) LEFT JOIN {name}_kr k USING ({key})""")


sentiment_ctes("nscore", "news", "news_id", "title", T.Lexicon())
_LAB = "CASE WHEN {0} > 0.2 THEN 'positive' WHEN {0} < -0.2 THEN 'negative' ELSE 'neutral' END"


@query("headline_sentiment", "nscore", f"SELECT news_id, {q('score')} AS score, {_LAB.format('score')} AS label FROM nscore")
def _sent(m):
    d = T.with_sentiment(news(m), "title")
    return d.select("news_id", report("score").alias("score"), T.sentiment_label("score").alias("label"))


# Whole documents with a lexicon of frequent words in place of financial ones.
DOC_LEXICON = T.Lexicon(bullish=["that", "with", "pour", "sich"], bearish=["this", "from", "dans", "nicht"], intense=["the", "para"], mild=["and"], negators=["in", "de", "der"])
sentiment_ctes("dscore", "documents_src", "doc_id", "text", DOC_LEXICON)
cte("documents_src", "", "SELECT doc_id, text FROM documents")


@query("document_sentiment", "dscore", f"SELECT doc_id, {q('score')} AS score FROM dscore")
def _docs(m):
    return T.with_sentiment(m.table("documents"), "text", "score", DOC_LEXICON).select("doc_id", report("score").alias("score"))


_CRED = "CASE " + " ".join(f"WHEN lower(source_type) = {s(k)} THEN {v}" for k, v in T.CREDIBILITY.items()) + " " + " ".join(f"WHEN {contains_any('lower(source)', w)} THEN {T.CREDIBILITY[k]}" for w, k in T.SOURCE_HINTS) + f" ELSE {T.DEFAULT_CREDIBILITY} END"
cte("nweight", "nscore", f"SELECT *, ({_CRED})::DOUBLE AS cred, ({_CRED})::DOUBLE * exp(-age / 48.0) AS weight FROM nscore")


@query("news_weights", "nweight", f"SELECT news_id, {q('cred', 2)} AS credibility, {q('weight', 6)} AS weight FROM nweight")
def _weights(m):
    d = dated(m)
    w = T.recency_weight("age_hours") * T.credibility("source_type", "source")
    return d.select("news_id", report(T.credibility("source_type", "source"), 2).alias("credibility"), report(w, 6).alias("weight"))


cte("nsent", "nweight", f"""SELECT *, CASE WHEN w2 > 0 THEN w * w / w2 ELSE 0 END AS en, round_even((avg_score + 1) * 50, 0) AS sentiment_score FROM (SELECT symbol, sum(weight) AS w, sum(weight * weight) AS w2, sum(weight * score) / sum(weight) AS avg_score,
  sum(weight * score * score) / sum(weight) AS m2, count(*) FILTER ({_LAB.format('score')} = 'positive') AS positive_count, count(*) FILTER ({_LAB.format('score')} = 'negative') AS negative_count, count(*) FILTER ({_LAB.format('score')} = 'neutral') AS neutral_count,
  CASE WHEN avg(CAST(regexp_matches(title, '[가-힣ㄱ-㆏]') AS INT)) >= 0.4 THEN 'ko' ELSE 'en' END AS language FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY cred DESC, news_id) AS k FROM nweight) WHERE k <= 12 GROUP BY symbol)""")


@query("news_sentiment", "nsent", f"""SELECT symbol, {q('sentiment_score', 0)} AS sentiment_score, {_LAB.format('avg_score')} AS overall, positive_count, negative_count, neutral_count, language, {q('en')} AS effective_n,
  {q('(1 - exp(-en / 4)) * (0.6 + 0.4 * (1 - least(1.0, greatest(m2 - avg_score * avg_score, 0))))')} AS quality FROM nsent""")
def _nsent(m):
    d = sentiments(m)
    return d.select("symbol", report("sentiment_score", 0).alias("sentiment_score"), "overall", "positive_count", "negative_count", "neutral_count", "language", report("effective_n").alias("effective_n"), report("quality").alias("quality"))


def sentiments(m):
    return N.news_sentiment(dated(m), ["symbol"], "news_id")


@query("recent_disclosures", "news", f"SELECT symbol, news_id, 'dart' AS source_type, place FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY published DESC, news_id) AS place FROM news WHERE event_type = 'purchase' AND published >= TIMESTAMP '{AS_OF}' - INTERVAL 90 DAY) WHERE place <= 5")
def _disc(m):
    d = N.recent_disclosures(news(m).filter("event_type = 'purchase'"), F.to_timestamp(F.lit(AS_OF)))
    return d.select("symbol", "news_id", "source_type", F.col("place").cast("long").alias("place"))


_FMT = ["strftime(ts, '%Y.%m.%d %H:%M:%S')", "strftime(ts, '%Y.%m.%d %H:%M')", "strftime(ts, '%Y-%m-%d %H:%M:%S')", "strftime(ts, '%a, %d %b %Y %H:%M:%S GMT')", "'soon'"]


@query("time_parsing", "", f"""SELECT event_id, CAST(ax AS VARCHAR) AS parsed, CASE WHEN ax IS NULL THEN NULL WHEN d < 60 THEN 'now' WHEN d < 3600 THEN CAST(d // 60 AS VARCHAR) || 'm' WHEN d < 86400 THEN CAST(d // 3600 AS VARCHAR) || 'h' WHEN d // 86400 < 7 THEN CAST(d // 86400 AS VARCHAR) || 'd' ELSE strftime(ax, '%m/%d') END AS ago FROM (
  SELECT event_id, ax, date_diff('second', ax, TIMESTAMP '2024-01-31 00:00:00') AS d FROM (SELECT event_id, CASE event_id % 5 WHEN 4 THEN NULL WHEN 1 THEN date_trunc('minute', ts) ELSE date_trunc('second', ts) END AS ax FROM events))""")
def _times(m):
    ts = F.col("ts").cast("timestamp")
    raw = F.when(F.col("event_id") % 5 == 0, F.date_format(ts, "yyyy.MM.dd HH:mm:ss")).when(F.col("event_id") % 5 == 1, F.date_format(ts, "yyyy.MM.dd HH:mm")).when(F.col("event_id") % 5 == 2, F.date_format(ts, "yyyy-MM-dd HH:mm:ss"))
    raw = raw.when(F.col("event_id") % 5 == 3, F.date_format(ts, "E, dd MMM yyyy HH:mm:ss 'GMT'")).otherwise("soon")
    d = m.table("events").withColumn("raw", raw).withColumns({"at": T.parse_time("raw"), "as_of": F.to_timestamp(F.lit(AS_OF))})
    return d.select("event_id", F.date_format("at", "yyyy-MM-dd HH:mm:ss").alias("parsed"), F.when(F.col("at").isNotNull(), T.time_ago("at", "as_of")).alias("ago"))


@query("dated_news", "", """SELECT event_id, strftime(p, '%Y-%m-%d %H:%M:%S') AS published, floor(CASE WHEN event_id % 7 = 0 THEN event_id % 50 + 0.5 ELSE greatest(0.0, (epoch_us(TIMESTAMP '2024-01-20 00:00:00') - epoch_us(p)) / 3.6e9) END * 1e4 + 0.500001) / 1e4 AS age_hours FROM (
  SELECT event_id, CASE event_id % 5 WHEN 4 THEN NULL WHEN 1 THEN CAST(CAST(ts AS DATE) AS TIMESTAMP) ELSE date_trunc('second', ts) END AS p FROM events)""")
def _dated(m):
    """News lines in JSON with the one or the other time field, or none; an age that a line brings stays."""
    ts, k = F.col("ts").cast("timestamp"), F.col("event_id") % 5
    line = F.to_json(F.struct(
        F.col("user_id").cast("string").alias("symbol"), F.when(k == 0, F.unix_timestamp(ts).cast("double")).alias("published_ts"), F.when(k == 1, F.date_format(ts, "yyyy.MM.dd")).alias("date"),
        F.when(k == 2, F.date_format(ts, "yyyy-MM-dd HH:mm:ss")).alias("published"), F.when(k == 3, F.date_format(ts, "E, dd MMM yyyy HH:mm:ss 'GMT'")).alias("pubDate"), F.when(F.col("event_id") % 7 == 0, F.col("event_id") % 50 + 0.5).alias("age_hours")))
    d = m.table("events").select("event_id", F.from_json(line, R.NEWS).alias("n")).select("event_id", "n.*")
    d = R.dated_news(d, F.to_timestamp(F.lit("2024-01-20 00:00:00")))
    return d.select("event_id", F.date_format("published_at", "yyyy-MM-dd HH:mm:ss").alias("published"), report("age_hours").alias("age_hours"))


@query("link_forms", "", """SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'https://n.example/article/' || CAST(page_id AS VARCHAR) || '/' || CAST(page_id * 7 AS VARCHAR) WHEN page_id % 3 = 1 THEN 'https://example.org/p/' || CAST(page_id AS VARCHAR) ELSE url END AS link FROM pages""")
def _links(m):
    p = F.col("page_id")
    href = F.when(p % 3 == 0, F.concat(F.lit("/item/news_read?office_id="), p.cast("string"), F.lit("&article_id="), (p * 7).cast("string"))).when(p % 3 == 1, F.concat(F.lit("/p/"), p.cast("string"))).otherwise(F.col("url"))
    return m.table("pages").select("page_id", T.canonical_link(href, "https://n.example/article", "https://example.org").alias("link"))


@query("substring_positions", "documents_src", "SELECT doc_id, CAST(len(string_split(text, 'the')) - 1 AS BIGINT) AS occurrences, CAST(CASE WHEN contains(text, 'the') THEN strpos(text, 'the') - 1 ELSE -1 END AS BIGINT) AS first_at FROM documents_src")
def _subs(m):
    d = m.table("documents").withColumn("at", T.find_all("text", "the"))
    return d.select("doc_id", F.size("at").cast("long").alias("occurrences"), F.coalesce(F.get("at", F.lit(0)), F.lit(-1)).cast("long").alias("first_at"))


# -- briefings --------------------------------------------------------------------------------

cte("snews", "news latest", f"SELECT n.news_id, n.symbol, date_trunc('second', n.published) AS published, n.title, l.sector, l.cluster, {impact_sql('stock')} AS impact FROM news n JOIN latest l USING (symbol)")


def stock_news(m):
    """News items of listed symbols, to the second, with sector and cluster."""
    d = news(m).select("news_id", "symbol", F.date_trunc("second", "published").alias("published"), "title").withColumn("impact", T.impact("title"))
    return d.join(m.universe.select("symbol", "sector", "cluster"), "symbol").join(m.latest_moves.select("symbol"), "symbol", "left_semi")


@query("sector_headlines", "snews", """SELECT sector, CAST(place AS BIGINT) AS place, symbol, news_id, title, impact, CAST(published AS VARCHAR) AS published FROM (
  SELECT *, row_number() OVER (PARTITION BY sector ORDER BY published DESC, news_id) AS place FROM (SELECT * FROM snews QUALIFY row_number() OVER (PARTITION BY sector, title ORDER BY symbol, news_id) = 1)) WHERE place <= 5""")
def _heads(m):
    d = N.sector_headlines(stock_news(m))
    return d.select("sector", F.col("place").cast("long").alias("place"), "symbol", "news_id", "title", "impact", F.date_format("published", "yyyy-MM-dd HH:mm:ss").alias("published"))


@query("sector_entries", "latest night snews", f"""SELECT l.sector, l.symbol, l.name, l.direction, {q('l.change_pct')} AS change_pct, o.overnight, CAST(coalesce(k, 0) AS BIGINT) AS news_count, t.title AS latest_title, t.impact AS latest_impact
  FROM latest l JOIN night o USING (symbol) LEFT JOIN (SELECT symbol, count(*) AS k FROM snews GROUP BY symbol) c USING (symbol) LEFT JOIN (SELECT * FROM snews QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY published DESC, news_id) = 1) t USING (symbol)""")
def _entries(m):
    stocks = m.latest_moves.select("sector", "symbol", "name", "direction", "change_pct").join(overnight(m).select("symbol", "overnight"), "symbol")
    d = N.with_latest(stocks, stock_news(m), ["symbol"])
    return d.select("sector", "symbol", "name", "direction", report("change_pct").alias("change_pct"), "overnight", "news_count", "latest_title", "latest_impact")
