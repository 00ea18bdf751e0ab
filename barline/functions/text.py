"""Headline scoring: impact classes, language, lexicon sentiment, recency and credibility.

All scoring stays in built-in expressions; lexicons are arguments with the fixed lists as defaults.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from barline.functions.numeric import col

# Impact patterns, in three variants.
STOCK_POSITIVE = ["상승", "급등", "강세", "반등", "신고가", "최고치", "돌파", "호실적", "실적\\s*개선", "영업이익\\s*증가", "어닝\\s*서프라이즈", "상향", "수주", "체결", "공급\\s*계약", "라이선스", "승인", "허가", "특허", "자사주\\s*매입", "자사주\\s*소각", "배당\\s*(인상|증가|확대)", "흑자\\s*전환", "수혜", "성장", "호재", "랠리", "폭등", "인수", "M&A", "골든크로스", "최대\\s*실적", "사상\\s*최대", "어닝\\s*비트", "목표가\\s*상향", "매수\\s*추천", "투자의견\\s*상향", "긍정적", "수주잔고", "호조", "낙관"]
STOCK_NEGATIVE = ["하락", "급락", "약세", "부진", "적자", "쇼크", "저조", "감소", "하향", "실패", "철회", "취소", "리스크", "부담", "제재", "과징금", "횡령", "배임", "소송", "경고", "우려", "손실", "위기", "낙폭", "추락", "불안", "악재", "하회", "둔화", "논란", "감원", "구조조정", "적자\\s*전환", "매도\\s*추천", "투자의견\\s*하향", "목표가\\s*하향", "부정적", "데드크로스", "실망감", "어닝\\s*쇼크", "실적\\s*쇼크", "규제", "조사", "경영권\\s*분쟁"]
MACRO_POSITIVE = ["상승", "급등", "강세", "반등", "신고가", "돌파", "호실적", "영업이익\\s*증가", "수주", "승인", "허가", "자사주", "배당\\s*(인상|증가)", "흑자", "수혜", "성장", "호재", "랠리", "낙관", "최대\\s*실적"]
MACRO_NEGATIVE = ["하락", "급락", "약세", "부진", "적자", "감소", "제재", "과징금", "소송", "경고", "우려", "손실", "위기", "부담", "둔화", "논란", "규제", "조사", "리스크"]
SECTOR_POSITIVE = ["상승", "급등", "강세", "반등", "신고가", "돌파", "호실적", "영업이익", "수주", "승인", "허가", "배당", "흑자", "수혜", "성장", "호재", "랠리", "최대\\s*실적", "낙관"]
IMPACT = {"stock": (STOCK_POSITIVE, STOCK_NEGATIVE), "macro": (MACRO_POSITIVE, MACRO_NEGATIVE), "sector": (SECTOR_POSITIVE, MACRO_NEGATIVE)}

# Sentiment words and their modifiers.
EN_BULLISH = "surge surges rally soar jump gain gains rise rises high record boom bull bullish breakout upgrade beat beats strong growth profit buy outperform optimistic boost recover recovery momentum upside milestone approval".split()
EN_BEARISH = "crash plunge drop drops fall falls decline low sell bear bearish loss losses miss misses weak warning fear risk cut cuts downgrade layoff bankruptcy debt recession crisis lawsuit fraud hack worst collapse tank".split()
EN_INTENSE = "strongly sharply sharp surge soar massive record huge significantly substantially steep skyrocket".split()
EN_MILD = "slightly marginally modest slight somewhat mild tad".split()
EN_NEGATORS = "no not never without fails failed lacks lack unlikely denies denied avoid avoids isn't aren't wasn't don't doesn't didn't cannot".split()
KR_BULLISH = ["급등", "상승", "강세", "호재", "신고가", "돌파", "최대", "흑자전환", "흑자", "성장", "개선", "호실적", "순익", "수익", "반등", "기대", "상향", "수혜", "견조", "역대", "사상 최대", "훈풍", "강세장", "낙관", "회복", "수주", "신기록"]
KR_BEARISH = ["급락", "하락", "약세", "악재", "신저가", "적자전환", "적자", "감소", "경고", "리스크", "우려", "부진", "손실", "하향", "쇼크", "폭락", "위기", "축소", "둔화", "리콜", "제재", "조사", "소송", "횡령", "분식", "경색", "충격", "불안"]
KR_INTENSE = ["급", "대폭", "크게", "사상", "역대", "최대", "강하게", "대규모", "훌쩍", "폭"]
KR_MILD = ["소폭", "약간", "다소", "소규모", "미미", "제한적"]
KR_FLIP_AFTER = ["해소", "완화", "불식", "벗어", "진정", "안도"]
PHRASES_POSITIVE = {"beats estimates": 2.0, "earnings beat": 2.0, "record high": 2.0, "all-time high": 2.2, "raises guidance": 2.0, "better than expected": 2.0, "strong demand": 1.5, "buy rating": 1.5, "price target raised": 1.8, "사상 최대": 2.0, "어닝 서프라이즈": 2.2, "실적 호조": 2.0, "신고가 경신": 1.8, "목표가 상향": 1.8, "흑자 전환": 2.0, "흑자전환": 2.0, "자사주 매입": 1.5, "배당 확대": 1.4, "대규모 수주": 1.8}
PHRASES_NEGATIVE = {"misses estimates": 2.0, "profit warning": 2.2, "cuts guidance": 2.0, "guidance cut": 2.0, "worse than expected": 2.0, "below expectations": 1.8, "files for bankruptcy": 2.5, "sell rating": 1.5, "price target cut": 1.8, "어닝 쇼크": 2.2, "실적 쇼크": 2.2, "적자 전환": 2.0, "적자전환": 2.0, "목표가 하향": 1.8, "신저가": 1.6, "유상증자": 1.2, "분식회계": 2.5, "상장폐지": 2.5, "거래정지": 2.0}
SIGNS_UP, SIGNS_DOWN = ["▲", "△", "↑", "🚀", "📈"], ["▼", "▽", "↓", "📉"]
CREDIBILITY = {"dart": 1.00, "disclosure": 0.95, "filing": 0.95, "공시": 0.95, "wire": 0.90, "naver": 0.85, "news": 0.80, "google_news": 0.60, "google": 0.60, "rss": 0.60, "community": 0.35, "blog": 0.30}
DEFAULT_CREDIBILITY = 0.65
# Source names that imply a type, first match first.
SOURCE_HINTS = [(["dart", "공시", "전자공시", "filing"], "disclosure"), (["naver", "네이버"], "naver"), (["google"], "google_news"), (["blog", "블로그", "카페", "community", "커뮤니티"], "community")]

WORD_BREAK = "[^\\p{L}\\p{N}_]+"
PERCENT = "([+-])\\s?(\\d+(?:\\.\\d+)?)\\s?%"


@dataclass(frozen=True)
class Lexicon:
    bullish: list = field(default_factory=lambda: EN_BULLISH)
    bearish: list = field(default_factory=lambda: EN_BEARISH)
    intense: list = field(default_factory=lambda: EN_INTENSE)
    mild: list = field(default_factory=lambda: EN_MILD)
    negators: list = field(default_factory=lambda: EN_NEGATORS)


def impact(title, variant: str = "stock") -> Column:
    pos, neg = (F.coalesce(col(title), F.lit("")).rlike("|".join(p)) for p in IMPACT[variant])
    return F.when(pos & ~neg, "positive").when(neg & ~pos, "negative").otherwise("neutral")


def has_hangul(text) -> Column:
    return F.coalesce(col(text), F.lit("")).rlike("[가-힣ㄱ-㆏]")


def dominant_language(share_of_hangul: Column) -> Column:
    return F.when(share_of_hangul >= 0.4, "ko").otherwise("en")


def find_all(text, sub: str | Column) -> Column:
    """0-based starts of all non-overlapping occurrences."""
    sub_c = F.lit(sub) if isinstance(sub, str) else sub
    quoted = F.concat(F.lit("\\Q"), sub_c, F.lit("\\E"))
    parts = F.split(col(text), quoted)
    start = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<int>)").alias("found"))

    def step(s: Column, part: Column) -> Column:
        """``at`` is where the next part starts; an occurrence ends there, but for the first."""
        here = s["at"] + F.length(part)
        return F.struct((here + F.length(sub_c)).alias("at"), F.concat(s["found"], F.array(here)).alias("found"))

    return F.aggregate(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), start, step)["found"]


def _any(text: Column, words: list[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(text, F.lit(w))
    return out


def _strength(text: Column, phrases: dict[str, float], low: Column) -> Column:
    out = F.lit(0.0)
    for p, w in phrases.items():
        out = out + F.when(F.contains(low, F.lit(p)) | F.contains(text, F.lit(p)), w).otherwise(0.0)
    return out


def _english(low: Column, lex: Lexicon) -> Column:
    """Struct (pos, neg). One pass over the tokens; the state is the running sums and the three tokens before."""
    tokens = F.split(low, WORD_BREAK)

    def code(t):
        base = F.when(t.isin(lex.bullish), 1.0).when(t.isin(lex.bearish), -1.0).otherwise(0.0)
        mult = F.when(t.isin(lex.intense), 1.5).otherwise(1.0) * F.when(t.isin(lex.mild), 0.6).otherwise(1.0)
        return F.struct(base.alias("b"), F.when(t.isin(lex.negators), -1.0).otherwise(1.0).alias("s"), mult.alias("m"))

    one = lambda: F.struct(F.lit(1.0).alias("s"), F.lit(1.0).alias("m"))
    zero = F.struct(F.lit(0.0).alias("pos"), F.lit(0.0).alias("neg"), one().alias("x1"), one().alias("x2"), one().alias("x3"))

    def step(a, t):
        v = t["b"] * (a["x3"]["m"] * a["x2"]["m"] * a["x1"]["m"]) * (a["x3"]["s"] * a["x2"]["s"] * a["x1"]["s"])
        return F.struct((a["pos"] + F.greatest(v, F.lit(0.0))).alias("pos"), (a["neg"] + F.greatest(-v, F.lit(0.0))).alias("neg"),
                        F.struct(t["s"].alias("s"), t["m"].alias("m")).alias("x1"), a["x1"].alias("x2"), a["x2"].alias("x3"))

    return F.aggregate(F.transform(tokens, code), zero, step)


def _korean(raw: Column) -> Column:
    """Struct (pos, neg) of Korean words with the words around them."""
    words = F.array(*[F.struct(F.lit(w).alias("w"), F.lit(b).alias("b")) for b, ws in ((1.0, KR_BULLISH), (-1.0, KR_BEARISH)) for w in ws])
    present = F.filter(words, lambda x: F.contains(raw, x["w"]))
    cut = F.transform(present, lambda x: F.struct(x["w"].alias("w"), x["b"].alias("b"), F.split(raw, x["w"]).alias("parts")))

    def signal(x, k):
        i = F.aggregate(F.slice(x["parts"], 1, k), F.lit(0), lambda a, p: a + F.length(p)) + (k - 1) * F.length(x["w"])
        spot = F.array(F.struct(F.substring(raw, F.greatest(i - 4, F.lit(0)) + 1, F.least(i, F.lit(4))).alias("before"), F.substring(raw, i + F.length(x["w"]) + 1, F.lit(6)).alias("after")))

        def value(p):
            v = x["b"] * F.when(p["before"].rlike("|".join(KR_INTENSE)), 1.5).otherwise(1.0) * F.when(p["before"].rlike("|".join(KR_MILD)), 0.6).otherwise(1.0)
            return F.when((x["b"] < 0) & p["after"].rlike("|".join(KR_FLIP_AFTER)), F.abs(v) * 0.8).otherwise(v)

        return F.transform(spot, value)[0]

    values = F.flatten(F.transform(cut, lambda x: F.transform(F.sequence(F.lit(1), F.size(x["parts"]) - 1), lambda k: signal(x, k))))
    zero = F.struct(F.lit(0.0).alias("pos"), F.lit(0.0).alias("neg"))
    total = F.aggregate(values, zero, lambda a, v: F.struct((a["pos"] + F.greatest(v, F.lit(0.0))).alias("pos"), (a["neg"] + F.greatest(-v, F.lit(0.0))).alias("neg")))
    return F.when(has_hangul(raw), total).otherwise(zero)


def with_sentiment(df: DataFrame, text: str, out: str = "score", lexicon: Lexicon = Lexicon()) -> DataFrame:
    """Adds the score -1..1 of whole texts: phrases, arrows, signed percentages, Korean and English words.

    The word scores are columns of their own first, so that each text is walked once.
    """
    raw = F.coalesce(F.col(text), F.lit(""))
    zero = F.struct(F.lit(0.0).alias("pos"), F.lit(0.0).alias("neg"))

    def move(a, m):
        v = F.least(F.lit(1.2), 0.3 + F.regexp_extract(m, PERCENT, 2).cast("double") / 15.0)
        up = F.substring(m, 1, 1) == "+"
        return F.struct((a["pos"] + F.when(up, v).otherwise(0.0)).alias("pos"), (a["neg"] + F.when(up, 0.0).otherwise(v)).alias("neg"))

    d = df.withColumn("_low", F.lower(raw)).withColumns({
        "_en": _english(F.col("_low"), lexicon), "_kr": _korean(raw), "_mv": F.aggregate(F.regexp_extract_all(raw, F.lit(PERCENT), 0), zero, move),
    })
    low = F.col("_low")
    pos = _strength(raw, PHRASES_POSITIVE, low) + F.when(_any(raw, SIGNS_UP), 0.7).otherwise(0.0)
    neg = _strength(raw, PHRASES_NEGATIVE, low) + F.when(_any(raw, SIGNS_DOWN), 0.7).otherwise(0.0)
    for part in ("_mv", "_kr", "_en"):
        pos, neg = pos + F.col(f"{part}.pos"), neg + F.col(f"{part}.neg")
    score = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (pos - neg) / 3.0))
    return d.withColumn(out, score).drop("_low", "_en", "_kr", "_mv")


def sentiment_label(score) -> Column:
    return F.when(col(score) > 0.2, "positive").when(col(score) < -0.2, "negative").otherwise("neutral")


def recency_weight(age_hours) -> Column:
    a = col(age_hours)
    return F.when(a.isNull(), 0.5).when(a < 0, 1.0).otherwise(F.exp(-a / 48.0))


def credibility(source_type, source) -> Column:
    kind, name = F.lower(F.trim(F.coalesce(col(source_type), F.lit("")))), F.lower(F.coalesce(col(source), F.lit("")))
    out = None
    for k, v in CREDIBILITY.items():
        out = F.when(kind == k, v) if out is None else out.when(kind == k, v)
    for words, k in SOURCE_HINTS:
        out = out.when(_any(name, words), CREDIBILITY[k])
    return out.otherwise(DEFAULT_CREDIBILITY)


def parse_time(raw) -> Column:
    """Timestamps in ISO form or with dots; NULL when none of the formats fits."""
    s = F.trim(col(raw))
    formats = ["yyyy.MM.dd HH:mm:ss", "yyyy.MM.dd HH:mm", "yyyy.MM.dd", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm", "EEE, dd MMM yyyy HH:mm:ss"]
    plain = F.regexp_replace(s, "\\s+GMT$", "")
    return F.coalesce(F.try_to_timestamp(s), *[F.try_to_timestamp(plain, F.lit(f)) for f in formats if not f.startswith("EEE")], rfc_time(plain))


def rfc_time(plain: Column) -> Column:
    """``Mon, 02 Jun 2026 09:00:00`` without a pattern letter for the weekday."""
    p = "^[A-Za-z]{3}, (\\d{1,2}) ([A-Za-z]{3}) (\\d{4}) (\\d{2}:\\d{2}:\\d{2})$"
    g = lambda i: F.regexp_extract(plain, p, i)
    month = F.array_position(F.array(*[F.lit(m) for m in "Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec".split()]), g(2))
    text = F.format_string("%s-%02d-%s %s", g(3), month, F.lpad(g(1), 2, "0"), g(4))
    return F.when(plain.rlike(p), F.try_to_timestamp(text))


def age_hours(stamp, as_of) -> Column:
    return F.greatest(F.lit(0.0), (F.unix_micros(col(as_of)) - F.unix_micros(col(stamp))) / 3.6e9)


def time_ago(stamp, as_of) -> Column:
    """Bucket and count: now, minutes, hours, days; the month and day from a week on."""
    s = F.floor((F.unix_micros(col(as_of)) - F.unix_micros(col(stamp))) / 1e6)
    return (
        F.when(s < 60, "now").when(s < 3600, F.concat(F.floor(s / 60).cast("string"), F.lit("m"))).when(s < 86400, F.concat(F.floor(s / 3600).cast("string"), F.lit("h")))
        .when(F.floor(s / 86400) < 7, F.concat(F.floor(s / 86400).cast("string"), F.lit("d"))).otherwise(F.date_format(col(stamp), "MM/dd"))
    )


def canonical_link(href, article_base: str, site_base: str) -> Column:
    """Article links by their two ids, site-relative links made absolute, others as they are."""
    h = col(href)
    office, article = F.regexp_extract(h, "office_id=(\\d+)", 1), F.regexp_extract(h, "article_id=(\\d+)", 1)
    is_article = F.contains(h, F.lit("news_read")) & (office != "") & (article != "")
    return F.when(is_article, F.concat(F.lit(article_base + "/"), office, F.lit("/"), article)).when(h.startswith("/"), F.concat(F.lit(site_base), h)).otherwise(h)


def share(c: Column) -> Column:
    return F.avg(c.cast("double"))
