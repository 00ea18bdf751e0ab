"""The registered queries of the operators, and the SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barline.llm import bpe, collocations, decontaminate, infill, langid, licences, ppm, quality, sharding, simhash, store, substrings, tokenfile, toxicity

#: The tokenizer file of the encoding queries.
TOKENIZER = "word_bpe_49k.json"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return deco


def _documents(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/documents.parquet")


def _remainder(n: int) -> Column:
    """crc32(doc_id as text) mod n; a null id counts as an empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(n))


@query("op1_context_mixing_coder")
def op1(spark, path):
    files = store.shared_path(spark, "tokens")
    tokenfile.write_tokens(_documents(spark, path), public_tokenizers.path(TOKENIZER), files)
    return tokenfile.read_tokens(spark, files).select("doc_id", "start", "n_tokens", F.crc32("tokens").alias("ids_crc32"))


@query("op2_ppm_language")
def op2(spark, path):
    docs = _documents(spark, path)
    trees = langid.train(docs.where(_remainder(5) != 0))
    return langid.identify(docs, trees).select("doc_id", (_remainder(5) == 0).alias("held_out"), "lang_pred", "score")


@query("op3_weak_toxicity")
def op3(spark, path):
    docs, labels = _documents(spark, path), spark.read.parquet(f"{path}/labels.parquet")
    model = toxicity.train(docs, labels.where(_remainder(3) != 1))
    return toxicity.score(docs, model).select("doc_id", (_remainder(3) == 1).alias("held_out"), "score", "predicted")


@query("op4_licence_scan")
def op4(spark, path):
    """A document's path is source/language/id."""
    place = F.concat_ws("/", F.coalesce("source", F.lit("-")), F.coalesce("lang", F.lit("-")), F.coalesce(F.col("doc_id").cast("string"), F.lit("-")))
    out = licences.scan(_documents(spark, path).select("doc_id", place.alias("path"), "text"))
    return out.select("doc_id", "path", "own_licence", F.round("own_score", 6).alias("own_score"), "licence_file", "licence", "licence_from")


_WORD = r"[^\x20\x09-\x0D]"


@query(
    "op5_line_frequency",
    f"""WITH d AS (SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS t FROM documents),
m AS (SELECT *, regexp_extract_all(t, '{_WORD}+') AS ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{_WORD}')) AS ls FROM d),
w AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, array_to_string(list_slice(ws, i, i + 4), ' ')) AS n FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM m WHERE len(ws) >= 5)),
c AS (SELECT doc_id, sum(least(5, coalesce(nxt - i, 5))) AS n FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM w WHERE n > 1) GROUP BY doc_id),
l AS (SELECT doc_id, host, t, lower(array_to_string(regexp_extract_all(x, '{_WORD}+'), ' ')) AS line, len(regexp_extract_all(x, '{_WORD}+')) AS k FROM (SELECT doc_id, host, t, unnest(ls) AS x FROM m)),
f AS (SELECT host, line FROM (SELECT host, line, count(DISTINCT t) AS n FROM l GROUP BY host, line) JOIN (SELECT host, count(DISTINCT t) AS texts FROM d GROUP BY host) USING (host) WHERE n >= 20 AND n > 0.1 * texts),
g AS (SELECT doc_id, sum(k) AS k FROM l JOIN f USING (host, line) GROUP BY doc_id),
b AS (SELECT m.doc_id, len(ws) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS n_symbols,
  len(ls) - len(list_distinct(ls)) AS n_dup_lines, CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(g.k, 0) AS BIGINT) AS removed_words FROM m LEFT JOIN c USING (doc_id) LEFT JOIN g USING (doc_id))
SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND NOT (removed_words > 0.6 * n_words OR (removed_words > 0 AND n_words - removed_words < 10)) AS kept FROM b""",
)
def op5(spark, path):
    out = quality.quality(_documents(spark, path))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "removed_words")


@query("op6_simhash_pigeonhole")
def op6(spark, path):
    return simhash.near_duplicates(_documents(spark, path))


@query(
    "op7_interval_tree",
    """WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, p, substr(h, 2 * p + 1, 100) AS s FROM (SELECT doc_id, h, unnest(range(0, greatest(length(h) // 2 - 49, 0))) AS p FROM d)),
c AS (SELECT doc_id, p FROM w JOIN (SELECT s, min(doc_id) AS least FROM w GROUP BY s) USING (s) WHERE doc_id > least),
g AS (SELECT doc_id, p, CASE WHEN p - lag(p) OVER (PARTITION BY doc_id ORDER BY p) <= 50 THEN 0 ELSE 1 END AS n FROM c),
r AS (SELECT doc_id, k, min(p) AS a, max(p) + 50 AS b FROM (SELECT doc_id, p, sum(n) OVER (PARTITION BY doc_id ORDER BY p) AS k FROM g) GROUP BY doc_id, k),
x AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS q FROM r),
k AS (SELECT doc_id, sum(b - a) AS gone, count(*) AS spans, max(b) AS e, string_agg(substr(h, 2 * q + 1, 2 * (a - q)), '' ORDER BY a) AS kept FROM x JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, CAST(coalesce(spans, 0) AS BIGINT) AS n_spans,
  sha256(unhex(coalesce(kept || substr(h, 2 * e + 1), h))) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)""",
)
def op7(spark, path):
    out = substrings.remove_repeats(_documents(spark, path).select("doc_id", "text"))
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    return out.select("doc_id", size.alias("n_bytes"), "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query("op8_bpe_pair_index")
def op8(spark, path):
    file = public_tokenizers.path(TOKENIZER)
    ids = bpe.encode(_documents(spark, path).select("doc_id", "text"), file).select("doc_id", "ids")
    return bpe.digests(bpe.decode(ids, file), "doc_id")


@query("op9_pigeonhole_edit")
def op9(spark, path):
    return decontaminate.matches(_documents(spark, path), spark.read.parquet(f"{path}/benchmark.parquet"))


@query("op10_histogram_sort")
def op10(spark, path):
    out = sharding.shard_documents(_documents(spark, path), shards=8)
    return out.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


@query(
    "op11_quotient_filter_collocations",
    r"""WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS ws FROM (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS p FROM d)),
g AS (SELECT lang, ws[i:i + k - 1] AS ws FROM (SELECT lang, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM p, range(1, 6) AS x(k) WHERE len(ws) >= k)),
f AS (SELECT lang, ws, count(*) AS f FROM g GROUP BY lang, ws HAVING count(*) >= 100),
n AS (SELECT lang, sum(len(ws)) AS n FROM p GROUP BY lang),
c AS (SELECT lang, ws, f AS a, unnest(range(1, len(ws))) AS k FROM f WHERE len(ws) > 1),
s AS (SELECT c.lang, c.ws, a, k, x.f AS l, y.f AS r, n.n, (1000 * CAST(a AS HUGEINT) * n.n) // (CAST(x.f AS HUGEINT) * y.f) AS score
  FROM c JOIN f x ON x.lang = c.lang AND x.ws = c.ws[1:k] JOIN f y ON y.lang = c.lang AND y.ws = c.ws[k + 1:] JOIN n ON n.lang = c.lang),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, ws ORDER BY score, k) = 1),
u AS (SELECT lang, ws, max(f) AS f FROM (SELECT lang, unnest([ws[1:len(ws) - 1], ws[2:]]) AS ws, f FROM f WHERE len(ws) > 2) GROUP BY lang, ws),
o AS (SELECT b.lang, array_to_string(b.ws, ' ') AS phrase, a, l, r, n, score FROM b LEFT JOIN u USING (lang, ws) WHERE 100 * coalesce(u.f, 0) < 100 * a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM o QUALIFY rank <= 2000""",
)
def op11(spark, path):
    return collocations.collocations(_documents(spark, path))


@query("op12_ppm_scores")
def op12(spark, path):
    out = ppm.score(_documents(spark, path), _remainder(10) != 0)
    return out.select("doc_id", (_remainder(10) == 0).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query(
    "op13_secondary_sort_infill",
    r"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS s FROM documents),
u AS (SELECT doc_id, t, regexp_extract_all(t, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS us, list_transform([0, 1, 2, 3], lambda i: CAST('0x' || substr(s, 8 * i + 1, 8) AS BIGINT)) AS h FROM d),
c AS (SELECT *, len(us) AS n, least(h[1] % (len(us) + 1), h[2] % (len(us) + 1)) AS a, greatest(h[1] % (len(us) + 1), h[2] % (len(us) + 1)) AS b,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h[3] % 100 >= 50 THEN 'plain' WHEN h[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT doc_id, t, n, form, array_to_string(us[1:a], '') AS p, array_to_string(us[a + 1:b], '') AS m, array_to_string(us[b + 1:n], '') AS z FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || z || '<M>' || m ELSE '<S>' || z || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256 FROM p""",
)
def op13(spark, path):
    return infill.digests(infill.pieces(_documents(spark, path)))
