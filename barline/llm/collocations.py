"""Phrase collocations by counting quotient filters.

Phrases grow word by word: a phrase of k words is counted only where both its parts of k - 1 words are frequent. Each
chunk of texts packs the word ids of its phrases into two half words, permutes them invertibly, and counts them in
filters: the leading bits of a permuted phrase name its bucket and quotient (kept in unary), the others are its full
remainder, so a filter is compact, sorted and loses nothing. Filters of a bucket from all chunks are merged; each chunk
gets back one bit for each phrase it sent. No table of words or phrases is ever in one place.
"""

from __future__ import annotations

import itertools
import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import window as w
from pyspark.sql.pandas.types import to_arrow_schema

from barline.llm.ppm import groups, pack, pack_words, unpack, unpack_words
from barline.llm.store import saved, slices, utf8
from barline.llm.words import ragged

#: Most words of a phrase; bits of a word id that five of them leave room for.
LONGEST, WIDEST = 5, 25
#: Bytes of text of a chunk and of a step of cutting it into words; elements merged at once.
CHUNK, STEP, MERGED = 8 << 20, 1 << 20, 1 << 20
#: Bytes of text for each bucket: few in small inputs, more in large ones.
LEAST_BUCKET, MOST_BUCKET = 16 << 20, 1 << 30
_BREAKS = b".,;:!?\x0b\x0c\r"
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t" + _BREAKS, b"abcdefghijklmnopqrstuvwxyz " + b"\n" * len(_BREAKS))
_ROUNDS = [np.uint64(c) for c in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


def permuted(left: np.ndarray, right: np.ndarray, half: int, back: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """A bijection of pairs of numbers of ``half`` bits, and the way back."""
    down, low = np.uint64(64 - half), np.uint64(31)

    def mixed(x, c):
        x = (x + c) * _ROUNDS[2]
        return (x ^ x >> low) * c >> down

    for c in reversed(_ROUNDS) if back else _ROUNDS:
        left, right = (right ^ mixed(left, c), left) if back else (right, left ^ mixed(right, c))
    return left, right


def packed(words: list[np.ndarray], width: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Word ids of ``width`` bits side by side in two numbers of so many bits each."""
    half = -(-len(words) * width // 2)
    left, right = (np.zeros(len(words[0]), np.uint64) for _ in range(2))
    for j, x in enumerate(words):
        x, at = x.astype(np.uint64), j * width
        if at >= half:
            left |= x << np.uint64(at - half)
        else:
            right |= (x << np.uint64(at)) & np.uint64((1 << half) - 1)
            if at + width > half:
                left |= x >> np.uint64(half - at)
    return left, right, half


def words_of(left: np.ndarray, right: np.ndarray, size: int, width: int) -> list[np.ndarray]:
    """The ids that ``packed`` took."""
    half, mask, out = -(-size * width // 2), np.uint64((1 << width) - 1), []
    for j in range(size):
        at = j * width
        if at >= half:
            x = left >> np.uint64(at - half)
        else:
            x = right >> np.uint64(at)
            if at + width > half:
                x |= left << np.uint64(half - at)
        out.append((x & mask).astype(np.int64))
    return out


def summed(left: np.ndarray, right: np.ndarray, n: np.ndarray, half: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Different pairs in order with the sums of ``n``; the order of the rows, and where in it each pair begins."""
    if 2 * half <= 64:
        both = left << np.uint64(half) | right
        order = np.argsort(both, kind="stable")
        both = both[order]
        first = np.flatnonzero(np.concatenate([np.ones(min(1, len(both)), bool), both[1:] != both[:-1]]))
    else:
        order = np.lexsort([right, left])
        a, b = left[order], right[order]
        first = np.flatnonzero(np.concatenate([np.ones(min(1, len(a)), bool), (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
    total = np.add.reduceat(n[order], first) if len(first) else np.zeros(0, np.int64)
    return left[order[first]], right[order[first]], total, order, first


def _planes(x: np.ndarray, bits: int) -> bytes:
    return b"".join((x >> np.uint64(8 * i) & np.uint64(255)).astype(np.uint8).tobytes() for i in range(-(-bits // 8)))


def filter_of(left: np.ndarray, right: np.ndarray, n: np.ndarray, half: int, bucket_bits: int) -> bytes:
    """A counting quotient filter of sorted pairs of one bucket (the leading ``bucket_bits`` of ``left``)."""
    free = half - bucket_bits
    quotient_bits = min(free, max(len(left) - 1, 0).bit_length())
    rest = left & np.uint64((1 << free) - 1)
    unary = np.zeros(len(left) + (1 << quotient_bits), np.uint8)
    unary[(rest >> np.uint64(free - quotient_bits)).astype(np.int64) + np.arange(len(left))] = 1
    more = n - 1
    parts = [
        np.array([len(left), quotient_bits], "<u4").tobytes(), np.packbits(unary).tobytes(), _planes(rest & np.uint64((1 << free - quotient_bits) - 1), free - quotient_bits),
        _planes(right, half), np.minimum(more, 255).astype(np.uint8).tobytes(), more[more >= 255].astype("<i8").tobytes(),
    ]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def pairs_of(data: bytes, half: int, bucket_bits: int, bucket: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The sorted pairs and counts of a filter."""
    raw, at = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8), 8
    size, quotient_bits = (int(x) for x in raw[:8].view("<u4"))
    free = half - bucket_bits

    def take(k):
        nonlocal at
        at += k
        return raw[at - k : at]

    def number(bits):
        out = np.zeros(size, np.uint64)
        for i in range(-(-bits // 8)):
            out |= take(size).astype(np.uint64) << np.uint64(8 * i)
        return out

    bits = size + (1 << quotient_bits)
    ones = np.flatnonzero(np.unpackbits(take(-(-bits // 8)), count=bits))
    quotient = (ones - np.arange(size)).astype(np.uint64)
    left = np.uint64(bucket) << np.uint64(free) | quotient << np.uint64(free - quotient_bits) | number(free - quotient_bits)
    right = number(half)
    n = take(size).astype(np.int64)
    n[n == 255] = raw[at:].view("<i8") if len(raw) > at else 0
    return left, right, n + 1


def phrases_in(seq: np.ndarray, size: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Where phrases of ``size`` words start in a sequence of ids (-1 parts runs), and the permuted pair of each."""
    m = max(len(seq) - size + 1, 0)
    fits = np.ones(m, bool)
    for j in range(size):
        fits &= seq[j : j + m] >= 0
    starts = np.flatnonzero(fits)
    left, right, half = packed([seq[starts + j] for j in range(size)], width)
    return starts, *permuted(left, right, half), half


def runs_of(seq: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """The longest runs in which every phrase of ``size`` words starts in ``starts``, those of more words only, each with a -1 after it."""
    first = np.flatnonzero(np.diff(starts, prepend=-2) != 1)
    count = np.diff(first, append=len(starts))
    first, count = first[count > 1], count[count > 1]
    spans = count + size  # words, and the mark
    out, _ = ragged(np.arange(len(seq) + 1), starts[first], spans)
    out = np.append(seq, -1)[out]
    out[np.cumsum(spans) - 1] = -1
    return out.astype(np.int32)


def _squeeze(seq: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(seq.astype("<i4").tobytes())


def _sequence(data: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), "<i4").astype(np.int64)


def _batch(schema: pa.Schema, size: int, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(size, f.type) for f in schema], schema=schema)


def _arrow(ddl: str) -> tuple[T.StructType, pa.Schema]:
    schema = T._parse_datatype_string(ddl)
    return schema, to_arrow_schema(schema)


def chunks(docs: DataFrame, bits: int, text: str, lang: str) -> DataFrame:
    """Written chunks of the texts of a language. Kind 1: (chunk, lang, data: numbers of its words, -1 at breaks, other: the bucket of each word); kind 0, by bucket: (words, other: counts)."""
    schema, arrow = _arrow("chunk bigint, lang string, kind int, bucket int, data binary, other binary")

    def run(batches):
        task, numbers = TaskContext.get().partitionId() << 33, itertools.count()
        held: dict[str, list[bytes]] = {}
        sizes: Counter = Counter()

        def chunk(name):
            index, codes, number = {b"\n": 0, b"": 1}, [], task + next(numbers)
            for part in _steps(held.pop(name)):
                tokens = part.translate(_LOWER).replace(b"\n", b" \n ").split(b" ")
                index.update(zip(set(tokens).difference(index), itertools.count(len(index))))
                c = np.fromiter(map(index.__getitem__, tokens), np.int32, len(tokens))
                codes.append(c[c != 1])
            seq = np.concatenate(codes)
            words, n = list(index)[2:], np.bincount(seq, minlength=len(index))[2:]
            where = np.fromiter((zlib.crc32(x) & (1 << bits) - 1 for x in words), np.int32, len(words))
            yield _batch(arrow, 1, chunk=[number], lang=[name], kind=[1], data=[_squeeze(np.maximum(seq - 2, -1))], other=[_squeeze(where)])
            order = np.argsort(where, kind="stable")
            cut = np.flatnonzero(np.diff(where[order], prepend=-1))
            for a, b in zip(cut, [*cut[1:], len(order)]):
                i = order[a:b]
                yield _batch(arrow, 1, chunk=[number], lang=[name], kind=[0], bucket=[where[i[0]]], data=[pack_words([words[k] for k in i.tolist()])], other=[pack(n[i])])

        for b in slices(batches):
            for name, t in zip(b.column(0).to_pylist(), utf8(b.column(1))):
                held.setdefault(name, []).append(t)
                sizes[name] += len(t) + 1
                if sizes[name] >= CHUNK:
                    sizes[name] = 0
                    yield from chunk(name)
        for name in list(held):
            yield from chunk(name)

    return saved(docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")), text).mapInArrow(run, schema), "coded")


def _steps(texts: list[bytes]):
    held, size = [], 0
    for t in texts:
        held.append(t)
        size += len(t)
        if size >= STEP:
            yield b"\n".join([*held, b""])
            held, size = [], 0
    yield b"\n".join([*held, b""])


_FOUND = "kind int, lang string, chunk bigint, bucket int, data binary, word string, ids array<int>, n bigint"


def _words(found: DataFrame, least: int, bits: int, parts: int) -> DataFrame:
    """Written: kind 2 the frequent words with their id and count, kind 3 all words of a bucket (n), kind 0 the ids of each message's words (-1: rare)."""
    schema, arrow = _arrow(_FOUND)

    def run(batches):
        for bucket, messages in _buckets(batches):
            count: Counter = Counter()
            for m in messages:
                for x, k in zip(unpack_words(m[1]), unpack(m[2]).tolist()):
                    count[x] += k
            frequent = sorted(x for x, k in count.items() if k >= least)
            ids = {x: i << bits | bucket for i, x in enumerate(frequent)}
            name = messages[0][3]
            for a in range(0, len(frequent), 10_000):
                part = frequent[a : a + 10_000]
                yield _batch(arrow, len(part), kind=[2] * len(part), lang=[name] * len(part), word=pa.array(part, pa.binary()).cast(pa.string()), ids=[[ids[x]] for x in part], n=[count[x] for x in part])
            yield _batch(arrow, 1, kind=[3], lang=[name], n=[sum(count.values())])
            for chunk, words, *_ in messages:
                answer = np.fromiter((ids.get(x, -1) for x in unpack_words(words)), np.int64)
                yield _batch(arrow, 1, kind=[0], lang=[name], chunk=[chunk], bucket=[bucket], data=[_squeeze(answer)])

    return saved(_dealt(found.where("kind = 0").select("chunk", "lang", "bucket", "data", "other"), parts).mapInArrow(run, schema), "words")


def _dealt(messages: DataFrame, parts: int) -> DataFrame:
    key = F.xxhash64("lang", "bucket")
    return messages.select(key.alias("key"), "bucket", "lang", "chunk", "data", "other").repartition(parts, "key").sortWithinPartitions("key", "lang", "bucket")


def _buckets(batches):
    """Bucket, and (chunk, data, other, lang) of its messages."""
    for group in groups(batches, 0):
        rows = [r for b in group for r in zip(*(b.column(i).to_pylist() for i in range(1, 6)))]
        for (lang, bucket), some in itertools.groupby(rows, key=lambda r: (r[1], r[0])):
            yield bucket, [(chunk, data, other, lang) for _, _, chunk, data, other in some]


def _answered(state: DataFrame, answers: DataFrame, parts: int, use, ddl: str) -> DataFrame:
    """``use(chunk, lang, data, other, answers by bucket)`` for every chunk of ``state``."""
    schema, arrow = _arrow(ddl)

    def run(batches):
        for group in groups(batches, 0):
            got = []
            for b in group:
                for chunk, kind, lang, bucket, data, other in zip(*(b.column(i).to_pylist() for i in range(6))):
                    if kind == 0:
                        got.append((bucket, data))
                    else:
                        yield from use(arrow, chunk, lang, data, other, [d for _, d in sorted(got)])

    columns = ["chunk", "kind", "lang", "bucket", "data", "other"]
    rows = state.select(columns).unionByName(answers.withColumn("other", F.lit(None).cast("binary")).select(columns))
    return rows.repartition(parts, "chunk").sortWithinPartitions("chunk", "kind").mapInArrow(run, schema)


_STATE = "chunk bigint, kind int, lang string, bucket int, data binary, other binary"


def _numbered(arrow, chunk, lang, data, other, got):
    """The sequence of a chunk in ids of frequent words."""
    where = _sequence(other)
    ids = np.full(len(where) + 1, -1)
    if len(where):
        ids[np.argsort(where, kind="stable")] = np.concatenate([_sequence(d) for d in got])
    seq = ids[_sequence(data)]  # a break takes the last, -1
    yield _batch(arrow, 1, chunk=[chunk], kind=[1], lang=[lang], data=[_squeeze(runs_of(seq, np.flatnonzero(seq >= 0), 1))])


def _filters(size: int, width: int, bits: int):
    """Messages with the filters of a chunk's phrases."""
    schema, arrow = _arrow(_STATE)

    def run(batches):
        for b in batches:
            for chunk, lang, data in zip(*(b.column(i).to_pylist() for i in range(3))):
                _, left, right, half = phrases_in(_sequence(data), size, width)
                left, right, n, *_ = summed(left, right, np.ones(len(left), np.int64), half)
                own = min(bits, half)
                where = (left >> np.uint64(half - own)).astype(np.int64)
                cut = np.flatnonzero(np.diff(where, prepend=-1))
                for s, e in zip(cut, [*cut[1:], len(left)]):
                    yield _batch(arrow, 1, chunk=[chunk], kind=[0], lang=[lang], bucket=[where[s]], data=[filter_of(left[s:e], right[s:e], n[s:e], half, own)])

    return run, schema


def _merged(size: int, width: int, bits: int, least: int):
    """Kind 2: frequent phrases; kind 0: for each message one bit for each of its phrases."""
    schema, arrow = _arrow(_FOUND)
    half = -(-size * width // 2)
    own = min(bits, half)

    def run(batches):
        for bucket, messages in _buckets(batches):
            left, right, n, held, count = np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64), [], 0
            for i, m in enumerate(messages):
                held.append(pairs_of(m[1], half, own, bucket))
                count += len(held[-1][0])
                if count > max(MERGED, len(left)) or i + 1 == len(messages):
                    left, right, n, *_ = summed(*(np.concatenate(x) for x in zip((left, right, n), *held)), half)
                    held, count = [], 0
            left, right, n = left[n >= least], right[n >= least], n[n >= least]
            name = messages[0][3]
            ids = np.stack(words_of(*permuted(left, right, half, back=True), size, width), axis=1).astype(np.int32)
            for a in range(0, len(n), 10_000):
                part = pa.FixedSizeListArray.from_arrays(pa.array(ids[a : a + 10_000].reshape(-1)), size).cast(pa.list_(pa.int32()))
                yield _batch(arrow, len(part), kind=[2] * len(part), lang=[name] * len(part), ids=part, n=n[a : a + 10_000])
            for chunk, data, *_ in messages:
                a, b, _ = pairs_of(data, half, own, bucket)
                _, _, _, order, first = summed(np.concatenate([left, a]), np.concatenate([right, b]), np.ones(len(left) + len(a), np.int64), half)
                sizes = np.diff(first, append=len(order))
                twice = np.zeros(len(order), bool)
                twice[order[first + sizes - 1]] = sizes > 1  # in both: the later one is the message's
                yield _batch(arrow, 1, kind=[0], lang=[name], chunk=[chunk], bucket=[bucket], data=[np.packbits(twice[len(left) :]).tobytes()])

    return run, schema


def _kept(size: int, width: int, bits: int):
    """The runs of a chunk in which all phrases of ``size`` words are frequent."""

    def use(arrow, chunk, lang, data, other, got):
        seq = _sequence(data)
        starts, left, right, half = phrases_in(seq, size, width)
        left, right, _, order, first = summed(left, right, np.ones(len(left), np.int64), half)
        own = min(bits, half)
        cut = np.flatnonzero(np.diff((left >> np.uint64(half - own)).astype(np.int64), prepend=-1))
        sizes = np.diff(cut, append=len(left))
        flags = np.concatenate([np.zeros(0, np.uint8), *(np.unpackbits(np.frombuffer(d, np.uint8), count=k) for d, k in zip(got, sizes.tolist()))])
        frequent = np.zeros(len(starts), bool)
        frequent[order] = np.repeat(flags, np.diff(first, append=len(order))).astype(bool)
        seq = runs_of(seq, starts[frequent], size)
        if len(seq):
            yield _batch(arrow, 1, chunk=[chunk], kind=[1], lang=[lang], data=[_squeeze(seq)])

    return use


def frequent_phrases(docs: DataFrame, least: int = 100, text: str = "text", lang: str = "lang") -> tuple[DataFrame, DataFrame]:
    """(lang, words, f) of all phrases of up to LONGEST words that occur ``least`` times, and (lang, n) of all word occurrences."""
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    bits = max(3, math.ceil(math.log2(size / min(MOST_BUCKET, max(LEAST_BUCKET, size // 4000)) + 1)))
    coded = chunks(docs, bits, text, lang)
    count, languages = coded.where("kind = 1").agg(F.count("*"), F.count_distinct("lang")).first()
    buckets, parts = max(8, languages << bits), max(8, -(-count // 2))
    words = _words(coded, least, bits, min(buckets, 4 << bits))
    top = words.where("kind = 2").agg(F.max(F.element_at("ids", 1))).first()[0]
    width = max(1, (top or 0).bit_length())
    if width > WIDEST:
        raise ValueError(f"a language has over 2 ** {WIDEST} words that occur {least} times")
    found = words.where("kind = 2").select("lang", "ids", "n")
    state = saved(_answered(coded.where("kind = 1"), words.where("kind = 0"), parts, _numbered, _STATE), "runs")
    for k in range(2, LONGEST + 1):
        run, schema = _filters(k, width, bits)
        messages = state.select("chunk", "lang", "data").mapInArrow(run, schema)
        run, schema = _merged(k, width, bits, least)
        merged = saved(_dealt(messages, min(buckets, 4 << bits)).mapInArrow(run, schema), f"phrases_{k}")
        found = found.unionByName(merged.where("kind = 2").select("lang", "ids", "n"))
        if k < LONGEST:
            state = saved(_answered(state, merged.where("kind = 0"), parts, _kept(k, width, bits), _STATE), "runs")
    named = words.where("kind = 2").select("lang", F.element_at("ids", 1).alias("id"), "word")
    placed = found.select("lang", "ids", "n", F.posexplode("ids").alias("i", "id")).join(named, ["lang", "id"])
    spelt = placed.groupBy("lang", "ids", "n").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "word"))), lambda x: x["word"]).alias("words"))
    return saved(spelt.select("lang", "words", F.col("n").alias("f")), "phrases"), words.where("kind = 3").groupBy("lang").agg(F.sum("n").alias("n"))


def collocations(docs: DataFrame, least: int = 100, share: int = 100, top: int = 2000, text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's ``top`` phrases of two to five words.

    A phrase occurs a >= ``least`` times; its score is the least floor(1000 * a * n / (l * r)) of its cuts, the first of
    equal ones. It is dropped if a longer phrase around it occurs ``share`` per cent as often. A null language is 'und', a
    null or empty text has no words, repeated rows count each, other columns are not read, an empty table gives no rows.
    At most 2 ** WIDEST words of a language may reach ``least``; more raise an error.
    """
    phrases, totals = frequent_phrases(docs, least, text, lang)
    many = phrases.where(F.size("words") > 1)
    cuts = many.select("lang", "words", "f", F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("k"))
    cuts = cuts.withColumns({"left": F.slice("words", 1, F.col("k")), "right": F.slice("words", F.col("k") + 1, F.size("words") - F.col("k"))})
    part = lambda side, name: phrases.select("lang", F.col("words").alias(side), F.col("f").alias(name))
    cuts = cuts.join(part("left", "l"), ["lang", "left"]).join(part("right", "r"), ["lang", "right"]).join(totals, "lang")
    whole = lambda c: F.col(c).cast("decimal(19,0)")
    score = F.call_function("div", F.lit(1000).cast("decimal(4,0)") * (whole("f") * whole("n")), whole("l") * whole("r"))
    best = cuts.withColumn("score", score).groupBy("lang", "words").agg(F.min(F.struct("score", "k", "l", "r", "n")).alias("b"), F.first("f").alias("a"))
    inner = F.explode(F.array(F.slice("words", 1, F.size("words") - 1), F.slice("words", 2, F.size("words") - 1)))
    longer = many.where(F.size("words") > 2).select("lang", inner.alias("words"), "f").groupBy("lang", "words").agg(F.max("f").alias("longer"))
    left = best.join(longer, ["lang", "words"], "left").where(100 * F.coalesce("longer", F.lit(0)) < share * F.col("a"))
    rows = left.select("lang", F.array_join("words", " ").alias("phrase"), "a", "b.l", "b.r", "b.n", "b.score")
    order = w.Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    ranked = rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
