"""Language-model scores by prediction by partial matching.

The model is a trie of byte contexts of ORDER bytes with the counts of every training text, kept as a table: one row for
each context and next byte, at every order. A byte costs its exact code length: the longest known context codes it, or
an escape (half a count for each different byte seen there) and the next shorter context do, where the bytes already
refused are left out. Each order takes its figures from the shorter one in a join on (context, byte), so the trie is
never in one place. Texts travel in chunks: the different contexts of a chunk fetch their costs from the trie, and every
place of its texts looks them up there.
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
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import window as w
from pyspark.sql.pandas.types import to_arrow_schema

from barline.llm.store import saved, slices, utf8

#: Bytes of context. A context and the byte after it are one number.
ORDER = 5
#: Bytes of text of a chunk, and places whose contexts are sorted at once.
CHUNK, STEP = 16 << 20, 1 << 20
#: Bytes of text for each bucket of words and contexts: few in small inputs, more in large ones.
LEAST_BUCKET, MOST_BUCKET = 32 << 20, 2 << 30
#: Added to every count of the unigram base.
ADDED = 0.1
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def normalised(text: bytes) -> bytes:
    """ASCII lower case, the words joined by one space. The end of a text is a line end, which no word holds."""
    return b" ".join(text.translate(_LOWER).split())


def _grams(texts: list[bytes]):
    """In steps, the context and next byte of every place of the texts (their ends too), and where each text begins among them."""
    held, size = [], 0
    for t in texts:
        held.append(t)
        size += len(t)
        if size >= STEP:
            yield _placed(held)
            held, size = [], 0
    if held:
        yield _placed(held)


def _placed(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    pad = b"\n" * ORDER
    raw = np.frombuffer(b"".join(itertools.chain.from_iterable((pad, t, b"\n") for t in texts)), np.uint8)
    gram = np.zeros(len(raw) - ORDER, np.int64)
    for j in range(ORDER + 1):
        gram = gram << 8 | raw[j : len(gram) + j]
    sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    starts = np.cumsum(sizes) - sizes
    text = np.repeat(np.arange(len(texts)), sizes)
    return gram[np.arange(len(text)) + ORDER * text], starts  # places in the padding before a text are left out


def _counted(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    grams, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for some, _ in _grams(texts):
        v, n = np.unique(some, return_counts=True)
        grams, counts = _merged(grams, counts, v, n)
    return grams, counts


def _merged(a: np.ndarray, n: np.ndarray, b: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    both, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    total = np.zeros(len(both), np.int64)
    np.add.at(total, at[: len(a)], n)
    np.add.at(total, at[len(a) :], m)
    return both, total


def pack(values: np.ndarray) -> bytes:
    """Numbers of 8 bytes, compressed byte place by byte place."""
    return zstandard.ZstdCompressor(level=3).compress(np.ascontiguousarray(values.view(np.uint8).reshape(-1, 8).T).tobytes())


def unpack(data: bytes, kind=np.int64) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(raw.reshape(8, -1).T).reshape(-1).view(kind)


def _pack_sorted(values: np.ndarray) -> bytes:
    return pack(np.diff(values, prepend=0))


def _unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data))


def pack_words(words: list[bytes]) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(b"\n".join(words))


def unpack_words(data: bytes) -> list[bytes]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    return raw.split(b"\n") if raw else []  # a word has a byte at least


def _bucket(grams: np.ndarray, buckets: int) -> np.ndarray:
    """Contexts that begin alike lie together."""
    return ((grams >> 24).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % buckets


#: What tasks say to one another: kind 0 are words and contexts, with counts or costs, 1 is a chunk of texts.
_MESSAGE = "chunk bigint, bucket int, kind int, words binary, word_n binary, grams binary, gram_n binary"


def chunks(docs: DataFrame, training: Column, buckets: int, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Chunks of texts and, for each bucket, the different words and contexts of a chunk with their counts in training texts.

    A written table: of kind 1 (chunk, keys, trained, data), where the first ``trained`` texts are for training; of kind 0
    (chunk, bucket, words, word_n, grams, gram_n).
    """
    schema = T.StructType([*T._parse_datatype_string(_MESSAGE).fields, T.StructField("keys", T.ArrayType(docs.schema[key].dataType)), *T._parse_datatype_string("trained int, data binary").fields])
    arrow = to_arrow_schema(schema)

    def run(batches):
        task, number = TaskContext.get().partitionId() << 33, 0
        own, other, size = [], [], 0

        def rows(columns: dict, n: int) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(columns.get(f.name, [None] * n), f.type) for f in arrow], schema=arrow)

        def chunk():
            train, rest = [t for _, t in own], [t for _, t in other]
            data = zstandard.ZstdCompressor(level=3).compress(b"".join(t + b"\n" for t in train + rest))
            yield rows({"chunk": [task + number], "kind": [1], "keys": [[k for k, _ in own + other]], "trained": [len(own)], "data": [data]}, 1)
            counts: Counter = Counter()
            for some, add in ((train, 1), (rest, 0)):
                for i in range(0, len(some), 500):
                    for x, n in Counter(b" ".join(some[i : i + 500]).split()).items():
                        counts[x] += n * add
            deal: list[list[bytes]] = [[] for _ in range(buckets)]
            for x in counts:
                deal[zlib.crc32(x) % buckets].append(x)
            grams, n = _merged(*_counted(train), (v := _counted(rest)[0]), np.zeros(len(v), np.int64))
            where = _bucket(grams, buckets)
            order = np.argsort(where, kind="stable")
            cut = np.searchsorted(where[order], np.arange(buckets + 1))
            for k, (a, b) in enumerate(zip(cut, cut[1:])):
                if b > a or deal[k]:
                    i = order[a:b]
                    words = np.fromiter(map(counts.__getitem__, deal[k]), np.int64, len(deal[k]))
                    yield rows({"chunk": [task + number], "bucket": [k], "kind": [0], "words": [pack_words(deal[k])], "word_n": [pack(words)], "grams": [_pack_sorted(grams[i])], "gram_n": [pack(n[i])]}, 1)

        for b in slices(batches):
            for k, t, mine in zip(b.column(0).to_pylist(), utf8(b.column(1)), b.column(2).to_pylist()):
                t = normalised(t)
                (own if mine else other).append((k, t))
                size += len(t) + 1
                if size >= CHUNK:
                    yield from chunk()
                    own, other, size, number = [], [], 0, number + 1
        if size:
            yield from chunk()

    return saved(docs.select(key, text, F.coalesce(training, F.lit(False)).alias("training")).mapInArrow(run, schema), "chunks")


def groups(batches, column: int):
    """The rows of each value of a column, as lists of batches; equal values stand together."""
    held, last = [], None
    for b in batches:
        v = b.column(column).to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(v)) + 1).tolist(), len(v)] if len(v) else []
        for s, e in zip(cuts, cuts[1:]):
            if held and v[s] != last:
                yield held
                held = []
            last = v[s]
            held.append(b.slice(s, e - s))
    if held:
        yield held


def totals(found: DataFrame, buckets: int) -> DataFrame:
    """A written table: of kind 0 the chunks' words with their counts in all training texts; of kind 2 (gram, n) rows, and of kind 3 (tokens, different words) of each bucket, both as (gram, n)."""
    schema = T._parse_datatype_string("kind int, chunk bigint, words binary, word_n binary, gram bigint, n bigint")
    arrow = to_arrow_schema(schema)

    def rows(size: int, **columns) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(size, f.type) for f in arrow], schema=arrow)

    def run(batches):
        for group in groups(batches, 0):
            messages = [m for b in group for m in zip(*(b.column(i).to_pylist() for i in range(1, 6)))]
            count: Counter = Counter()
            grams, n, held, size = np.zeros(0, np.int64), np.zeros(0, np.int64), [], 0
            for i, (_, words, word_n, some, some_n) in enumerate(messages):
                for x, k in zip(unpack_words(words), unpack(word_n).tolist()):
                    count[x] += k
                held.append((_unpack_sorted(some), unpack(some_n)))
                size += len(held[-1][0])
                if size > STEP or i + 1 == len(messages):
                    grams, n = _merged(grams, n, *(np.concatenate(x) for x in zip(*held)))
                    held, size = [], 0
            for a in range(0, len(grams), 100_000):
                part = grams[a : a + 100_000]
                yield rows(len(part), kind=np.full(len(part), 2), gram=part, n=n[a : a + 100_000])
            yield rows(1, kind=[3], gram=[sum(count.values())], n=[sum(k > 0 for k in count.values())])
            for chunk, words, *_ in messages:
                answer = np.fromiter(map(count.__getitem__, unpack_words(words)), np.int64)
                yield rows(1, kind=[0], chunk=[chunk], words=[words], word_n=[pack(answer)])

    messages = found.where("kind = 0").select("bucket", "chunk", "words", "word_n", "grams", "gram_n")
    return saved(messages.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(run, schema), "totals")


def trie(sums: DataFrame) -> DataFrame:
    """(gram, cost): the natural code length of the last byte of every context, by the training counts ``sums`` (gram, n).

    At each order a row has its count n, and of its context the total t and the different bytes d; ``after`` is what the
    byte costs after an escape from the context.
    """
    orders = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.col("gram").bitwiseAND(F.lit((1 << 8 * (k + 1)) - 1)).alias("gram")) for k in range(ORDER)))).alias("o")
    short = saved(sums.select(orders, "n").groupBy("o.k", "o.gram").agg(F.sum("n").alias("n")), "shorter_contexts")

    def nodes(df: DataFrame, **more: Column) -> DataFrame:
        context = w.Window.partitionBy(F.shiftright("gram", 8))  # at most 256 rows
        return df.withColumns({"t": F.sum("n").over(context), "d": F.sum((F.col("n") > 0).cast("long")).over(context)} | {c: e.over(context) for c, e in more.items()})

    level = nodes(short.where("k = 0").select("gram", "n")).withColumn("after", F.log(F.greatest(256 - F.col("d"), F.lit(1)).cast("double")))
    for k in range(1, ORDER + 1):
        shorter = level.select(F.col("gram").alias("suffix"), F.col("n").alias("n1"), F.col("t").alias("t1"), F.col("d").alias("d1"), F.col("after").alias("after1"))
        longer = (sums if k == ORDER else short.where(F.col("k") == k)).select("gram", "n", F.col("gram").bitwiseAND(F.lit((1 << 8 * k) - 1)).alias("suffix"))
        level = nodes(longer.join(shorter, "suffix"), refused=F.sum(F.when(F.col("n") > 0, F.col("n1")).otherwise(0)))
        left, different = 2 * (F.col("t1") - F.col("refused")), F.col("d1") - F.col("d")
        escape = F.when(different > 0, F.log(left / different)).otherwise(0.0) + F.col("after1")
        level = level.withColumn("after", F.when(F.col("n1") > 0, F.log(left / (2 * F.col("n1") - 1))).otherwise(escape)).select("gram", "n", "t", "d", "after")
    total = 2 * F.col("t")
    unseen = F.when(F.col("d") > 0, F.log(total / F.col("d"))).otherwise(0.0) + F.col("after")
    return level.select("gram", F.when(F.col("n") > 0, F.log(total / (2 * F.col("n") - 1))).otherwise(unseen).alias("cost"))


def _answers(found: DataFrame, costs: DataFrame, buckets: int) -> DataFrame:
    """(chunk, grams, gram_n): the costs of the contexts of each message of ``found``."""

    def packed(batches):
        for b in batches:
            grams, cost = (b.column(i).to_numpy() for i in (0, 1))
            where = _bucket(grams, buckets)
            order = np.lexsort([grams, where])
            cut = np.flatnonzero(np.diff(where[order], prepend=-1))
            parts = [order[s:e] for s, e in zip(cut, [*cut[1:], len(order)])]
            blobs = [[_pack_sorted(grams[i]) for i in parts], [pack(cost[i]) for i in parts]]
            yield pa.RecordBatch.from_arrays([pa.array(where[order[cut]].astype(np.int32)), *(pa.array(x, pa.binary()) for x in blobs)], names=["bucket", "grams", "gram_n"])

    def run(batches):
        for group in groups(batches, 0):
            known, table = [], None
            for b in group:
                for chunk, grams, gram_n in zip(*(b.column(i).to_pylist() for i in (1, 2, 3))):
                    if chunk is None:
                        known.append((_unpack_sorted(grams), unpack(gram_n, np.float64)))
                        continue
                    if table is None:
                        own, cost = (np.concatenate(x) for x in zip(*known))
                        order = np.argsort(own)
                        table, known = (own[order], cost[order]), []
                    answer = table[1][np.searchsorted(table[0], _unpack_sorted(grams))] if len(grams) else np.zeros(0)
                    yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), pa.array([grams], pa.binary()), pa.array([pack(answer)], pa.binary())], names=["chunk", "grams", "gram_n"])

    rows = costs.mapInArrow(packed, "bucket int, grams binary, gram_n binary").withColumn("chunk", F.lit(None).cast("bigint"))
    rows = rows.unionByName(found.where("kind = 0").select("bucket", "grams", "gram_n", "chunk")).select("bucket", "chunk", "grams", "gram_n")
    return rows.repartition(buckets, "bucket").sortWithinPartitions("bucket", F.asc_nulls_first("chunk")).mapInArrow(run, "chunk bigint, grams binary, gram_n binary")


def score(docs: DataFrame, training: Column, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, trained, n_tokens, n_known, train_tokens, base_score, score) of every whole text.

    Scores are log10 probabilities of the lower-cased words and the end of the text: ``base_score`` by unigrams, ``score``
    by the trie of all ``training`` texts. A null or empty text is its end alone. Without training texts all bytes are
    alike and the base has no tokens to count. Repeated rows count each and have equal scores; null keys stay; other
    columns are not read; an empty table gives no rows.
    """
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    buckets = max(8, -(-size // min(MOST_BUCKET, max(LEAST_BUCKET, size // 2000))))
    found = chunks(docs, training, buckets, text, key)
    sums = totals(found, buckets)
    whole = found.where("kind = 1")
    count, ends = whole.agg(F.count("*"), F.sum("trained")).first()
    tokens, v = sums.where("kind = 3").agg(F.sum("gram"), F.sum("n")).first()
    ends = ends or 0
    n, v = (tokens or 0) + ends, (v or 0) + (ends > 0)
    least = n + ADDED * (v + 1)
    costs = trie(sums.where("kind = 2").select("gram", "n"))
    order = ["chunk", "kind", "words", "word_n", "grams", "gram_n", "keys", "trained", "data"]
    nothing = {f.name: F.lit(None).cast(f.dataType) for f in found.schema}

    def part(df: DataFrame) -> DataFrame:
        return df.withColumns({c: e for c, e in ({"kind": F.lit(0)} | nothing).items() if c not in df.columns}).select(order)

    rows = part(sums.where("kind = 0").select("kind", "chunk", "words", "word_n")).unionByName(part(_answers(found, costs, buckets).withColumn("kind", F.lit(0)))).unionByName(part(whole))
    schema = T.StructType([T.StructField(key, docs.schema[key].dataType), *T._parse_datatype_string("trained boolean, n_tokens bigint, n_known bigint, base_score double, score double").fields])

    def run(batches):
        for group in groups(batches, 0):
            index, counts, grams, costs = {}, [np.zeros(0, np.int64)], [], []
            for b in group:
                for kind, words, word_n, some, cost, keys, trained, data in zip(*(b.column(i).to_pylist() for i in range(1, 9))):
                    if kind == 1:
                        texts = zstandard.ZstdDecompressor().decompress(data).split(b"\n")[:-1]
                        c, g = np.concatenate(counts), np.concatenate(grams)
                        by_gram = np.argsort(g)
                        yield from _scored(keys, trained, texts, (g[by_gram], np.concatenate(costs)[by_gram]), (index, np.log10((c + ADDED) / least), c > 0), math.log10((ends + ADDED) / least), ends > 0, schema, b.schema.field(6).type.value_type)
                    elif words is None:
                        grams.append(_unpack_sorted(some))
                        costs.append(unpack(cost, np.float64))
                    else:
                        index.update(zip(unpack_words(words), itertools.count(len(index))))
                        counts.append(unpack(word_n))

    scored = rows.repartition(max(8, count), "chunk").sortWithinPartitions("chunk", "kind").mapInArrow(run, schema)
    return scored.withColumn("train_tokens", F.lit(n).cast("long"))


def _scored(keys, trained, texts, tables, words, end, end_known, schema, kind):
    grams, costs = tables
    index, base, seen = words
    scores = []
    for some, starts in _grams(texts):
        scores.append(np.add.reduceat(costs[np.searchsorted(grams, some)], starts))
    score = -np.concatenate(scores) / math.log(10)
    for a in range(0, len(texts), 1000):
        part = texts[a : a + 1000]
        split = [t.split() for t in part]
        sizes = np.fromiter(map(len, split), np.int64, len(part))
        ids = np.fromiter(map(index.__getitem__, itertools.chain.from_iterable(split)), np.int64, int(sizes.sum()))
        text = np.repeat(np.arange(len(part)), sizes)
        sums = np.bincount(text, base[ids], len(part)) + end
        known = np.bincount(text, seen[ids], len(part)).astype(np.int64) + end_known
        rows = [pa.array(keys[a : a + 1000], kind), pa.array(np.arange(a, a + len(part)) < trained), pa.array(sizes + 1), pa.array(known), pa.array(sums), pa.array(score[a : a + len(part)])]
        yield pa.RecordBatch.from_arrays(rows, names=schema.fieldNames())
