"""Token files: the ids of documents in ascending order of their keys, as blocks of a range coder.

A file set is a folder of Parquet files with one row for each block: (part, block, before, n_docs, n_tokens, data). A part
is what one task wrote, in the order of keys; ``before`` is the number of ids of the part before the block. ``data`` holds
the keys and sizes of its documents and the coded ids, and stands alone.
"""

from __future__ import annotations

import struct
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barline.llm.rangecoder import decode_block, encode_block
from barline.llm.store import slices, utf8
from barline.llm.words import WordTable

#: Ids of a block; a block ends with the document that reaches it.
BLOCK_IDS = 4_000_000
#: Words whose ids a worker keeps; the library is slow, and memory bounds it.
KEPT = 1_200_000
_SCHEMA = "part int, block int, before bigint, n_docs int, n_tokens bigint, data binary"


@lru_cache(maxsize=2)
def _table(path: str) -> tuple[WordTable, int]:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs one task on each core
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)

    border, border_id = max(((t.content, i) for i, t in tokenizer.get_added_tokens_decoder().items() if t.special), key=lambda x: x[1], default=("", -1))

    def encode(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Many words in one call, with a special token between them; words that hold one are encoded alone."""
        texts = [w.decode("utf-8") for w in words]
        alone = {i for i, t in enumerate(texts) if not border or "<" in t}
        plain = [t for i, t in enumerate(texts) if i not in alone] if alone else texts
        found = tokenizer.encode_batch_fast([border.join(plain[i : i + 100]) + border for i in range(0, len(plain), 100)], add_special_tokens=False)
        flat = np.concatenate([np.zeros(0, np.int64), *(np.array(e.ids, np.int64) for e in found)])
        ends = np.flatnonzero(flat == border_id)
        sizes = np.diff(ends, prepend=-1) - 1
        flat = np.delete(flat, ends)
        if alone:
            own = {i: tokenizer.encode(texts[i], add_special_tokens=False).ids for i in sorted(alone)}
            parts, rest, k = [], np.split(flat, np.cumsum(sizes)[:-1]) if len(sizes) else [], 0
            for i in range(len(texts)):
                parts.append(np.array(own[i], np.int64) if i in alone else rest[k])
                k += i not in alone
            flat, sizes = np.concatenate(parts), np.array([len(p) for p in parts], np.int64)
        return flat, sizes

    return WordTable(encode, KEPT), tokenizer.get_vocab_size()


def pack(keys: list[int | None], sizes: np.ndarray, ids: np.ndarray, vocab: int) -> bytes:
    """The bytes of a block: a head with keys, nulls and sizes, compressed and checked, and the coded ids."""
    null = np.array([k is None for k in keys], np.uint8)
    values = np.array([k or 0 for k in keys], "<i8")
    head = zlib.compress(null.tobytes() + np.diff(values, prepend=np.int64(0)).astype("<i8").tobytes() + sizes.astype("<u4").tobytes(), 1)
    return struct.pack("<III", len(keys), len(head), zlib.crc32(head)) + head + encode_block(ids, vocab)


def unpack(data: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """Keys, sizes and ids of a block; ValueError if it is damaged."""
    n, size, check = struct.unpack_from("<III", data)
    head = data[12 : 12 + size]
    if zlib.crc32(head) != check:
        raise ValueError("damaged token block")
    raw = zlib.decompress(head)
    null = np.frombuffer(raw, np.uint8, n)
    values = np.cumsum(np.frombuffer(raw, "<i8", n, n))
    sizes = np.frombuffer(raw, "<u4", n, 9 * n).astype(np.int64)
    return [None if z else int(v) for z, v in zip(null, values)], sizes, decode_block(data[12 + size :])


def write_tokens(docs: DataFrame, tokenizer: str, path: str, text: str = "text", key: str = "doc_id", end_id: int | None = 1, block_ids: int = BLOCK_IDS) -> None:
    """Encodes every whole text and writes the token files to ``path``.

    A null or empty text has only the end id. Keys are longs; null keys come first, and repeated keys are ordered by the
    hash of their text. Other columns are not read. An empty table writes no blocks.
    """

    def run(batches):
        table, vocab = _table(tokenizer)
        part, block, before = TaskContext.get().partitionId(), 0, 0
        keys: list = []
        pieces: list[np.ndarray] = []
        held = 0

        def flush():
            sizes = np.array([len(p) for p in pieces], np.int64)
            data = pack(keys, sizes, np.concatenate(pieces) if pieces else np.zeros(0, np.int64), vocab)
            return pa.RecordBatch.from_pylist([{"part": part, "block": block, "before": before, "n_docs": len(keys), "n_tokens": held, "data": data}], schema=arrow)

        for b in slices(batches):
            ids, ends = table(utf8(b.column(1)))
            last, start = [end_id] if end_id is not None else [], 0
            for k, e in zip(b.column(0).to_pylist(), ends.tolist()):
                keys.append(k)
                pieces.append(np.append(ids[start:e], last).astype(np.uint32))
                held += len(pieces[-1])
                start = e
                if held >= block_ids:
                    yield flush()
                    block, before = block + 1, before + held
                    keys, pieces, held = [], [], 0
        if keys:
            yield flush()

    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(T.StructType.fromDDL(_SCHEMA))
    ordered = docs.select(F.col(key).cast("long").alias(key), text)
    ordered = ordered.repartitionByRange(F.col(key).asc_nulls_first(), F.xxhash64(text)).sortWithinPartitions(F.col(key).asc_nulls_first(), F.xxhash64(text))
    blocks = ordered.mapInArrow(run, _SCHEMA)
    blocks.write.option("compression", "none").option("parquet.block.size", 8 << 20).parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, tokens): ids as little-endian unsigned 32-bit integers; start counts the ids before."""
    blocks = spark.read.schema(_SCHEMA).parquet(path)
    totals = {r[0]: r[1] for r in blocks.groupBy("part").agg(F.sum("n_tokens")).collect()}  # one for each task that wrote
    offset, first = 0, {}
    for part in sorted(totals):
        first[part], offset = offset, offset + totals[part]
    shared = spark.sparkContext.broadcast(first)

    def run(batches):
        for b in batches:
            for part, before, data in zip(*(b.column(i).to_pylist() for i in range(3))):
                keys, sizes, ids = unpack(data)
                raw = ids.astype("<u4").tobytes()
                ends = np.cumsum(sizes)
                starts = ends - sizes
                for i in range(0, len(keys), 1000):
                    s, e = starts[i : i + 1000], ends[i : i + 1000]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(keys[i : i + 1000], pa.int64()), pa.array(s + shared.value[part] + before, pa.int64()), pa.array(e - s, pa.int64()), pa.array([raw[4 * x : 4 * y] for x, y in zip(s.tolist(), e.tolist())], pa.binary())],
                        names=["doc_id", "start", "n_tokens", "tokens"],
                    )

    return blocks.select("part", "before", "data").mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, tokens binary")
