"""Sharding by histogram sort.

Documents are ordered by the 128-bit key (hash of the text, hash of the id). Exact bytes and rows below candidate
boundaries are counted over all partitions, and only the intervals in which a splitter lies are probed again,
256 times finer each time, until every splitter meets its tolerance. Then the rows are exchanged once.
"""

from __future__ import annotations

from bisect import bisect_right
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barline.llm.store import saved

#: Bits that one round of counting resolves, and rounds for each half of the key.
DIGIT, ROUNDS = 8, 8
_OWN = ["size", "text_crc32", "law", "shard", "slot", "grown_shard"]
_BUCKET_BITS = 12


@dataclass
class Splitter:
    """A boundary: rows with (a, b) below it come before it."""

    target: float
    tolerance: float
    prefix: tuple[int, ...] = ()
    bytes_below: int = 0
    rows_below: int = 0
    done: bool = False
    a: int = 0
    b: int = 0


def _digit(level: int) -> Column:
    half, shift = ("__a" if level < ROUNDS else "__b"), 64 - DIGIT * (level % ROUNDS + 1)
    d = F.shiftrightunsigned(half, shift).bitwiseAND(F.lit(255).cast("long"))
    # the sign bit is flipped, so that digits order as the signed values do
    return (d.bitwiseXOR(F.lit(128).cast("long")) if level % ROUNDS == 0 else d).cast("int")


def _prefix(level: int) -> Column:
    """The first ``level`` digits of a row, as one string of hex digits."""
    return F.concat(F.lit(""), *[F.lpad(F.hex(_digit(i)), 2, "0") for i in range(level)])


def _key(prefix: tuple[int, ...]) -> tuple[int, int]:
    """The smallest (a, b) with these digits, as signed values."""
    digits = list(prefix) + [0] * (2 * ROUNDS - len(prefix))
    out = []
    for half in (digits[:ROUNDS], digits[ROUNDS:]):
        x = int.from_bytes(bytes(half), "big") - (1 << 63)
        out.append(x)
    return out[0], out[1]


def _next(prefix: tuple[int, ...]) -> tuple[int, ...] | None:
    """The prefix that follows at the same level; None after the last."""
    p = list(prefix)
    while p and p[-1] == 255:
        p.pop()
    if not p:
        return None
    p[-1] += 1
    return tuple(p)


def find_splitters(keys: DataFrame, parts: int, every: int, tolerance: float) -> tuple[list[Splitter], int, int]:
    """Splitters for ``parts`` ranges of nearly equal bytes; each ``every``-th one bounds a shard.

    ``keys`` has __a, __b and size. A splitter is settled at an edge between different hashes of texts where one lies
    within ``tolerance`` of a shard (of a range, for those inside a shard: a quarter of the range); only then is a
    group of equal texts whole. A group that is larger is split by the hash of the id.
    """
    total, rows = keys.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    found = []
    for i in range(1, parts):
        near = tolerance * total / parts * every if i % every == 0 else 0.25 * total / parts
        found.append(Splitter(total * i / parts, near))
    for level in range(2 * ROUNDS):
        active = [s for s in found if not s.done]
        if not active or not rows:
            break
        wanted = sorted({"".join(f"{d:02X}" for d in s.prefix) for s in active})
        df = keys.select("*", _prefix(level).alias("__p")) if level else keys.select("*", F.lit("").alias("__p"))
        counted = df.where(F.col("__p").isin(wanted)).groupBy("__p", _digit(level).alias("d")).agg(F.sum("size").alias("s"), F.count("*").alias("n"))
        bins: dict[str, dict[int, tuple[int, int]]] = {}
        for r in counted.collect():  # at most 256 rows for each splitter
            bins.setdefault(r["__p"], {})[r["d"]] = (r["s"], r["n"])
        for s in active:
            below, count, mine = s.bytes_below, s.rows_below, bins.get("".join(f"{d:02X}" for d in s.prefix), {})
            for d in sorted(mine):
                size, n = mine[d]
                if below + size < s.target:
                    below, count = below + size, count + n
                    continue
                low, high = s.target - below, below + size - s.target
                here = s.prefix + (d,)
                last = level == 2 * ROUNDS - 1
                if high <= low and (high <= s.tolerance or last) and (after := _next(here)) is not None:
                    s.done, s.bytes_below, s.rows_below = True, below + size, count + n
                    s.a, s.b = _key(after)
                else:
                    s.done, s.bytes_below, s.rows_below, s.prefix = low <= s.tolerance or last, below, count, here
                    s.a, s.b = _key(here)
                break
            else:  # nothing above: the boundary follows all rows
                s.done, s.bytes_below, s.rows_below = True, below, count
                s.a = s.b = (1 << 63) - 1
    ordered = sorted(found, key=lambda s: (s.bytes_below, s.rows_below))
    return ordered, total, rows


def shard_documents(docs: DataFrame, shards: int = 8, text: str = "text", key: str = "doc_id", tolerance: float = 0.005, range_bytes: int = 16 << 20, max_ranges: int = 16384) -> DataFrame:
    """All columns of ``docs`` and size, text_crc32, law ('bytes'), shard, slot, grown_shard (null: law is not 'key').

    Shards are nearly equal in bytes (UTF-8 bytes of the text plus 1). A slot is the place in the shard's order, gapless
    from 0. Each shard is exchanged and ordered in many ranges of about ``range_bytes``, so no task holds a shard.
    A null text has size 1 and counts as empty; null ids are ordered first; rows that repeat in both id and text keep
    their copies in neighbouring slots; an empty table gives an empty result. Input columns named like an output
    column are replaced. One row is never split, so shards differ at least by what the longest text needs.
    """
    raw = F.coalesce(F.col(text), F.lit("")).cast("binary")
    keyed = docs.select(
        *[c for c in docs.columns if c not in _OWN],
        (F.octet_length(raw) + 1).cast("long").alias("size"),
        F.crc32(raw).alias("text_crc32"),
        F.xxhash64(raw).alias("__a"),
        F.xxhash64(F.col(key)).alias("__b"),
    )
    keys = saved(keyed.select("__a", "__b", "size"), "shard-keys")
    total = keys.agg(F.sum("size")).first()[0] or 0
    every = max(1, min(max_ranges // shards, -(-total // (shards * range_bytes))))
    splitters, total, _ = find_splitters(keys, shards * every, every, tolerance)

    spark = docs.sparkSession
    cuts = [(s.a, s.b) for s in splitters]
    cuts.sort()
    buckets = []
    for v in range(-(1 << _BUCKET_BITS - 1), 1 << _BUCKET_BITS - 1):
        low, high = (v << 64 - _BUCKET_BITS), (v + 1 << 64 - _BUCKET_BITS)
        i, j = bisect_right(cuts, (low - 1, 1 << 63)), bisect_right(cuts, (high - 1, 1 << 63))
        buckets.append((v, i, [{"a": a, "b": b} for a, b in cuts[i:j]]))
    lookup = spark.createDataFrame(buckets, "__v int, __base int, __cuts array<struct<a: bigint, b: bigint>>")
    rows_below = [0] + [s.rows_below for s in splitters]
    ranges = spark.createDataFrame([(i, i // every, rows_below[i] - rows_below[i // every * every]) for i in range(shards * every)], "__range int, shard int, __first bigint")
    inside = F.size(F.filter("__cuts", lambda c: (c["a"] < F.col("__a")) | ((c["a"] == F.col("__a")) & (c["b"] <= F.col("__b")))))
    placed = (
        keyed.withColumn("__v", F.shiftright("__a", 64 - _BUCKET_BITS).cast("int"))
        .join(F.broadcast(lookup), "__v")  # 4,096 rows, at most max_ranges cuts
        .withColumn("__range", F.col("__base") + inside)
        .join(F.broadcast(ranges), "__range")
    )
    order = Window.partitionBy("__range").orderBy("__a", "__b", F.col(key).asc_nulls_first())
    return placed.select(
        *[c for c in docs.columns if c not in _OWN], "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("__first") + F.row_number().over(order) - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
