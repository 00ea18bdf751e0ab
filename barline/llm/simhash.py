"""Near-duplicates by SimHash and the generalised pigeonhole principle.

Correlated bits of the fingerprints are grouped into partitions. Partition i gets a threshold t_i, with the sum of
(t_i + 1) one above the number of differing bits: two fingerprints within that number then agree in some partition up
to t_i bits. Dynamic programming picks the thresholds (-1: the partition is skipped) of the least estimated candidates
and probes. Candidates are probed by exact keys and verified.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barline.llm.components import components
from barline.llm.store import saved, slices, utf8

BITS, WORDS, SEED, DIFFERING = 64, 3, 42, 2
#: Fingerprints of the sample from which candidates are estimated; results don't depend on it.
SAMPLE = 2048
#: A key with more probes than this is joined through common neighbours, not pair by pair.
PAIRWISE = 32
#: What sending one probe costs, in candidate pairs to verify.
PROBE_COST = 4


def shingle_hashes(text: bytes, width: int = WORDS) -> np.ndarray:
    """The hashes of the shingles of ``width`` words, one of all words if there are fewer; none without words."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < width:
        shingles = [b" ".join(words)]
    else:
        shingles = list(map(b" ".join, zip(*(words[i:] for i in range(width)))))
    return np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in shingles), np.uint64, len(shingles))


def fingerprint(text: bytes) -> int:
    """Bit by bit the majority of the hashes of the shingles; 0 without words."""
    return majority(shingle_hashes(text))


def majority(h: np.ndarray) -> int:
    """The fingerprint of these hashes as a signed long: a bit is set if it is in over half of them."""
    if not len(h):
        return 0
    bits = np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return int.from_bytes(np.packbits(2 * bits.sum(axis=0, dtype=np.int32) > len(h), bitorder="little").tobytes(), "little", signed=True)


def fingerprints(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, fp): the fingerprint of every whole text as a signed long. A null text counts as empty."""
    schema = T.StructType([T.StructField(key, docs.schema[key].dataType), T.StructField("fp", T.LongType())])

    def run(batches):
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([fingerprint(t) for t in utf8(b.column(1))], pa.int64())], names=[key, "fp"])

    return docs.select(key, text).mapInArrow(run, schema)


def _together(fps: DataFrame) -> tuple[np.ndarray, int]:
    """How often each two bits are both set, over all fingerprints; and their number."""

    def run(batches):
        total = np.zeros((BITS, BITS), np.float64)
        n = 0
        for b in slices(batches, 65536):
            raw = np.ascontiguousarray(b.column(0).to_numpy(zero_copy_only=False)).astype("<i8").view(np.uint8).reshape(-1, 8)
            bits = np.unpackbits(raw, axis=1, bitorder="little").astype(np.float32)
            total += bits.T @ bits
            n += len(raw)
        cells = np.append(total.ravel(), n).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(cells)), pa.int32()), pa.array(cells)], names=["cell", "n"])

    rows = fps.select("fp").mapInArrow(run, "cell int, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).collect()  # 64 x 64 sums
    cells = np.zeros(BITS * BITS + 1)
    for r in rows:
        cells[r["cell"]] = r["n"]
    return cells[:-1].reshape(BITS, BITS), int(cells[-1])


def group_bits(together: np.ndarray, n: int, parts: int) -> list[list[int]]:
    """Bits in ``parts`` groups of nearly equal size; each group takes the bits most correlated with it."""
    p = np.diag(together) / max(n, 1)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    corr = np.abs((together / max(n, 1) - np.outer(p, p)) / np.outer(sd, sd))
    np.fill_diagonal(corr, 0)
    free, groups = set(range(BITS)), []
    for g in range(parts):
        size = (BITS - sum(map(len, groups))) // (parts - g)
        group = [max(sorted(free), key=lambda b: corr[b, sorted(free)].sum())]
        free.discard(group[0])
        while len(group) < size:
            b = max(sorted(free), key=lambda x: corr[x, group].sum())
            group.append(b)
            free.discard(b)
        groups.append(sorted(group))
    return groups


@dataclass
class Plan:
    groups: list[list[int]]
    thresholds: list[int]
    cost: float


def allocate(costs: np.ndarray, budget: int) -> tuple[float, list[int]]:
    """Least sum of costs[i, t_i + 1] with the sum of (t_i + 1) equal to ``budget``; costs[i, 0] is for a skipped one."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for row in costs:
        step: dict[int, tuple[float, list[int]]] = {}
        for used, (cost, chosen) in best.items():
            for extra, c in enumerate(row):
                if used + extra <= budget and (used + extra not in step or cost + c < step[used + extra][0]):
                    step[used + extra] = (cost + c, [*chosen, extra - 1])
        best = step
    return best[budget]


def plan(fps: DataFrame, differing: int = DIFFERING) -> Plan:
    """Groups and thresholds for these fingerprints. Any plan gives the same links."""
    together, n = _together(fps)
    sample = np.array([r["fp"] for r in fps.select("fp").orderBy(F.xxhash64("fp")).limit(SAMPLE).collect()], np.int64).view(np.uint64)
    x = sample[:, None] ^ sample[None, :]
    best = None
    for parts in range(2, 7):
        groups = group_bits(together, n, parts)
        costs = np.zeros((parts, differing + 2))
        for i, group in enumerate(groups):
            d = np.bitwise_count(x & np.uint64(_mask(group)))
            for t in range(differing + 1):
                share = max(0, int((d <= t).sum()) - len(sample)) / max(1, len(sample) * (len(sample) - 1))
                chance = sum(_choose(len(group), k) for k in range(t + 1)) / 2 ** len(group)
                costs[i, t + 1] = max(share, chance) * n * n / 2 + PROBE_COST * n * sum(_choose(len(group), k) for k in range(t + 1))
        cost, chosen = allocate(costs, differing + 1)
        if best is None or cost < best.cost:
            best = Plan(groups, chosen, cost)
    return best


def _choose(n: int, k: int) -> int:
    return len(list(combinations(range(n), k)))


def _mask(bits: list[int] | tuple[int, ...]) -> int:
    return sum(1 << b for b in bits)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def links(fps: DataFrame, differing: int = DIFFERING, chosen: Plan | None = None) -> DataFrame:
    """(a, b): links between different fingerprints that join the same components as all links do.

    Keys with few probes give their verified pairs. In a key with many, each fingerprint meets its neighbours at the
    values one bit away from it: two fingerprints within two bits share such a value, and at most 65 share one.
    """
    if differing != 2:
        raise ValueError("common neighbours are worked out for 2 differing bits")
    chosen = chosen or plan(fps, differing)
    probes = []
    for i, (group, t) in enumerate(zip(chosen.groups, chosen.thresholds)):
        mask = F.lit(_signed(_mask(group)))
        for k in range(t + 1):
            for flips in combinations(group, k):
                key = F.col("fp").bitwiseAND(mask).bitwiseXOR(F.lit(_signed(_mask(flips))))
                probes.append(F.struct(F.lit(i).alias("part"), key.alias("key"), F.lit(k == 0).alias("home")))
    rows = fps.select("fp", F.explode(F.array(*probes)).alias("p")).select("fp", "p.*")
    counts = rows.groupBy("part", "key").agg(F.count("*").alias("n"), F.max("home").alias("met")).where((F.col("n") > 1) & F.col("met"))
    near = saved(rows.join(counts, ["part", "key"]), "simhash-near")
    few = near.where(F.col("n") <= PAIRWISE).groupBy("part", "key").agg(F.collect_list(F.struct("fp", "home")).alias("all"))
    pairs = few.select(F.explode("all").alias("x"), "all").select(
        F.col("x.fp").alias("a"),
        F.explode(F.filter("all", lambda y: F.col("x.home") & (y["fp"] != F.col("x.fp")) & (F.bit_count(y["fp"].bitwiseXOR(F.col("x.fp"))) <= differing))).alias("y"),
    ).select("a", F.col("y.fp").alias("b"))
    many = near.where(F.col("n") > PAIRWISE).select("fp").distinct()
    around = F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit(_signed(1 << i))) for i in range(BITS)])
    met = many.select("fp", F.explode(around).alias("at")).groupBy("at").agg(F.min("fp").alias("a"), F.collect_list("fp").alias("all")).where(F.size("all") > 1)
    stars = met.select("a", F.explode("all").alias("b")).where(F.col("a") != F.col("b"))
    return pairs.unionByName(stars).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, fingerprint as 16 hex digits, component_id: the smallest key reachable by links).

    A null or empty text has fingerprint zero and is linked like any other; equal fingerprints are one node, so copies
    are never paired. Repeated rows stay repeated. A null key never becomes a component's id unless all its keys
    are null. Other columns, whatever their names, are not read. An empty table gives no rows.
    """
    prints = saved(fingerprints(docs, text, key).select(F.col(key).alias("__key"), "fp"), "fingerprints")
    nodes = saved(prints.groupBy("fp").agg(F.min("__key").alias("first")), "simhash-nodes")
    labels = components(links(nodes.select("fp"))).withColumnRenamed("node", "fp")
    placed = nodes.join(labels, "fp", "left").select("fp", "first", F.coalesce("label", "fp").alias("label"))
    least = placed.groupBy("label").agg(F.min("first").alias("component_id"))
    named = placed.join(least, "label").select("fp", "component_id")
    return prints.join(named, "fp").select(F.col("__key").alias(key), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, text: str = "text", key: str = "doc_id", near=near_duplicates) -> DataFrame:
    """``docs`` with one row of each component of ``near``: that of the smallest key. Rows with a null key can't be told apart and all stay."""
    named = docs.where(F.col(key).isNotNull())
    first = near(named, text, key).where(F.col(key) == F.col("component_id")).select(F.col(key).alias("__first")).distinct()
    kept = named.join(first, F.col(key) == F.col("__first"), "left_semi").dropDuplicates([key])
    return kept.unionByName(docs.where(F.col(key).isNull()))
