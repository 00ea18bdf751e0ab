"""Language identification by prediction by partial matching.

For each language a tree of byte contexts of up to ORDER bytes holds how often each byte followed. A byte costs its exact
code length under the frozen counts: the longest known context codes it, or an escape and the next shorter context do
(the chance of an escape is the number of different bytes seen over that number plus all bytes seen). Contexts start at
the space before a word, so a text costs the sum of its words, and each different word is coded once.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barline.llm.store import SLICE, slices, utf8

ORDER = 4
#: Training rows per language, picked by the hash of their id; bounds the model, whatever the corpus.
TRAINING_ROWS = 2000
#: Contexts of this order and above are kept if seen this often.
PRUNED_ORDER, PRUNED_COUNT = 3, 2
KEPT_WORDS = 500_000
_LETTER = regex.compile(r"\p{L}")


def _words(text: bytes) -> list[bytes]:
    return text.lower().split()


@dataclass
class Trees:
    """Sorted keys of (context, next byte) and of contexts for each order, with the bits of a hit and of an escape by language."""

    languages: list[str]
    entries: list[np.ndarray]
    hit: list[np.ndarray]
    contexts: list[np.ndarray]
    escape: list[np.ndarray]

    @classmethod
    def of(cls, languages: list[str], rows: list[tuple[int, int, int, int]]) -> Trees:
        """``rows``: (order, language, context and next byte, count)."""
        table = np.array(rows, np.int64).reshape(-1, 4)
        out = cls(languages, [], [], [], [])
        for order in range(ORDER + 1):
            t = table[table[:, 0] == order]
            entries, at = np.unique(t[:, 2], return_inverse=True)
            counts = np.zeros((len(entries), len(languages)))
            counts[at, t[:, 1]] = t[:, 3]
            contexts, of = np.unique(entries >> 8, return_inverse=True)
            total, different = (np.zeros((len(contexts), len(languages))) for _ in range(2))
            np.add.at(total, of, counts)
            np.add.at(different, of, counts > 0)
            with np.errstate(divide="ignore", invalid="ignore"):
                out.hit.append(np.where(counts > 0, -np.log2(counts / (total + different)[of]), np.inf))
                out.escape.append(np.where(total > 0, -np.log2(different / (total + different)), 0.0))
            out.entries.append(np.append(entries, -1))
            out.contexts.append(np.append(contexts, -1))
        return out

    def bits(self, words: list[bytes]) -> np.ndarray:
        """The code length of each word in each language."""
        if not words:
            return np.zeros((0, len(self.languages)))
        joined = np.frombuffer(b" " + b" ".join(words) + b" ", np.uint8).astype(np.int64)
        sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1  # with the space that follows
        word = np.repeat(np.arange(len(words)), sizes)
        inside = np.arange(len(word)) - np.repeat(np.cumsum(sizes) - sizes, sizes)  # place of the coded byte in its word
        at = np.arange(1, len(joined))
        cost = np.zeros((len(at), len(self.languages)))
        left = np.ones(cost.shape, bool)
        for order in range(ORDER, -1, -1):
            some = np.flatnonzero((inside + 1 >= order) & left.any(axis=1))
            context = np.zeros(len(some), np.int64)
            for k in range(order, 0, -1):
                context = context << 8 | joined[at[some] - k]
            i = np.searchsorted(self.contexts[order][:-1], context)
            known = self.contexts[order][i] == context
            some, context, i = some[known], context[known], i[known]
            entry = context << 8 | joined[at[some]]
            e = np.searchsorted(self.entries[order][:-1], entry)
            seen = (self.entries[order][e] == entry)[:, None]
            hit = np.where(seen, self.hit[order][np.where(seen[:, 0], e, 0)], np.inf)
            done = np.isfinite(hit)
            open_ = left[some]
            cost[some] += np.where(open_, np.where(done, hit, self.escape[order][i]), 0.0)
            left[some] = open_ & ~done
        cost += 8.0 * left  # a byte never seen
        return np.add.reduceat(cost, np.cumsum(sizes) - sizes, axis=0)


def train(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id") -> Trees:
    """Trees from at most about TRAINING_ROWS rows of each language that have a text. No such rows give no languages."""
    usable = docs.where(F.col(text).isNotNull() & F.col(lang).isNotNull())
    sizes = {r[0]: r[1] for r in usable.groupBy(lang).count().collect()}
    languages = sorted(sizes)
    if not languages:
        return Trees.of([], [])
    share = F.lit(0.0)
    for name in languages:
        share = F.when(F.col(lang) == name, F.lit(TRAINING_ROWS / sizes[name])).otherwise(share)
    picked = usable.where(F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(1_000_000)) < share * 1_000_000)
    number = {name: i for i, name in enumerate(languages)}

    def words(batches):
        for b in slices(batches):
            seen: dict[str, Counter] = {}
            for t, name in zip(utf8(b.column(0)), b.column(1).to_pylist()):
                seen.setdefault(name, Counter()).update(_words(t))
            for name, c in seen.items():
                yield pa.RecordBatch.from_arrays([pa.array([number[name]] * len(c), pa.int32()), pa.array(list(c), pa.binary()), pa.array(list(c.values()), pa.int64())], names=["lang", "word", "n"])

    def contexts(batches):
        for b in slices(batches, 20_000):
            ws = b.column(1).to_pylist()
            if not ws:
                continue
            joined = np.frombuffer(b" " + b" ".join(ws) + b" ", np.uint8).astype(np.int64)
            sizes = np.fromiter(map(len, ws), np.int64, len(ws)) + 1
            inside = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            n = np.repeat(b.column(2).to_numpy(), sizes)
            langs = np.repeat(b.column(0).to_numpy(), sizes)
            at = np.arange(1, len(joined))
            for order in range(ORDER + 1):
                some = np.flatnonzero(inside + 1 >= order)
                entry = np.zeros(len(some), np.int64)
                for k in range(order, -1, -1):
                    entry = entry << 8 | joined[at[some] - k]
                both = np.stack([langs[some], entry])
                unique, where = np.unique(both, axis=1, return_inverse=True)
                total = np.zeros(unique.shape[1], np.int64)
                np.add.at(total, where.ravel(), n[some])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(total), order), pa.int32()), pa.array(unique[0].astype(np.int32)), pa.array(unique[1]), pa.array(total)], names=["ord", "lang", "entry", "n"])

    counted = picked.select(text, lang).mapInArrow(words, "lang int, word binary, n bigint").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    rows = counted.mapInArrow(contexts, "ord int, lang int, entry bigint, n bigint").groupBy("ord", "lang", "entry").agg(F.sum("n").alias("n"))
    kept = rows.where((F.col("ord") < PRUNED_ORDER) | (F.col("n") >= PRUNED_COUNT))
    return Trees.of(languages, [tuple(r) for r in kept.collect()])  # bounded by TRAINING_ROWS


def identify(docs: DataFrame, trees: Trees, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, lang_pred, score) of every whole text.

    The language of the least code length, the first by name of equal ones; the score is its share of 2 ** -length. A
    null text or one without letters, and any text without trained languages, gives 'und' with score 0. Repeated rows
    give equal results; other columns are not read; an empty table gives no rows.
    """
    schema = T.StructType([T.StructField(key, docs.schema[key].dataType), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast(trees)

    def run(batches):
        model = shared.value
        index: dict[bytes, int] = {}
        costs = np.zeros((0, len(model.languages)))
        for b in slices(batches, SLICE):
            texts = utf8(b.column(1))
            split = [_words(t) for t in texts]
            new = list(set(chain.from_iterable(split)).difference(index))
            if len(index) + len(new) > KEPT_WORDS:
                index, costs = {}, costs[:0]
                new = list(set(chain.from_iterable(split)))
            if new and model.languages:
                index.update(zip(new, range(len(index), len(index) + len(new))))
                costs = np.concatenate([costs, *(model.bits(new[i : i + 20_000]) for i in range(0, len(new), 20_000))])
            names, scores = [], []
            for t, ws in zip(texts, split):
                if not model.languages or not _LETTER.search(t.decode("utf-8")):
                    names.append("und")
                    scores.append(0.0)
                    continue
                total = costs[np.fromiter(map(index.__getitem__, ws), np.int64, len(ws))].sum(axis=0)
                best = int(total.argmin())
                names.append(model.languages[best])
                scores.append(float(1 / np.exp2(-np.minimum(total - total[best], 1000.0)).sum()))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=[key, "lang_pred", "score"])

    return docs.select(key, text).mapInArrow(run, schema)
