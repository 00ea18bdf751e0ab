"""Benchmark decontamination by pigeonhole edit matching.

An item with an error budget of k edits is split into k + 1 pieces: a passage within k edits of it holds one piece
unchanged. Exact piece hits come from one automaton over all pieces; Myers' bit-parallel distance verifies the places.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barline.llm.store import saved, slices

#: Edits allowed for each character of an item; an item of fewer characters than LEAST must occur unchanged.
SHARE, LEAST = 0.08, 40
#: Bytes of items that one pass over the documents takes; more items take more passes.
BLOCK_BYTES = 8 << 20
_GAPS = re.compile(r"[\W_]+")


def normalised(text: str | None) -> str:
    """Lower case, letters and digits, one space between words."""
    return _GAPS.sub(" ", (text or "").lower()).strip()


def distances(pattern: str, text: str) -> list[int]:
    """For each end in ``text``, the least edits between the pattern and a passage that ends there."""
    m = len(pattern)
    peq: dict[str, int] = {}
    for i, c in enumerate(pattern):
        peq[c] = peq.get(c, 0) | 1 << i
    full, high = (1 << m) - 1, 1 << m - 1
    pv, mv, score, out = full, 0, m, []
    for c in text:
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph, mh = mv | (full & ~(xh | pv)), pv & xh
        if ph & high:
            score += 1
        elif mh & high:
            score -= 1
        ph, mh = ph << 1 & full, mh << 1 & full
        pv, mv = mh | (full & ~(xv | ph)), ph & xv
        out.append(score)
    return out


@dataclass
class Index:
    """Items with an automaton over their pieces."""

    ids: list[int]
    texts: list[str]
    budgets: list[int]
    automaton: ahocorasick.Automaton

    @classmethod
    def of(cls, items: list[tuple[int, str]]) -> Index:
        a = ahocorasick.Automaton()
        budgets, places = [], {}
        for n, (_, text) in enumerate(items):
            k = int(SHARE * len(text)) if len(text) >= LEAST else 0
            budgets.append(k)
            cuts = [len(text) * i // (k + 1) for i in range(k + 2)]
            for s, e in zip(cuts, cuts[1:]):
                places.setdefault(text[s:e], []).append((n, s))
        for piece, at in places.items():
            a.add_word(piece, (len(piece), at))
        a.make_automaton()
        return cls([i for i, _ in items], [t for _, t in items], budgets, a)

    def find(self, text: str) -> list[tuple[int, int, int, int]]:
        """(item, start, end, edits) of the best passage of each item within its budget."""
        windows: dict[int, list[tuple[int, int]]] = {}
        for end, (size, at) in self.automaton.iter(text):
            for n, offset in at:
                start, k = end + 1 - size - offset, self.budgets[n]
                windows.setdefault(n, []).append((max(0, start - k), start + len(self.texts[n]) + k))
        found = []
        for n, spans in windows.items():
            best = None
            spans.sort()
            merged = [list(spans[0])]
            for s, e in spans[1:]:
                if s <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], e)
                else:
                    merged.append([s, e])
            for s, e in merged:
                d = distances(self.texts[n], text[s:e])
                least = min(d, default=len(self.texts[n]))
                if least <= self.budgets[n] and (best is None or least < best[2]):
                    best = (s, s + d.index(least) + 1, least)
            if best:
                low, end, least = best
                back = distances(self.texts[n][::-1], text[low:end][::-1])
                found.append((n, end - back.index(least) - 1, end, least))
        return found


def matches(docs: DataFrame, items: DataFrame, text: str = "text", key: str = "doc_id", item_text: str = "text", item_key: str = "item_id") -> DataFrame:
    """(key, item_id, start, end, edits, n_chars): for each document and item the best passage within the budget.

    Start, end and n_chars (of the item) count characters of the normalised texts; the first of equally good
    passages is given. Null and empty texts and items match nothing; repeated rows on either side give repeated
    results; other columns are not read; an empty table gives no rows. Documents are not shuffled. Items are
    broadcast in blocks of at most BLOCK_BYTES, with one pass over the documents for each block.
    """
    spark = docs.sparkSession
    bare = items.select(item_key, F.col(item_text).alias("t")).where(F.length(F.btrim("t")) > 0)
    total = bare.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    blocks = int(-(-total // BLOCK_BYTES))
    schema = T.StructType([T.StructField(key, docs.schema[key].dataType), T.StructField("item_id", items.schema[item_key].dataType), *(T.StructField(c, T.IntegerType()) for c in ("start", "end", "edits", "n_chars"))])
    parts = []
    for block in range(blocks):
        rows = bare.where(F.pmod(F.xxhash64("t"), F.lit(blocks)) == block).collect()
        shared = spark.sparkContext.broadcast([(r[item_key], n) for r in rows if (n := normalised(r["t"]))])

        def run(batches, shared=shared):
            index = Index.of(shared.value)
            for b in slices(batches) if index.texts else ():
                keys, out = b.column(0).to_pylist(), []
                for k, t in zip(keys, b.column(1).to_pylist()):
                    out += [(k, index.ids[n], s, e, d, len(index.texts[n])) for n, s, e, d in index.find(normalised(t))]
                columns = list(zip(*out)) or [[]] * 6
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow)

        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        part = docs.select(key, text).mapInArrow(run, schema)
        parts.append(saved(part, "leaks") if blocks > 1 else part)
    if not parts:
        return spark.createDataFrame([], schema)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def decontaminated(docs: DataFrame, items: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``docs`` without the documents that hold a passage of an item. Rows with equal key and text go or stay together."""
    same = F.concat_ws(":", F.col(key).cast("string"), F.xxhash64(text).cast("string"))
    bad = matches(docs.select(same.alias("__k"), text), items, text, "__k").select("__k").distinct()
    return docs.join(bad, same == F.col("__k"), "left_anti")
