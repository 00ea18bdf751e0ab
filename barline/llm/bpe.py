"""Byte-pair encoding with a pair occurrence index, and decoding.

All different pieces of a slice lie one after another in one array of symbols. An index maps each rank to the positions
of its pair; active ranks are applied in ascending order, each to all its positions at once, and only the lists of the
pairs beside a merge are updated.
"""

from __future__ import annotations

import heapq
import json
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barline.llm.store import release, slices, utf8
from barline.llm.words import WordTable, ragged

_BITS = 20


def byte_symbols() -> list[str]:
    """The character that stands for each byte: printable ones for themselves, the others from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


class Bpe:
    """A model read from a tokenizer file of type BPE."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if spec.get("decoder") is not None:
            raise ValueError("only files without a decoder are supported")
        vocab: dict[str, int] = model["vocab"]
        self.end = model.get("end_of_word_suffix") or ""
        merges = [tuple(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
        pairs = np.array([(vocab[a] << _BITS) | vocab[b] for a, b in merges], np.int64)
        self.left, self.right = (np.array([vocab[m[i]] for m in merges], np.int64) for i in (0, 1))
        self.made = np.array([vocab[a + b] for a, b in merges], np.int64)
        order = np.argsort(pairs, kind="stable")
        self.pairs, self.rank_of = np.append(pairs[order], np.int64(1 << 62)), np.append(order, len(order))
        self.none = len(merges)
        chars = byte_symbols()
        self.inner = np.array([vocab[c] for c in chars], np.int64)
        self.last = np.array([vocab[c + self.end] for c in chars], np.int64)
        added = {a["content"]: a["id"] for a in spec.get("added_tokens", [])}
        self.added = {k.encode(): v for k, v in added.items()}
        self.special = re.compile(b"(" + b"|".join(map(re.escape, self.added)) + b")") if added else None
        # words of characters up to U+00FF keep to plain rules and are cut together; others go through the normaliser
        # and splitter of the file
        self.parts = Tokenizer.from_file(path)
        self.unusual = re.compile(rb"[\x00-\x09\x0b-\x20\x7f]|\xc2[\x80-\xa0]|[\xc4-\xff]")
        self.split = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"] + r"|\n")
        self.byte_of = {c: b for b, c in enumerate(chars)}

    def _unusual_pieces(self, word: bytes) -> list[bytes | int]:
        """The pieces of any word; an added token is its id."""
        out: list[bytes | int] = []
        for part in self.special.split(word) if self.special else (word,):
            if part in self.added:
                out.append(self.added[part])
            elif part:
                s = self.parts.normalizer.normalize_str(part.decode("utf-8"))
                out += [bytes(self.byte_of[c] for c in p) for p, _ in self.parts.pre_tokenizer.pre_tokenize_str(s)]
        return out

    def pieces(self, words: list[bytes]) -> list[bytes | int]:
        """The pieces of all words; each word is ended by a line feed."""
        joined = b"\n".join(words) + b"\n"
        odd = [m.start() for pattern in (self.unusual, self.special) if pattern for m in pattern.finditer(joined)]
        if not odd:
            return [p.encode() for p in self.split.findall(joined.decode("utf-8").lower())]
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        out: list[bytes | int] = []
        start = 0
        for k in sorted(set(np.searchsorted(ends, odd, side="right").tolist())):
            if k > start:
                out += self.pieces(words[start:k])
            out += [*self._unusual_pieces(words[k]), b"\n"]
            start = k + 1
        return out + (self.pieces(words[start:]) if start < len(words) else [])

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words one after another, and how many each has."""
        pieces = self.pieces(words)
        different = dict.fromkeys(pieces)
        different.pop(b"\n")
        added = [p for p in different if isinstance(p, int)]
        for p in added:
            different.pop(p)
        ids, starts = self.merge(list(different))
        # behind the pieces stand the added tokens, and the word end without ids
        index = dict(zip([*different, *added, b"\n"], range(len(different) + len(added) + 1)))
        starts = np.concatenate([starts, starts[-1] + np.arange(1, len(added) + 1), [starts[-1] + len(added)]])
        at = np.fromiter(map(index.__getitem__, pieces), np.int64, len(pieces))
        out, ends = ragged(np.concatenate([ids, np.array(added, np.int64)]), starts[at], starts[at + 1] - starts[at])
        return out, np.diff(ends[at == len(index) - 1], prepend=0)

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = (a << _BITS) | b
        at = np.searchsorted(self.pairs, key)
        return np.where(self.pairs[at] == key, self.rank_of[at], self.none)

    def merge(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the pieces one after another, and where each starts."""
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        ends = np.cumsum(sizes)
        n = int(ends[-1]) if len(ends) else 0
        raw = np.frombuffer(b"".join(pieces), np.uint8)
        sym = np.full(n + 1, -1, np.int64)  # the last place is a border
        sym[:n] = self.inner[raw]
        sym[ends - 1] = self.last[raw[ends - 1]]
        after, before = np.arange(1, n + 2), np.arange(-1, n)
        after[ends - 1] = n
        before[ends[:-1]] = n
        if n:
            before[0] = n
        # the index: places of each rank, at first by one sort
        left = np.flatnonzero(after[:n] < n)
        rank = self.ranks(sym[left], sym[after[left]])
        left, rank = left[rank < self.none], rank[rank < self.none]
        order = np.argsort(rank, kind="stable")
        left, rank = left[order], rank[order]
        heads = np.flatnonzero(np.diff(rank, prepend=-1)) if len(rank) else rank
        index: dict[int, list[np.ndarray]] = {int(rank[h]): [left[h:t]] for h, t in zip(heads, [*heads[1:], len(rank)])}
        active = list(index)  # ascending, so it is a heap
        while active:
            r = heapq.heappop(active)
            lists = index.pop(r, None)
            if lists is None:
                continue
            a, b, new = self.left[r], self.right[r], self.made[r]
            at = lists[0] if len(lists) == 1 else np.unique(np.concatenate(lists))
            at = at[(sym[at] == a) & (sym[after[at]] == b)]
            if a == b and len(at) > 1:  # aaa: from the left, without overlap
                keep, used = [], -1
                for p in at.tolist():
                    if p != used:
                        keep.append(p)
                        used = int(after[p])
                at = np.array(keep, np.int64)
            if not len(at):
                continue
            gone = after[at]
            right = after[gone]
            sym[at], sym[gone] = new, -1
            after[at] = right
            before[right] = at  # of the border too, where it has no meaning
            lead = before[at]
            for x in (lead[lead < n], at[right < n]):
                found = self.ranks(sym[x], sym[after[x]])
                ok = found < self.none
                if not ok.any():
                    continue
                x, found = x[ok], found[ok]
                if len(x) > 1:
                    o = np.argsort(found, kind="stable")
                    x, found = x[o], found[o]
                    cut = [0, *(np.flatnonzero(np.diff(found)) + 1).tolist(), len(x)]
                else:
                    cut = [0, 1]
                for h, t in zip(cut, cut[1:]):
                    k = int(found[h])
                    if k in index:
                        index[k].append(x[h:t])
                    else:
                        index[k] = [x[h:t]]
                        heapq.heappush(active, k)
        alive = sym[:n] >= 0
        starts = np.concatenate([[0], np.cumsum(alive)])[np.concatenate([[0], ends])] if n else np.zeros(len(pieces) + 1, np.int64)
        return sym[:n][alive], starts


@lru_cache(maxsize=2)
def model(path: str) -> Bpe:
    return Bpe(path)


@lru_cache(maxsize=2)
def _table(path: str) -> WordTable:
    return WordTable(model(path).encode_words)


def encode(docs: DataFrame, path: str, text: str = "text", out: str = "ids") -> DataFrame:
    """``docs`` with ``out``: the ids of the whole text, array of int.

    A null or empty text has no ids. Other columns pass as they are; one named ``out`` is replaced. Rows are
    independent of one another, so repeated rows give equal ids; an empty table gives an empty one.
    """
    rest = [c for c in docs.columns if c != out]
    schema = T.StructType([docs.schema[c] for c in rest] + [T.StructField(out, T.ArrayType(T.IntegerType()))])
    at = rest.index(text)

    def run(batches):
        table = _table(path)
        for b in slices(batches, 5000, 2 << 20):
            ids, ends = table(utf8(b.column(at)))
            offsets = pa.array(np.concatenate([[0], ends]), pa.int32())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.ListArray.from_arrays(offsets, pa.array(ids, pa.int32()))], names=[*rest, out])
            release()

    return docs.select(*rest).mapInArrow(run, schema)


@lru_cache(maxsize=2)
def tokens(path: str) -> list[str | None]:
    """The text of each id."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    if spec.get("decoder") is not None:
        raise ValueError("only files without a decoder are supported")
    names = spec["model"]["vocab"] | {a["content"]: a["id"] for a in spec.get("added_tokens", [])}
    out: list[str | None] = [None] * (max(names.values()) + 1)
    for k, v in names.items():
        out[v] = k
    return out


def decode(docs: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``docs`` with ``out``: the tokens of the ids joined by one space (the file names no decoder).

    Null ids and an empty array give an empty text; an id outside the vocabulary is left out; a column named ``out`` is
    replaced. A column expression: the vocabulary is a literal of fixed size.
    """
    names = F.from_json(F.lit(json.dumps(tokens(path))), "array<string>")
    return docs.withColumn(out, F.coalesce(F.array_join(F.transform(ids, lambda i: F.get(names, i)), " "), F.lit("")))


def digests(docs: DataFrame, *columns: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """``columns``, the number of tokens and SHA-256 of the ids (decimal, joined by one space) and of the decoded text."""
    return docs.select(
        *columns,
        F.size(ids).cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col(ids).cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col(decoded).cast("binary"), 256).alias("decoded_sha256"),
    )
