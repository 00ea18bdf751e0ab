"""Fill-in-middle texts by secondary sort.

A text is cut into units (a word with the white space before it), the units into a prefix, a middle and a suffix, and
these into chunks of units that know their document and their place in the output. One exchange on the document, sorted
by place within it, brings the chunks in output order: they stream into the output text or into a running digest, so no
task holds more than a chunk of a text. The way back reads the sections from the output by its marks and sorts them by
their original order.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from barline.llm.store import slices, utf8

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
#: Bytes of a chunk; a single longer unit is cut between bytes.
CHUNK = 1 << 14
#: Marks in output order, and the original order of the section after each.
FORMS = {"psm": ((PREFIX, 0), (SUFFIX, 2), (MIDDLE, 1)), "spm": ((SUFFIX, 2), (PREFIX, 0), (MIDDLE, 1))}
_LEVEL = 3
_HEAD = "n bigint, form string, prefix_chars bigint, middle_chars bigint"


@dataclass(frozen=True)
class Options:
    """``plain`` and ``spm``: per cent of the texts that stay, and of the others that have the suffix first."""

    seed: int = 42
    plain: int = 50
    spm: int = 80


def unit_ends(raw: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Where each unit of the texts one after another ends; ``ends``: where each text does."""
    space = (raw == 32) | ((raw >= 9) & (raw <= 13))
    last = np.zeros(len(raw) + 1, bool)
    last[ends] = True
    closes = last[1:].copy()  # the last byte of a text closes a unit of any kind
    closes[:-1] |= ~space[:-1] & space[1:]
    return np.flatnonzero(closes) + 1


def _draws(key, options: Options) -> list[int]:
    digest = hashlib.sha256(f"{options.seed}:{'' if key is None else key}".encode()).hexdigest()
    return [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]


def _layout(key, raw: bytes, units: np.ndarray, options: Options) -> tuple[str, int, int]:
    """Form, and where prefix and middle end. ``units``: where each unit ends."""
    h = _draws(key, options)
    if not raw or any(m in raw for m in (PREFIX, SUFFIX, MIDDLE)) or h[2] % 100 >= options.plain:
        return "plain", len(raw), len(raw)
    cuts = sorted(x % (len(units) + 1) for x in h[:2])
    first, second = (int(units[c - 1]) if c else 0 for c in cuts)
    return "spm" if h[3] % 100 < options.spm else "psm", first, second


def _chunks(raw: bytes, start: int, end: int, units: np.ndarray) -> Iterator[bytes]:
    while end - start > CHUNK:
        i = int(np.searchsorted(units, start + CHUNK, "right")) - 1
        cut = int(units[i]) if i >= 0 and units[i] > start else start + CHUNK
        yield raw[start:cut]
        start = cut
    yield raw[start:end]


class _Rows:
    """Rows gathered for Arrow batches of bounded size."""

    def __init__(self, schema: pa.Schema):
        self.schema, self.rows, self.size = schema, [], 0

    def add(self, row: tuple, size: int) -> Iterator[pa.RecordBatch]:
        self.rows.append(row)
        self.size += size + 50
        if self.size > 4 << 20:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*self.rows), self.schema)], schema=self.schema)
        self.rows, self.size = [], 0


def pieces(docs: DataFrame, text: str = "text", key: str = "doc_id", options: Options = Options()) -> DataFrame:
    """(row, place, key, n, form, prefix_chars, middle_chars, data): the chunks of every output, not yet in order.

    ``row`` names a row of ``docs``, so rows that repeat stay apart; ``place`` is the chunk's in the output; ``data`` is
    compressed. Only the first chunk of a row has the head (key to middle_chars). A null text is empty and gives one
    empty chunk; a null key draws as an empty one. Other columns are not read; an empty table gives no rows.
    """
    schema = T.StructType([T.StructField("row", T.LongType()), T.StructField("place", T.IntegerType()), T.StructField(key, docs.schema[key].dataType), *T._parse_datatype_string(_HEAD).fields, T.StructField("data", T.BinaryType())])
    arrow = to_arrow_schema(schema)

    def run(batches):
        pack, out = zstandard.ZstdCompressor(level=_LEVEL).compress, _Rows(arrow)
        for b in slices(batches):
            texts = utf8(b.column(2))
            ends = np.cumsum([len(t) for t in texts])
            units = unit_ends(np.frombuffer(b"".join(texts), np.uint8), ends[np.diff(ends, prepend=0) > 0])
            first = np.searchsorted(units, ends, "right")
            for i, (row, name, raw) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), texts)):
                own = units[first[i - 1] if i else 0 : first[i]] - (ends[i] - len(raw))
                form, p, m = _layout(name, raw, own, options)
                if form == "plain":
                    sections, chars = [(b"", 0, len(raw))], (None, None)
                else:
                    at = {0: (0, p), 1: (p, m), 2: (m, len(raw))}
                    sections, chars = [(mark, *at[order]) for mark, order in FORMS[form]], (len(raw[:p].decode()), len(raw[p:m].decode()))
                place = 0
                for mark, s, e in sections:
                    for chunk in _chunks(raw, s, e, own):
                        data = pack(mark + chunk)
                        head = (None,) * 5 if place else (name, len(own), form, *chars)
                        yield from out.add((row, place, *head, data), len(data))
                        mark = b""
                        place += 1
        yield from out.flush()

    return docs.select(F.monotonically_increasing_id().alias("row"), key, text).mapInArrow(run, schema)


def _in_order(df: DataFrame, *place: str) -> DataFrame:
    return df.repartition("row").sortWithinPartitions("row", *place)


class _Sections:
    """Cuts an output that comes in chunks into its sections: (original order, bytes)."""

    def __init__(self, form: str):
        self.marks, self.order, self.held = [*FORMS[form]], None, b""

    def feed(self, chunk: bytes) -> Iterator[tuple[int, bytes]]:
        self.held += chunk
        while self.marks:
            mark, order = self.marks[0]
            i = self.held.find(mark)
            if i < 0:
                break
            if i:
                yield self.order, self.held[:i]
            self.held, self.order = self.held[i + len(mark) :], order
            self.marks.pop(0)
        sure = len(self.held) - (2 if self.marks else 0)  # a mark may go on in the next chunk
        if sure > 0:
            yield self.order, self.held[:sure]
            self.held = self.held[sure:]

    def close(self) -> Iterator[tuple[int, bytes]]:
        if self.held:
            yield self.order, self.held


def transformed(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, n, form, prefix_chars, middle_chars, output) of the ``pieces``: the output texts."""
    names = [key, "n", "form", "prefix_chars", "middle_chars"]
    schema = T.StructType([*(found.schema[c] for c in names), T.StructField("output", T.StringType())])
    arrow = to_arrow_schema(schema)

    def run(batches):
        unpack, out, head, parts = zstandard.ZstdDecompressor().decompress, _Rows(arrow), None, []
        for b in batches:
            for _, place, *own, data in zip(*(c.to_pylist() for c in b.columns)):
                if place == 0:
                    if head:
                        yield from out.add((*head, b"".join(parts).decode()), sum(map(len, parts)))
                    head, parts = own, []
                parts.append(unpack(data))
        if head:
            yield from out.add((*head, b"".join(parts).decode()), sum(map(len, parts)))
        yield from out.flush()

    return _in_order(found, "place").select("row", "place", *names, "data").mapInArrow(run, schema)


def digests(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256) of the ``pieces``.

    Outputs stream into their digest in output order. The sections of a transformed output, found by its marks alone, are
    sorted again, by their original order, and stream into the digest of the restored text; a plain output is its text.
    """
    names = [key, "n", "form", "prefix_chars", "middle_chars"]
    head_fields = [found.schema[c] for c in names]
    middle = T.StructType([T.StructField("row", T.LongType()), T.StructField("section", T.IntegerType()), T.StructField("place", T.IntegerType()), *head_fields, T.StructField("output_sha256", T.StringType()), T.StructField("data", T.BinaryType())])
    last = T.StructType([*head_fields, T.StructField("output_sha256", T.StringType()), T.StructField("restored_sha256", T.StringType())])
    arrow, arrow_last = to_arrow_schema(middle), to_arrow_schema(last)
    none = (None,) * (len(names) + 1)

    def outputs(batches):
        pack, unpack, out = zstandard.ZstdCompressor(level=_LEVEL).compress, zstandard.ZstdDecompressor().decompress, _Rows(arrow)
        row, head, digest, cut, place = None, None, None, None, 0

        def sections(some):
            nonlocal place
            for order, part in some:
                data = pack(part)
                yield from out.add((row, order, place, *none, data), len(data))
                place += 1

        def close():
            if head:
                yield from sections(cut.close() if cut else ())
                yield from out.add((row, -1, 0, *head, digest.hexdigest(), None), 100)

        for b in batches:
            for new, at, *own, data in zip(*(c.to_pylist() for c in b.columns)):
                if at == 0:
                    yield from close()
                    row, head, digest, place = new, own, hashlib.sha256(), 0
                    cut = None if own[2] == "plain" else _Sections(own[2])
                chunk = unpack(data)
                digest.update(chunk)
                if cut:
                    yield from sections(cut.feed(chunk))
        yield from close()
        yield from out.flush()

    def restored(batches):
        unpack, out, head, digest = zstandard.ZstdDecompressor().decompress, _Rows(arrow_last), None, None
        for b in batches:
            for _, section, _, *own, data in zip(*(c.to_pylist() for c in b.columns)):
                if section < 0:
                    if head:
                        yield from out.add((*head, digest.hexdigest() if digest else head[-1]), 200)
                    head, digest = own, None if own[2] == "plain" else hashlib.sha256()
                else:
                    digest.update(unpack(data))
        if head:
            yield from out.add((*head, digest.hexdigest() if digest else head[-1]), 200)
        yield from out.flush()

    streamed = _in_order(found, "place").select("row", "place", *names, "data").mapInArrow(outputs, middle)
    return _in_order(streamed, "section", "place").mapInArrow(restored, last)
