"""Removal of repeated substrings by enhanced suffix arrays.

Of the 12-byte pieces of every window of WINDOW bytes, the one of the smallest hash is the window's anchor. Equal windows
have equal anchors, so the texts are cut into contexts (the windows in a row that share an anchor) and contexts meet by
their anchors in tasks of bounded size. There the suffixes of the different contexts are sorted, and the interval tree of
their common prefixes gives the maximal repeats with all occurrences; what a smaller key holds too is removed.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from barline.llm.enhanced import DEPTH, repeat_groups, sort_suffixes
from barline.llm.store import release, saved, slices, utf8
from barline.llm.words import ragged

WINDOW, PIECE = 50, 12
_PIECES = WINDOW - PIECE + 1
#: A window has its anchor and this many more bytes on one side at least.
_SIDE = (WINDOW - PIECE) // 2
#: Bytes of text that a task indexes at once, and that one message to each bucket is made from.
CHUNK, MESSAGE = 1 << 19, 16 << 20
#: Bytes of text for each bucket: few in small inputs, more in large ones.
LEAST_BUCKET, MOST_BUCKET = 2 << 20, 64 << 20
#: The same for the buckets in which texts meet their spans.
TEXT_BUCKET = 12 << 20
#: An anchor in more texts than this is not gathered: its windows are joined one by one.
HOT = 300_000
#: Contexts whose suffixes are sorted at once; those of one anchor stay together.
SORTED = 8000
#: Texts that are looked at for such anchors.
HOT_SAMPLE = 200_000
_C = [np.uint64(c) for c in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


def _eights(x: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one number."""
    a = x.astype(np.uint64)
    for n in (1, 2, 4):
        a = a[:-n] | a[n:] << np.uint64(8 * n)
    return a


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> np.uint64(32)) * _C[2]
    return h ^ h >> np.uint64(29)


def _piece_hash(eights: np.ndarray, other: np.ndarray) -> np.ndarray:
    return _mix(eights * _C[0] ^ (other * _C[1] >> np.uint64(7)) ^ other * _C[3])


def contexts(raw: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the texts one after another: text, place in ``raw``, windows, offset of the anchor, and its hash, by context."""
    none = np.zeros(0, np.int64)
    if len(raw) < WINDOW:
        return none, none, none, none, none.astype(np.uint64)
    eights = _eights(raw)
    h = _piece_hash(eights[:-4], eights[4:])
    place = np.arange(len(h), dtype=np.uint64)
    m = h >> np.uint64(24) << np.uint64(24) | place
    width = 1
    while 2 * width <= _PIECES:
        m = np.minimum(m[:-width], m[width:])
        width *= 2
    m = np.minimum(m[: len(m) - (_PIECES - width)], m[_PIECES - width :])
    anchor = (m & np.uint64((1 << 24) - 1)).astype(np.int64)  # of the window that starts at each place
    sizes = np.diff(ends, prepend=0)
    text = np.repeat(np.arange(len(ends)), sizes)[: len(anchor)]
    valid = np.arange(len(anchor)) + WINDOW <= ends[text]
    start = np.flatnonzero(valid)
    if not len(start):
        return none, none, none, none, none.astype(np.uint64)
    a = anchor[start]
    first = np.flatnonzero((np.diff(a, prepend=-1) != 0) | (np.diff(start, prepend=-2) != 1))
    count = np.diff(first, append=len(start))
    at = start[first]
    return text[at], at, count, a[first] - at, h[a[first]]


def _pack(*arrays: np.ndarray) -> bytes:
    """Each array is a frame of its own, first bytes of all its numbers before the second ones: unlike bytes compress badly together."""
    c = zstandard.ZstdCompressor(level=9)
    frames = [c.compress(np.ascontiguousarray(a).view("u1").reshape(len(a), a.itemsize).T.tobytes()) for a in arrays]
    return np.array([(len(a), len(f)) for a, f in zip(arrays, frames)], "<u4").tobytes() + b"".join(frames)


def _unpack(data: bytes, *kinds: str) -> list[np.ndarray]:
    d = zstandard.ZstdDecompressor()
    out, at = [], 8 * len(kinds)
    for kind, (n, size) in zip(kinds, np.frombuffer(data, "<u4", 2 * len(kinds)).reshape(-1, 2).tolist()):
        raw = np.frombuffer(d.decompress(data[at : at + size]), "u1").reshape(np.dtype(kind).itemsize, n)
        out.append(np.ascontiguousarray(raw.T).reshape(-1).view(kind))
        at += size
    return out


def _steps(x: np.ndarray) -> np.ndarray:
    """Differences of neighbours, modulo 2**32; ``_sums`` takes them back."""
    return np.diff(x.astype(np.int64), prepend=0).astype("<u4")


def _sums(x: np.ndarray) -> np.ndarray:
    return np.cumsum(x, dtype=np.uint32)


_KINDS = ("<i8", "<u4", "<u4", "u1", "u1", "u1")


def _bucket_of_key(keys: np.ndarray, buckets: int) -> np.ndarray:
    return (_mix(keys.astype(np.int64).view(np.uint64) * _C[0]) >> np.uint64(11)).astype(np.int64) % buckets


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Keys, bytes of the texts one after another, and their ends, in pieces of about CHUNK bytes."""
    for b in slices(batches):
        keys, texts = b.column(0).to_numpy(zero_copy_only=False), utf8(b.column(1))
        i = 0
        while i < len(texts):
            j, n = i, 0
            while j < len(texts) and (j == i or n + len(texts[j]) <= CHUNK):
                n += len(texts[j])
                j += 1
            yield keys[i:j].astype(np.int64), np.frombuffer(b"".join(texts[i:j]), np.uint8), np.cumsum([len(t) for t in texts[i:j]])
            i = j


def _long(raw: np.ndarray, ends: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """Parts of at most CHUNK bytes (the place bits of ``contexts`` hold more); parts of one long text share WINDOW - 1 bytes."""
    if len(raw) <= CHUNK or len(ends) > 1:
        yield raw, ends, 0
        return
    for s in range(0, max(1, len(raw) - WINDOW + 1), CHUNK - WINDOW + 1):
        part = raw[s : s + CHUNK]
        yield part, np.array([len(part)]), s


def _messages(buckets: int, hot: np.ndarray):
    """Contexts packed for the bucket of their anchor."""

    def run(batches):
        held: list[tuple] = []  # texts, and of their contexts the places alone: written out they are some times as long
        size = 0

        def flush():
            raw, at, place, count, offset, bucket, keys = [np.concatenate(c) for c in zip(*held)]
            held.clear()  # the parts are not needed beside the whole
            order = np.argsort(bucket, kind="stable")  # a bucket's contexts as they stand in the texts: small steps
            cut = np.flatnonzero(np.diff(bucket[order], prepend=-1))
            numbers, blobs = [], []
            for s, e in zip(cut, [*cut[1:], len(order)]):
                o = order[s:e]
                body, _ = ragged(raw, at[o].astype(np.int64), count[o].astype(np.int64) + WINDOW - 1)
                own, index = np.unique(keys[o], return_inverse=True)
                blobs.append(_pack(own.astype("<i8"), _steps(index), _steps(place[o]), count[o], offset[o], body))
                numbers.append(int(bucket[o[0]]))
            return pa.RecordBatch.from_arrays([pa.array(numbers, pa.int32()), pa.array(blobs, pa.binary())], names=["bucket", "data"])

        for keys, raw, ends in _chunks(batches):
            for part, part_ends, shift in _long(raw, ends):
                text, at, count, offset, h = contexts(part, part_ends)
                if len(hot) and len(h):
                    cold = ~np.isin(h, hot)
                    text, at, count, offset, h = text[cold], at[cold], count[cold], offset[cold], h[cold]
                if not len(h):
                    continue
                place = at + shift - (part_ends - np.diff(part_ends, prepend=0))[text]
                held.append((part, (at + size).astype("<u4"), place.astype("<u4"), count.astype("u1"), offset.astype("u1"), (h % np.uint64(buckets)).astype(np.int32), keys[text]))
                size += len(part)
                if size >= MESSAGE:
                    yield flush()
                    size = 0
                    release()
        if held:
            yield flush()
        release()

    return run


def _shared(value: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether a value occurs with two different keys or more."""
    order = np.argsort(value)
    v, k = value[order], keys[order]
    heads = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]])) if len(v) else np.zeros(0, int)
    low, high = np.minimum.reduceat(k, heads), np.maximum.reduceat(k, heads)
    out = np.empty(len(v), bool)
    out[order] = np.repeat(low < high, np.diff(heads, append=len(v)))
    return out


def _at(body: np.ndarray, places: np.ndarray) -> np.ndarray:
    """The eight bytes at each place as one number."""
    return np.lib.stride_tricks.sliding_window_view(body, 8)[places].view("<u8").ravel()


def covered(keys: np.ndarray, count: np.ndarray, offset: np.ndarray, body: np.ndarray) -> np.ndarray:
    """Which windows of each context (one row each) start in a smaller key too. All contexts of an anchor are given."""
    n = len(keys)
    flags = np.zeros((n, _PIECES), bool)
    if n < 2:
        return flags
    sizes = count + WINDOW - 1
    starts = np.cumsum(sizes) - sizes
    body = np.append(body, np.zeros(DEPTH, np.uint8))
    # what nobody shares on either side of the anchor is left out
    keep = np.zeros(n, bool)
    for has, at in ((offset >= _SIDE, starts + offset - _SIDE), (count - 1 > offset - _SIDE, starts + offset)):
        i = np.flatnonzero(has)
        if len(i):
            p = at[i]  # 31 bytes from here
            v = _piece_hash(_piece_hash(_at(body, p), _at(body, p + 8)), _piece_hash(_at(body, p + 16), _at(body, p + 23)))
            keep[i[_shared(v, keys[i])]] = True
    some = np.flatnonzero(keep)
    p = starts[some] + offset[some]
    anchor = _piece_hash(_at(body, p), _at(body, p + 4))
    order = np.argsort(anchor, kind="stable")
    some, anchor = some[order], anchor[order]
    heads = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]])) if len(some) else np.zeros(0, int)
    cuts = [0] if len(some) else []
    for h in [*heads[1:].tolist(), len(some)] if len(some) else ():
        if h - cuts[-1] >= SORTED or h == len(some):
            cuts.append(h)
    for a, b in zip(cuts, cuts[1:]):
        part = some[a:b]
        flags[part] = _covered_together(keys[part], count[part], np.lib.stride_tricks.sliding_window_view(body, DEPTH)[starts[part]])
    return flags


def _covered_together(keys: np.ndarray, count: np.ndarray, rows: np.ndarray) -> np.ndarray:
    sizes = count + WINDOW - 1
    rows[np.arange(DEPTH) >= sizes[:, None]] = 0
    rows[:, -1] = sizes  # different contexts only: sizes stand in the last byte
    _, first, which = np.unique(rows.view(f"S{DEPTH}").ravel(), return_index=True, return_inverse=True)
    least = np.full(len(first), np.iinfo(np.int64).max)
    np.minimum.at(least, which, keys)
    rows = rows[first]
    size = rows[:, -1].astype(np.int64)
    rows[:, -1] = 0
    row, start, lcp = sort_suffixes(rows, size, WINDOW)
    left = np.where(start > 0, rows[row, start - 1].astype(np.int64), -1 - np.arange(len(row)))
    groups = repeat_groups(lcp, least[row], left, WINDOW)
    smallest = np.repeat(least[:, None], _PIECES, axis=1)  # of the keys that hold each window
    members = groups[:, 1] - groups[:, 0] + 1
    suffix, _ = ragged(np.arange(len(row)), groups[:, 0], members)
    group = np.repeat(np.arange(len(groups)), members)
    # windows up to the parent's length have the parent's key, which is no greater
    skip = np.maximum(groups[group, 4] - WINDOW + 1, 0)
    reach = groups[group, 2] - WINDOW + 1 - skip
    at, _ = ragged(np.arange(len(rows) * _PIECES), row[suffix] * _PIECES + start[suffix] + skip, reach)
    np.minimum.at(smallest.reshape(-1), at, np.repeat(groups[group, 3], reach))
    return (smallest[which] < keys[:, None]) & (np.arange(_PIECES) < count[:, None])


def _spans(buckets: int):
    """Spans to remove, packed for the bucket of the key, from all messages to a bucket of anchors."""

    def run(table: pa.Table) -> pa.Table:
        parts = [_unpack(d, *_KINDS) for d in table.column("data").to_pylist()]
        keys = np.concatenate([own[_sums(index)] for own, index, *_ in parts])
        place = np.concatenate([_sums(p[2]) for p in parts]).astype(np.int64)
        count, offset, body = (np.concatenate([p[i] for p in parts]).astype(np.uint8 if i == 5 else np.int64) for i in (3, 4, 5))
        edge = np.diff(np.pad(covered(keys, count, offset, body).astype(np.int8), ((0, 0), (1, 1))), axis=1)
        (i, s), (_, e) = np.nonzero(edge == 1), np.nonzero(edge == -1)
        out = pa.Table.from_arrays(_packed_spans(keys[i], place[i] + s, e - s + WINDOW - 1, buckets), names=["bucket", "data"])
        del parts, keys, place, count, offset, body, edge, i, s, e
        release()
        return out

    return run


def _packed_spans(keys: np.ndarray, start: np.ndarray, size: np.ndarray, buckets: int) -> list[pa.Array]:
    bucket = _bucket_of_key(keys, buckets)
    order = np.lexsort([start, keys, bucket])
    cut = np.flatnonzero(np.diff(bucket[order], prepend=-1))
    blobs = []
    for a, b in zip(cut, [*cut[1:], len(order)]):
        o = order[a:b]
        blobs.append(_pack(keys[o].astype("<i8"), start[o].astype("<u4"), size[o].astype("<u4")))
    return [pa.array(bucket[order[cut]], pa.int32()), pa.array(blobs, pa.binary())]


def _packed_documents(buckets: int, at: int):
    """Rows with a key, packed for its bucket; a null key goes to bucket 0."""

    def run(batches):
        for b in slices(batches):
            keys = b.column(at).fill_null(0).to_numpy(zero_copy_only=False)
            bucket = _bucket_of_key(keys, buckets)
            order = np.argsort(bucket, kind="stable")
            cut = np.flatnonzero(np.diff(bucket[order], prepend=-1))
            blobs = []
            for s, e in zip(cut, [*cut[1:], len(order)]):
                sink = io.BytesIO()
                with pa.ipc.new_stream(sink, b.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 9))) as w:
                    w.write_batch(b.take(pa.array(order[s:e])))
                blobs.append(sink.getvalue())
            yield pa.RecordBatch.from_arrays([pa.array(bucket[order[cut]], pa.int32()), pa.array(blobs, pa.binary())], names=["bucket", "data"])

    return run


def _removed(schema: pa.Schema, key: int, text: int, as_text: bool):
    def run(docs: pa.Table, spans: pa.Table) -> pa.Table:
        cuts = [_unpack(d, "<i8", "<u4", "<u4") for d in spans.column("data").to_pylist()]
        keys = np.concatenate([c[0] for c in cuts]) if cuts else np.zeros(0, np.int64)
        start = np.concatenate([c[1] for c in cuts]).astype(np.int64) if cuts else keys
        end = start + (np.concatenate([c[2] for c in cuts]) if cuts else keys)
        order = np.lexsort([start, keys])
        keys, start, end = keys[order], start[order], end[order]
        out = []
        for data in docs.column("data").to_pylist():
            t = pa.ipc.open_stream(data).read_all()
            own = t.column(key).to_pylist()
            kept, spans_, gone = [], [], []
            for k, raw in zip(own, utf8(t.column(text).combine_chunks())):
                i, j = (np.searchsorted(keys, k, "left"), np.searchsorted(keys, k, "right")) if k is not None else (0, 0)
                runs, pieces, last = 0, [], 0
                for s, e in zip(start[i:j].tolist(), end[i:j].tolist()):
                    if s > last or not runs:
                        pieces.append(raw[last:s])
                        runs += 1
                    last = max(last, e)
                pieces.append(raw[last:])
                rest = b"".join(pieces)
                kept.append(rest.decode("utf-8", "ignore") if as_text else rest)
                spans_.append(runs)
                gone.append(len(raw) - len(rest))
            new = [pa.array(kept, pa.string() if as_text else pa.binary()), pa.array(gone, pa.int64()), pa.array(spans_, pa.int64())]
            out.append(pa.Table.from_arrays([*(c.combine_chunks() for c in t.columns), *new], schema=schema))
        return pa.concat_tables(out) if out else schema.empty_table()

    return run


def _hot_anchors(docs: DataFrame, total: int, hot: int) -> np.ndarray:
    """Hashes of anchors that, by a sample of the texts, occur more than ``hot`` times."""
    if total <= hot:
        return np.zeros(0, np.uint64)
    share = min(1.0, HOT_SAMPLE / total)
    name = docs.columns[0]

    def seen(batches):
        for _, raw, ends in _chunks(batches):
            for part, part_ends, _ in _long(raw, ends):
                text, _, _, _, h = contexts(part, part_ends)
                once = np.unique(np.stack([h, text.astype(np.uint64)]), axis=1)[0]
                v, n = np.unique(once, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(v.view(np.int64)), pa.array(n)], names=["h", "n"])

    picked = docs.where(F.pmod(F.xxhash64(name), F.lit(1_000_000)) < share * 1_000_000)
    least = max(2, hot * share, min(10, hot))
    found = picked.mapInArrow(seen, "h bigint, n bigint").groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") > least)
    return np.array([r["h"] for r in found.select("h").collect()], np.int64).view(np.uint64)  # at most sample x anchors / least


def _hot_spans(docs: DataFrame, hot: np.ndarray, buckets: int) -> DataFrame:
    """Spans of windows with a hot anchor: the smallest key of each window by an aggregate, and a join back to the places."""

    def windows(batches):
        for keys, raw, ends in _chunks(batches):
            for part, part_ends, shift in _long(raw, ends):
                text, at, count, _, h = contexts(part, part_ends)
                i = np.isin(h, hot)
                text, at, count = text[i], at[i], count[i]
                place, _ = ragged(np.arange(len(part)), at, count)
                of = np.repeat(text, count)
                data = part.tobytes()
                inside = place + shift - (part_ends - np.diff(part_ends, prepend=0))[of]
                yield pa.RecordBatch.from_arrays([pa.array(keys[of]), pa.array(inside), pa.array([data[p : p + WINDOW] for p in place.tolist()], pa.binary())], names=["key", "place", "w"])

    rows = docs.mapInArrow(windows, "key bigint, place bigint, w binary")
    least = rows.groupBy("w").agg(F.min("key").alias("least"))
    found = rows.join(least, "w").where(F.col("key") > F.col("least")).select("key", "place")

    def packed(batches):
        for b in batches:
            k, p = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            yield pa.RecordBatch.from_arrays(_packed_spans(k, p, np.full(len(p), WINDOW), buckets), names=["bucket", "data"])

    return found.mapInArrow(packed, "bucket int, data binary")


def remove_repeats(docs: DataFrame, text: str = "text", key: str = "doc_id", hot: int = HOT, as_text: bool = False) -> DataFrame:
    """All columns of ``docs``, kept (the bytes that stay; with ``as_text`` as a string, without cut characters), n_removed and n_spans (maximal removed runs).

    A byte goes if a string of WINDOW bytes over it also starts in a text with a smaller key, judged on the input. A null
    text is empty, a text below WINDOW bytes stays whole, and so does one with a null key, which takes nothing from others
    either. The key (a long) names a text: rows that repeat both lose the same and nothing to one another. Input columns
    named like an output column are replaced; an empty table gives no rows.
    """
    rest = [c for c in docs.columns if c not in ("kept", "n_removed", "n_spans")]
    docs = docs.select(*rest).withColumn(key, F.col(key).cast("long"))
    total, size = docs.agg(F.count("*"), F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()
    buckets = max(16, -(-size // min(MOST_BUCKET, max(LEAST_BUCKET, size // 2000))))
    parts = max(16, -(-size // max(TEXT_BUCKET, size // 100_000)))
    texts = docs.where(F.col(key).isNotNull() & (F.octet_length(text) >= WINDOW)).select(key, text)
    anchors = _hot_anchors(texts, total, hot)
    met = texts.mapInArrow(_messages(buckets, anchors), "bucket int, data binary")
    spans = met.groupBy("bucket").applyInArrow(_spans(parts), "bucket int, data binary")
    if len(anchors):
        spans = spans.unionByName(_hot_spans(texts, anchors, parts))
    schema = T.StructType([*docs.schema.fields, T.StructField("kept", T.StringType() if as_text else T.BinaryType()), T.StructField("n_removed", T.LongType()), T.StructField("n_spans", T.LongType())])
    packed = docs.mapInArrow(_packed_documents(parts, rest.index(key)), "bucket int, data binary")
    run = _removed(to_arrow_schema(schema), rest.index(key), rest.index(text), as_text)
    return packed.groupBy("bucket").cogroup(saved(spans, "spans").groupBy("bucket")).applyInArrow(run, schema)
