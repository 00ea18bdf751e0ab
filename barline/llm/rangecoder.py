"""Adaptive context-mixing range coder for token ids.

A block of ids is cut into lanes of STEPS ids. All lanes advance together, one id each a step, and share one adaptive
model, so a step is a handful of array operations. The orders 2 and 1 each predict an id: the one that followed the same
two ids, or the same id, before. Whether a prediction holds is coded with a probability mixed in the logistic domain from
what the orders 0 to 2 have seen; the weights learn from every step. An id that no order predicts is coded by its order-0
frequency. All arithmetic is in integers, so that every machine decodes what any other has written.
"""

from __future__ import annotations

import math
import struct
import zlib

import numpy as np

MAGIC = b"BTB1"
STEPS = 256
SLOT_BITS = 19
#: What one occurrence adds to an id's order-0 frequency.
GAIN = 32
_LOW = np.uint64(0xFFFFFFFF)
_U = np.uint64
_STRETCH = np.array([0] + [max(-2047, min(2047, round(256 * math.log(p / (4096 - p))))) for p in range(1, 4096)], np.int64)
_SQUASH = np.array([max(32, min(65504, round(65536 / (1 + math.exp(-d / 256))))) for d in range(-2047, 2048)], np.int64)
_LOG = np.array([min(31, 2 * i.bit_length() + ((i >> max(0, i.bit_length() - 2)) & 1)) for i in range(1 << 16)], np.int64)


class Encoder:
    """One range coder for each lane: a window of 48 bits, from which settled words of 16 bits go out."""

    def __init__(self, lanes: int):
        self.low, self.range = np.zeros(lanes, np.uint64), np.full(lanes, 1 << 48, np.uint64)
        self.lanes, self.words = [], []

    def narrow(self, at, start: np.ndarray, width: np.ndarray) -> None:
        self.low[at] += start
        self.range[at] = width
        wait = np.flatnonzero(width <= _LOW)
        if len(wait):
            self.settle(wait if isinstance(at, slice) else at[wait])

    def settle(self, at: np.ndarray) -> None:
        while len(at):
            low, width = self.low[at], self.range[at]
            # an interval over a border of words is cut there
            across = (low ^ (low + width - _U(1))) > _LOW
            width = np.where(across, _LOW + _U(1) - (low & _LOW), width)
            self.move(at, low)
            self.low[at], width = (low & _LOW) << _U(16), width << _U(16)
            self.range[at] = width
            at = at[width <= _LOW]

    def move(self, at: np.ndarray, low: np.ndarray) -> None:
        self.lanes.append(at)
        self.words.append((low >> _U(32)).astype(np.uint16))

    def bit(self, at, p: np.ndarray, bits: np.ndarray) -> np.ndarray:
        width = self.range[at]
        bound = (width >> _U(16)) * p.astype(np.uint64)
        self.narrow(at, np.where(bits, _U(0), bound), np.where(bits, bound, width - bound))
        return bits

    def symbol(self, at: np.ndarray, cum: np.ndarray, ids: np.ndarray) -> np.ndarray:
        unit = self.range[at] // _U(cum[-1])
        self.narrow(at, unit * cum[ids].astype(np.uint64), unit * (cum[ids + 1] - cum[ids]).astype(np.uint64))
        return ids

    def finish(self) -> bytes:
        """The number of words of each lane, then the words lane by lane."""
        last = np.arange(len(self.low))
        self.move(last, self.low + _LOW)  # one word picks a value inside the interval
        lanes, words = np.concatenate(self.lanes), np.concatenate(self.words)
        order = np.argsort(lanes, kind="stable")
        return np.bincount(lanes, minlength=len(last)).astype("<u2").tobytes() + words[order].astype("<u2").tobytes()


class Decoder(Encoder):
    def __init__(self, lanes: int, data: bytes):
        super().__init__(lanes)
        sizes = np.frombuffer(data, "<u2", lanes).astype(np.int64)
        self.data = np.append(np.frombuffer(data, "<u2", offset=2 * lanes), np.zeros(4, np.uint16)).astype(np.uint64)
        self.end = np.cumsum(sizes)
        self.next = self.end - sizes
        self.value = np.zeros(lanes, np.uint64)  # above low
        every = np.arange(lanes)
        for _ in range(3):
            self.value = self.value << _U(16) | self.read(every)

    def read(self, at: np.ndarray) -> np.ndarray:
        i = self.next[at]
        self.next[at] = i + 1
        return np.where(i < self.end[at], self.data[np.minimum(i, len(self.data) - 1)], _U(0))

    def move(self, at: np.ndarray, low: np.ndarray) -> None:
        self.value[at] = self.value[at] << _U(16) | self.read(at)

    def bit(self, at, p: np.ndarray, bits: None) -> np.ndarray:
        width = self.range[at]
        bound = (width >> _U(16)) * p.astype(np.uint64)
        hit = self.value[at] < bound
        start = np.where(hit, _U(0), bound)
        self.value[at] -= start
        self.narrow(at, start, np.where(hit, bound, width - bound))
        return hit

    def symbol(self, at: np.ndarray, cum: np.ndarray, ids: None) -> np.ndarray:
        unit = self.range[at] // _U(cum[-1])
        got = np.minimum(self.value[at] // unit, _U(cum[-1] - 1)).astype(np.int64)
        order = np.argsort(got)  # sorted places are found much faster
        ids = np.empty_like(got)
        ids[order] = np.searchsorted(cum, got[order], side="right") - 1
        start = unit * cum[ids].astype(np.uint64)
        self.value[at] -= start
        self.narrow(at, start, unit * (cum[ids + 1] - cum[ids]).astype(np.uint64))
        return ids


class Mixer:
    """A probability of 16 bits from adaptive states, one for each order."""

    def __init__(self, sizes: list[int]):
        self.hits = [np.zeros(n, np.int64) for n in sizes]
        self.all = [np.zeros(n, np.int64) for n in sizes]
        self.weights = [(1 << 16) // len(sizes) + 6000] * len(sizes)

    def predict(self, states: list[np.ndarray]) -> np.ndarray:
        self.states = states
        self.inputs = [_STRETCH[np.clip((h * 4096 + 1024) // (n + 1), 1, 4095)][s] for h, n, s in zip(self.hits, self.all, states)]
        dot = sum(w * x for w, x in zip(self.weights, self.inputs)) >> 16
        self.p = _SQUASH[np.clip(dot, -2047, 2047) + 2047]
        return self.p

    def learn(self, bits: np.ndarray) -> None:
        error = (bits.astype(np.int64) << 16) - self.p
        for k, (s, x) in enumerate(zip(self.states, self.inputs)):
            seen = np.bincount(2 * s + bits, minlength=2 * len(self.hits[k])).reshape(-1, 2)
            self.hits[k] += seen[:, 1]
            self.all[k] += seen.sum(axis=1)
            self.weights[k] = max(-(1 << 17), min(1 << 18, self.weights[k] + (int(error @ x) // max(1, len(s)) >> 8)))
        for k in range(len(self.hits)):
            if self.all[k].max(initial=0) > 1 << 20:
                self.hits[k] >>= 1
                self.all[k] >>= 1


def _often(freq: np.ndarray) -> np.ndarray:
    return _LOG[np.minimum(freq // GAIN, 65535)]


#: Trust after a miss (first half) and after a hit.
_TRUST = np.array([t >> 1 for t in range(8)] + [min(t + 1, 7) for t in range(8)], np.int8)


def _follow(table: np.ndarray, trust: np.ndarray, slot: np.ndarray, ids: np.ndarray, hit: np.ndarray) -> None:
    """After a hit an id is trusted more; after misses the newest id takes its place."""
    t = trust[slot]
    new = np.flatnonzero(~hit & (t == 0))
    table[slot[new]] = ids[new] + 1
    trust[slot] = _TRUST[t + 8 * hit]


def _code(coder: Encoder, lanes: int, vocab: int, given: np.ndarray | None) -> np.ndarray:
    """Runs the model over all steps; both directions share it. ``given`` is None in decoding."""
    out = np.zeros((STEPS, lanes), np.int64)
    two, one = np.zeros(1 << SLOT_BITS, np.int32), np.zeros(vocab + 1, np.int32)
    two_trust, one_trust = np.zeros(1 << SLOT_BITS, np.int8), np.zeros(vocab + 1, np.int8)
    freq = np.ones(vocab, np.int64)
    first, second = Mixer([9, 18, 64]), Mixer([9, 9, 32])
    p1 = p2 = np.full(lanes, vocab, np.int64)
    every = slice(None)
    for step in range(STEPS):
        ids = given[step] if given is not None else None
        slot = ((p2 * 0x9E3779B1 + p1 * 0x85EBCA6B) >> 7) & ((1 << SLOT_BITS) - 1)
        a, b = two[slot].astype(np.int64) - 1, one[p1].astype(np.int64) - 1
        a_state, b_state = np.where(a < 0, 8, two_trust[slot]).astype(np.int64), np.where(b < 0, 8, one_trust[p1]).astype(np.int64)
        same = a == b
        p = first.predict([a_state, b_state * 2 + same, _often(freq[a]) * 2 + same])
        hit_a = coder.bit(every, p, None if ids is None else ids == a)
        first.learn(hit_a)
        got = np.where(hit_a, a, -1)
        rest = np.flatnonzero(~hit_a & ~same & (b >= 0))
        if len(rest):
            p = second.predict([b_state[rest], a_state[rest], _often(freq[b[rest]])])
            hit_b = coder.bit(rest, p, None if ids is None else ids[rest] == b[rest])
            second.learn(hit_b)
            got[rest[hit_b]] = b[rest[hit_b]]
        left = np.flatnonzero(got < 0)
        if len(left):
            cum = np.concatenate([[0], np.cumsum(freq)])
            got[left] = coder.symbol(left, cum, None if ids is None else ids[left])
        out[step] = got
        _follow(two, two_trust, slot, got, hit_a)
        _follow(one, one_trust, p1, got, got == b)
        freq += GAIN * np.bincount(got, minlength=vocab)
        p2, p1 = p1, got
    return out


def encode_block(ids: np.ndarray, vocab: int) -> bytes:
    """A block that stands alone: sizes, checksums of the ids and of the coded words, then the words."""
    lanes = -(-len(ids) // STEPS)
    grid = np.zeros(lanes * STEPS, np.int64)
    grid[: len(ids)] = ids
    body = b""
    if lanes:
        coder = Encoder(lanes)
        _code(coder, lanes, vocab, np.ascontiguousarray(grid.reshape(lanes, STEPS).T))
        body = coder.finish()
    return MAGIC + struct.pack("<IIII", len(ids), vocab, zlib.crc32(ids.astype("<u4").tobytes()), zlib.crc32(body)) + body


def decode_block(data: bytes) -> np.ndarray:
    """The ids of a block; ValueError if it is damaged."""
    if data[:4] != MAGIC or len(data) < 20:
        raise ValueError("not a token block")
    n, vocab, of_ids, of_body = struct.unpack_from("<IIII", data, 4)
    body = data[20:]
    if zlib.crc32(body) != of_body:
        raise ValueError("damaged token block")
    lanes = -(-n // STEPS)
    if not lanes:
        return np.zeros(0, np.int64)
    ids = _code(Decoder(lanes, body), lanes, vocab, None).T.reshape(-1)[:n]
    if zlib.crc32(ids.astype("<u4").tobytes()) != of_ids:
        raise ValueError("damaged token block")
    return ids
