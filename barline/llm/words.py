"""Encodings of whole texts put together from encodings of their words.

A text is cut at ASCII white space. Tokenizers that drop white space never form a token across it, so each different
word needs to be encoded once; a bounded table keeps the encodings between slices.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import chain

import numpy as np

#: Words that the table keeps; beyond it starts anew. Only the memory depends on it.
KEPT_WORDS = 200_000


class WordTable:
    def __init__(self, encode: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]], kept: int = KEPT_WORDS):
        """``encode`` gives the ids of the words one after another, and how many each word has."""
        self.encode, self.kept = encode, kept
        self.clear()

    def clear(self) -> None:
        self.index: dict[bytes, int] = {}
        self.ids = np.zeros(0, np.int32)
        self.starts = np.zeros(1, np.int64)

    def __call__(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the texts one after another, and the end of each text in them."""
        split = [t.split() for t in texts]
        new = list(set(chain.from_iterable(split)).difference(self.index))
        if len(self.index) + len(new) > self.kept and self.index:
            self.clear()
            new = list(set(chain.from_iterable(split)))
        if new:
            ids, sizes = self.encode(new)
            self.index.update(zip(new, range(len(self.index), len(self.index) + len(new))))
            self.ids = np.concatenate([self.ids, ids.astype(np.int32)])
            self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(sizes)])
        per = np.fromiter(map(len, split), np.int64, len(split))
        where = np.fromiter(map(self.index.__getitem__, chain.from_iterable(split)), np.int64, int(per.sum()))
        out, ends = ragged(self.ids, self.starts[where], self.starts[where + 1] - self.starts[where])
        return out, np.concatenate([[0], ends])[np.cumsum(per)] if len(per) else np.zeros(0, np.int64)


def ragged(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs of ``values`` one after another, and the end of each run in the result."""
    ends = np.cumsum(sizes)
    if not len(ends):
        return values[:0], ends
    at = np.arange(ends[-1]) + np.repeat(starts - (ends - sizes), sizes)
    return values[at], ends
