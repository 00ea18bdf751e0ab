"""Enhanced suffix array of short contexts, and the repeat groups of its common-prefix interval tree."""

from __future__ import annotations

from array import array

import numpy as np

#: Bytes of a suffix that are compared; longer contexts are cut by the caller.
DEPTH = 96
_WORDS = DEPTH // 8


def sort_suffixes(rows: np.ndarray, sizes: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Suffixes of at least ``least`` bytes in order: row, start, and the common prefix with the suffix before.

    ``rows`` holds a context of ``sizes`` bytes in each row, with zeros behind it.
    """
    count = sizes - least + 1
    row = np.repeat(np.arange(len(rows)), count)
    start = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
    wide = np.concatenate([rows, np.zeros((len(rows), DEPTH), np.uint8)], axis=1)
    windows = np.lib.stride_tricks.sliding_window_view(wide, DEPTH, axis=1)
    words = windows[row, start].view(">u8")  # their order is the order of the bytes
    words.byteswap(inplace=True)
    words = words.view("<u8")
    size = sizes[row] - start
    order = np.lexsort([size, *(words[:, k] for k in range(_WORDS - 1, -1, -1))])
    row, start, size, words = row[order], start[order], size[order], words[order]
    lcp = np.zeros(len(row), np.int64)
    if len(row) > 1:
        x = words[1:] ^ words[:-1]
        word = (x != 0).argmax(axis=1)
        first = x[np.arange(len(x)), word]
        zeros = sum((first < np.uint64(1 << s)).astype(np.int64) for s in range(8, 64, 8))
        same = np.where(first == 0, DEPTH, 8 * word + zeros)
        lcp[1:] = np.minimum(same, np.minimum(size[1:], size[:-1]))
    return row, start, lcp


def repeat_groups(lcp: np.ndarray, weight: np.ndarray, left: np.ndarray, least: int) -> np.ndarray:
    """Maximal repeats as rows (first, last, length, smallest weight, length of the parent) of the sorted suffixes.

    One scan with a stack visits every interval of common prefixes of at least ``least`` bytes. An interval is a maximal
    repeat if the bytes on the left of its suffixes differ; else a longer one has the same occurrences. ``left`` holds
    these bytes; a suffix without one needs a value of its own. All that hold a maximal repeat are maximal too; a parent
    below ``least`` counts as 0.
    """
    n = len(lcp)
    inside = lcp >= least
    heads = np.flatnonzero(inside & ~np.concatenate([[False], inside[:-1]])) - 1 if n else np.zeros(0, int)
    ends = np.flatnonzero(inside & ~np.concatenate([inside[1:], [False]])) if n else heads
    changes = np.concatenate([[0], np.cumsum(left[1:] != left[:-1])]) if n else heads
    lengths, weights = lcp.tolist(), weight.tolist()
    out = array("q")
    for head, end in zip(heads.tolist(), ends.tolist()):
        stack: list[list[int]] = []
        for i in range(head + 1, end + 2):
            now = lengths[i] if i <= end else 0
            first, small = i - 1, weights[i - 1]
            while stack and stack[-1][0] > now:
                length, first, w = stack.pop()
                small = min(small, w)
                out.extend((first, i - 1, length, small, max(now, stack[-1][0] if stack else 0)))
            if now:
                if stack and stack[-1][0] == now:
                    stack[-1][2] = min(stack[-1][2], small)
                else:
                    stack.append([now, first, small])
    groups = np.array(out, np.int64).reshape(-1, 5)
    return groups[changes[groups[:, 1]] > changes[groups[:, 0]]] if len(groups) else groups
