"""Simple-8b: integers packed into 64-bit words by a 4-bit selector.

The selector (top 4 bits) says how many values of how many bits the other 60
bits hold.  Selector 0 is an escape: the next word is one raw 64-bit value.
Values are coded in blocks of `BLOCK`; block offsets (in words) let a reader
start at any block, and all words of one selector decode in one array step.
"""

from __future__ import annotations

import numpy as np

# Fixed by the coding: (values, bits) of the selectors 1 to 14.
SELECTORS = [(60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8),
             (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60)]
BLOCK = 256
COUNTS = np.array([1] + [c for c, _ in SELECTORS] + [0], dtype=np.int64)


def encode(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words, offsets of the blocks' first words and the end)."""
    step = 64 * BLOCK                                            # keeps the arrays in the CPU's cache
    runs = [_encode(values[i:i + step]) for i in range(0, max(len(values), 1), step)]
    shift = np.cumsum([0] + [len(w) for w, _ in runs])
    blocks = [b[:-1] + s for (_, b), s in zip(runs, shift)] + [shift[-1:]]
    return np.concatenate([w for w, _ in runs]), np.concatenate(blocks)


def _encode(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    v = np.ascontiguousarray(values, dtype=np.uint64)
    n = len(v)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(1, np.int64)
    width = np.frexp(v.astype(np.float64))[1]
    at = np.arange(n, dtype=np.int64)
    room = np.minimum((at // BLOCK + 1) * BLOCK, n) - at         # values left in the block
    held = np.cumsum(np.bincount(width, minlength=66))
    pick = np.zeros(n, dtype=np.int8)                            # 0: escape
    for code, (count, bits) in enumerate(SELECTORS, 1):
        if held[bits] < count:
            continue
        wide = np.where(width > bits, at, n)
        run = np.minimum(np.minimum.accumulate(wide[::-1])[::-1] - at, room)
        pick[(pick == 0) & (run >= count)] = code
    # Follow the words of all blocks at once.
    is_start = np.zeros(n, dtype=bool)
    pos = np.arange(0, n, BLOCK, dtype=np.int64)
    end = np.minimum(pos + BLOCK, n)
    while len(pos):
        is_start[pos] = True
        pos = pos + COUNTS[pick[pos]]
        more = pos < end
        pos, end = pos[more], end[more]
    starts = np.flatnonzero(is_start)
    code = pick[starts]
    size = np.where(code == 0, 2, 1)
    place = np.cumsum(size) - size
    words = np.zeros(int(size.sum()), dtype=np.uint64)
    for c in np.unique(code):
        of = code == c
        if c == 0:
            words[place[of] + 1] = v[starts[of]]
            continue
        count, bits = SELECTORS[c - 1]
        word = np.full(int(of.sum()), int(c) << 60, dtype=np.uint64)
        for k in range(count):
            word |= v[starts[of] + k] << np.uint64(k * bits)
        words[place[of]] = word
    firsts = np.searchsorted(starts, np.arange(0, n, BLOCK))
    return words, np.append(place[firsts], len(words)).astype(np.int64)


def decode(words: np.ndarray) -> np.ndarray:
    """All values of a whole run of blocks."""
    w = np.ascontiguousarray(words, dtype=np.uint64)
    code = (w >> np.uint64(60)).astype(np.int64)
    raw_after = []
    last = -2
    for i in np.flatnonzero(code == 0):                          # escapes are rare
        if i != last + 1:                                        # not itself a raw value
            raw_after.append(i)
            last = i
    count = COUNTS[code]
    if raw_after:
        raw = np.array(raw_after) + 1
        code[raw], count[raw] = -1, 0
    place = np.cumsum(count) - count
    out = np.zeros(int(count.sum()), dtype=np.uint64)
    for c in np.unique(code):
        of = np.flatnonzero(code == c)
        if c == 0:
            out[place[of]] = w[of + 1]
        elif c > 0:
            n, bits = SELECTORS[c - 1]
            mask = np.uint64((1 << bits) - 1)
            for k in range(n):
                out[place[of] + k] = (w[of] >> np.uint64(k * bits)) & mask
    return out
