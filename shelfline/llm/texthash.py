"""64-bit hashes of words and of runs of words, in arrays.

Words are hashed one by one (xxh3); runs of words by array arithmetic on those
hashes, so a run's hash is a fixed function of its word sequence.
"""

from __future__ import annotations

import numpy as np
import xxhash

_word_hash = xxhash.xxh3_64_intdigest
# Odd constants (fractional bits of square roots), one pair per lane.
_MULT = [np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBB67AE8584CAA73B), np.uint64(0x3C6EF372FE94F82B)]


def split_words(text: bytes | None) -> list[bytes]:
    """Words of a text: bytes.split() parts at exactly [\\x20\\x09-\\x0D]."""
    return text.split() if text else []


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_word_hash, words), dtype=np.uint64, count=len(words))


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def run_hashes(hashes: np.ndarray, length: int, lane: int = 0) -> np.ndarray:
    """Hash of every run of `length` consecutive words; lanes differ.  Built by
    doubling: the hash of a run of 2n combines those of its two halves."""
    n = len(hashes) - length + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out, done, power, span = None, 0, mix(hashes + _MULT[lane]), 1
    while True:
        if length & span:
            part = power[done:done + n]
            out = part if out is None else mix(out * _MULT[lane] + part)
            done += span
            if done == length:
                return out
        power = mix(power[:-span] * _MULT[lane] + power[span:])
        span *= 2
