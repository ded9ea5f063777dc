"""64-bit hashes of words and of runs of words, alike on every machine.

Words are hashed where they stand in the bytes of a text, all at once: a word's
hash is a polynomial of its bytes, which is a difference of two sums from the
text's beginning, brought to one power. No word becomes an object of its own.
"""

from __future__ import annotations

import numpy as np
import xxhash

ODD = np.uint64(0x9E3779B97F4A7C15)
#: Bytes that are summed up together; longer words than half of them are hashed one by one.
SPAN = 1 << 19


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> np.ndarray:
    """The powers of an odd number from 0 to ``n``, each from two smaller ones."""
    out = np.ones(n + 1, np.uint64)
    done, base = 1, 0xD6E8FEB86659FD93
    while done <= n:
        step = min(done, n + 1 - done)
        out[done : done + step] = out[:step] * np.uint64(pow(base, done, 1 << 64))
        done += step
    return out


POWERS = _powers(SPAN)
#: A number for every byte; in the second row capital letters have that of their small ones.
BYTES = np.stack([mixed(np.arange(1, 257, dtype=np.uint64) * ODD)] * 2)
BYTES[1, 65:91] = BYTES[1, 97:123]
BLANK = np.zeros(256, bool)
BLANK[[32, *range(9, 14)]] = True


def word_hashes(texts: list[bytes], lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words in order, and the number of words of each text; ``lower`` takes A-Z for a-z."""
    sizes = np.array([len(t) for t in texts], np.int64)
    data = np.frombuffer(b" ".join([*texts, b""]), np.uint8)
    blank = np.ones(len(data) + 1, bool)
    np.take(BLANK, data, out=blank[1:])
    edges = np.flatnonzero(blank[1:] != blank[:-1])  # a word begins and ends; the last byte is a blank
    starts, ends = edges[::2], edges[1::2]
    counts = np.bincount(np.searchsorted(np.cumsum(sizes + 1), starts, side="right"), minlength=len(texts)).astype(np.int64)
    hashes = np.zeros(len(starts), np.uint64)
    table, at = BYTES[int(lower)], 0
    while at < len(starts):
        first = starts[at]
        last = int(np.searchsorted(ends, first + SPAN, side="right"))
        if ends[at] - first > SPAN // 2:
            word = data[first : ends[at]].tobytes()
            hashes[at] = xxhash.xxh3_64_intdigest(word.lower() if lower else word)
            at += 1
            continue
        long = np.flatnonzero(ends[at:last] - starts[at:last] > SPAN // 2)
        last = at + int(long[0]) if len(long) else last
        own = data[first : ends[last - 1]]
        total = np.zeros(len(own) + 1, np.uint64)
        np.cumsum(table[own] * POWERS[: len(own)], out=total[1:])
        a, b = starts[at:last] - first, ends[at:last] - first
        hashes[at:last] = mixed((total[b] - total[a]) * POWERS[SPAN - a])
        at = last
    return hashes, counts


def run_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """The hash of the ``width`` words from each place on; shorter runs at the end are left out.

    A polynomial of the words; that of a run is put together from those of
    runs of powers of two.
    """
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total, done = np.zeros(n, np.uint64), 0
    power, span, factor = words, 1, int(ODD)
    while True:
        if width & span:
            total = total * np.uint64(factor) + power[done : done + n]
            done += span
        if done == width:
            return mixed(total + np.uint64(width))
        power = power[:-span] * np.uint64(factor) + power[span:]
        span, factor = 2 * span, factor * factor % (1 << 64)
