"""Vectorised word hashing for Arrow batches of texts.

The bytes of a block of texts are hashed with one polynomial prefix sum modulo
2**64, from which every word's hash is a difference of two entries. Blocks are
cut between words, so memory stays bounded however long one text is.
"""

from __future__ import annotations

import sys
from types import ModuleType

import numpy as np

_P = np.uint64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2**64
_P_INV = np.uint64(pow(int(_P), -1, 1 << 64))
BLOCK = 1 << 19


def _tables(separators: bytes) -> tuple[np.ndarray, np.ndarray]:
    low = np.arange(256, dtype=np.uint64)
    low[65:91] += np.uint64(32)
    cut = np.zeros(256, dtype=bool)
    cut[list(separators)] = True
    return low + np.uint64(1), cut


#: Words as the contracts define them: cut at space and at tab to carriage return.
PLAIN = _tables(b" \t\n\x0b\x0c\r")
#: Words for language models: ASCII punctuation and controls separate as well.
LETTERS = _tables(bytes(c for c in range(128) if not chr(c).isalnum()))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit values that spreads every input bit (splitmix64 finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, kept by the process (not by this module, which is sent by value)."""
    kept = sys.modules.setdefault("_taxalake_powers", ModuleType("_taxalake_powers")).__dict__
    if (found := kept.get(f"n{n}")) is not None:
        return found
    both = []
    for p in (_P, _P_INV):
        a = np.full(n, p, dtype=np.uint64)
        a[0] = 1
        both.append(np.cumprod(a, dtype=np.uint64))
    kept[f"n{n}"] = both[0], both[1]
    return both[0], both[1]


def _hash_block(raw: np.ndarray, tables) -> tuple[np.ndarray, np.ndarray]:
    value, cut = tables
    gap = cut[raw]
    edge = np.diff(np.concatenate(([True], gap, [True])).astype(np.int8))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    size = BLOCK
    while size < len(raw) + 1:
        size *= 2
    up, down = _powers(size)
    total = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum(value[raw] * up[: len(raw)], out=total[1:])
    return start, mix((total[end] - total[start]) * down[start])


def word_places(texts: list[bytes], tables=PLAIN) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all words of ``texts`` in order and where each begins in the joined bytes, those
    bytes (every text followed by a newline), and where each text begins in them (len + 1)."""
    lengths = np.array([len(t) for t in texts], dtype=np.int64)
    begin = np.concatenate(([0], np.cumsum(lengths + 1)))
    raw = np.frombuffer(b"\n".join(texts) + b"\n" if texts else b"", dtype=np.uint8)
    cut = tables[1]
    starts, hashes, at = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], 0
    while at < len(raw):
        to = min(at + BLOCK, len(raw))
        while to < len(raw):  # go on to the next gap, so that no word is cut
            gap = np.flatnonzero(cut[raw[to : to + BLOCK]])
            if len(gap):
                to += int(gap[0])
                break
            to = min(to + BLOCK, len(raw))
        s, h = _hash_block(raw[at:to], tables)
        starts.append(s + at)
        hashes.append(h)
        at = to
    return np.concatenate(hashes), np.concatenate(starts), raw, begin


def word_hashes(texts: list[bytes], tables=PLAIN) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of ``texts`` in order, and the offsets (len + 1) of each text's words."""
    hashes, starts, _, begin = word_places(texts, tables)
    return hashes, np.searchsorted(starts, begin).astype(np.int64)


def groups(sizes: list[int], limit: int):
    """Slices of consecutive texts of about ``limit`` bytes together (one text at least)."""
    first = size = 0
    for i, n in enumerate(sizes):
        size += n
        if size >= limit:
            yield slice(first, i + 1)
            first, size = i + 1, 0
    if first < len(sizes):
        yield slice(first, len(sizes))


def grams(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the runs of ``n`` words; of all words as one run if they are fewer (none: none)."""
    if len(words) == 0:
        return words
    n = min(n, len(words))
    out = np.zeros(len(words) - n + 1, dtype=np.uint64)
    for i in range(n):
        out = mix(out + words[i : len(words) - n + 1 + i] + np.uint64(n))
    return out
