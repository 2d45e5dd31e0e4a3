"""Vectorised hashing of words and word shingles for use inside tasks."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np

#: Text hashed at once; the arrays of a block take about 60 times that.
BLOCK_BYTES = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACE = _rng.integers(1, 1 << 63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, _BASE), np.full(n, np.uint64(pow(int(_BASE), -1, 1 << 64)))
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers of the base and of its inverse modulo 2^64, n of each at least."""
    return _powers(1 << max(20, int(n).bit_length()))


def blocks(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about BLOCK_BYTES; a longer text is a block of its own."""
    begin = held = 0
    for i, t in enumerate(texts):
        if held and held + len(t) > BLOCK_BYTES:
            yield begin, i
            begin, held = i, 0
        held += len(t) + 1
    if begin < len(texts):
        yield begin, len(texts)


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Of the words of all texts, with A-Z lower-cased: 64-bit hashes, and the index of each one's text."""
    data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    gap = (data == 32) | ((data >= 9) & (data <= 13))
    edge = np.flatnonzero(np.diff(np.concatenate(([True], gap)).view(np.int8)))
    start, end = edge[::2], edge[1::2]
    lower = data + np.where((data >= 65) & (data <= 90), np.uint8(32), np.uint8(0))
    up, down = powers(len(data))
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[lower] * up[: len(data)], out=total[1:])
    h = mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))
    first = np.cumsum([0] + [len(t) + 1 for t in texts])
    return h, np.searchsorted(first, start, "right") - 1


def shingle_sets(texts: list[bytes], width: int = 5) -> Iterator[np.ndarray]:
    """For each text its distinct word shingles as sorted 64-bit hashes; a text with fewer words has its whole
    sequence as the only one, and a text without words none."""
    for begin, stop in blocks(texts):
        h, doc = word_hashes(texts[begin:stop])
        n = np.bincount(doc, minlength=stop - begin)
        at = np.concatenate(([0], np.cumsum(n)))
        rolled = np.zeros(max(0, len(h) - width + 1), np.uint64)
        for k in range(width):
            rolled += h[k : k + len(rolled)] * _PLACE[k]
        rolled = mix(rolled)
        for i in range(stop - begin):
            a, b = at[i], at[i + 1]
            if b - a >= width:
                found = np.sort(rolled[a : b - width + 1])
                yield found[np.concatenate(([True], found[1:] != found[:-1]))]
            elif b > a:
                yield mix((h[a:b] * _PLACE[: b - a]).sum(dtype=np.uint64, keepdims=True) + np.uint64(b - a))
            else:
                yield np.empty(0, np.uint64)
