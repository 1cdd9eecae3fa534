"""Word and n-gram hashes of whole texts, by array operations over their bytes."""

from __future__ import annotations

import numpy as np
import xxhash

BLOCK = 1 << 19
SPACES = b" \t\n\x0b\x0c\r"
_IS_WORD = np.array([c not in SPACES for c in range(256)])


def _odd(name: str, n: int) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(f"{name} {i}") | 1 for i in range(n)], np.uint64)


_BYTE, _PLACE = _odd("byte", 256), _odd("place", 16)
_BASE = int(_odd("base", 1)[0])


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class _Powers:
    """Powers of the base and of its inverse modulo 2^64, as many as were asked for."""

    n = 0

    @classmethod
    def get(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > cls.n:
            cls.n = 2 * n
            cls.up, cls.down = _powers(_BASE, cls.n), _powers(pow(_BASE, -1, 1 << 64), cls.n)
        return cls.up[:n], cls.down[:n]


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(27))


def word_hashes(data: bytes) -> np.ndarray:
    """A 64-bit hash of every run of bytes that aren't ASCII white space: a polynomial over random values of the bytes.

    Long texts are taken in blocks that end between words.
    """
    if len(data) > 2 * BLOCK:
        parts, at = [], 0
        while at < len(data):
            end = next((i for i in range(min(at + BLOCK, len(data)), len(data)) if data[i] in SPACES), len(data))
            parts.append(word_hashes_of_block(data[at:end]))
            at = end
        return np.concatenate(parts)
    return word_hashes_of_block(data)


def word_hashes_of_block(data: bytes) -> np.ndarray:
    if not data:
        return np.empty(0, np.uint64)
    b = np.frombuffer(data, np.uint8)
    inside = np.zeros(len(b) + 2, np.int8)
    inside[1:-1] = _IS_WORD[b]
    edges = np.flatnonzero(np.diff(inside))
    start, end = edges[::2], edges[1::2]
    up, down = _Powers.get(len(b))
    total = np.zeros(len(b) + 1, np.uint64)
    np.cumsum(_BYTE[b] * up, out=total[1:])
    return _mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64) * _PLACE[15])


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """The hash of every n consecutive words."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.empty(0, np.uint64)
    out = hashes[:m] * _PLACE[0]
    for i in range(1, n):
        out += hashes[i : i + m] * _PLACE[i]
    return _mix(out)
