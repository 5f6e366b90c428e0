"""Word shingles of a text as 64-bit hashes, and their minhash sketch, in numpy."""

from __future__ import annotations

import hashlib

import numpy as np

WORDS = 5
COORDINATES = 64

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xD6E8FEB86659FD93)
_MULTIPLIERS = (np.random.default_rng(7).integers(0, 1 << 63, COORDINATES, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
_ADDENDS = np.random.default_rng(8).integers(0, 1 << 63, COORDINATES, dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Powers:
    """Powers of the base and of its inverse modulo 2**64, as far as the longest text so far."""

    up = np.ones(1, np.uint64)
    down = np.ones(1, np.uint64)

    @classmethod
    def upto(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        while len(cls.up) < n:
            k = len(cls.up)
            inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
            cls.up = np.concatenate([cls.up, cls.up * (cls.up[-1:] * _BASE)])
            cls.down = np.concatenate([cls.down, cls.down * (cls.down[-1:] * inverse)])
            assert len(cls.up) == 2 * k
        return cls.up[:n], cls.down


def word_hashes(text: str | None) -> np.ndarray:
    """Hashes of the lower-cased words between ASCII white space, in order."""
    data = np.frombuffer((text or "").lower().encode("utf-8", "surrogatepass"), np.uint8)
    if not len(data):
        return np.zeros(0, np.uint64)
    inside = ~_SPACE[data]
    edges = np.flatnonzero(np.diff(inside.view(np.int8), prepend=np.int8(0), append=np.int8(0)))
    starts, ends = edges[::2], edges[1::2]
    up, down = _Powers.upto(len(data))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up)])
    return mix((sums[ends] - sums[starts]) * down[starts] ^ ((ends - starts).astype(np.uint64) * _STEP))


def shingle_set(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted different shingle hashes. A text of fewer words is one shingle; one of none has none."""
    w = word_hashes(text)
    if not len(w):
        return w
    size = min(words, len(w))
    h = w[: len(w) - size + 1].copy()
    for k in range(1, size):
        h = h * _STEP + w[k : len(w) - size + 1 + k]
    return np.unique(mix(h + np.uint64(size)))


def set_key(shingles: np.ndarray) -> bytes:
    """128-bit name of a set."""
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def minhashes(shingles: np.ndarray) -> np.ndarray:
    """The smallest hash of the set under each coordinate's hash function.

    Two sets agree in a share of coordinates that is, on average, their Jaccard similarity.
    """
    low = np.full(COORDINATES, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 1024):
        part = shingles[at : at + 1024, None] * _MULTIPLIERS + _ADDENDS
        low = np.minimum(low, part.min(axis=0))
    return low


def sketch(lows: np.ndarray) -> np.ndarray:
    """16 bits of each minhash."""
    return (lows >> np.uint64(24)).astype(np.uint16)
