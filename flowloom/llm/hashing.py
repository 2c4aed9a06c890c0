"""Hashes of byte strings inside a long array, and runs of bytes of one kind, in numpy."""

from __future__ import annotations

import numpy as np

_BASE = 0x9FB21C651E98DF25
TABLE = np.random.default_rng(6).integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_powers: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit integers (the finalizer of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, at least ``n`` of each."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, 5 << 18)
        _powers[:] = [np.cumprod(np.concatenate([[np.uint64(1)], np.full(size, np.uint64(b), np.uint64)])) for b in (_BASE, pow(_BASE, -1, 1 << 64))]
    return _powers[0], _powers[1]


class Hasher:
    """The same polynomial hash for equal strings, wherever they stand in ``data``."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        power, self.inverse = powers(n + 1)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(TABLE[data] * power[:n], out=self.sums[1:])

    def __call__(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return (self.sums[stop] - self.sums[start]) * self.inverse[start]


def hash_of(text: str) -> int:
    """What ``Hasher`` gives for one string."""
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    return int(Hasher(data)(np.array([0]), np.array([len(data)]))[0])


SPACE, LETTER, DIGIT, MARK = range(4)
_KINDS = np.full(256, MARK, np.uint8)
_KINDS[[*range(33), 127]] = SPACE
_KINDS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = LETTER
_KINDS[48:58] = DIGIT


def kinds(data: np.ndarray) -> np.ndarray:
    """Kind of each byte of UTF-8 text; letters outside ASCII are letters, three blocks of punctuation marks."""
    out = _KINDS[data]
    if len(data) > 2:
        lead = np.flatnonzero(data[:-1] == 0xC2)
        lead = lead[data[lead + 1] < 0xC0]  # U+0080 to U+00BF
        out[lead] = out[lead + 1] = MARK
        lead = np.flatnonzero((data[:-2] == 0xE2) | (data[:-2] == 0xE3))
        lead = lead[((data[lead] == 0xE2) & (data[lead + 1] < 0x82)) | ((data[lead] == 0xE3) & (data[lead + 1] == 0x80))]  # U+2000 to U+207F, U+3000 to U+303F
        out[lead] = out[lead + 1] = out[lead + 2] = MARK
    return out


def joined(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of texts with a space behind each, and where each begins (and the last ends)."""
    parts = [t.encode("utf-8", "surrogatepass") for t in texts]
    begin = np.cumsum([0, *(len(p) + 1 for p in parts)])
    return np.frombuffer(b" ".join([*parts, b""]), np.uint8), begin


def runs_of(kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and stop of each longest run of one kind but 0; the last kind is a 0."""
    edge = np.flatnonzero(kind[1:] != kind[:-1]) + 1
    edge = np.concatenate([[0], edge, [len(kind)]])
    own = kind[edge[:-1]] != 0
    return edge[:-1][own], edge[1:][own]
