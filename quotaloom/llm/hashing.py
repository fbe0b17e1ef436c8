"""64-bit hashes of words and of runs of words, for many texts at once in numpy."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

U = np.uint64
BASE = 0x9E3779B97F4A7C15
#: A-Z in lower case; white space (space, tab to carriage return) as it is.
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
WHITE = np.zeros(256, bool)
WHITE[[32, *range(9, 14)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mixer."""
    x = np.atleast_1d(x)  # arrays wrap around silently
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


VALUES = mix(np.arange(1, 257, dtype=U))


class Powers:
    """Powers of an odd base and of its inverse modulo 2**64, as far as asked for."""

    def __init__(self):
        self.up = self.down = np.ones(1, U)

    def of(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << (n - 1).bit_length()
            for name, base in (("up", BASE), ("down", pow(BASE, -1, 1 << 64))):
                steps = np.full(size, base, U)
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))
        return self.up[:n], self.down[:n]


POWERS = Powers()


def word_hashes(texts: Sequence[str], table: bytes = LOWER, white: np.ndarray = WHITE) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word of all texts in order, index of the first word of each text and the number of words).

    Words are what white space separates, A-Z in lower case.  Keep the texts to a few MB: arrays of 8 bytes a byte.
    """
    parts = [t.encode("utf-8", "surrogatepass").translate(table) for t in texts]
    ends = np.cumsum([len(p) + 1 for p in parts]) if parts else np.zeros(0, np.int64)
    data = np.frombuffer(b" ".join([*parts, b""]), np.uint8)
    inside = ~white[data]
    edge = np.diff(inside.astype(np.int8), prepend=0, append=0)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    up, down = POWERS.of(len(data) + 1)
    total = np.zeros(len(data) + 1, U)
    np.cumsum(VALUES[data] * up[: len(data)], out=total[1:])
    hashes = mix((total[end] - total[start]) * down[start])
    return hashes, np.r_[0, np.searchsorted(start, ends)].astype(np.int64)


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the runs of ``k`` words; of fewer words, the hash of all as one; of none, none."""
    n = len(words)
    if not n:
        return words
    width, h = min(k, n), np.full(n - min(k, n) + 1, U(min(k, n)))
    for j in range(width):
        h = mix(h + words[j : n - width + 1 + j])
    return h
