"""64-bit hashes of words and of runs of words, for whole texts at once."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

BASE = np.uint64(0x9E3779B97F4A7C15)
PIECE = 200_000  # words whose letters are read at once


@lru_cache(maxsize=4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2^64."""
    ups, downs = np.full(n, BASE), np.full(n, np.uint64(pow(int(BASE), -1, 1 << 64)))
    ups[0] = downs[0] = 1
    return np.cumprod(ups), np.cumprod(downs)


def _room(n: int) -> int:
    return 1 << max(12, n.bit_length())


def mixed(x: np.ndarray) -> np.ndarray:
    """Every bit depends on every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def run_hashes(values: np.ndarray, first: np.ndarray, past: np.ndarray) -> np.ndarray:
    """A hash of each run ``values[first:past]``, which depends on its values in order alone."""
    ups, downs = _powers(_room(len(values) + 1))
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * ups[: len(values)], out=sums[1:])
    return mixed((sums[past] - sums[first]) * downs[first] + (past - first).astype(np.uint64))


def word_hashes(words: list[bytes]) -> np.ndarray:
    """A hash of each word."""
    parts = []
    for i in range(0, len(words), PIECE):
        some = words[i : i + PIECE]
        past = np.cumsum(np.fromiter(map(len, some), np.int64, len(some)))
        letters = np.frombuffer(b"".join(some), np.uint8).astype(np.uint64) + np.uint64(1)
        parts.append(run_hashes(letters, np.concatenate([[0], past[:-1]]), past))
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64)


def window_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of ``size`` words."""
    first = np.arange(max(0, len(hashes) - size + 1))
    return run_hashes(hashes, first, first + size)
