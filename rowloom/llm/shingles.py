"""Sets of word shingles as sorted 64-bit hashes, computed in numpy."""

from __future__ import annotations

import hashlib

import numpy as np
import xxhash

CACHE_WORDS = 200_000

# Odd multipliers that mix the hashes of neighbouring words.
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], dtype=np.uint64)


def mixed(h: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit values."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class _Known(dict):
    def __missing__(self, word: bytes) -> int:
        found = self[word] = xxhash.xxh3_64_intdigest(word)
        return found


class Hasher:
    """64-bit hashes of words, remembered for a bounded number of them."""

    def __init__(self):
        self.known = _Known()

    def words(self, words: list[bytes]) -> np.ndarray:
        if len(self.known) > CACHE_WORDS:
            self.known.clear()
        return np.fromiter(map(self.known.__getitem__, words), dtype=np.uint64, count=len(words))


def split_words(text: str, lower: bool = True) -> list[bytes]:
    """Words between space and the control characters from tab to carriage return; only A-Z are lowered."""
    data = text.encode("utf-8", "surrogatepass")
    return (data.lower() if lower else data).split()


def windows(words: np.ndarray, width: int) -> np.ndarray:
    """The hash of every run of ``width`` words, by its start."""
    if len(words) < width:
        return np.zeros(0, dtype=np.uint64)
    return windows_at(words, np.arange(len(words) - width + 1), width)


def windows_at(words: np.ndarray, places: np.ndarray, width: int) -> np.ndarray:
    """The hash of the run of ``width`` words at each of ``places``."""
    out = np.zeros(len(places), dtype=np.uint64)
    for i in range(width):
        out = mixed(out * _MIX[i % 3] + words[places + i])
    return out


def doubled(words: np.ndarray, width: int) -> np.ndarray:
    """The hash of every run of ``width`` words, a power of two, by its start: made of those of half the width."""
    out, size = words, 1
    while size < width:
        if len(out) <= size:
            return out[:0]
        out, size = mixed(out[:-size] * _MIX[0] + out[size:]), size * 2
    return out


def shingle_set(words: np.ndarray, width: int) -> np.ndarray:
    """The distinct shingles, sorted; fewer words than ``width`` are one shingle, no words none."""
    if not len(words):
        return np.zeros(0, dtype=np.uint64)
    if len(words) < width:
        return mixed(windows(words, len(words)) + np.uint64(len(words)))
    return np.unique(windows(words, width))


def digest(values: np.ndarray) -> bytes:
    """128 bits that name a set."""
    return hashlib.blake2b(values.tobytes(), digest_size=16).digest()


def sequence_name(words: np.ndarray) -> int:
    """A signed 64-bit name of a whole sequence of word hashes, in one call whatever its length."""
    return int.from_bytes(xxhash.xxh3_64_digest(words.tobytes()), "big", signed=True)
