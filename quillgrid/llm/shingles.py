"""Word hashes and word windows, shared by the operators that compare texts."""

from __future__ import annotations

import hashlib
import os

import numpy as np
import xxhash

#: Distinct words whose hashes one Python worker keeps; the table starts anew beyond it.
CACHE_WORDS = 400_000


class WordHashes(dict):
    """64-bit hashes of words, computed once each while the table lasts."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        got = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 64:
            self[word] = got
        return got


HASHES = WordHashes()


def word_hashes(words: list[bytes]) -> np.ndarray:
    """64-bit hashes of words, the same in all workers of an application: Spark gives them one PYTHONHASHSEED, which makes
    Python's own hash (SipHash) fixed; where it is unset, xxHash takes its place."""
    if os.environ.get("PYTHONHASHSEED", "random") != "random":
        return np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    return np.fromiter(map(HASHES.__getitem__, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def factors(size: int, seed: int) -> np.ndarray:
    """size odd random multipliers."""
    return np.random.default_rng(seed).integers(0, 2**63, size, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def window_hashes(hashes: np.ndarray, size: int, seed: int = 1) -> np.ndarray:
    """A hash for every window of size consecutive words; empty if there are fewer words."""
    n = len(hashes) - size + 1
    if n < 1:
        return np.empty(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for k, f in enumerate(factors(size, seed)):
        total += hashes[k : k + n] * f
    return mixed(total)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n + 1, np.uint64(base))
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def rolling_hashes(hashes: np.ndarray, size: int, seed: int) -> np.ndarray:
    """A hash for every window, as window_hashes() gives, in time that doesn't depend on the size: differences of a running sum of powers, modulo 2**64."""
    n = len(hashes) - size + 1
    if n < 1:
        return np.empty(0, np.uint64)
    base = int(factors(1, seed)[0])
    sums = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(mixed(hashes ^ np.uint64(seed)) * _powers(base, len(hashes) - 1), out=sums[1:])
    return mixed((sums[size:] - sums[:n]) * _powers(pow(base, -1, 2**64), n - 1))


class Members:
    """Membership in a set of hashes: a table of bits rules most others out before the search."""

    def __init__(self, known: np.ndarray):
        self.known = np.unique(known)
        self.bits = min(26, max(10, len(self.known).bit_length() + 4))
        self.table = np.zeros(1 << self.bits, bool)
        self.table[self._slot(self.known)] = True

    def _slot(self, x: np.ndarray) -> np.ndarray:
        return ((x * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def has(self, x: np.ndarray) -> np.ndarray:
        out = self.table[self._slot(x)]
        may = np.flatnonzero(out)
        if len(may):
            at = np.minimum(np.searchsorted(self.known, x[may]), len(self.known) - 1)
            out[may] = self.known[at] == x[may]
        return out


def shingle_set(text: str | None, size: int = 5) -> np.ndarray:
    """Sorted distinct hashes of a text's windows of size words, A-Z in lower case; with fewer words, of the whole sequence; without any, empty."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    hashes = word_hashes(words)
    if len(words) < size:
        return window_hashes(hashes, len(words), seed=1000 + len(words))
    return np.unique(window_hashes(hashes, size))


def set_digest(shingles: np.ndarray) -> bytes:
    """128 bits that stand for a set of shingles."""
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def similar(a: np.ndarray, b: np.ndarray, percent: int = 75) -> bool:
    """Whether 100 * intersection size >= percent * union size, both sets sorted and distinct."""
    if len(a) == 0 or len(b) == 0 or 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = len(a) + len(b) - len(np.union1d(a, b))
    return 100 * both >= percent * (len(a) + len(b) - both)
