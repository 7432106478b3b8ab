"""64-bit hashes of words and word sequences for NumPy kernels."""

from __future__ import annotations

import numpy as np
import xxhash

#: Words that a worker keeps the hashes of.
WORDS = 150_000

_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_MIX1 = np.uint64(0xBF58476D1CE4E5B9)
_MIX2 = np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of the splitmix64 generator; a bijection of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


class _Words(dict):
    def __missing__(self, word: str | bytes) -> int:
        if len(self) >= WORDS:
            self.clear()
        out = self[word] = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass") if isinstance(word, str) else word)
        return out


_words = _Words()


def word_hashes(words: list[str] | list[bytes]) -> np.ndarray:
    return np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))


def sequence_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of ``size`` neighbouring words (none if there are fewer)."""
    n = len(words) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(size):
        out = mix(out + words[k : k + n] + _GOLDEN)
    return out
