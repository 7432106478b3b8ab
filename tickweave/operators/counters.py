"""Random numbers as a function of seed, series, tick and use, for arrays of (series x particles).

No generator has a state, so numbers don't depend on which series are stepped
together, on partitions or on retries.
"""

from __future__ import annotations

import hashlib

import numpy as np

_STEP, _A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
#: Numbers that a tick may ask for: uses of one array each.
USES = 64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that scatters neighbours."""
    x = (x ^ (x >> np.uint64(30))) * _A
    x = (x ^ (x >> np.uint64(27))) * _B
    return x ^ (x >> np.uint64(31))


def stream_of(seed: int, key) -> int:
    """64 bits for a series; equal keys have equal streams."""
    return int.from_bytes(hashlib.blake2b(repr((seed, key)).encode(), digest_size=8).digest(), "little")


class Draws:
    """Draws of one tick: ``streams`` (series) and ``ticks`` (series) name them; every use has its own number."""

    def __init__(self, streams: np.ndarray, ticks: np.ndarray, n: int):
        self.base = mix(streams + _STEP * (ticks.astype(np.uint64) * np.uint64(USES)))
        self.steps = _STEP * np.arange(1, n + 1, dtype=np.uint64)

    def _start(self, use: int, rows) -> np.ndarray:
        return mix(self.base[rows] + np.uint64((use + 1) * int(_B) % (1 << 64)))

    def bits(self, use: int, rows=slice(None)) -> np.ndarray:
        return mix(self._start(use, rows)[:, None] + self.steps)

    def uniform(self, use: int, rows=slice(None)) -> np.ndarray:
        """In (0, 1)."""
        return ((self.bits(use, rows) >> np.uint64(40)).astype(np.float32) + np.float32(0.5)) * np.float32(2.0**-24)

    def one(self, use: int, rows=slice(None)) -> np.ndarray:
        """One uniform number for each series."""
        return ((self._start(use, rows) >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53

    def normal(self, use: int, rows=slice(None)) -> np.ndarray:
        """Standard normal numbers, by the polar form of two uniform ones."""
        x = self.bits(use, rows)
        u = ((x >> np.uint64(40)).astype(np.float32) + np.float32(0.5)) * np.float32(2.0**-24)
        angle = (x & np.uint64(0xFFFFFF)).astype(np.float32) * np.float32(2 * np.pi * 2.0**-24)
        return np.sqrt(-2 * np.log(u)) * np.cos(angle)

    def gamma(self, shape, use: int, rows=slice(None)) -> np.ndarray:
        """Gamma numbers of shapes of one or more (scale one), by rejection; takes eight uses."""
        size = (len(self.base[rows]), len(self.steps))
        d = np.broadcast_to(np.asarray(shape, np.float32) - np.float32(1 / 3), size)
        c = 1 / np.sqrt(9 * d)
        out, open_ = d.copy(), np.ones(size, bool)
        for attempt in range(4):
            z = self.normal(use + 2 * attempt, rows)
            v = (1 + c * z) ** 3
            ok = open_ & (v > 0)
            ok &= np.log(self.uniform(use + 2 * attempt + 1, rows)) < 0.5 * z * z + d - d * v + d * np.log(np.where(v > 0, v, 1))
            out = np.where(ok, d * v, out)
            open_ &= ~ok
            if not open_.any():
                break
        return out  # one in 160,000 is left at its mode
