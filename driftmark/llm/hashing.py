"""Hashes of all substrings of a buffer by prefix sums.

hash(a, b) = (S[b] - S[a]) / B^a with S the running sum of T[byte] * B^position, all modulo 2^64: B is
odd, so the division is a multiplication by its inverse. Two bases give 128 bits.
"""

from __future__ import annotations

import numpy as np

BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


class Rolling:
    """Powers of one base, kept and extended as buffers ask for more."""

    def __init__(self, base: int, seed: int):
        self.base = base
        self.table = np.random.default_rng(seed).integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
        self.powers = self.inverses = np.ones(1, np.uint64)

    def _extend(self, n: int) -> None:
        if n > len(self.powers):
            inverse = pow(self.base, -1, 1 << 64)
            for name, factor in (("powers", self.base), ("inverses", inverse)):
                steps = np.full(n, np.uint64(factor & (1 << 64) - 1))
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))

    def sums(self, data: np.ndarray) -> np.ndarray:
        self._extend(len(data) + 1)
        out = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.table[data] * self.powers[: len(data)], out=out[1:])
        return out

    def of(self, sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hashes of the substrings [start, end)."""
        return mixed((sums[ends] - sums[starts]) * self.inverses[starts])


def mixed(h: np.ndarray) -> np.ndarray:
    """Every bit of the result depends on every bit of the number."""
    h = h ^ (h >> np.uint64(33))
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h
