"""Binary fuse filters: static sets of 64-bit keys in about nine bits a key, without false negatives (Graf and Lemire, 2022)."""

from __future__ import annotations

from dataclasses import dataclass
from math import ceil, floor, log

import numpy as np


@dataclass(frozen=True)
class FuseFilter:
    """Three places in neighbouring segments for each key; their bytes combine to the key's fingerprint. Other keys pass once in 256."""

    seed: int
    segment: int
    segments: int
    prints: bytes

    def places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(3 x keys places, fingerprints)"""
        h = keys.astype(np.uint64) + np.uint64(self.seed)
        for mult in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
            h = (h ^ (h >> np.uint64(33))) * np.uint64(mult)
        h ^= h >> np.uint64(33)
        first = ((h >> np.uint64(32)) * np.uint64(self.segments * self.segment)) >> np.uint64(32)
        mask = np.uint64(self.segment - 1)
        second = (first + np.uint64(self.segment)) ^ ((h >> np.uint64(18)) & mask)
        third = (first + np.uint64(2 * self.segment)) ^ (h & mask)
        return np.stack([first, second, third]).astype(np.int64), ((h ^ (h >> np.uint64(32))) & np.uint64(255)).astype(np.uint8)

    def has(self, keys: np.ndarray) -> np.ndarray:
        """Which keys may be in the set."""
        at, prints = self.places(keys)
        table = np.frombuffer(self.prints, np.uint8)
        return table[at[0]] ^ table[at[1]] ^ table[at[2]] == prints

    @staticmethod
    def build(keys: np.ndarray) -> FuseFilter:
        """The filter of distinct keys. Places that one key alone has are peeled off, round by round; bytes are set in reverse."""
        n = max(2, len(keys))
        segment = 1 << min(18, max(2, floor(log(n) / log(3.33) + 2.25)))
        segments = max(1, ceil(n * max(1.125, 0.875 + 0.25 * log(1e6) / log(n)) / segment) - 2)
        for seed in range(1, 200):
            draft = FuseFilter(seed * 0x9E3779B97F4A7C15 & (1 << 64) - 1, segment, segments, b"")
            at, prints = draft.places(keys)
            size = (segments + 2) * segment
            times, mix = np.bincount(at.ravel(), minlength=size), np.zeros(size, np.int64)
            np.bitwise_xor.at(mix, at.ravel(), np.tile(np.arange(len(keys)), 3))
            peeled, left, front = [], len(keys), np.flatnonzero(times == 1)
            while len(front):
                key, one = np.unique(mix[front], return_index=True)
                peeled.append((key, front[one]))
                left -= len(key)
                touched = at[:, key].ravel()
                np.subtract.at(times, touched, 1)
                np.bitwise_xor.at(mix, touched, np.tile(key, 3))
                front = np.unique(touched)
                front = front[times[front] == 1]
            if not left:
                table = np.zeros(size, np.uint8)
                for key, place in reversed(peeled):
                    a, b, c = at[:, key]
                    table[place] = prints[key] ^ table[a] ^ table[b] ^ table[c]
                return FuseFilter(draft.seed, segment, segments, table.tobytes())
        raise RuntimeError("no seed gives a filter; keys must be distinct")
