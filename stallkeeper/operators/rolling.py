"""Many terms looked for in texts at once: hashes of all byte windows against those that the terms are found by."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Window sizes in bytes. A term is found by a window of the largest size that fits into it.
SIZES = (16, 8, 4, 2, 1)
#: Bytes of text whose windows are hashed at once.
SPAN = 1 << 19
#: Bytes of terms that are compared at once, a longer term apart.
COMPARED = 1 << 20


def windows(data: np.ndarray, size: int) -> np.ndarray:
    """A number for each window of ``size`` bytes; up to eight bytes it is the window itself, beyond a hash."""
    eight = min(size, 8)
    if len(data) < size:
        return np.zeros(0, np.uint64)
    whole = np.ndarray((len(data) - eight + 1,), f"<u{eight}", data, strides=(1,)).astype(np.uint64)
    return whole if size <= 8 else (whole[:-8] * np.uint64(0x9E3779B97F4A7C15)) ^ (whole[8:] * np.uint64(0xC2B2AE3D27D4EB4F))


class Window:
    """Terms of one window size by the numbers of the windows they are found by, and a table of bits that few other windows pass."""

    def __init__(self, size: int, terms: list[bytes], numbers: np.ndarray):
        self.size, line = size, np.frombuffer(b"".join(terms), np.uint8)
        length = np.array([len(t) for t in terms])
        end = np.cumsum(length)
        owner = np.repeat(np.arange(len(terms)), length)
        place = np.arange(len(line)) - (end - length)[owner]
        inside = np.flatnonzero(place <= (length - size)[owner])
        key = windows(line, size)[inside]
        _, kind, times = np.unique(key, return_inverse=True, return_counts=True)
        order = np.lexsort((place[inside], times[kind], owner[inside]))  # of each term the window that the fewest windows equal
        chosen = order[np.unique(owner[inside][order], return_index=True)[1]]
        chosen = chosen[np.argsort(key[chosen], kind="stable")]
        self.keys, self.place, self.term = key[chosen], place[inside][chosen], numbers[owner[inside][chosen]]
        self.bits = np.uint64(64 - min(24, max(16, int(16 * len(terms)).bit_length())))
        self.table = np.zeros(1 << (64 - int(self.bits)), bool)
        self.table[self.slot(self.keys)] = True

    def slot(self, key: np.ndarray) -> np.ndarray:
        return (key * np.uint64(0x9E3779B97F4A7C15)) >> self.bits

    def hits(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start, term): where terms may begin, and which."""
        key = windows(data, self.size)
        at = np.flatnonzero(self.table[self.slot(key)])
        lo, hi = np.searchsorted(self.keys, key[at], "left"), np.searchsorted(self.keys, key[at], "right")
        n = hi - lo
        found = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())
        return np.repeat(at, n) - self.place[found], self.term[found]


class TermScan:
    """The first of a list of terms that each text contains. Every hit is compared byte by byte at its place."""

    def __init__(self, terms: list[str]):
        self.terms = [t.encode() for t in terms]
        self.length = np.array([len(t) for t in self.terms], np.int64)
        self.line, self.begin = np.frombuffer(b"".join(self.terms), np.uint8), np.cumsum(self.length) - self.length
        fits = np.array([next((s for s in SIZES if s <= n), 0) for n in self.length.tolist()])
        self.windows = [Window(s, [self.terms[i] for i in np.flatnonzero(fits == s)], np.flatnonzero(fits == s)) for s in SIZES if (fits == s).any()]

    def equal(self, data: np.ndarray, start: np.ndarray, term: np.ndarray) -> np.ndarray:
        """Which of the terms lie at their starts, byte by byte."""
        n = self.length[term]
        end = np.cumsum(n)
        inside = np.arange(end[-1])
        same = data[inside + np.repeat(start - end + n, n)] == self.line[inside + np.repeat(self.begin[term] - end + n, n)]
        return np.logical_and.reduceat(same, end - n)

    def first(self, texts: pa.Array) -> np.ndarray:
        """For each text the number of its first term, -1 without one or for a null text."""
        wide = np.int64 if pa.types.is_large_string(texts.type) else np.int32
        best = np.full(len(texts), len(self.terms), np.int64)
        _, offsets, buffer = texts.buffers()
        if buffer is None or not len(texts):
            return np.full(len(texts), -1, np.int64)
        edges = np.frombuffer(offsets, wide)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        data = np.frombuffer(buffer, np.uint8)
        for w in self.windows:
            for at in range(int(edges[0]), int(edges[-1]), SPAN):
                start, term = w.hits(data[at : min(int(edges[-1]), at + SPAN + w.size - 1)])
                start = start + at
                row = np.searchsorted(edges, start, "right") - 1
                some = (row >= 0) & (start + self.length[term] <= edges[np.clip(row + 1, 0, len(texts))])
                some[some] = term[some] < best[row[some]]
                left = np.flatnonzero(some)
                if self.length[term[left]].sum() > COMPARED:
                    left = left[np.argsort(term[left], kind="stable")]  # first terms first, so that later ones need no comparison
                while len(left):
                    many = max(1, int(np.searchsorted(np.cumsum(self.length[term[left]]), COMPARED, "right")))
                    now, left = left[:many], left[many:]
                    now = now[self.equal(data, start[now], term[now])]
                    np.minimum.at(best, row[now], term[now])
                    left = left[term[left] < best[row[left]]]
        return np.where(best < len(self.terms), best, -1)
