"""Periodic runs of words: squares caught by catchers over dyadic blocks while words are appended, merged into runs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_and_text, pieces

#: A run has at least so many words, and at least twice its period.
LEAST = 12
#: Words appended at once.
CHUNK = 1 << 16
#: Bytes of text that are split into words at once.
SLICE = 1 << 20
NONE = np.zeros(0, np.int64)


def mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    h = (a * np.uint64(0x9E3779B97F4A7C15)) ^ (b + np.uint64(0x7F4A7C159E3779B9))
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


class Catchers:
    """Finds all runs of a sequence of word numbers that is appended in parts of any size.

    A completed block of 2 ** k words at a multiple of its size L is a catcher: it watches for its words to come again 2 L - 1 to 4 L - 2
    places on (1 to 6 for the blocks of two). A stretch in which words equal those ``q`` before is at least max(12 - q, q) long in a run, so it
    holds a whole block of the size that watches for ``q``: no run is missed. So a word that is appended completes a window of every size, and
    each window meets two or three catchers. Windows are compared by hashes; what they catch is compared word by word, to both sides, as far as
    the words so far go. Stretches that reach the last word stay open and go on with the next one. Once a stretch is two periods long, it is a
    square, and all squares of one stretch are one run. ``longest``, the length of the longest text appended, leaves out larger blocks.
    """

    def __init__(self, longest: int | None = None):
        self.longest, self.n = longest, 0
        self.ids, self.cover, self.period = np.zeros(1024, np.int64), np.zeros(1024, np.int64), np.ones(1024, np.int64)
        self.tails: list[tuple[int, np.ndarray]] = [(0, np.zeros(0, np.uint64))]  # for each size the first place and the hashes from it on
        self.open: dict[tuple[int, int], int] = {}  # (start, period) -> end of the stretches that reach the last word
        self.found: dict[tuple[int, int], int] = {}  # (start, end) -> least period

    def append(self, ids: np.ndarray) -> None:
        if not len(ids):
            return
        old, self.n = self.n, self.n + len(ids)
        if self.n > len(self.ids):
            self.ids, self.cover, self.period = (np.concatenate([x, np.zeros(max(len(x), self.n - len(x)), np.int64)]) for x in (self.ids, self.cover, self.period))
        self.ids[old : self.n], self.period[old : self.n] = ids, 1
        waiting, self.open = self.open, {}
        for (s, q), e in waiting.items():
            self.note(s, self.reach(e - q, q) + q, q)
        self.tails[0] = (base := max(0, old - 8), np.concatenate([self.tails[0][1][base - self.tails[0][0] :], mixed(ids.astype(np.uint64), np.ones(len(ids), np.uint64))]))
        size, level = 2, 1
        while size <= self.n and (self.longest is None or size == 2 or 2 * size - 1 <= self.longest // 2):
            self.advance(size, level, old)
            size, level = 2 * size, level + 1

    def advance(self, size: int, level: int, old: int) -> None:
        """Complete the windows of ``size`` words that end in the words appended, and compare them with the catchers that watch them."""
        if level == len(self.tails):
            self.tails.append((0, np.zeros(0, np.uint64)))
        below, lower = self.tails[level - 1]
        base, mine = self.tails[level]
        x = np.arange(max(0, old - size + 1), self.n - size + 1)
        a = lower[x[0] - below : x[-1] + 1 - below]
        b = lower[x[0] + size // 2 - below : x[-1] + 1 + size // 2 - below]
        mine = np.concatenate([mine, mixed(a, b)])
        least, watchers = (1, 3) if size == 2 else (2 * size - 1, 2)
        at, hits = (x - least) // size * size, []
        for k in range(watchers):
            i = at - k * size
            some = i >= 0
            i, to = i[some], x[some]
            same = mine[i - base] == mine[to - base]
            hits.append((i[same], to[same] - i[same]))
        keep = max(0, old - 5 * size - 8)  # the next size reads back from the first word of this part
        self.tails[level] = (keep, mine[keep - base :]) if keep > base else (base, mine)
        self.catch(size, *map(np.concatenate, zip(*hits)))

    def catch(self, size: int, i: np.ndarray, q: np.ndarray) -> None:
        """Follow the catches: the block at ``i`` came again ``q`` places on. Those inside a run whose period divides ``q`` say nothing new."""
        new = ~((self.cover[i] >= i + q + size) & (q % self.period[i] == 0))
        i, q = i[new], q[new]
        order = np.lexsort((i, q))
        i, q = i[order], q[order]
        first = np.ones(len(i), bool)
        first[1:] = (q[1:] != q[:-1]) | (i[1:] != i[:-1] + size)  # neighbouring blocks that come again at one distance are one stretch
        last = (0, 0, 0)
        for at, p in zip(i[first].tolist(), q[first].tolist()):
            if last[2] == p and last[0] <= at and at + p + size <= last[1]:
                continue
            end = self.reach(at, p)
            if end - at >= size:  # the hashes didn't lie
                last = (self.back(at, p), end + p, p)
                self.note(*last)

    def reach(self, at: int, q: int) -> int:
        """The first place from ``at`` on whose word isn't that ``q`` places on, or has none there."""
        step = 16
        while at + q < self.n:
            m = min(step, self.n - at - q)
            same = self.ids[at : at + m] == self.ids[at + q : at + q + m]
            if not same.all():
                return at + int(same.argmin())
            at, step = at + m, 4 * step
        return at

    def back(self, at: int, q: int) -> int:
        """The least place down from ``at`` such that all words from it to ``at`` are those ``q`` places on."""
        step = 16
        while at > 0:
            m = min(step, at)
            same = (self.ids[at - m : at] == self.ids[at - m + q : at + q])[::-1]
            if not same.all():
                return at - int(same.argmin())
            at, step = at - m, 4 * step
        return at

    def note(self, s: int, e: int, q: int) -> None:
        if e == self.n:
            self.open[s, q] = e
        if e - s >= max(LEAST, 2 * q):
            if e < self.n:
                self.found[s, e] = min(q, self.found.get((s, e), q))
            wider = np.flatnonzero(self.cover[s:e] < e) + s
            self.cover[wider], self.period[wider] = e, q

    def runs(self) -> list[tuple[int, int, int]]:
        """(start, length, period) of all runs so far, by start, then period."""
        found = dict(self.found)
        for (s, q), e in self.open.items():
            if e - s >= max(LEAST, 2 * q):
                found[s, e] = min(q, found.get((s, e), q))
        return sorted(((s, e - s, q) for (s, e), q in found.items()), key=lambda r: (r[0], r[2]))


def word_ids(raw: bytes, names: dict[bytes, int]) -> np.ndarray:
    """Numbers of a text's words; new words get the next ones."""
    out, at = [], 0
    while at < len(raw):
        end = min(len(raw), at + SLICE)
        while end < len(raw) and not raw[end - 1 : end].isspace():
            end += 1
        words = raw[at:end].split()
        out.append(np.fromiter((names.setdefault(w, len(names)) for w in words), np.int64, len(words)))
        at = end
    return np.concatenate(out) if out else NONE


def runs_of_texts(texts: list[bytes]) -> list[tuple[list[tuple[int, int, int]], bytes]]:
    """For each text its runs and its words without the later periods, joined by a space.

    The texts are appended to one set of catchers, parted by numbers that no word has, so that short texts share the array operations.
    """
    names: dict[bytes, int] = {}
    ids = [word_ids(t, names) for t in texts]
    longest = max(map(len, ids), default=0)
    found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    if longest >= LEAST:
        line = np.concatenate([x for k, part in enumerate(ids) for x in (part, [-1 - k])])
        starts = np.cumsum([0, *(len(x) + 1 for x in ids)])
        catchers = Catchers(longest)
        for at in range(0, len(line), CHUNK):
            catchers.append(line[at : at + CHUNK])
        for s, n, q in catchers.runs():
            k = int(np.searchsorted(starts, s, "right")) - 1
            found[k].append((s - int(starts[k]), n, q))
    vocabulary, out = list(names), []
    for part, runs in zip(ids, found):
        stays = np.ones(len(part), bool)
        for s, n, q in runs:
            stays[s + q : s + n] = False
        out.append((runs, b" ".join([vocabulary[i] for i in part[stays].tolist()])))
    return out


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", together: int = 1 << 18) -> DataFrame:
    """doc_id, n_words, runs (array of start, length, period), collapsed: the runs of words of each text, and its words without those after a run's first period.

    Words are what ASCII white space leaves, numbered from 0. A run is a stretch of at least 12 words, and two periods, with a smallest period that
    no neighbouring word keeps on. Null texts count as empty, without words or runs; repeated rows and ids are rows like any other; an empty table gives
    no rows; other columns are not read. Texts are read whole, however long: a task holds one long text's word numbers, or
    ``together`` bytes of short ones.
    """
    rows = id_and_text(docs, id_col, text_col).select("doc_id", F.col("text").cast("binary").alias("text"))
    run_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            size = [len(x.as_buffer()) for x in b.column(1)]
            group, held = [], 0
            for at in [*np.argsort(size, kind="stable").tolist(), None]:
                if at is None or group and held + size[at] > together:
                    if group:
                        yield answer(b.take(pa.array(group)))
                    group, held = [], 0
                if at is not None:
                    group.append(at)
                    held += size[at]

    def answer(b: pa.RecordBatch) -> pa.RecordBatch:
        texts = b.column(1).to_pylist()
        got = runs_of_texts(texts)
        runs = pa.array([[dict(zip(("start", "length", "period"), r)) for r in rs] for rs, _ in got], run_type)
        words = pa.array([len(t.split()) for t in texts], pa.int64())
        return pa.RecordBatch.from_arrays([b.column(0), words, runs, pa.array([c for _, c in got], pa.binary()).cast(pa.string())], ["doc_id", "n_words", "runs", "collapsed"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string")
