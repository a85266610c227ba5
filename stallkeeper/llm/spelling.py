"""Spelling variants: words one edit apart, found by search schemes over FM-indexes of the delimited vocabulary in both directions."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import pieces, staged

#: A run of a-z and U+00C0..U+00FF in UTF-8 whose A-Z are lower-cased.
RUN = re.compile(rb"(?:[a-z]|\xc3[\x80-\xbf])+")
#: Texts of more bytes are read run by run, not as a list.
LONG = 1 << 22
#: A form has at least so many times the occurrences of its word, so forms end after log5(2 ** 63) < 28 steps.
FORM_TIMES = 5


def runs_of(raw: bytes) -> Iterable[bytes]:
    text = raw.lower()
    return RUN.findall(text) if len(text) <= LONG else (m.group() for m in RUN.finditer(text))


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 6, misspelt: int = 199, most: int = 300_000) -> DataFrame:
    """(word, n): occurrences of the words of ``least`` code points or more in all texts.

    Words are runs of A-Z, a-z and U+00C0..U+00FF, A-Z lower-cased. Where ``misspelt`` divides the crc32 h of ``<id>:<run>``, the run's code
    point h % length is left out. A null text has no words, a null id counts as the empty string. A task keeps up to ``most`` counts, which
    it then sends; every occurrence counts.
    """
    rows = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary"), F.coalesce(F.col(text_col), F.lit("")).cast("binary"))

    def sent(counts: Counter) -> pa.RecordBatch:
        kept = [(t, n) for t, n in ((w.decode(), n) for w, n in counts.items()) if len(t) >= least]
        return pa.RecordBatch.from_arrays([pa.array([t for t, _ in kept], pa.string()), pa.array([n for _, n in kept], pa.int64())], ["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for b in pieces(batches):
            for key, raw in zip(b.column(0), b.column(1)):
                start = zlib.crc32(key.as_py() + b":")
                for w, n in Counter(runs_of(raw.as_py())).items():
                    if len(w) < least:
                        continue
                    h = zlib.crc32(w, start)
                    if h % misspelt == 0:
                        t = w.decode()
                        at = h % len(t)
                        w = (t[:at] + t[at + 1 :]).encode()
                    counts[w] += n
                if len(counts) > most:
                    yield sent(counts)
                    counts = Counter()
        yield sent(counts)

    return rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def rotations(text: np.ndarray) -> np.ndarray:
    """Places of a cyclic text's rotations in sorted order, by prefix doubling."""
    rank, step = np.unique(text, return_inverse=True)[1].astype(np.int64), 1
    while True:
        order, rank = np.unique(rank * len(text) + np.roll(rank, -step), return_inverse=True)
        if len(order) == len(text) or step >= len(text):
            return np.argsort(rank, kind="stable")
        step *= 2


class FmIndex:
    """FM-index of distinct words, each after a delimiter. A search reads from a word's end to its start, a symbol a step, and narrows an
    interval of suffix ranks; for the other direction index the reversed words."""

    def __init__(self, words: list[np.ndarray]):
        size = np.array([len(w) + 1 for w in words])
        points = np.concatenate([np.concatenate(([0], w)) for w in words])
        self.symbols, text = np.unique(points, return_inverse=True)  # the delimiter is symbol 0
        places = rotations(text)
        self.owner = np.repeat(np.arange(len(words)), size)[places]
        self.bwt = text[places - 1]
        order = np.argsort(self.bwt, kind="stable")
        self.width = len(text) + 1
        self.keys = self.bwt[order] * self.width + order  # of symbol c before place i: as many as keys are less than c * width + i

    def step(self, symbol: np.ndarray | int, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of the suffixes that begin with the symbol and go on with those of [lo, hi)."""
        return np.searchsorted(self.keys, symbol * self.width + lo), np.searchsorted(self.keys, symbol * self.width + hi)

    def symbols_before(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(interval number, symbol): the symbols but the delimiter that may stand before each interval's suffixes; of large intervals all there are."""
        every, size = np.arange(1, len(self.symbols)), hi - lo
        large, small = np.flatnonzero(size > len(every)), np.flatnonzero(size <= len(every))
        n = size[small]
        at = np.repeat(lo[small] - np.cumsum(n) + n, n) + np.arange(n.sum())
        pairs = np.unique(np.repeat(small, n) * len(self.symbols) + self.bwt[at])
        of, symbol = pairs // len(self.symbols), pairs % len(self.symbols)
        return np.concatenate([of[symbol > 0], np.repeat(large, len(every))]), np.concatenate([symbol[symbol > 0], np.tile(every, len(large))])

    def one_error(self, queries: list[np.ndarray], exact: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, word) numbers of words that differ from a query by one edit after its first ``exact`` symbols.

        Queries are read in search order. A state is an interval, a place in its query and whether the edit is behind it.
        """
        size = np.array([len(x) for x in queries])
        start, flat = np.cumsum(size) - size, np.concatenate([*queries, [0]])
        code = np.minimum(np.searchsorted(self.symbols, flat), len(self.symbols) - 1)
        code = np.where(self.symbols[code] == flat, code, -1)
        q = np.arange(len(queries))
        lo, hi = self.step(0, np.zeros(len(q), np.int64), np.full(len(q), self.width - 1))
        pos, err = np.zeros(len(q), np.int64), np.zeros(len(q), bool)
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        while len(q):
            end = pos == size[q]
            c = np.where(end, -1, code[np.minimum(start[q] + pos, len(code) - 1)])
            done = np.flatnonzero(end & err)  # the delimiter before the word makes it whole
            a, b = self.step(0, lo[done], hi[done])
            found.append((q[done][b > a], self.owner[a[b > a]]))
            on = np.flatnonzero(c > 0)
            a, b = self.step(c[on], lo[on], hi[on])
            nxt = [(q[on], pos[on] + 1, a, b, err[on])]
            edit = np.flatnonzero(~err & (pos >= exact[q]))
            left_out = edit[~end[edit]]
            nxt.append((q[left_out], pos[left_out] + 1, lo[left_out], hi[left_out], np.ones(len(left_out), bool)))
            of, symbol = self.symbols_before(lo[edit], hi[edit])
            of = edit[of]
            a, b = self.step(symbol, lo[of], hi[of])
            of, symbol, a, b = (x[b > a] for x in (of, symbol, a, b))
            nxt.append((q[of], pos[of], a, b, np.ones(len(of), bool)))  # put in
            other = (symbol != c[of]) & ~end[of]
            nxt.append((q[of][other], pos[of][other] + 1, a[other], b[other], np.ones(other.sum(), bool)))  # replaced
            q, pos, lo, hi, err = (np.concatenate(x) for x in zip(*nxt))
            live = hi > lo
            q, pos, lo, hi, err = (x[live] for x in (q, pos, lo, hi, err))
        return tuple(np.concatenate(x) for x in zip(*found))


def half(word: Column, side: str, n: Column) -> Column:
    """The first or the last ``n`` characters of a word."""
    return F.substring(word, F.lit(1), n) if side == "first" else F.right(word, n)


def near_words(words: DataFrame, per_shard: int = 4096, together: int = 2048) -> DataFrame:
    """(word, near, near_n): every ordered pair of ``words`` (distinct word, n) that differ by one code point put in, left out or replaced.

    Of a word's two halves one is untouched by the edit. So a word is looked for in the shards of its first and its last half, and a word is
    indexed under the first and last characters of the lengths that the halves of near words can have: two of either. A half that more than
    ``per_shard`` words have is split into parts, each looked at by all its queries; no more than rows / ``per_shard`` halves are. A shard's
    index reads first halves from the start on and last ones from the end on, exactly, and the rest with one error.
    """
    m = F.length("word")
    keys = lambda side, ns: [F.struct(F.lit(side).alias("side"), half(F.col("word"), side, n.cast("int")).alias("half")) for n in ns]
    own = [*keys("first", [F.floor((m - 1) / 2), F.floor((m + 1) / 2)]), *keys("last", [F.floor(m / 2), F.floor(m / 2) + 1])]
    asked = [*keys("first", [F.floor(m / 2)]), *keys("last", [m - F.floor(m / 2)])]
    index = words.select("word", "n", F.explode(F.array(*own)).alias("k")).select("word", "n", "k.*")
    counts = index.groupBy("side", "half").agg(F.count("*").alias("n"))
    rows = counts.agg(F.sum("n")).first()[0] or 0
    split = F.broadcast(counts.filter(F.col("n") > per_shard).select("side", "half", F.ceil(F.col("n") / per_shard).cast("int").alias("parts")))
    shards = max(1, -(-rows // per_shard))
    shard = F.pmod(F.xxhash64("side", "half", "part"), F.lit(shards)).cast("int") * 2 + (F.col("side") == "last").cast("int")
    index = index.join(split, ["side", "half"], "left").withColumn("part", F.pmod(F.xxhash64("word"), F.coalesce("parts", F.lit(1))).cast("int"))
    queries = words.select("word", F.lit(None).cast("long").alias("n"), F.explode(F.array(*asked)).alias("k")).select("word", "n", "k.*")
    queries = queries.join(split, ["side", "half"], "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)))
    both = index.withColumn("shard", shard).select("shard", "word", "n").unionByName(queries.withColumn("shard", shard).select("shard", "word", "n"))

    def search(key: tuple, group: pa.Table) -> pa.Table:
        last = key[0].as_py() % 2
        text, n = group.column("word").to_pylist(), group.column("n").to_pylist()
        terms = dict(x for x in zip(text, n) if x[1] is not None)
        pairs = [[], [], []]
        names, looked = list(terms), sorted({t for t, k in zip(text, n) if k is None}, key=len)
        if names:
            points = lambda t: np.frombuffer(t.encode("utf-32-le"), "<u4").astype(np.int64)
            order = (lambda t: t[::-1]) if last else (lambda t: t)
            fm = FmIndex([points(order(t[::-1])) for t in names])
            for at in range(0, len(looked), together):
                some = looked[at : at + together]
                exact = np.array([len(t) - len(t) // 2 if last else len(t) // 2 for t in some])
                a, b = fm.one_error([points(order(t)) for t in some], exact)
                hit = sorted(set(zip(a.tolist(), b.tolist())))
                pairs[0] += [some[x] for x, _ in hit]
                pairs[1] += [names[y] for _, y in hit]
                pairs[2] += [terms[names[y]] for _, y in hit]
        return pa.table([pa.array(pairs[0], pa.string()), pa.array(pairs[1], pa.string()), pa.array(pairs[2], pa.int64())], ["word", "near", "near_n"])

    return both.groupBy("shard").applyInArrow(search, "word string, near string, near_n long").distinct()


def spelling_forms(words: DataFrame, times: int = FORM_TIMES) -> DataFrame:
    """word, form, root, n, n_near, form_n of every one of ``words`` (distinct word, n).

    A word's form is its near word of the largest n (ties: the least), if that n is at least ``times`` the word's; its root is the last of its forms' forms.
    An empty table gives no rows.
    """
    words = staged(words, "words")
    near = near_words(words).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("form"))).alias("best"))
    known = words.join(near, "word", "left").withColumn("enough", -F.col("best.less") >= times * F.col("n"))
    known = staged(known.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(F.col("enough"), F.col("best.form")).alias("form"),
                                F.when(F.col("enough"), -F.col("best.less")).alias("form_n")), "forms")
    steps = known.filter("form is not null").select("word", F.col("form").alias("root"))
    for _ in range(5):  # after k rounds a root is 2 ** k forms away, or the last
        on = steps.select(F.col("word").alias("root"), F.col("root").alias("next"))
        steps = staged(steps.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "roots")
    return known.join(steps, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
