"""Supervised subword embeddings: averaged word and character n-gram vectors with a softmax."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import pieces

#: Character n-gram lengths of a word written between < and >.
GRAMS = (3, 4, 5)
#: Characters of a part whose row is kept.
PART = 60
#: The bucket of a part of a text that follows itself.
SAME = 0


def mixed(h: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets 1..buckets-1 of 64-bit hashes."""
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return ((h >> np.uint64(32)) % np.uint64(buckets - 1)).astype(np.int64) + 1


def word_features(words: list[str], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, place of its word) of all features: each word itself and its character n-grams."""
    marked = [f"<{w}>" for w in words]
    points = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64) + np.uint64(1)
    size = np.fromiter(map(len, marked), np.int64, len(marked))
    end = np.cumsum(size)
    start, owner = end - size, np.repeat(np.arange(len(words)), size)
    room = end[owner] - np.arange(len(points))  # characters to the word's end
    prime = np.uint64(0x9E3779B97F4A7C15)
    power = np.cumprod(np.full(int(size.max(initial=1)), prime))
    found, of = [mixed(np.add.reduceat(points * power[np.arange(len(points)) - start[owner]], start), buckets)], [np.arange(len(words))]
    h = np.zeros(len(points), np.uint64)
    for n in range(1, max(GRAMS) + 1):
        h = (h[: len(points) - n + 1] + points[n - 1 :]) * prime
        if n in GRAMS:
            at = np.flatnonzero(room[: len(h)] >= n)
            found.append(mixed(h[at] + np.uint64(n), buckets))
            of.append(owner[at])
    return np.concatenate(found), np.concatenate(of)


@dataclass
class SubwordModel:
    """``table``: for each class, every bucket's embedding times the output weights; a document's scores are averages of these.

    Texts are read in parts, which single spaces separate; a part is one word, or a few where there is other white space in it.
    A task keeps the rows of the parts of up to ``PART`` characters it met, ``words`` of them at most (with their keys under 100 MB); the first met, which are
    the frequent ones, stay. Longer parts, such as texts without spaces, are read anew each time.
    """

    classes: list
    table: np.ndarray
    bias: np.ndarray
    words: int = 200_000
    known: dict = field(default_factory=dict)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"known": {}}

    def rows_of(self, parts: list[str], count: Callable[[list[str]], np.ndarray] | None) -> tuple[np.ndarray, np.ndarray]:
        """For each part: sums of its features for each class, numbers of features and of words; and ``count`` of it, exactly."""
        split = [p.split() for p in parts]
        words = [w for ws in split for w in ws]
        owner = np.repeat(np.arange(len(parts)), [len(ws) for ws in split])
        found, of = word_features(words, self.table.shape[1])
        of = owner[of]
        sums = [np.bincount(of, row[found], len(parts)) for row in self.table] + [np.bincount(x, minlength=len(parts)) for x in (of, owner)]
        return np.stack(sums, axis=1).astype(np.float32), np.asarray(count(parts), np.int64) if count else np.zeros(len(parts), np.int64)

    def learnt(self, parts: list[str], count: Callable[[list[str]], np.ndarray] | None) -> tuple[np.ndarray, np.ndarray]:
        """``rows_of`` of distinct parts; only those not met before are read."""
        width, counted = len(self.classes) + 2, count is not None
        ids, rows, counts = self.known.pop(counted, None) or ({}, np.zeros((0, width), np.float32), np.zeros(0, np.int64))
        at = np.array([ids.get(p, -1) for p in parts], np.int64)
        out, told, old = np.empty((len(parts), width), np.float32), np.empty(len(parts), np.int64), at >= 0
        out[old], told[old] = rows[at[old]], counts[at[old]]
        new = [parts[i] for i in np.flatnonzero(~old)]
        if new:
            out[~old], told[~old] = fresh, more = self.rows_of(new, count)
            short = np.fromiter((len(p) <= PART for p in new), bool, len(new))
            if not short.all():
                new, fresh, more = [p for p, s in zip(new, short) if s], fresh[short], more[short]
            if len(ids) + len(new) > self.words:
                ids, rows, counts = dict(islice(ids.items(), self.words // 2)), rows[: self.words // 2], counts[: self.words // 2]
            if len(ids) + len(new) <= self.words:
                ids.update(zip(new, range(len(ids), len(ids) + len(new))))
                rows, counts = np.concatenate([rows, fresh]), np.concatenate([counts, more])
        self.known = {counted: (ids, rows, counts)}
        return out, told

    def read(self, texts: pa.Array, count: Callable[[list[str]], np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray | None]:
        """(class probabilities of each text, sums of ``count`` over its parts); a text without words has the probabilities of the bias alone."""
        lists = pc.split_pattern(texts, " ")
        coded = lists.flatten().dictionary_encode()
        codes, size = coded.indices.to_numpy(), pc.list_value_length(lists).to_numpy()
        rows, counts = self.learnt(coded.dictionary.to_pylist(), count)
        start, k = np.cumsum(size) - size, len(self.classes)  # every text has a part, the empty one if no other
        sums = [np.add.reduceat(np.ascontiguousarray(c).take(codes), start, dtype=np.float64) for c in rows.T] if len(size) else [np.zeros(0)] * rows.shape[1]
        total = np.stack(sums, axis=1)
        again = np.flatnonzero((codes[1:] == codes[:-1]) & (rows[:, k + 1][codes[1:]] > 0)) + 1
        text = np.searchsorted(start, again, "right") - 1
        same, words = np.bincount(text[again > start[text]], minlength=len(size)), total[:, k + 1]
        out = np.tile(self.bias, (len(size), 1)).astype(np.float64)
        some = words > 0
        out[some] += (total[some, :k] + same[some, None] * self.table[:, SAME]) / (total[some, k] + words[some] - 1)[:, None]
        out = np.exp(out - out.max(1, keepdims=True))
        told = np.add.reduceat(counts.take(codes), start) if len(size) else np.zeros(0, np.int64)
        return out / out.sum(1, keepdims=True), told if count else None

    def posteriors(self, texts: list[str] | pa.Array) -> np.ndarray:
        """Class probabilities of each text, (texts, classes)."""
        return self.read(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()))[0]


def document_features(text: str, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(distinct buckets, their shares) of a text."""
    words = text.split()
    if not words:
        return np.zeros(0, np.int64), np.zeros(0)
    places: dict[str, int] = {}
    back = np.array([places.setdefault(w, len(places)) for w in words])
    found, of = word_features(list(places), buckets)
    weight = np.bincount(back)[of].astype(np.float64)
    parts = text.split(" ")
    same = float(sum(a == b and not b.isspace() and b != "" for a, b in zip(parts, parts[1:])))
    idx, place = np.unique(np.concatenate([found, [SAME]]), return_inverse=True)
    share = np.bincount(place, np.concatenate([weight, [same]]), len(idx))
    return idx, share / (weight.sum() + len(words) - 1)


def train(texts: list[str], labels: list, classes: list, buckets: int = 1 << 16, dim: int = 12, epochs: int = 6,
          rate: float = 0.5, least_steps: int = 8000, seed: int = 7) -> SubwordModel:
    """Stochastic gradient descent, one document at a time, over hashed embeddings and softmax weights.

    Few documents are gone over more often, so that ``least_steps`` are made.
    """
    rng = np.random.default_rng(seed)
    emb = rng.uniform(-1 / dim, 1 / dim, (buckets, dim)).astype(np.float32)
    out, bias = np.zeros((dim, len(classes)), np.float32), np.zeros(len(classes), np.float32)
    rows = [document_features(t, buckets) for t in texts]
    y = [classes.index(v) for v in labels]
    epochs = max(epochs, -(-least_steps // max(1, len(rows))))
    steps, done = epochs * max(1, len(rows)), 0
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            idx, share = rows[i]
            lr = rate * (1 - done / steps)
            done += 1
            h = share.astype(np.float32) @ emb[idx] if len(idx) else np.zeros(dim, np.float32)
            z = h @ out + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y[i]] -= 1
            back = out @ p
            out -= lr * np.outer(h, p)
            bias -= 0.05 * lr * p
            if len(idx):  # shares are small, so rows move by their share against the largest
                emb[idx] -= (lr * share / share.max())[:, None].astype(np.float32) * back
    return SubwordModel(list(classes), np.ascontiguousarray((emb @ out).T, np.float32), bias)


def labelled_sample(docs: DataFrame, labels: DataFrame, most_rows: int, id_col: str = "doc_id", text_col: str = "text", most_chars: int = 40_000) -> DataFrame:
    """Bounded training sample: documents of ``most_rows`` label rows at most, those of the smallest hashes of their ids.

    Only ids and labels are ordered, thinned by hash first so that each task sends a few; as no more than ``most_rows`` are left, they
    are sent to the tasks that read the documents, and no text is shuffled. Texts longer than ``most_chars`` are left out.
    """
    n, hashed = labels.count(), F.xxhash64(id_col)
    if n > 2 * most_rows:
        labels = labels.filter(hashed < -(1 << 63) + int((1 << 64) * 1.3 * most_rows / n))
    chosen = labels.filter(F.col(id_col).isNotNull()).orderBy(hashed, *labels.columns).limit(most_rows)
    return docs.filter(F.length(text_col) <= most_chars).join(F.broadcast(chosen), id_col)


def fit(sample: DataFrame, label: Column, text_col: str = "text", **options) -> SubwordModel:
    """Train on a bounded sample (``labelled_sample``), collected in the order of text hashes.

    Rows without a label are left out. Without any labelled row the model knows one class, None.
    """
    rows = sample.select(F.coalesce(F.col(text_col), F.lit("")).alias("t"), label.alias("y")).filter("y is not null").collect()
    rows = sorted(rows, key=lambda r: (zlib.crc32(r.t.encode()), r.t, r.y))
    classes = sorted({r.y for r in rows})
    return train([r.t for r in rows], [r.y for r in rows], classes, **options) if classes else SubwordModel([None], np.zeros((1, 2), np.float32), np.zeros(1, np.float32))


def scored(docs: DataFrame, model: SubwordModel, positive, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score: the model's probability of class ``positive`` for every row; null texts count as empty.

    Repeated rows are scored as often as they come, an empty table gives no rows, other columns are not read.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = model.classes.index(positive) if positive in model.classes else None
        for batch in pieces(batches):
            p = model.posteriors(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p[:, k] if k is not None else np.zeros(len(p)), pa.float64())], ["doc_id", "score"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double")


def accepted(docs: DataFrame, model: SubwordModel, positive, threshold: float, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose score reaches ``threshold``, all columns as they are."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = model.classes.index(positive) if positive in model.classes else None
        for batch in pieces(batches):
            p = model.posteriors(batch.column(at).fill_null(""))
            yield batch.filter(pa.array(p[:, k] >= threshold if k is not None else np.zeros(len(p), bool)))

    return docs.mapInArrow(run, docs.schema)
