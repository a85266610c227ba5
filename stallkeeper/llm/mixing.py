"""Soft-membership mixing: domain posteriors and nonnegative document rates that meet token targets."""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import pieces, staged
from .subword import SubwordModel, fit
from .tokens import byte_bpe


#: The tokenizer whose ids the packing stages pack.
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
#: Bytes of text that leave a task at once when rows are repeated.
BATCH = 16 << 20


def domain_model(sample: DataFrame, domain: Column, text_col: str = "text", **options) -> SubwordModel:
    """Subword classifier of ``domain``, from a bounded sample of the labelled table."""
    return fit(sample, domain, text_col, **{"epochs": 4, "buckets": 1 << 15} | options)


def memberships(docs: DataFrame, model: SubwordModel, text_col: str = "text", tokenizer: str = BYTE_BPE) -> DataFrame:
    """row (a struct of all columns), n_tokens (ids of ``tokenizer``), posteriors (array, in the order of model.classes) of every row.

    Null texts count as empty. The classifier's pass over the words counts the ids too.
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = byte_bpe(tokenizer)
        for batch in pieces(batches):
            texts = batch.column(0).field(at).fill_null("")
            p, sums = model.read(texts, encoder.counts)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, p.size + 1, p.shape[1]), pa.int32()), pa.array(p.ravel(), pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(encoder.totals(texts.to_pylist(), sums), pa.int64()), lists], ["row", "n_tokens", "posteriors"])

    return rows.mapInArrow(run, T.StructType([rows.schema["row"], T.StructField("n_tokens", T.LongType()), T.StructField("posteriors", T.ArrayType(T.DoubleType()))]))


@dataclass(frozen=True)
class Fit:
    """``steps``: one row for each round, its momentum and its step for each domain; ``totals``: expected tokens of each domain."""

    steps: np.ndarray
    totals: np.ndarray
    targets: np.ndarray
    met: bool

    @property
    def left(self) -> float:
        """The largest distance of a domain to its target, as a share of all target tokens."""
        return float(np.abs(self.totals - self.targets).max() / max(1.0, self.targets.sum())) if len(self.targets) else 0.0


def rate_after(posteriors: np.ndarray, steps: np.ndarray) -> np.ndarray:
    """Rates after the projected steps: each goes on with some momentum, moves by -(posterior . step) and is cut at 0; they start at 1."""
    rate = before = np.ones(len(posteriors))
    for momentum, *step in steps:
        rate, before = np.maximum(0.0, rate + momentum * (rate - before) - posteriors @ np.array(step)), rate
    return rate


def matrix_of(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def fit_steps(members: DataFrame, targets: np.ndarray, most_rounds: int = 40, tolerance: float = 1e-4, ridge: float = 1e-3) -> Fit:
    """Steps of projected-gradient least squares: min over rates >= 0 of (total - target)' W (total - target), total_k = sum_d rate tokens p_k.

    W is the inverse of the second moments sum_d tokens p p', with ``ridge`` times the domains' tokens on its diagonal, so that a domain that hardly
    any document belongs to doesn't outweigh the others. The gradient is taken in the metric of the tokens; the step size is then 1, the
    loss never rises, and without rates cut at 0 the first rounds nearly meet the targets. Momentum (restarted when the loss would rise)
    speeds up the others. A document's rate follows from its posteriors and the steps so far, a rounds x domains matrix: no state for each
    document is kept or shuffled. Each round is one pass of partial sums; only numbers by domain reach the driver.
    Rounds end when every domain is within ``tolerance`` of all tokens; when two rounds in a row move no total by a hundredth of that, as
    then rates >= 0 can come no nearer; or after ``most_rounds``. Unless the targets are met a warning names the error that is left.
    """
    k = len(targets)
    rows = members.select("n_tokens", "posteriors")

    def moments(p: np.ndarray, t: np.ndarray) -> np.ndarray:
        return np.concatenate([p.T @ (p * t[:, None]), [t @ p]])

    def gathered(fn, shape: tuple) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(shape)
            for b in batches:
                total += fn(matrix_of(b.column(1)), b.column(0).to_numpy().astype(float))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], ["i", "x"])

        out = np.zeros(int(np.prod(shape)))
        for r in rows.mapInArrow(run, "i long, x double").groupBy("i").agg(F.sum("x").alias("x")).collect():
            out[r.i] = r.x
        return out.reshape(shape)

    first = gathered(moments, (k + 1, k))
    have, steps = first[k], np.zeros((0, k + 1))
    if have.sum() == 0:
        return Fit(steps, have, targets, not targets.any())
    weight = np.linalg.pinv(first[:k] + ridge * np.diag(have), hermitian=True)
    loss = lambda total: float((total - targets) @ weight @ (total - targets))
    close = tolerance * max(targets.sum(), 1e-9 * have.sum())
    now = before = have
    pace, still = 1.0, 0
    while np.abs(now - targets).max() > close and len(steps) < most_rounds and still < 2:
        faster = (1 + (1 + 4 * pace * pace) ** 0.5) / 2
        momentum = (pace - 1) / faster
        tried = np.vstack([steps, [momentum, *(weight @ (now + momentum * (now - before) - targets))]])
        after = gathered(lambda p, t, s=tried: (t * rate_after(p, s)) @ p, (k,))
        if momentum and loss(after) > loss(now):
            tried = np.vstack([steps, [0.0, *(weight @ (now - targets))]])
            after, faster = gathered(lambda p, t, s=tried: (t * rate_after(p, s)) @ p, (k,)), 1.0
        still = still + 1 if np.abs(after - now).max() <= close / 100 else 0
        steps, before, now, pace = tried, now, after, faster
    found = Fit(steps, now, targets, bool(np.abs(now - targets).max() <= close))
    if not found.met:
        warnings.warn(f"targets not met after {len(steps)} rounds: a domain is {found.left:.2%} of all tokens off", stacklevel=2)
    return found


def rates(members: DataFrame, steps: np.ndarray) -> DataFrame:
    """``members`` with each row's rate."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.append_column("rate", pa.array(rate_after(matrix_of(b.column(b.schema.get_field_index("posteriors"))), steps)))

    return members.mapInArrow(run, T.StructType([*members.schema.fields, T.StructField("rate", T.DoubleType())]))


def targets_of(members: DataFrame, classes: list, weights: dict) -> np.ndarray:
    """Target tokens of each class: its share in ``weights`` (left out: 0) of all tokens."""
    total = members.agg(F.sum("n_tokens")).first()[0] or 0
    share = np.array([float(weights.get(c, 0)) for c in classes])
    return total * share / share.sum() if share.sum() else share


def mix(docs: DataFrame, model: SubwordModel, weights: dict, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, Fit]:
    """(doc_id, n_tokens, posteriors, rate of every row; the fit that gives the rates).

    Rates are nonnegative expected numbers of copies; the expected tokens of each domain, over all rows, meet its share
    in ``weights`` (by class of the model; left out: 0) of all tokens, or come as near as rates >= 0 can. Texts without
    words weigh nothing; their rate follows from their posterior like any other. Texts are read whole, however long. Repeated rows get
    equal rates, null ids are kept, an empty table gives no rows, other columns are not read.
    """
    asked = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    members = staged(memberships(asked, model).select(F.col("row.doc_id").alias("doc_id"), "n_tokens", "posteriors"), "memberships")
    found = fit_steps(members, targets_of(members, model.classes, weights))
    return rates(members, found.steps), found


def batches_of(times: np.ndarray, size: np.ndarray) -> Iterator[pa.Array]:
    """Places of rows, each as often as ``times`` says, in order, in parts of about ``BATCH`` by the rows' ``size``."""
    at, done, n = 0, 0, len(times)
    while at < n:
        part, room = [], BATCH
        while at < n and (room > 0 or not part):
            take = min(int(times[at]) - done, max(1, room // int(size[at])))
            part += [at] * take
            room -= take * int(size[at])
            done += take
            if done == times[at]:
                at, done = at + 1, 0
        yield pa.array(part, pa.int64())


def resample(docs: DataFrame, model: SubwordModel, weights: dict, id_col: str = "doc_id", text_col: str = "text", seed: int = 11) -> tuple[DataFrame, Fit]:
    """(``docs`` with every row repeated as its rate says, the fit): the whole part, and once more where a hash of its id and text is under the rest.

    Rates are those of ``mix``. Rows are written with their posteriors, so that texts are scored once. Columns of any name are kept.
    Copies leave a task in batches of about ``BATCH`` bytes of text, however high a rate is.
    """
    members = staged(memberships(docs, model, text_col), "memberships")
    found = fit_steps(members, targets_of(members, model.classes, weights))
    names, steps = docs.columns, found.steps
    at, key = names.index(text_col), names.index(id_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        for b in pieces(batches):
            columns = b.column(0).flatten()
            rate = rate_after(matrix_of(b.column(1)), steps)
            u = np.array([xxh64_intdigest(f"{k} {t or ''}", seed) for k, t in zip(columns[key].to_pylist(), columns[at].to_pylist())], np.float64) / 2.0**64
            times, size = np.floor(rate).astype(int) + (u < rate % 1), pc.binary_length(columns[at]).fill_null(0).to_numpy().astype(int) + 64
            for copies in batches_of(times, size):
                yield pa.RecordBatch.from_arrays([c.take(copies) for c in columns], names)

    return members.select("row", "posteriors").mapInArrow(run, docs.schema), found
