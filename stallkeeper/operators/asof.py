"""As-of joins: both sides sorted into ranges once, the last quote carried forward in a range and over its borders."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..staging import staged

#: Rows of the pass over a range: an ask with its quote; an ask without one before it in the range, whose key the range began with; the range's first key; its last key and quote.
ANSWERED, OPEN, FIRST, LAST = range(4)


def asof(asks: DataFrame, quotes: DataFrame, key: str, at: str, quoted_at: str, tie: list[str] | None = None) -> DataFrame:
    """``asks`` with the other columns of the newest quote of the same key that is not later (ties: the greatest by ``tie``); asks without one are left out.

    Asks and quotes are sorted together by key and time into ranges of equal size, so a key with very many rows lies in many ranges. A range is
    passed once, and holds one quote at a time; what it can't answer needs the last quote of the ranges before it, of which there is one row each.
    The work doesn't grow with the quotes that an ask could meet. Rows whose key or time is null meet nothing; repeated asks are answered each.
    """
    spark = asks.sparkSession
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    given = [c for c in quotes.columns if c != key]
    order = F.struct(*[F.col(c) for c in tie]) if tie else F.lit(0)
    a = asks.select(F.col(key).alias("k"), micros(at).alias("t"), F.lit(1).alias("side"), F.struct(*[F.col(f"`{c}`") for c in asks.columns]).alias("a"))
    q = quotes.select(F.col(key).alias("k"), micros(quoted_at).alias("t"), F.lit(0).alias("side"), order.alias("tie"), F.struct(*[F.col(f"`{c}`") for c in given]).alias("q"))
    both = a.unionByName(q, allowMissingColumns=True).filter("k is not null and t is not null")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = both.repartitionByRange(n, "k", "t").sortWithinPartitions("k", "t", "side", "tie").select("k", "side", "a", "q")
    schema = StructType([StructField("part", IntegerType()), StructField("kind", IntegerType()), *[dealt.schema[c] for c in ("k", "a", "q")]])
    passed = staged(dealt.mapInArrow(carry, schema), "asof")
    states = passed.filter(F.col("kind") >= FIRST)
    before = Window.partitionBy("k").orderBy("part", "kind").rowsBetween(Window.unboundedPreceding, -1)
    carried = states.withColumn("c", F.last("q", True).over(before)).filter((F.col("kind") == FIRST) & F.col("c").isNotNull()).select("part", "c")
    late = passed.filter(F.col("kind") == OPEN).join(F.broadcast(carried), "part")  # a row for each range at most
    found = passed.filter(F.col("kind") == ANSWERED).select("a", "q").unionByName(late.select("a", F.col("c").alias("q")))
    return found.select("a.*", *[F.col(f"q.`{c}`") for c in given])


def carry(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One pass over a sorted range (k, side, a, q): rows of (part, kind, k, a, q)."""
    part = TaskContext.get().partitionId()
    first = last = None  # the range's first key, the key read last (arrays of one)
    quote = None  # the last quote of that key, if any

    def told(kind: np.ndarray, k: pa.Array, a: pa.Array, q: pa.Array) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(kind), part), pa.int32()), pa.array(kind, pa.int32()), k, a, q], ["part", "kind", "k", "a", "q"])

    for b in batches:
        if not b.num_rows:
            continue
        k, side, a, q = b.columns
        side, n = side.to_numpy(), b.num_rows
        if first is None:
            first = k[:1]
            yield told(np.array([FIRST]), first, pa.nulls(1, a.type), pa.nulls(1, q.type))
        change = np.zeros(n, bool)
        change[1:] = pc.not_equal(k[1:], k[:-1]).to_numpy(zero_copy_only=False)
        same = last is not None and last[0] == k[0]
        if not same:
            quote = None
        index = np.arange(n)
        began = np.maximum.accumulate(np.where(change, index, 0))
        near = np.maximum.accumulate(np.where(side == 0, index, -1))
        own, head = near >= began, began == 0  # head: rows of the key that the batch begins with
        ask = side == 1
        pool = pa.concat_arrays([q, quote if quote is not None else pa.nulls(1, q.type)])
        some = np.flatnonzero(ask & (own | (head & (quote is not None))))
        yield told(np.full(len(some), ANSWERED), k.take(pa.array(some)), a.take(pa.array(some)), pool.take(pa.array(np.where(own[some], near[some], n))))
        if quote is None and first[0] == k[0]:
            some = np.flatnonzero(ask & head & ~own)
            yield told(np.full(len(some), OPEN), k.take(pa.array(some)), a.take(pa.array(some)), pa.nulls(len(some), q.type))
        if own[-1]:
            quote = q.take(pa.array([near[-1]]))
        elif not head[-1]:
            quote = None
        last = k[-1:]
    if last is not None:
        kind = a.type
        yield told(np.array([LAST]), last, pa.nulls(1, kind), quote if quote is not None else pa.nulls(1, q.type))
