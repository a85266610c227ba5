"""First, latest and running choices per key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..staging import staged


def first_match(df: DataFrame, by: list[str], order: list) -> DataFrame:
    """The first row of each key by ``order``; an aggregate, so that rows are reduced before they are shuffled."""
    rest = [c for c in df.columns if c not in by]
    keyed = df.groupBy(*by).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("__r"))
    return keyed.select(*by, "__r.*").select(*df.columns)


def latest(df: DataFrame, by: list[str], order: list) -> DataFrame:
    """The last row of each key by ``order``."""
    rest = [c for c in df.columns if c not in by]
    keyed = df.groupBy(*by).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("__r"))
    return keyed.select(*by, "__r.*").select(*df.columns)


def dedupe(df: DataFrame, keys: list, order: list) -> DataFrame:
    """The first row by ``order`` for each value of the key expressions."""
    named = {f"__k{i}": k if isinstance(k, Column) else F.col(k) for i, k in enumerate(keys)}
    return first_match(df.withColumns(named), list(named), order).drop(*named)


def lookahead_first(df: DataFrame, doc: str, pos: str, marker: Column, value: Column, rows: int = 8) -> DataFrame:
    """Rows where ``marker`` holds, with the first non-null ``value`` among them and the rows after, ``rows`` in all."""
    frame = Window.partitionBy(doc).orderBy(pos).rowsBetween(0, rows - 1)
    return df.withColumn("found", F.first(value, ignorenulls=True).over(frame)).withColumn("__m", marker).filter("__m").drop("__m")


def row_numbers(df: DataFrame, order: list, col: str) -> DataFrame:
    """``df`` with ``col``: the row's place from 0 by ``order``.

    Rows are ordered inside ranges, which are written once so that both uses see the same ranges; only one row for each range
    is ordered in one task.
    """
    n = df.sparkSession.conf.get("spark.sql.shuffle.partitions")
    dealt = df.repartitionByRange(int(n), *order).sortWithinPartitions(*order).withColumn("__mono", F.monotonically_increasing_id())
    dealt = staged(dealt, "numbered")
    part = F.shiftright("__mono", 33)
    counts = dealt.groupBy(part.alias("__part")).agg(F.count("*").alias("__n"))
    before = counts.withColumn("__before", F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inside = F.col("__mono").bitwiseAND(F.lit((1 << 33) - 1))
    joined = dealt.withColumn("__part", part).join(before.drop("__n"), "__part")
    return joined.withColumn(col, F.col("__before") + inside).drop("__part", "__mono", "__before")


def number_rows(df: DataFrame, order: list, prefix: str = "p") -> DataFrame:
    """``df`` with id: ``prefix`` and the row's place from 0. Keep a real id where there is one."""
    return row_numbers(df, order, "__n0").withColumn("id", F.concat(F.lit(prefix), F.col("__n0").cast("string"))).drop("__n0")


def keep_last(df: DataFrame, order: Column, n: int = 5000) -> DataFrame:
    """The ``n`` rows that are last by ``order`` (a top-k: each task keeps n rows at most)."""
    return df.orderBy(order.desc()).limit(n)


def head_by(df: DataFrame, order: list, n: int = 15) -> DataFrame:
    return df.orderBy(*order).limit(n)
