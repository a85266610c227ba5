"""Threshold-scaled sketches: every shingle hash below a fixed fraction of the hash range. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sketch(text: Column, shingle: int = 5, fraction: float = 0.25) -> Column:
    """Sorted distinct 64-bit hashes of the word shingles of ``text`` that lie below ``fraction`` of the range.

    Words are lower-cased and split at white space; with fewer words than ``shingle`` all of them are the one shingle.
    The least hash is always kept, so only a text without words has an empty sketch.
    """
    bound = -(1 << 63) + int(fraction * (1 << 64))
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+"), lambda w: w != "")
    hashes = F.transform(words, lambda w: F.xxhash64(w))

    def of(h: Column) -> Column:
        few = F.array(F.aggregate(h, F.lit(42).cast("long"), lambda a, x: F.xxhash64(a, x)))
        many = F.transform(F.sequence(F.lit(0), F.size(h) - shingle), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(shingle)]))
        return F.when(F.size(h) == 0, F.array().cast("array<bigint>")).when(F.size(h) < shingle, few).otherwise(many)

    def kept(h: Column) -> Column:
        low = F.filter(h, lambda x: x < bound)
        return F.when(F.size(low) > 0, F.sort_array(F.array_distinct(low))).when(F.size(h) > 0, F.array(F.array_min(h))).otherwise(h)

    # transform over a one-element array names a value, so that it is computed once
    named = F.transform(F.array(hashes), of)
    return F.get(F.transform(named, kept), 0)


def merged(sketches: Column, fraction: float = 0.25) -> Column:
    """Sketch of a union of texts' shingles, from an array of their sketches."""
    bound = -(1 << 63) + int(fraction * (1 << 64))
    every = F.sort_array(F.array_distinct(F.flatten(sketches)))
    return F.when(F.size(F.filter(every, lambda x: x < bound)) > 0, F.filter(every, lambda x: x < bound)).otherwise(F.slice(every, 1, 1))


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard index of the shingle sets; 1 for two empty sketches."""
    both = F.size(F.array_intersect(a, b))
    every = F.size(a) + F.size(b) - both
    return F.when(every == 0, F.lit(1.0)).otherwise(both / every)


def containment(a: Column, b: Column) -> Column:
    """Estimated share of a's shingles that b has too; 1 for an empty a."""
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(a))


def as_text(a: Column) -> Column:
    """A sketch as a string: 16 hex digits for each hash, in order."""
    return F.array_join(F.transform(a, lambda x: F.lower(F.lpad(F.hex(x), 16, "0"))), "")


def key_of(id_: Column, text: Column) -> Column:
    """What rows are ordered by: null ids first, then by id, rows of one id by a hash of their texts."""
    return F.struct(id_.isNotNull().alias("some"), id_.alias("id"), F.xxhash64(text).alias("h"))


def range_edges(keyed: DataFrame, most: int, seed: int = 5) -> list:
    """Keys (column ``key``) at which ranges of about equally many rows begin, ``most`` at most, from a sample of about 50 keys for each."""
    n = keyed.count()
    some = keyed.select("key").sample(min(1.0, 50 * most / max(1, n)), seed) if n > 50 * most else keyed.select("key")
    dealt = some.repartitionByRange(most, "key").groupBy(F.spark_partition_id().alias("p")).agg(F.min("key").alias("key"))
    return [r.key for r in dealt.orderBy("key").collect()]


def range_of(key: Column, edges: list, kind) -> Column:
    """Number of the range that ``key`` lies in: the edges up to it, counted in groups of the square root of their number."""
    size = max(1, int(len(edges) ** 0.5))
    groups = [edges[i : i + size] for i in range(0, len(edges), size)]
    if not groups:
        return F.lit(0)
    value = lambda e: F.struct(F.lit(e.some).alias("some"), F.lit(e.id).cast(kind).alias("id"), F.lit(e.h).alias("h"))
    upto = lambda es: F.size(F.filter(es, lambda e: e <= key))
    group = F.greatest(upto(F.array(*[value(g[0]) for g in groups])) - 1, F.lit(0))
    return group * size + upto(F.get(F.array(*[F.array(*map(value, g)) for g in groups]), group))


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int | None = None, **how) -> DataFrame:
    """doc_id, text, own, next_text, next_own: each row and its sketch with those of the next row; after the last comes the first.

    Rows are ordered by id of any type that has an order (null ids first), those of one id by a hash of their texts. They are dealt to
    ranges of about equally many rows, ``most`` of them at most, so each text is shuffled once and sketched once; the first row of each range goes to the
    range before. Null texts are empty.
    """
    base = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    base = base.withColumn("key", key_of(F.col("doc_id"), F.col("text")))
    most = most or min(4096, 8 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    base = base.withColumn("range", range_of(F.col("key"), range_edges(base, most), base.schema["doc_id"].dataType))
    firsts = base.groupBy("range").agg(F.min_by("text", "key").alias("first_text"))
    every = Window.partitionBy(F.lit(0))  # over ``most`` numbers
    links = firsts.select("range").select(F.coalesce(F.lead("range").over(every.orderBy("range")), F.min("range").over(every)).alias("next"), "range")
    after = links.join(firsts.withColumnRenamed("range", "next"), "next").select("range", F.struct(F.col("first_text").alias("text"), sketch(F.col("first_text"), **how).alias("own")).alias("first"))
    own = base.repartition("range").withColumn("own", sketch(F.col("text"), **how))
    led = own.withColumn("led", F.lead(F.struct("text", "own")).over(Window.partitionBy("range").orderBy("key")))
    both = led.join(after, "range").withColumn("following", F.coalesce("led", "first"))
    return both.select("doc_id", "text", "own", F.col("following.text").alias("next_text"), F.col("following.own").alias("next_own"))


def edited(text: Column, following: Column) -> Column:
    """``text`` with its last floor(n/2) code points replaced by the first as many (or all) of ``following``."""
    half = F.floor(F.length(text) / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - half), F.substring(following, F.lit(1), half))


def sketch_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, fraction: float = 0.25) -> DataFrame:
    """Sketches of every text, of its edited text and of the next text, with their likeness.

    Returns doc_id, n_chars, edited_text, own, changed (sketches), near_edited, near_next. Texts without words have the empty
    sketch, which is like another empty one only. Equal texts have equal sketches. Repeated rows and null ids are
    kept; with one row the next document is itself; an empty table gives no rows; texts are read whole, however long; other columns are not read.
    """
    rows = with_next(docs, id_col, text_col, shingle=shingle, fraction=fraction).withColumn("edited_text", edited(F.col("text"), F.col("next_text")))
    rows = rows.select("doc_id", F.length("text").cast("long").alias("n_chars"), "edited_text", "own", sketch(F.col("edited_text"), shingle, fraction).alias("changed"), "next_own")
    return rows.select("doc_id", "n_chars", "edited_text", "own", "changed", likeness(F.col("own"), F.col("changed")).alias("near_edited"),
                       likeness(F.col("own"), F.col("next_own")).alias("near_next"))
