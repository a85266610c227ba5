"""Which texts contain which terms: window hashes for tables that fit into a task, joins on character runs beyond; every hit is verified."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..staging import staged
from .common import row_numbers
from .rolling import TermScan

#: A term table of up to this many bytes, its other columns included, goes to every task; texts are then read once and not shuffled.
MOST_BYTES = 8 << 20


def runs(text: Column, n: int) -> Column:
    """Distinct character runs of length ``n`` in a text, found in one pass over it."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1)))


def all_runs(text: Column, lengths: list[int]) -> Column:
    return F.flatten(F.array(*[runs(text, n) for n in lengths]))


def own_runs(text: Column, gram: int) -> Column:
    """The runs a text is found by: itself, if it is no longer than ``gram``."""
    return F.when(F.length(text) <= gram, F.array(text)).otherwise(runs(text, gram))


def rarest_run(terms: DataFrame, col: str, counts: DataFrame, gram: int) -> DataFrame:
    """``terms`` with __g, n: of the runs of ``col`` the one with the least n in ``counts`` (__g, n); terms with a run that it lacks are left out."""
    mine = terms.select(F.col(col).alias("__t")).distinct().withColumn("__runs", own_runs(F.col("__t"), gram))
    met = mine.select("__t", F.size("__runs").alias("__size"), F.explode("__runs").alias("__g")).join(counts, "__g")
    best = met.groupBy("__t", "__size").agg(F.min_by("__g", F.struct("n", "__g")).alias("__g"), F.min("n").alias("n"), F.count("*").alias("__met"))
    return terms.join(best.filter("__met = __size").select("__t", "__g", "n"), F.col(col) == F.col("__t")).drop("__t")


#: Run lengths and strides by the least length of a term: a text's runs are taken at every stride-th character, a term's at as many neighbouring ones.
CLASSES = [(13, 12, 2), (7, 6, 2), (3, 3, 1), (1, 1, 1)]


def strided_runs(text: Column, size: int, stride: int) -> Column:
    """Distinct runs of ``size`` characters that begin at every ``stride``-th character of a text."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{size}}})).{{{stride}}}"), F.lit(1)))


def indexed_terms(terms: DataFrame) -> DataFrame:
    """``terms`` with __size and __g, one row for each run of ``__size`` characters that a term is found by.

    Wherever a term lies in a text, one of any ``stride`` neighbouring runs of it begins at a character that the text's runs are taken at. Those
    neighbours are chosen that the fewest terms share.
    """
    by_length = lambda k: F.when(F.length("term") >= CLASSES[0][0], CLASSES[0][k]).when(F.length("term") >= CLASSES[1][0], CLASSES[1][k]).when(F.length("term") >= CLASSES[2][0], CLASSES[2][k]).otherwise(1)
    each = F.transform(F.sequence(F.lit(1), F.length("term") - F.col("__size") + 1), lambda i: F.substring("term", i, F.col("__size")))
    mine = terms.select("term").distinct().withColumns({"__size": by_length(1), "__stride": by_length(2)}).withColumn("__runs", each)
    counts = mine.select(F.explode(F.array_distinct("__runs")).alias("__g")).groupBy("__g").agg(F.count("*").alias("n"))
    met = mine.select("term", "__size", "__stride", F.posexplode("__runs").alias("__pos", "__g")).join(counts, "__g")
    runs = met.groupBy("term", "__size", "__stride").agg(F.array_sort(F.collect_list(F.struct("__pos", "n", "__g"))).alias("r"))
    shared = lambda at: F.aggregate(F.slice("r", at, F.col("__stride")), F.lit(0).cast("long"), lambda x, y: x + y["n"])
    windows = F.transform(F.sequence(F.lit(1), F.size("r") - F.col("__stride") + 1), lambda at: F.struct(shared(at).alias("n"), at.alias("at")))
    chosen = F.transform(F.slice("r", F.array_min(windows)["at"], F.col("__stride")), lambda x: x["__g"])
    return terms.join(runs.select("term", "__size", F.explode(F.array_distinct(chosen)).alias("__g")), "term")


def first_term(texts: DataFrame, terms: DataFrame, text_col: str, order: list[str], span: int = 8192) -> DataFrame:
    """``texts`` with the columns of the first of ``terms`` (by ``order``, then term) that each row's text contains; one row for each such row.

    Rows are answered by themselves: repeated and null ids are rows like any other. Null texts and empty terms match nothing. Terms of up to
    ``MOST_BYTES`` in all go to every task, where texts are scanned by window hashes (``TermScan``); nothing is shuffled. Larger term tables are joined
    with the texts' character runs (``joined_terms``).
    """
    names = [c for c in terms.columns if c not in ("term", *order)]
    asked = terms.filter("term <> ''").select("term", *[f"`{c}`" for c in names], *[f"`{c}`" for c in order])
    width = sum((F.coalesce(F.octet_length(F.col(f"`{c}`").cast("string")), F.lit(0)) for c in names), F.octet_length("term") + 64)
    bytes_ = asked.agg(F.sum(width.cast("long"))).first()[0] or 0
    if bytes_ > MOST_BYTES:
        return joined_terms(texts, asked, text_col, order, names, span)
    known = asked.orderBy(*order, "term", *names).select("term", *[f"`{c}`" for c in names])
    return scanned_terms(texts, known, text_col)


def scanned_terms(texts: DataFrame, known: DataFrame, text_col: str) -> DataFrame:
    """``first_term`` for a small table ``known`` in order of preference: each task scans its texts."""
    spark, fields = texts.sparkSession, known.schema.fields
    rest, at = [f for f in texts.schema.fields if f.name != text_col], texts.columns.index(text_col)
    table = known.toArrow()
    sent = spark.sparkContext.broadcast((table, TermScan(table.column(0).to_pylist())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, scan = sent.value
        for b in batches:
            k = scan.first(b.column(at))
            hit = np.flatnonzero(k >= 0)
            kept, found = b.take(pa.array(hit)), table.take(pa.array(k[hit])).combine_chunks()
            told = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in found.columns]
            yield pa.RecordBatch.from_arrays([*[c for i, c in enumerate(kept.columns) if i != at], *told], names)

    names = [f.name for f in (*rest, *fields)]
    return texts.mapInArrow(run, StructType([*rest, *fields]))


def joined_terms(texts: DataFrame, terms: DataFrame, text_col: str, order: list[str], names: list[str], span: int) -> DataFrame:
    """``first_term`` for any number of terms.

    Texts are cut into chunks of about ``span`` characters, which overlap by the longest term. Their runs at every stride are joined with those that
    the terms are found by (``indexed_terms``); runs are shuffled, and chunks once, to be verified. Terms are numbered by their order, so a
    row keeps its least number.
    """
    rest = [f"`{c}`" for c in texts.columns if c != text_col]
    terms = staged(row_numbers(terms, [*order, "term", *names], "__k").select("term", *names, "__k"), "terms")
    longest = terms.agg(F.max(F.length("term"))).first()[0]
    index = staged(indexed_terms(terms.select("term", "__k")), "term-index")
    sizes = sorted(r[0] for r in index.select("__size").distinct().collect())  # at most one for each class
    index = index.drop("__size")
    step = max(span, longest)
    cuts = F.transform(F.sequence(F.lit(0), F.floor((F.length("__text") - 1) / step).cast("int")), lambda i: F.substring("__text", i * step + 1, F.lit(step + longest - 1)))
    rows = texts.select(*rest, F.col(text_col).alias("__text")).filter("__text <> ''").withColumn("__row", F.monotonically_increasing_id())
    chunks = rows.select("__row", *rest, F.posexplode(F.when(F.length("__text") <= span, F.array("__text")).otherwise(cuts)).alias("__part", "__chunk"))
    chunks = staged(chunks, "chunks")
    every = F.explode(F.flatten(F.array(*[strided_runs(F.col("__chunk"), n, stride) for _, n, stride in CLASSES if n in sizes]))).alias("__g")
    pairs = chunks.select("__row", "__part", every).join(index, "__g").select("__row", "__part", "term", "__k").distinct()
    met = pairs.join(chunks.select("__row", "__part", "__chunk"), ["__row", "__part"]).filter(F.col("__chunk").contains(F.col("term")))
    found = met.groupBy("__row").agg(F.min("__k").alias("__k"))
    heads = chunks.filter("__part = 0").select("__row", *rest)
    return found.join(heads, "__row").join(terms, "__k").select(*rest, "term", *names)


#: Names under a run, times the texts that have it: up to so many are compared, beyond it the names are looked for under longer runs.
MOST_PAIRS = 10_000_000


def shortest_holder(names: DataFrame, texts: DataFrame, gram: int = 5, most_pairs: int = MOST_PAIRS) -> DataFrame:
    """__a, __b of the shortest, then least text (``texts``: __b) that contains each name (``names``: __a, distinct and not empty).

    A name no longer than ``gram`` is a run itself: the least text of each run answers it, without pairs. A longer one is compared with the texts that have
    the run of its that the fewest texts have. If all names under a run and its texts would make more than ``most_pairs``, those names go on with runs twice
    as long, among the texts with such a run, until they are runs themselves; so a run shared by all costs one more pass, never its pairs.
    """
    shape, found = names.select("__a", F.lit(None).cast("string").alias("__b")).limit(0), []
    names, texts = names.select("__a"), texts.select("__b").distinct()
    least = F.min_by("__b", F.struct(F.length("__b"), "__b")).alias("__b")
    while True:
        sizes = sorted(r[0] for r in names.select(F.least(F.length("__a"), F.lit(gram + 1))).distinct().collect())  # at most gram + 1 numbers
        index = lambda lengths: texts.select("__b", F.explode(all_runs(F.col("__b"), lengths)).alias("__g"))
        if whole := [n for n in sizes if 0 < n <= gram]:
            found.append(names.join(index(whole).groupBy("__g").agg(least), F.col("__a") == F.col("__g")).select("__a", "__b"))
        if gram + 1 not in sizes:
            break
        indexed = index([gram])
        counts = indexed.groupBy("__g").agg(F.count("*").alias("n"))
        picked = staged(rarest_run(names.filter(F.length("__a") > gram), "__a", counts, gram), "picked")
        hot = picked.groupBy("__g", "n").agg(F.count("*").alias("names")).filter(F.col("names") * F.col("n") > most_pairs).select("__g")
        met = picked.join(hot, "__g", "left_anti").drop("n").join(indexed, "__g").filter(F.col("__b").contains(F.col("__a")))
        found.append(met.groupBy("__a").agg(least))
        if hot.isEmpty():
            break
        names = staged(picked.join(hot, "__g", "left_semi").select("__a"), "names")
        texts = staged(texts.join(indexed.join(hot, "__g", "left_semi").select("__b").distinct(), "__b", "left_semi"), "texts")
        gram *= 2
    return reduce(DataFrame.unionByName, found, shape)
