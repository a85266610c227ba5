"""Exact duplicates over arrivals: binary fuse filters of immutable snapshots screen digests, positives are compared byte by byte."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from .common import staged
from .fuse import FuseFilter
from .simhash import content_filter

#: Bits of the set of digests that tells tasks which texts to send for comparison; 4 MB, whatever the size of an arrival.
ASKED_BITS = 1 << 25
#: Rows of one text in a snapshot beyond one in so many of all rows are hot; no more than that many texts can be.
HOT = 500


def normalised(text: Column) -> Column:
    """A text without its ASCII white space; a null one is empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", "")


class DedupStore:
    """Snapshots of arrivals under ``path``. Each is written once: its rows, its groups of equal texts and the filters of the texts that were new in it.

    ``add`` groups an arrival's equal texts among themselves. Its distinct digests are dealt to the filters of the earlier snapshots, each in
    shards of about ``shard_keys`` digests by their leading bits; a digest that passes meets the rows of that snapshot with the same digest, and only texts
    with the same bytes are one. So are texts of one digest within an arrival: equal digests alone join nothing. Only texts whose digest comes twice
    or passes a filter are sent, each once from a task. An arrival that fails is no snapshot; adding it again replaces what it left.
    """

    def __init__(self, spark: SparkSession, path: str, shard_keys: int = 8192, digest: Callable[[Column], Column] = F.xxhash64):
        self.spark, self.path, self.shard_keys, self.digest = spark, path.rstrip("/"), shard_keys, digest
        jvm = spark.sparkContext._jvm
        self.Path = jvm.org.apache.hadoop.fs.Path
        self.fs = self.Path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def snapshots(self) -> int:
        k = 0
        while self.fs.exists(self.Path(f"{self.path}/filters/snapshot={k + 1}/_SUCCESS")):
            k += 1
        return k

    def _write(self, df: DataFrame, name: str, k: int) -> DataFrame:
        at = f"{self.path}/{name}/snapshot={k}"
        df.write.mode("overwrite").option("compression", "zstd").parquet(at)
        return self.spark.read.schema(df.schema).parquet(at)

    def _all(self, name: str, schema, k: int) -> DataFrame:
        """The parts of snapshots 1 to ``k``, with their number."""
        paths = [f"{self.path}/{name}/snapshot={n}" for n in range(1, k + 1)]
        fields = StructType([*schema.fields, StructField("snapshot", IntegerType())])
        return self.spark.read.schema(fields).option("basePath", f"{self.path}/{name}").parquet(*paths)

    def add(self, arrival: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> int:
        """Add an arrival as the next snapshot and return its number. Null texts are empty, empty texts equal; any ids, other columns are not read."""
        k = self.snapshots() + 1
        key = normalised(F.col(text_col))
        rows = arrival.select(F.col(id_col).alias("doc_id"), F.length(F.coalesce(F.col(text_col), F.lit(""))).cast("long").alias("chars"), key.alias("norm"))
        rows = rows.select("doc_id", "chars", "norm", self.digest(F.col("norm")).alias("digest"), F.unhex(F.sha2(F.encode("norm", "UTF-8"), 256)).alias("sha"), F.monotonically_increasing_id().alias("row"))
        rows = self._write(rows, "rows", k)
        first = F.struct((-F.col("chars")).alias("less"), F.col("doc_id").isNull().alias("none"), "doc_id", F.lit(k).alias("snapshot"), "row")
        digests = staged(rows.groupBy("digest").agg(F.count("*").alias("n"), F.min(first).alias("first")), "digests")
        passed = staged(self.screened(digests.select("digest"), k - 1), "passed")
        asked = digests.filter("n > 1").select("digest").unionByName(passed.select("digest")).distinct()
        texts = self.sent(rows, asked, "digest, norm").groupBy("digest", "norm").agg(F.count("*").alias("n"))
        texts = staged(texts, "texts")
        shared = texts.groupBy("digest").agg(F.count("*").alias("n")).filter("n > 1").select("digest")  # digests of several texts
        shared = self._write(shared, "shared", k)
        groups = digests.join(shared, "digest", "left_anti").select("digest", F.lit("").alias("x"), "n", "first")
        apart = rows.join(shared, "digest").groupBy("digest", F.concat(F.lit("="), "norm").alias("x")).agg(F.count("*").alias("n"), F.min(first).alias("first"))
        groups = groups.unionByName(apart)
        if k > 1:
            known = self.matched(texts, passed, shared, rows.schema, k)
            groups = groups.join(known, ["digest", "x"], "left")
            groups = groups.select("digest", "x", "n", "first", F.coalesce("home", F.lit(k)).alias("home"), F.coalesce("home_x", "x").alias("home_x"))
        else:
            groups = groups.select("digest", "x", "n", "first", F.lit(k).alias("home"), F.col("x").alias("home_x"))
        groups = self._write(groups, "groups", k)
        self._write(self.filters(groups.filter(F.col("home") == k).select("digest").distinct()), "filters", k)
        return k

    def filters(self, digests: DataFrame) -> DataFrame:
        """bits, shard, seed, segment, segments, prints: the filters of distinct digests by their leading bits."""
        bits = max(0, (digests.count() // self.shard_keys).bit_length())

        def build(key: tuple, group: pa.Table) -> pa.Table:
            f = FuseFilter.build(group.column("digest").to_numpy().view(np.uint64))
            return pa.table({"bits": pa.array([bits], pa.int32()), "shard": pa.array([key[0].as_py()], pa.int64()), "seed": pa.array([np.uint64(f.seed).astype(np.int64)], pa.int64()),
                             "segment": pa.array([f.segment], pa.int32()), "segments": pa.array([f.segments], pa.int32()), "prints": pa.array([f.prints], pa.binary())})

        dealt = digests.withColumn("shard", leading(F.col("digest"), bits))
        return dealt.groupBy("shard").applyInArrow(build, "bits int, shard long, seed long, segment int, segments int, prints binary")

    def screened(self, digests: DataFrame, k: int) -> DataFrame:
        """(digest, home): digests that pass the filter of snapshot ``home``, of 1 to ``k``. A task holds one shard's filter, digests stream by."""
        if not k:
            return digests.select("digest", F.lit(0).alias("home")).limit(0)
        schema = self.spark.read.parquet(f"{self.path}/filters/snapshot=1").schema
        filters = self._all("filters", schema, k)
        homes = [(r.snapshot, r.bits) for r in filters.groupBy("snapshot").agg(F.max("bits").alias("bits")).collect()]  # one for each snapshot with new texts
        places = [F.struct(F.lit(home).alias("home"), leading(F.col("digest"), bits).alias("shard")) for home, bits in homes]
        if not places:
            return digests.select("digest", F.lit(0).alias("home")).limit(0)
        asked = digests.select("digest", F.explode(F.array(*places)).alias("p")).select(F.col("p.home").alias("home"), F.col("p.shard").alias("shard"), "digest")
        fields = ["seed", "segment", "segments", "prints"]
        both = filters.select(F.col("snapshot").alias("home"), "shard", F.lit(None).cast("long").alias("digest"), *fields).unionByName(asked, allowMissingColumns=True)
        both = both.repartition("home", "shard").sortWithinPartitions("home", "shard", F.col("prints").isNull())  # a shard's filter comes before its digests

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = {}
            for b in batches:
                is_filter = b.column("prints").is_valid().to_numpy(zero_copy_only=False)
                for r in b.filter(pa.array(is_filter)).to_pylist():
                    known[r["home"], r["shard"]] = FuseFilter(r["seed"] & (1 << 64) - 1, r["segment"], r["segments"], r["prints"])
                rows = b.filter(pa.array(~is_filter))
                home, shard, digest = (rows.column(c).to_numpy() for c in ("home", "shard", "digest"))
                passed = np.zeros(len(home), bool)
                edges = np.flatnonzero(np.diff(home, prepend=-1) | np.diff(shard, prepend=-1)) if len(home) else []
                for s, e in zip(edges, [*edges[1:], len(home)]):
                    f = known.get((int(home[s]), int(shard[s])))
                    if f:
                        passed[s:e] = f.has(digest[s:e].view(np.uint64))
                if len(home):
                    known = {(int(home[-1]), int(shard[-1])): f}
                yield pa.RecordBatch.from_arrays([rows.column("digest"), rows.column("home")], ["digest", "home"]).filter(pa.array(passed))

        return both.mapInArrow(run, "digest long, home int")

    def sent(self, rows: DataFrame, asked: DataFrame, columns: str) -> DataFrame:
        """The rows whose digest may be in ``asked``: all that are, and a few others. Nothing is shuffled."""
        mask = self.spark.sparkContext.broadcast(content_filter(asked.select(F.col("digest").alias("c")), ASKED_BITS).tobytes())

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            bits = np.frombuffer(mask.value, np.uint64)
            for b in batches:
                at = b.column("digest").to_numpy() & (ASKED_BITS - 1)
                yield b.filter(pa.array((bits[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(bool)))

        rows = rows.select(*columns.split(", "))
        return rows.mapInArrow(run, rows.schema)

    def matched(self, texts: DataFrame, passed: DataFrame, shared: DataFrame, schema, k: int) -> DataFrame:
        """digest, x, home, home_x: of the arrival's ``texts`` those that the rows of an earlier snapshot hold, byte by byte; the earliest is home."""
        old = self.sent(self._all("rows", schema, k - 1), passed.select("digest").distinct(), "digest, norm, snapshot").distinct()
        old = old.join(passed.withColumnRenamed("home", "snapshot"), ["digest", "snapshot"], "left_semi")
        crossed = self._all("shared", shared.schema, k - 1).withColumn("several", F.lit(True))
        old = old.join(crossed, ["digest", "snapshot"], "left")
        home_x = F.when(F.col("several"), F.concat(F.lit("="), "norm")).otherwise("")
        old = old.select("digest", "norm", F.col("snapshot").alias("home"), home_x.alias("home_x"))
        mine = texts.join(shared.withColumn("several", F.lit(True)), "digest", "left")
        mine = mine.select("digest", "norm", F.when(F.col("several"), F.concat(F.lit("="), "norm")).otherwise("").alias("x"))
        met = mine.join(old, ["digest", "norm"]).groupBy("digest", "x").agg(F.min(F.struct("home", "home_x")).alias("h"))
        return met.select("digest", "x", "h.home", "h.home_x")

    def report(self) -> DataFrame:
        """doc_id, keep_id, group_size, kept, sha, snapshot, home (the snapshot that had the text first) of every row of all snapshots.

        Of equal texts the row of the most characters stays, then of the smallest id (null ids last); among repeated rows one. Texts that many rows
        have are sent to all tasks: at most ``HOT``.
        """
        k = self.snapshots()
        if not k:
            raise ValueError("nothing was added")
        read = lambda name: self._all(name, self.spark.read.parquet(f"{self.path}/{name}/snapshot=1").schema, k)
        groups, rows, shared = read("groups"), read("rows"), read("shared")
        total = groups.groupBy("home", "digest", "home_x").agg(F.sum("n").alias("group_size"), F.min("first").alias("best"))
        told = groups.select("snapshot", "digest", "x", "n", "home", "home_x").join(total, ["home", "digest", "home_x"])
        told = staged(told.select("snapshot", "digest", "x", "n", "home", "group_size", "best"), "told")
        x = F.lit("")
        if not shared.isEmpty():
            rows = rows.join(shared.withColumn("several", F.lit(True)), ["snapshot", "digest"], "left")
            x = F.when(F.col("several"), F.concat(F.lit("="), "norm")).otherwise("")
        rows = rows.select("snapshot", "digest", x.alias("x"), "doc_id", "row", "sha")
        most = (told.agg(F.sum("n")).first()[0] or 0) // HOT
        keys = ["snapshot", "digest", "x"]
        hot = F.broadcast(told.filter(F.col("n") > most).filter("n > 1"))
        cold = rows.join(hot, keys, "left_anti").join(told.filter((F.col("n") <= most) | (F.col("n") == 1)), keys)
        both = rows.join(hot, keys).unionByName(cold)
        kept = (F.col("snapshot") == F.col("best.snapshot")) & (F.col("row") == F.col("best.row"))
        return both.select("doc_id", F.col("best.doc_id").alias("keep_id"), "group_size", kept.alias("kept"), "sha", "snapshot", "home")


def leading(digest: Column, bits: int) -> Column:
    """The first ``bits`` of a digest."""
    return F.shiftrightunsigned(digest, 64 - bits) if bits else F.lit(0).cast("long")
