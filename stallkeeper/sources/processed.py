"""Ids that runs have handled, in segments with Bloom filters: a run reads only the segments that may hold one of its ids."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import has_id
from ..staging import commit_file, staged

#: Bits of a shard's filter, what bitmap_construct_agg makes.
BITS = 32768
#: Hashes of an id in its filter.
HASHES = 6
#: Ids a shard is made for: 16 bits for each, so about one absent id in 1,000 passes.
IDS = 2048
#: Segments of one tier that are merged into one of the next.
FANOUT = 8
#: Filters of up to this many bytes in all, those of the smallest segments, go to every task: their few shards would be hot keys of a join.
MOST_SENT = 32 << 20
#: Ids that a task may hold in a hash table, so that rows joined with them need no sort.
MOST_HASHED = 1_000_000
#: Up to this many shards are asked for by number, which prunes row groups; beyond it a segment is read whole.
MOST_SHARDS = 1000


@dataclass(frozen=True)
class Segment:
    """Ids of the runs ``first`` to ``last`` in ``folder``; ``tier`` merges made it, ``shards`` is a power of two."""

    folder: str
    first: int
    last: int
    tier: int
    shards: int


def shard_of(shards: Column | int) -> Column:
    return F.pmod(F.xxhash64("id"), F.lit(shards) if isinstance(shards, int) else shards).cast("int")


def positions() -> list[Column]:
    """The bits of an id in its shard's filter."""
    return [F.pmod(F.xxhash64("id", F.lit(k)), F.lit(BITS)).cast("int") for k in range(HASHES)]


def passes(bits: str = "bits") -> Column:
    """Whether the filter has all bits of the id; the first that it lacks ends the test."""
    found = F.lit(True)
    for p in positions():
        byte = F.conv(F.hex(F.substring(F.col(bits), (p / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        found = found & (F.getbit(byte, p % 8) == 1)
    return found


class ProcessedIds:
    """Ids by run under ``path``: data/<segment>/ids and /filters, never changed, and log/v-N files that name the live segments.

    A version's file is made by one writer, whole or not at all; who loses the race starts again from the version that won. ``FANOUT`` segments of a
    tier are merged into one, so there are about ``FANOUT`` times the logarithm of the runs. Segments keep the run of every id, so a run can be
    repeated at any time: it does not see its own ids, and replaces them. Null and empty ids are never kept.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.Path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self.fs = self.Path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def version(self) -> tuple[int, list[Segment]]:
        """The number of the last version and its segments; 0 and none before the first run."""
        log = self.Path(f"{self.path}/log")
        named = [s.getPath().getName() for s in self.fs.listStatus(log)] if self.fs.exists(log) else []
        number = max((int(n[2:]) for n in named if n.startswith("v-")), default=0)
        if not number:
            return 0, []
        file = self.fs.open(self.Path(f"{self.path}/log/v-{number}"))
        text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(file, "UTF-8")
        file.close()
        return number, [Segment(**json.loads(line)) for line in text.splitlines()]

    def _rows(self, segments: list[Segment], shards: list[tuple[str, int]] | None = None) -> DataFrame:
        """id, run of segments; with ``shards`` only the rows of those shards (folder, number)."""
        each = []
        for s in segments:
            rows = self.spark.read.schema("id string, run int, shard int").parquet(f"{self.path}/data/{s.folder}/ids")
            each.append((rows if shards is None else rows.filter(F.col("shard").isin([n for folder, n in shards if folder == s.folder]))).drop("shard"))
        return reduce(DataFrame.unionByName, each) if each else self.spark.createDataFrame([], "id string, run int")

    def ids(self, but_run: int = -1) -> DataFrame:
        """id of all that runs other than ``but_run`` have handled, from every segment."""
        return self._rows(self.version()[1]).filter(F.col("run") != but_run).select("id").distinct()

    def candidates(self, ids: DataFrame, segments: list[Segment]) -> DataFrame:
        """id, folder, shard of distinct ``ids`` (id) and the segments whose filters let them pass: all that hold them, and few others."""
        sent, size = set(), 0
        for s in sorted(segments, key=lambda s: s.shards):
            size += s.shards * BITS // 8
            if size <= MOST_SENT:
                sent.add(s.folder)
        small, large = [s for s in segments if s.folder in sent], [s for s in segments if s.folder not in sent]
        found = [self._screen(ids, part, how) for part, how in ((small, F.broadcast), (large, lambda df: df)) if part]
        return reduce(DataFrame.unionByName, found)

    def _screen(self, ids: DataFrame, segments: list[Segment], how: Callable[[DataFrame], DataFrame]) -> DataFrame:
        each = []
        for s in segments:
            mine = self.spark.read.schema("shard int, bits binary").parquet(f"{self.path}/data/{s.folder}/filters")
            each.append(mine.select(F.lit(s.folder).alias("folder"), F.lit(s.shards).alias("shards"), "shard", "bits"))
        sizes = F.explode(F.array(*[F.lit(n) for n in sorted({s.shards for s in segments})])).alias("shards")  # powers of two: a few numbers
        asked = ids.select("id", sizes).withColumn("shard", shard_of(F.col("shards")))
        return asked.join(how(reduce(DataFrame.unionByName, each)), ["shards", "shard"]).filter(passes()).select("id", "folder", "shard")

    def seen(self, ids: DataFrame, but_run: int = -1) -> DataFrame:
        """Those of ``ids`` (id) that a run other than ``but_run`` has handled, once each."""
        asked = ids.select(F.col("id").cast("string").alias("id")).filter(has_id(F.col("id"))).distinct()
        return asked.join(self.handled(ids, but_run), "id", "left_semi")

    def handled(self, ids: DataFrame, but_run: int = -1) -> DataFrame:
        """id that runs other than ``but_run`` have handled, for a join: all of ``ids`` among them, and maybe others; an id may come twice.

        The smallest segments, with no more ids in all than are asked for, are given whole: to screen that many ids would cost more than to join
        them. Of the others filters are read, ids only of segments and shards that may hold one that is asked for.
        """
        segments = sorted((s for s in self.version()[1] if (s.first, s.last) != (but_run, but_run)), key=lambda s: s.shards)
        if not segments:
            return self.spark.createDataFrame([], "id string")
        asked, whole = ids.count(), []
        while segments and sum(s.shards for s in [*whole, segments[0]]) * IDS <= asked:
            whole.append(segments.pop(0))
        known = self._rows(whole).filter(F.col("run") != but_run).select("id")
        if segments:
            return known.unionByName(self._screened(ids, segments, but_run)) if whole else self._screened(ids, segments, but_run)
        hashed = sum(s.shards for s in whole) * IDS <= MOST_HASHED * int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        return known.hint("shuffle_hash") if hashed else known

    def _screened(self, ids: DataFrame, segments: list[Segment], but_run: int) -> DataFrame:
        """id of ``segments``: all of ``ids`` among them, and some others."""
        may = staged(self.candidates(ids.select(F.col("id").cast("string").alias("id")).filter(has_id(F.col("id"))).distinct(), segments), "may-be-seen")
        hit = may.select("folder", "shard").distinct().limit(MOST_SHARDS + 1).collect()
        if len(hit) > MOST_SHARDS:
            folders, shards = {r[0] for r in may.select("folder").distinct().collect()}, None  # at most one for each segment
        else:
            shards = [(r[0], r[1]) for r in hit]
            folders = {f for f, _ in shards}
        known = self._rows([s for s in segments if s.folder in folders], shards).filter(F.col("run") != but_run)
        return known.select("id").join(may.select("id"), "id", "left_semi")

    def _write(self, rows: DataFrame, first: int, last: int, tier: int) -> Segment:
        """A new segment of ``rows`` (id, run), which are counted, sampled and dealt: three readings. Rows that are repeated meet in their shard and are kept once."""
        rows = rows.select("id", F.col("run").cast("int").alias("run"))
        n, shards = rows.count(), 1
        while shards * IDS < n:
            shards *= 2
        folder = uuid.uuid4().hex
        to, placed = f"{self.path}/data/{folder}", rows.withColumn("shard", shard_of(shards))
        files = max(1, min(shards, shards * IDS // 1_000_000))
        dealt = placed.repartitionByRange(files, "shard") if files > 1 else placed.coalesce(1)
        dealt.dropDuplicates(["shard", "id", "run"]).sortWithinPartitions("shard", "id").write.option("compression", "zstd").parquet(f"{to}/ids")
        written = self.spark.read.schema("id string, run int, shard int").parquet(f"{to}/ids")
        bits = written.select("shard", F.explode(F.array(*positions())).alias("p")).groupBy("shard").agg(F.bitmap_construct_agg("p").alias("bits"))
        bits.repartition(max(1, files // 8)).write.parquet(f"{to}/filters")
        return Segment(folder, first, last, tier, shards)

    def _commit(self, number: int, segments: list[Segment]) -> bool:
        self.fs.mkdirs(self.Path(f"{self.path}/log"))
        return commit_file(self.spark, f"{self.path}/log/v-{number + 1}", "".join(json.dumps(asdict(s)) + "\n" for s in segments))

    def append(self, ids: DataFrame, run: int) -> None:
        """Keep the ids (id, of a stored table: they are read three times) that ``run`` handled, in place of those it may have kept before; then merge what has become many."""
        mine = self._write(ids.select(F.col("id").cast("string").alias("id"), F.lit(run).alias("run")).filter(has_id(F.col("id"))), run, run, 0)
        while True:
            number, segments = self.version()
            live = [s for s in segments if not s.first <= run <= s.last]
            for s in segments:
                if s.first <= run <= s.last and s.first != s.last:
                    live.append(self._write(self._rows([s]).filter(F.col("run") != run), s.first, s.last, s.tier))
            if self._commit(number, [*live, mine]):
                break
        while self._merge():
            pass

    def _merge(self) -> bool:
        """Merge the oldest ``FANOUT`` segments of the lowest tier that has as many; False if none has, or another writer was faster."""
        number, segments = self.version()
        for tier in sorted({s.tier for s in segments}):
            old = sorted((s for s in segments if s.tier == tier), key=lambda s: s.first)[:FANOUT]
            if len(old) == FANOUT:
                merged = self._write(self._rows(old), min(s.first for s in old), max(s.last for s in old), tier + 1)
                return self._commit(number, [*(s for s in segments if s not in old), merged])
        return False

    def vacuum(self, keep_seconds: float = 7 * 24 * 3600) -> None:
        """Delete segments that the last version doesn't name, if they are older than ``keep_seconds``. 0 is for a store without other users."""
        limit, named = time.time() * 1000 - keep_seconds * 1000, {s.folder for s in self.version()[1]}
        data = self.Path(f"{self.path}/data")
        for s in self.fs.listStatus(data) if self.fs.exists(data) else []:
            if s.getModificationTime() <= limit and s.getPath().getName() not in named:
                self.fs.delete(s.getPath(), True)
