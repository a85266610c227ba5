"""Size-tiered compaction: small immutable shards, merged into target-sized files under a versioned manifest."""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import asdict, dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType


@dataclass(frozen=True)
class Shard:
    """An immutable shard: ``name`` is its folder under data/, ``size`` the bytes of its rows as text."""

    name: str
    rows: int
    size: int


#: Names of live shards (some tens of bytes each) that are sent to every task; more are joined.
MOST_SENT = 100_000
#: One line of a version's file: a shard that the version adds, or (with ``gone``) one that it takes away.
CHANGE = "name string, rows long, size long, gone boolean"


def all_columns(known: StructType, new: StructType) -> StructType:
    """The columns of both, those of ``known`` first, all nullable. One name with two types, or two names that differ in case only, are refused."""
    named = {f.name.lower(): f for f in known.fields}
    for f in new.fields:
        old = named.setdefault(f.name.lower(), f)
        if old.name != f.name or old.dataType.simpleString() != f.dataType.simpleString():
            raise ValueError(f"column {f.name} {f.dataType.simpleString()} doesn't agree with the store's {old.name} {old.dataType.simpleString()}")
    return StructType([StructField(f.name, f.dataType, True) for f in named.values()])


class ShardStore:
    """Shards under ``path``: data/run=R/shard=S folders, and log/v-N files, each with what version N adds and takes away.

    Repeated rows, nulls and any column names are kept as they come; an empty arrival adds a version without new shards. Arrivals may have
    different columns: a version's file holds the columns of all arrivals so far, and shards are read with them, null where a shard has none.
    An arrival with a column of another type than the store's is refused, and adds nothing.
    Writers add data first and then commit the changes as the next version, which exactly one writer can get; readers see the last
    committed version. What is live is worked out by Spark from the log: from the last snapshot (one in ``every`` versions) and the
    changes since. Only a version's own changes, and the bounded plan of one round of merges, pass the driver; rows stay in Spark.
    """

    def __init__(self, spark: SparkSession, path: str, target: int, fan_in: int = 4, size_col: str = "text", every: int = 16):
        self.spark, self.path, self.target, self.fan_in, self.size_col, self.every = spark, path.rstrip("/"), target, fan_in, size_col, every
        jvm = spark.sparkContext._jvm
        self.Path = jvm.org.apache.hadoop.fs.Path
        self.fs = self.Path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self.fs.mkdirs(self.Path(f"{self.path}/log"))

    def _numbers(self, folder: str, done: str = "") -> list[int]:
        at = self.Path(f"{self.path}/{folder}")
        names = [s.getPath().getName() for s in self.fs.listStatus(at)] if self.fs.exists(at) else []
        return sorted(int(n[2:]) for n in names if n.startswith("v-") and (not done or self.fs.exists(self.Path(f"{self.path}/{folder}/{n}/{done}"))))

    def version(self) -> int:
        return max(self._numbers("log"), default=0)

    def live(self, version: int | None = None) -> DataFrame:
        """name, rows, size of the shards of a version, the last one by default."""
        version = self.version() if version is None else version
        snapshot = max((n for n in self._numbers("snapshots", "_SUCCESS") if n <= version), default=0)
        changes = self.spark.createDataFrame([], CHANGE)
        if snapshot:
            changes = self.spark.read.schema(CHANGE).parquet(f"{self.path}/snapshots/v-{snapshot}")
        if files := [f"{self.path}/log/v-{n}" for n in range(snapshot + 1, version + 1)]:
            changes = changes.unionByName(self.spark.read.schema(CHANGE).json(files).filter("name is not null"))
        found = changes.groupBy("name").agg(F.max("rows").alias("rows"), F.max("size").alias("size"), F.max("gone").alias("gone"))
        return found.filter("not gone").select("name", "rows", "size")

    def columns(self, version: int | None = None) -> StructType:
        """The columns of all arrivals up to a version, the last one by default."""
        version = self.version() if version is None else version
        if not version:
            return StructType()
        said = self.spark.read.schema("columns string").json(f"{self.path}/log/v-{version}").filter("columns is not null").first()
        return StructType.fromJson(json.loads(said.columns))

    def _read(self, version: int, folders: list[str] | None = None) -> DataFrame:
        """row, run, shard of the shards in ``folders``, of all by default, with the columns of a version."""
        fields = [StructField("row", self.columns(version)), StructField("run", StringType()), StructField("shard", IntegerType())]
        reader = self.spark.read.schema(StructType(fields)).option("basePath", f"{self.path}/data")
        return reader.parquet(*(folders or [f"{self.path}/data"]))

    def manifest(self, version: int | None = None) -> list[Shard]:
        """The shards of a version as a list, for small stores."""
        return [Shard(*r) for r in self.live(version).orderBy("name").collect()]

    def commit(self, added: list[Shard], removed: list[str], base: int, columns: StructType | None = None) -> int:
        """Make version base + 1 of ``base`` and the changes (``columns``: the store's from now on); raises if another writer has made that version.

        The finished file takes the version's name only if no file has it: by a hard link on a local file system, by a rename, which
        HDFS refuses then, elsewhere. An object store without such a rename needs a lock of its own.
        """
        jvm, lines = self.spark.sparkContext._jvm, [asdict(s) | {"gone": False} for s in added] + [{"name": n, "gone": True} for n in removed]
        lines.append({"columns": (columns or self.columns(base)).json()})
        draft, to = (self.Path(f"{self.path}/log/{n}") for n in (f".draft-{jvm.java.util.UUID.randomUUID()}", f"v-{base + 1}"))
        out = self.fs.create(draft, False)
        out.write(bytearray("".join(json.dumps(x) + "\n" for x in lines).encode()))
        out.close()
        if self.fs.getUri().getScheme() == "file":
            file = lambda p: jvm.java.io.File(p.toUri().getPath()).toPath()
            try:
                jvm.java.nio.file.Files.createLink(file(to), file(draft))
                made = True
            except Py4JJavaError as e:
                if not e.java_exception.getClass().getName().endswith("FileAlreadyExistsException"):
                    raise
                made = False
            self.fs.delete(draft, False)
        else:
            made = self.fs.rename(draft, to)
        if not made:
            raise RuntimeError(f"version {base + 1} was committed by another writer")
        if (base + 1) % self.every == 0:
            self.live(base + 1).withColumn("gone", F.lit(False)).write.mode("overwrite").parquet(f"{self.path}/snapshots/v-{base + 1}")
        return base + 1

    def _write(self, df: DataFrame, run: str) -> list[Shard]:
        """Write ``df`` (row: struct, shard: int) and list what was written; only the rows' sizes are read back."""
        sized = self.size_col in df.schema["row"].dataType.names  # an arrival may come without the column
        size = F.coalesce(F.octet_length(F.col("row")[self.size_col]), F.lit(0)).cast("long") if sized else F.lit(0).cast("long")
        df.withColumn("size", size).write.option("compression", "zstd").partitionBy("shard").parquet(f"{self.path}/data/run={run}")
        if not any(s.isDirectory() for s in self.fs.listStatus(self.Path(f"{self.path}/data/run={run}"))):
            return []
        got = self.spark.read.schema("size long, shard int").parquet(f"{self.path}/data/run={run}").groupBy("shard").agg(F.count("*").alias("n"), F.sum("size").alias("b")).collect()
        return sorted((Shard(f"run={run}/shard={r.shard}", r.n, r.b) for r in got), key=lambda s: s.name)

    def append(self, arrival: DataFrame) -> int:
        """Add an arrival, every task's rows as one small shard, and commit. Nothing is shuffled."""
        base = self.version()
        columns = all_columns(self.columns(base), arrival.schema)
        row = F.struct(*[F.col(f"`{c}`") for c in arrival.columns]).alias("row")
        run = f"a{base + 1}-{uuid.uuid4().hex[:8]}"  # another writer of this version has another run
        return self.commit(self._write(arrival.select(row, F.spark_partition_id().alias("shard")), run), [], base, columns)

    def tier(self, size: Column) -> Column:
        """How often the size of the smallest shards grows ``fan_in``-fold up to this one, 3 at most."""
        low = max(1, self.target // self.fan_in**3)
        return sum((size >= low * self.fan_in ** (k + 1)).cast("int") for k in range(3))

    def plan(self, version: int | None = None, most: int = 50_000) -> dict[str, int]:
        """Shard name -> number of its merge: runs of one tier, filled to the target in order of size.

        A tier is merged when it holds at least ``fan_in`` shards under half the target; a merge of one shard is left out.
        One round takes the first such tier, and ``most`` of its shards at most, the smallest first; ``compact`` goes on with the rest.
        """
        small = self.live(version).filter(F.col("size") < self.target // 2).withColumn("tier", self.tier(F.col("size")))
        full = [r.tier for r in small.groupBy("tier").agg(F.count("*").alias("n")).filter(F.col("n") >= self.fan_in).collect()]
        for t in sorted(full):
            groups, held, merges = [[]], 0, {}
            for r in small.filter(F.col("tier") == t).orderBy("size", "name").limit(most).collect():
                if groups[-1] and held + r.size > self.target:
                    groups.append([])
                    held = 0
                groups[-1].append(r.name)
                held += r.size
            for number, group in enumerate(g for g in groups if len(g) > 1):
                merges |= dict.fromkeys(group, number)
            if merges:
                return merges
        return {}

    def slots(self, n: int) -> list[int]:
        """For each of ``n`` partitions a number that Spark's hash sends there."""
        ids = self.spark.range(40 * n).select(F.col("id").cast("int").alias("slot"))
        got = ids.groupBy(F.pmod(F.hash("slot"), F.lit(n)).alias("part")).agg(F.min("slot").alias("slot")).collect()
        return [{r.part: r.slot for r in got}.get(k, k) for k in range(n)]

    def compact(self) -> int:
        """Merge by ``plan`` until nothing is left to merge; each round commits one version. Returns the last version.

        Every merge is one partition of one shuffle, and one file. The plan of a round is bounded, so it is sent to every task.
        """
        while merges := self.plan(base := self.version()):
            n = len(set(merges.values()))
            slots = self.slots(n)
            moves = [(name[4:].split("/shard=")[0], int(name.split("/shard=")[1]), k, slots[k]) for name, k in merges.items()]
            lookup = self.spark.createDataFrame(moves, "run string, shard int, merge int, slot int")
            old = self._read(base, [f"{self.path}/data/{m}" for m in merges])
            rows = old.join(F.broadcast(lookup), ["run", "shard"])
            rows = rows.select("row", "merge", "slot").repartition(n, "slot").select("row", F.col("merge").alias("shard"))
            new = self._write(rows, f"m{base + 1}-{uuid.uuid4().hex[:8]}")
            asked = self.spark.createDataFrame([(m,) for m in merges], "name string")
            if sum(s.rows for s in new) != self.live(base).join(F.broadcast(asked), "name").agg(F.sum("rows")).first()[0]:
                raise RuntimeError("a merge changed the number of rows")
            self.commit(new, list(merges), base)
        return self.version()

    def rows(self) -> DataFrame:
        """row (a struct of the columns), run and shard of all rows of the last version."""
        version = self.version()
        live = self.live(version)
        n = live.limit(MOST_SENT + 1).count()
        if not n:
            return self.spark.createDataFrame([], StructType([StructField("row", self.columns(version)), StructField("run", StringType()), StructField("shard", IntegerType())]))
        stored = self._read(version)
        parts = live.select(F.regexp_extract("name", "run=([^/]*)", 1).alias("run"), F.regexp_extract("name", "shard=(.*)", 1).cast("int").alias("shard"))
        return stored.join(F.broadcast(parts) if n <= MOST_SENT else parts, ["run", "shard"], "left_semi").select("row", "run", "shard")

    def vacuum(self, keep_seconds: float = 7 * 24 * 3600) -> None:
        """Delete what no version of the last ``keep_seconds`` holds: shards that an older version took away, and older runs that no version names.

        Readers and writers that began within that time keep their files. 0 is for a store that nobody else uses.
        """
        last, limit = self.live().select("name"), time.time() * 1000 - keep_seconds * 1000
        old = lambda path: self.fs.getFileStatus(self.Path(path)).getModificationTime() <= limit
        versions = self._numbers("log")
        if files := [f"{self.path}/log/v-{n}" for n in versions if old(f"{self.path}/log/v-{n}")]:
            gone = self.spark.read.schema(CHANGE).json(files).filter("gone").select("name").distinct().join(last, "name", "left_anti")
            for r in gone.toLocalIterator():
                self.fs.delete(self.Path(f"{self.path}/data/{r.name}"), True)
        at = self.Path(f"{self.path}/data")
        runs = [s.getPath().getName() for s in self.fs.listStatus(at) if s.getModificationTime() <= limit] if self.fs.exists(at) else []
        if runs and versions:
            named = self.spark.read.schema(CHANGE).json([f"{self.path}/log/v-{n}" for n in versions]).filter("name is not null")
            named = named.select(F.regexp_extract("name", "^([^/]*)", 1).alias("run")).distinct()
            lost = self.spark.createDataFrame([(r,) for r in runs], "run string").join(named, "run", "left_anti")
            for r in lost.toLocalIterator():
                self.fs.delete(self.Path(f"{self.path}/data/{r.run}"), True)
