"""Keyed tables as immutable versions: merges rewrite the buckets they touch, readers resolve the last version when they read."""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.common import latest
from ..staging import commit_file, delete, new_folder, staged


@dataclass
class Version:
    """``live``: the folder of each bucket's rows; ``batches``: the last batch of each writer that the version holds."""

    number: int = 0
    live: dict[int, str] = field(default_factory=dict)
    batches: dict[str, int] = field(default_factory=dict)


class VersionedTable:
    """A table with one row for each key, under ``path``: data/<write>/bucket=B folders, never changed, and log/v-N files that name the live ones.

    A version's file is made by exactly one writer, whole or not at all; it is the pointer that readers follow. A writer that loses the race works on the
    version that won. A file has one line for each bucket, so it stays as small as ``buckets``, which is fixed when the table is made.
    Keys are dealt to buckets by hash; null is a key like any other. Old versions can be read until ``vacuum``.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, key: str = "item", buckets: int = 64):
        self.spark, self.path, self.schema, self.key, self.buckets = spark, path.rstrip("/"), schema, key, buckets
        self.Path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self.fs = self.Path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self.fs.mkdirs(self.Path(f"{self.path}/log"))

    def _versions(self) -> dict[int, int]:
        """Number -> time of its file, in milliseconds."""
        listed = self.fs.listStatus(self.Path(f"{self.path}/log"))
        return {int(s.getPath().getName()[2:]): s.getModificationTime() for s in listed if s.getPath().getName().startswith("v-")}

    def version(self, number: int | None = None) -> Version:
        """A version by number, by default the last; version 0 is empty."""
        number = max(self._versions(), default=0) if number is None else number
        out = Version(number)
        if number:
            file = self.fs.open(self.Path(f"{self.path}/log/v-{number}"))
            for line in self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(file, "UTF-8").splitlines():
                said = json.loads(line)
                if "writer" in said:
                    out.batches[said["writer"]] = said["batch"]
                else:
                    out.live[said["bucket"]] = said["folder"]
            file.close()
        return out

    def before(self, writer: str, batch: int) -> int:
        """The last version without ``batch`` of ``writer``."""
        number = max(self._versions(), default=0)
        while self.version(number).batches.get(writer, -1) >= batch:
            number -= 1
        return number

    def read(self, number: int | None = None) -> DataFrame:
        """The rows of a version, the last one when this is called by default."""
        return self._rows(self.version(number))

    def _rows(self, version: Version, buckets: set[int] | None = None) -> DataFrame:
        paths = [f"{self.path}/data/{folder}/bucket={b}" for b, folder in version.live.items() if buckets is None or b in buckets]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def merge(self, updates: DataFrame, order: list[str], writer: str = "", batch: int | None = None) -> int:
        """Upsert: of each key the last row by ``order`` over the table and ``updates`` (among equals an update); returns the version that has them.

        Only buckets with updates are read and written. With a ``writer`` a ``batch`` that the table already has changes nothing, so a repeated
        micro-batch is harmless; batches of a writer come in order.
        """
        return self._commit(updates, order, writer, batch, False)

    def overwrite(self, rows: DataFrame, order: list[str], writer: str = "", batch: int | None = None) -> int:
        """Replace all rows; of repeated keys the last row by ``order`` is taken."""
        return self._commit(rows, order, writer, batch, True)

    def _commit(self, updates: DataFrame, order: list[str], writer: str, batch: int | None, replace: bool) -> int:
        path = new_folder(self.spark, "updates")
        rows = None
        while True:
            base = self.version()
            if batch is not None and base.batches.get(writer, -1) >= batch:
                break
            if rows is None:
                fields = [f"`{f.name}`" for f in self.spark.createDataFrame([], self.schema).schema]
                rows = staged(updates.select(*fields), "updates", path)
                touched = {r[0] for r in rows.select(self.bucket()).distinct().collect()}  # at most ``buckets`` numbers
            both = rows.withColumn("__src", F.lit(1))
            if not replace:
                both = self._rows(base, touched).withColumn("__src", F.lit(0)).unionByName(both)
            best = latest(both, [self.key], [*order, "__src"]).drop("__src").withColumn("bucket", self.bucket())
            folder = uuid.uuid4().hex
            if touched:
                best.repartition(len(touched), "bucket").write.option("compression", "zstd").partitionBy("bucket").parquet(f"{self.path}/data/{folder}")
            live = ({} if replace else base.live) | dict.fromkeys(touched, folder)
            batches = base.batches | ({writer: batch} if batch is not None else {})
            lines = [{"bucket": b, "folder": f} for b, f in sorted(live.items())] + [{"writer": w, "batch": n} for w, n in batches.items()]
            if commit_file(self.spark, f"{self.path}/log/v-{base.number + 1}", "".join(json.dumps(x) + "\n" for x in lines)):
                base = Version(base.number + 1)
                break
            delete(self.spark, f"{self.path}/data/{folder}")
        if rows is not None:
            delete(self.spark, path)
        return base.number

    def vacuum(self, keep_seconds: float = 7 * 24 * 3600) -> None:
        """Delete data that neither the last version nor one of the last ``keep_seconds`` names, if it is older than that. 0 is for a table without other users."""
        limit, versions = time.time() * 1000 - keep_seconds * 1000, self._versions()
        named = {f"{folder}/bucket={b}" for n, at in versions.items() if at > limit or n == max(versions) for b, folder in self.version(n).live.items()}
        data = self.Path(f"{self.path}/data")
        for write in self.fs.listStatus(data) if self.fs.exists(data) else []:
            if write.getModificationTime() <= limit:
                name = write.getPath().getName()
                parts = [s.getPath().getName() for s in self.fs.listStatus(write.getPath()) if s.isDirectory()]
                gone = [p for p in parts if f"{name}/{p}" not in named]
                for p in [None] if len(gone) == len(parts) else gone:
                    self.fs.delete(self.Path(f"{self.path}/data/{name}" + (f"/{p}" if p else "")), True)
        for n, at in versions.items():
            if at <= limit and n != max(versions):
                self.fs.delete(self.Path(f"{self.path}/log/v-{n}"), False)
