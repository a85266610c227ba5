"""Folders that driver and executors share, and the package on the executors."""

from __future__ import annotations

import shutil
import tempfile
import uuid
from pathlib import Path

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session.

    Only a local master may run without it; it then gets a temporary folder of its own.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("stallkeeper.shared.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="stallkeeper-")
        spark.conf.set("stallkeeper.shared.dir", path)
    return path.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other call gets."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage, survives lost executors.

    With a ``path`` of its own (from ``new_folder``) a caller can ``delete`` the table once nothing reads it any more.
    """
    path = path or new_folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder that ``new_folder`` named."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def commit_file(spark: SparkSession, path: str, text: str) -> bool:
    """Make the file ``path`` of ``text`` if nobody has made it: whole or not at all. Returns whether this call made it.

    The finished file takes its name by a hard link on a local file system, elsewhere by a rename, which HDFS refuses where the name is taken. An
    object store without such a rename needs a lock of its own.
    """
    jvm = spark.sparkContext._jvm
    to = jvm.org.apache.hadoop.fs.Path(path)
    fs = to.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    draft = jvm.org.apache.hadoop.fs.Path(to.getParent(), f".draft-{uuid.uuid4().hex}")
    out = fs.create(draft, False)
    out.write(bytearray(text.encode()))
    out.close()
    if fs.getUri().getScheme() != "file":
        return fs.rename(draft, to)
    local = lambda p: jvm.java.io.File(p.toUri().getPath()).toPath()
    try:
        jvm.java.nio.file.Files.createLink(local(to), local(draft))
        return True
    except Py4JJavaError as e:
        if not e.java_exception.getClass().getName().endswith("FileAlreadyExistsException"):
            raise
        return False
    finally:
        fs.delete(draft, False)


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once for each application, whatever folder the driver was started in."""
    sc, package = spark.sparkContext, Path(__file__).parent
    if f"{package.name}.zip" not in sc._python_includes:
        folder = tempfile.mkdtemp(prefix="stallkeeper-")
        sc.addPyFile(shutil.make_archive(f"{folder}/{package.name}", "zip", package.parent, package.name))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of a file's row group, the least that a scan can split.
ROW_GROUP = 128 << 20


def spread(df: DataFrame, *key: str) -> DataFrame:
    """``df``; where there is less than a row group for each core, its rows are dealt over all cores, as one row group is one task. Large inputs stay as they are.

    Rows are dealt by the hash of ``key``, columns that few rows share; without one by turns, for which Spark sorts them first.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())  # Catalyst's estimate, no job
    return df.repartition(cores, *key) if size < cores * ROW_GROUP else df
