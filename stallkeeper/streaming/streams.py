"""Structured Streaming forms of the batch operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..operators.deals import score, screen
from ..sources.versioned import VersionedTable
from ..staging import new_folder

#: Rows later than this behind the newest event are dropped, and counted by the query's progress.
LATENESS = "1 day"


def stream_listings(spark: SparkSession, path: str, schema: StructType, ts: str = "posted_at", files: int = 1000) -> DataFrame:
    """Stream of the files under ``path`` (a folder, one file or a pattern), up to ``files`` in a batch, with a watermark on ``ts``."""
    pattern = path if "*" in path else f"{path[:-1]}[{path[-1]}]"  # a pattern may name a file, a plain path only a folder
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(pattern)
    return rows.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, LATENESS)


def dedupe_stream(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each key within the watermark; the state is bounded by time."""
    return df.dropDuplicatesWithinWatermark(keys)


def daily_counts_stream(df: DataFrame, ts: str = "posted_at") -> DataFrame:
    return df.groupBy(F.window(ts, "1 day")).agg(F.count("*").alias("n")).select(F.col("window.start").alias("day"), "n")


#: What a stream does with a micro-batch and its number.
Each = Callable[[DataFrame, int], DataFrame]


def priced_by(prices: VersionedTable, key: str, writer: str | None = None) -> Each:
    """For each micro-batch: its rows with the price table's columns, as of the table's last version when the batch runs.

    Prices appended or overwritten while the stream runs are seen by the next batch; a version once read isn't changed under it. With the ``writer`` by
    which the same stream merges its quotes (``merging``), it is the last version before this batch's quotes, also when the batch is repeated.
    """
    return lambda batch, n: batch.join(prices.read(prices.before(writer, n) if writer else None), F.col(key) == F.col(prices.key))


def priced_deals(prices: VersionedTable, min_margin: float, min_volume: float, key: str = "item", writer: str | None = None, **options) -> Each:
    """For each micro-batch of asks: its screened deals at the prices that ``priced_by`` gives."""
    return lambda batch, n: deal_stream(priced_by(prices, key, writer)(batch, n), min_margin, min_volume, **options)


def deal_stream(df: DataFrame, min_margin: float, min_volume: float, **options) -> DataFrame:
    return screen(score(df), min_margin, min_volume, **options)


def whole(batch: DataFrame, n: int) -> DataFrame:
    return batch


def write_batches(df: DataFrame, path: str, each: Each = whole, then: Callable[[DataFrame, int], None] | None = None) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function: a batch goes to its own folder, so a repeated batch replaces itself. ``then`` sees the batch after that."""

    def write(batch: DataFrame, batch_id: int) -> None:
        each(batch, batch_id).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
        if then:
            then(batch, batch_id)

    return write


def merging(prices: VersionedTable, order: list[str], writer: str, quotes: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
    """For ``then``: merges the quotes of each micro-batch into the price table. A batch that the table has already changes nothing.

    The batch's deals are written before its quotes are merged; one that is repeated writes the same deals, if they come from ``priced_by`` with ``writer``.
    """

    def then(batch: DataFrame, batch_id: int) -> None:
        prices.merge(quotes(batch), order, writer, batch_id)

    return then


def run_available(df: DataFrame, mode: str = "append", each: Each = whole, path: str | None = None,
                  then: Callable[[DataFrame, int], None] | None = None) -> DataFrame:
    """Run a stream over all that is there and read what its batches wrote; with ``path``, a later call goes on from the last one.

    Without any input there is no batch; the result is then empty, with the columns of ``each`` of an empty batch.
    """
    spark = df.sparkSession
    path = path or new_folder(spark, "stream")
    query = started(df, path, mode, each, then, availableNow=True)
    query.awaitTermination()
    out = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/out")
    if out.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(out):
        return spark.read.parquet(f"{path}/out")
    return each(spark.createDataFrame([], df.schema), 0).withColumn("batch", F.lit(0))


def started(df: DataFrame, path: str, mode: str = "append", each: Each = whole,
            then: Callable[[DataFrame, int], None] | None = None, **trigger) -> StreamingQuery:
    """Start a stream that writes its batches under ``path``; every 10 minutes unless a trigger is given."""
    writer = df.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/checkpoint").foreachBatch(write_batches(df, f"{path}/out", each, then))
    return writer.trigger(**(trigger or {"processingTime": "10 minutes"})).start()
