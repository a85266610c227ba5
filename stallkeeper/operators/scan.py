"""One run over new listings, from their texts to stored deals; a batch, or a micro-batch of a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.processed import ProcessedIds
from ..sources.versioned import VersionedTable
from ..staging import staged
from .deals import named_listings, new_listings, score, screen
from .prices import Source, match_price, price_cascade

#: The name by which scans write into the price table.
WRITER = "scan"


def scan(listings: DataFrame, folder: str, run: int, full: DataFrame, patterns: DataFrame, prices: VersionedTable, sources: list[tuple[str, Source]],
         min_margin: float = 5, min_volume: float = 50) -> DataFrame:
    """The deals of run number ``run``: id, name, mode, ask, price_twd, volume, match_kind, net, profit, margin.

    Listings (id, content) that no earlier run has handled get their name from the dictionaries and their price from the table by that name, else from the
    shortest item that contains it, else from the first of ``sources`` that knows it, whose prices are merged into the table. Each name is priced once,
    whatever the number of its listings. Deals of prices from sources have no volume and pass without one. All that the run saw is stored as processed, and its deals under ``folder``; a run that is repeated sees the
    table and the processed ids as they were before it, and replaces what it wrote.
    """
    spark, version = listings.sparkSession, prices.before(WRITER, run)
    processed = ProcessedIds(spark, f"{folder}/processed")
    new = staged(new_listings(listings, processed.handled(listings, run)), "new")
    asked = staged(named_listings(new, full, patterns).select("id", "name", "mode", "ask"), "asked")
    matched = staged(match_price(asked.select("name").distinct(), prices.read(version)), "matched")
    found = F.col("price_twd").isNotNull()
    missed = price_cascade(matched.filter(~found).select("name"), prices, sources, version=version, writer=WRITER, batch=run)
    quoted = matched.filter(found).drop("matched_item").unionByName(missed.filter("price_twd is not null").withColumn("match_kind", F.col("source")).drop("source"))
    rows = asked.join(quoted, "name").select(*asked.columns, "price_twd", "volume", "match_kind")
    deals = screen(score(rows), min_margin, min_volume, allow_unknown_volume=True)
    path = f"{folder}/deals/run={run}"
    deals.write.mode("overwrite").parquet(path)
    processed.append(new, run)
    return spark.read.schema(deals.schema).parquet(path)
