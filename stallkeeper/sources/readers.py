"""Readers and sinks of prices, catalogues, dictionaries, candidate responses and deals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from ..functions.text import falsy_coalesce, strip
from .schemas import CANDIDATES, DEALS, PRICES, TERMS, USD_QUOTE, WATCHLIST


def parse_timestamp(c: Column) -> Column:
    """Timestamp of a text with or without seconds."""
    return F.coalesce(F.try_to_timestamp(c, F.lit("yyyy-MM-dd HH:mm:ss")), F.try_to_timestamp(c, F.lit("yyyy-MM-dd HH:mm")))


def read_prices(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PRICES).parquet(path)


def quoted_columns(spark: SparkSession, url: str, table: DataFrame) -> dict[str, str]:
    """Lower-case name -> the name as the database writes and quotes it, of the columns of a table read from it."""
    dialect = spark.sparkContext._jvm.org.apache.spark.sql.jdbc.JdbcDialects.get(url)
    return {c.lower(): dialect.quoteIdentifier(c) for c in table.columns}


def read_prices_jdbc(spark: SparkSession, url: str, table: str, column: str = "last_updated", rows_a_task: int = 1_000_000, most_tasks: int = 64, **options: str) -> DataFrame:
    """A price table of a database. Filters and the choice of columns are worked out there; several tasks read ranges of ``column``.

    ``column`` is a number, date or timestamp; the database gives its least and greatest value and the number of rows, from which come as many
    ranges of the same width as ``rows_a_task`` asks for, ``most_tasks`` (connections) at most. Nulls are in the first range. ``table`` is a name
    or a subquery with an alias.
    """
    source = lambda **more: spark.read.format("jdbc").options(url=url, **options, **more)
    by = quoted_columns(spark, url, source(dbtable=table).load())[column.lower()]
    ends = source(query=f"SELECT min({by}) AS lo, max({by}) AS hi, count(*) AS n FROM {table}").load()
    whole = isinstance(ends.schema[0].dataType, NumericType)
    text = lambda c, round_: (round_(F.col(c)).cast("bigint") if whole else F.col(c)).cast("string")
    lo, hi, n = ends.select(text("lo", F.floor), text("hi", F.ceil), "n").first()
    tasks = min(most_tasks, -(-n // rows_a_task))
    ranges = dict(partitionColumn=column, lowerBound=lo, upperBound=hi, numPartitions=tasks) if tasks > 1 and lo is not None and lo != hi else {}
    return source(dbtable=table, customSchema=PRICES, **ranges).load().select(*[F.col(c).alias(c) for c in PRICES.names])


def best_prices_jdbc(spark: SparkSession, url: str, table: str, n: int, **options: str) -> DataFrame:
    """The ``n`` dearest items, then by name, sorted and cut by the database."""
    source = lambda part: spark.read.format("jdbc").options(url=url, dbtable=part, customSchema=PRICES, **options).load()
    named = quoted_columns(spark, url, source(table))
    best = f"SELECT {', '.join(named[c] for c in PRICES.names)} FROM {table} ORDER BY {named['price_twd']} DESC NULLS LAST, {named['item']} FETCH FIRST {int(n)} ROWS ONLY"
    return source(f"({best}) best").select(*[F.col(c).alias(c) for c in PRICES.names])


def write_prices_jdbc(prices: DataFrame, url: str, table: str, most_tasks: int = 16, **options: str) -> None:
    """Replace the rows of a price table, which is made if it isn't there; up to ``most_tasks`` connections insert in batches."""
    out = prices.select(PRICES.names).write.format("jdbc").options(url=url, dbtable=table, numPartitions=most_tasks, truncate="true", **options)
    out.option("createTableColumnTypes", "item VARCHAR(512)").mode("overwrite").save()


def create_prices(spark: SparkSession, name: str, path: str | None = None) -> None:
    """Create the price table if it isn't there, in the warehouse or under ``path``."""
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({PRICES}) USING parquet" + (f" LOCATION '{path}'" if path else ""))


def placed(lines: DataFrame) -> Column:
    """The place of a line of text files: file, block, number inside; lines sort as they are read."""
    return F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))


def json_entries(lines: DataFrame, body: str) -> DataFrame:
    """``lines`` with one row for each element of the JSON array, or member of the object, in ``body``: entry (its number), key (null in arrays), entry_value (a variant).

    An object with an id of its own is one entry. Texts that aren't JSON, and scalars, give none.
    """
    value = F.try_parse_json(body)
    single = F.try_variant_get(value, "$.id", "string").isNotNull() & F.try_variant_get(value, "$.name", "string").isNotNull()
    parsed = lines.withColumn("__v", F.try_parse_json(F.when(single, F.concat(F.lit("["), body, F.lit("]"))).otherwise(F.col(body))))
    exploded = parsed.lateralJoin(lines.sparkSession.tvf.variant_explode(F.col("__v").outer()))
    return exploded.select(*[exploded[c] for c in lines.columns], F.col("pos").alias("entry"), "key", F.col("value").alias("entry_value"))


def read_catalogue(spark: SparkSession, folder: str, whole_files: bool = True) -> DataFrame:
    """lang, id, name, pos of catalogues in folders lang=<code>: one JSON value in each file, or (``whole_files`` false) in each line.

    A value is an array of objects with id and name, one such object, or an object with names, or objects with a name, by id. ``pos`` is the
    place of an entry: file, block, line, entry.
    """
    lines = spark.read.schema("value string, lang string").text(folder, wholetext=whole_files)
    lines = lines.select("lang", F.col("value").alias("body"), placed(lines).alias("place"))
    rows = json_entries(lines, "body")
    of = lambda path: F.try_variant_get("entry_value", path, "string")
    named = rows.select("lang", F.coalesce(of("$.id"), "key").alias("id"), F.coalesce(of("$.name"), F.when(F.schema_of_variant("entry_value") == "STRING", of("$"))).alias("name"),
                        F.struct("place.*", "entry").alias("pos"))
    return named.filter("id is not null")


def write_catalogue(catalogue: DataFrame, folder: str, block: Column, order: str = "id") -> None:
    """Write lang, id, name as JSON arrays in the order of ``order``, one line for each language and ``block``."""
    blocks = catalogue.groupBy("lang", block.alias("__b")).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("__o"), "id", "name"))).alias("__a"))
    arrays = blocks.select("lang", "__b", F.to_json(F.transform("__a", lambda x: F.struct(x["id"].alias("id"), x["name"].alias("name")))).alias("value"))
    n = int(catalogue.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    arrays.repartitionByRange(n, "__b").sortWithinPartitions("lang", "__b").select("lang", "value").write.partitionBy("lang").text(folder)


def read_quoted_pairs(spark: SparkSession, path: str) -> DataFrame:
    """term, target of lines such as 'term': 'target', in a text file; other lines are left out."""
    return quoted_pairs(spark.read.text(path))


def read_placed_pairs(spark: SparkSession, path: str) -> DataFrame:
    """``read_quoted_pairs`` with pos, the place of the line; entry is 0."""
    lines = spark.read.text(path)
    lines = lines.select("value", placed(lines).alias("place"))
    return quoted_pairs(lines, "value", F.struct("place.*", F.lit(0).alias("entry")).alias("pos"))


def quoted_pairs(lines: DataFrame, col: str = "value", *also: Column) -> DataFrame:
    line = F.regexp_replace(strip(F.col(col)), ",$", "")
    part = lambda k: F.regexp_replace(strip(F.get(F.split(line, "': '"), F.lit(k))), "^'|'$", "")
    return lines.select(part(0).alias("term"), part(1).alias("target"), *also).filter("term <> '' and target <> ''")


def write_terms(terms: DataFrame, path: str) -> None:
    terms.select(TERMS.names).write.mode("overwrite").partitionBy("kind").parquet(path)


def read_terms(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(TERMS).parquet(path)


def explode_candidates(responses: DataFrame, body: str = "body") -> DataFrame:
    """``responses`` with one row for each candidate of a body whose code is OK: pos, name, price, volume."""
    parsed = responses.withColumn("__r", F.from_json(body, CANDIDATES)).filter("__r.code = 'OK'")
    rows = parsed.select(*responses.columns, F.posexplode("__r.data.items").alias("pos", "__i"))
    return rows.select(*responses.columns, "pos", falsy_coalesce(F.col("__i.market_hash_name"), F.col("__i.name"), default="").alias("candidate"),
                       F.col("__i.sell_min_price").try_cast("double").alias("price_rmb"),
                       falsy_coalesce(F.col("__i.sell_num"), F.col("__i.volume"), default=0).alias("volume")).filter("price_rmb is not null")


def parse_usd_quote(df: DataFrame, body: str = "body") -> DataFrame:
    """``df`` with ask_usd of a JSON quote; rows without a positive ask are left out."""
    return df.withColumn("ask_usd", F.from_json(body, USD_QUOTE)["ask"].try_cast("double")).filter("ask_usd > 0")


def watchlist(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(WATCHLIST, "name_en string, name_zh string")


def append_deals(deals: DataFrame, path: str, now: Column | None = None) -> None:
    """Append a batch of deals, stamped; the newest are taken when read."""
    deals.withColumn("created_at", now if now is not None else F.current_timestamp()).select(DEALS.names).write.mode("append").parquet(path)


def export_csv(df: DataFrame, path: str) -> None:
    df.write.option("header", True).csv(path)

