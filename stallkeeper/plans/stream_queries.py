"""Streaming queries: the files of a table read as a stream to its end."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.versioned import VersionedTable
from ..staging import new_folder, table
from ..streaming import streams as S
from ..streaming.state import dedupe_newest, fresh_quotes_live, kept_ids, newest_quote
from .registry import query


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{sf_dir}/events.parquet"
    return S.stream_listings(spark, path, spark.read.parquet(path).schema, "ts")


@query("SELECT user_id, event_type, strftime(ts, '%Y-%m-%d') AS day, count(*) > 0 AS seen FROM events GROUP BY 1, 2, 3")
def stream_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    keyed = event_stream(spark, sf_dir).withColumn("day", F.to_date("ts").cast("string"))
    once = S.dedupe_stream(keyed, ["user_id", "event_type", "day"])
    return S.run_available(once).select("user_id", "event_type", "day", F.lit(True).alias("seen"))


@query("SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n FROM events GROUP BY 1")
def stream_daily_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = S.daily_counts_stream(event_stream(spark, sf_dir), "ts")
    out = S.run_available(counted, "complete")
    last = out.groupBy("day").agg(F.max_by("n", "batch").alias("n"))
    return last.select(F.substring(F.col("day").cast("string"), 1, 10).alias("day"), "n")


@query("""WITH e AS (SELECT event_id, user_id, value AS ask, p_retailprice AS price_twd, CAST(p_size AS BIGINT) AS volume FROM events JOIN part ON user_id = p_partkey),
  s AS (SELECT *, price_twd * 0.985::DOUBLE - ask AS profit, CASE WHEN ask > 0 THEN (price_twd * 0.985::DOUBLE - ask) / ask * 100 ELSE 0.0 END AS margin FROM e)
  SELECT event_id, user_id, ask, price_twd, volume, profit, margin FROM s WHERE margin > 5 AND volume > 20""")
def stream_enrich(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Asks of a stream against the price table, read in every batch."""
    asks = event_stream(spark, sf_dir).select("ts", "event_id", "user_id", F.col("value").alias("ask"))
    out = S.run_available(asks, each=S.priced_deals(price_versions(spark, sf_dir), 5, 20, "user_id"))
    return out.select("event_id", "user_id", "ask", "price_twd", "volume", "profit", "margin")


PRICE_SCHEMA = "item int, price_twd double, volume long, at struct<ts: timestamp, event_id: int>"


def price_versions(spark: SparkSession, sf_dir: str) -> VersionedTable:
    """A price table whose first version has part's prices, older than any quote."""
    part = table(spark, sf_dir, "part")
    prices = VersionedTable(spark, new_folder(spark, "prices"), PRICE_SCHEMA)
    rows = part.select(F.col("p_partkey").cast("int").alias("item"), F.col("p_retailprice").alias("price_twd"), F.col("p_size").cast("long").alias("volume"))
    prices.merge(rows.withColumn("at", F.lit(None).cast("struct<ts: timestamp, event_id: int>")), ["at"])
    return prices


def arriving(spark: SparkSession, sf_dir: str, parts: int):
    """The events as files that arrive one after the other: a stream of their folder, and a function that lets part k arrive."""
    folder, events = new_folder(spark, "arriving"), table(spark, sf_dir, "events")
    arrive = lambda k: events.filter(F.col("event_id") % parts == k).coalesce(1).write.parquet(f"{folder}/part={k}")
    return lambda: S.stream_listings(spark, f"{folder}/part=*", events.schema, "ts"), arrive


def quotes_of(batch: DataFrame) -> DataFrame:
    return batch.select(F.col("user_id").cast("int").alias("item"), F.col("value").alias("price_twd"), F.lit(None).cast("long").alias("volume"),
                        F.struct(F.col("ts"), F.col("event_id").cast("int").alias("event_id")).alias("at"))


@query("""WITH q AS (SELECT user_id AS item, arg_max(value, struct_pack(a := ts, b := event_id)) AS price_twd FROM events GROUP BY 1)
  SELECT coalesce(p_partkey, item) AS item, coalesce(price_twd, p_retailprice) AS price_twd FROM part FULL JOIN q ON item = p_partkey""")
def stream_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices of part, overwritten by the newest quote of each item: every micro-batch of a stream merges its quotes into the price table."""
    prices = price_versions(spark, sf_dir)
    S.run_available(event_stream(spark, sf_dir), then=S.merging(prices, ["at"], "quotes", quotes_of))
    return prices.read().select("item", "price_twd")


@query("""WITH e AS (SELECT event_id, user_id, ts, value, event_id % 3 AS k FROM events), b AS (SELECT unnest([0, 1, 2]) AS k),
  q AS (SELECT b.k, user_id AS item, arg_max(value, struct_pack(a := ts, b := event_id)) AS price FROM b JOIN e ON e.k < b.k GROUP BY 1, 2),
  p AS (SELECT b.k, p_partkey AS item, p_retailprice AS price FROM b CROSS JOIN part), t AS (SELECT k, item, coalesce(q.price, p.price) AS price FROM p FULL JOIN q USING (k, item)),
  s AS (SELECT event_id, user_id, e.k AS batch, value AS ask, price, CASE WHEN value > 0 THEN (price * 0.985::DOUBLE - value) / value * 100 ELSE 0.0 END AS margin FROM e JOIN t ON e.k = t.k AND user_id = item)
  SELECT event_id, user_id, CAST(batch AS BIGINT) AS batch, ask, price AS price_twd, round(margin, 6) AS margin FROM s WHERE margin > 5""")
def stream_deals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scan that goes on: each batch's asks are screened at the prices so far and appended as deals, then its quotes are merged into the price table."""
    prices, (stream, arrive), path = price_versions(spark, sf_dir), arriving(spark, sf_dir, 3), new_folder(spark, "stream")
    deals = S.priced_deals(prices, 5, 0, "user_id", "scan", allow_unknown_volume=True)
    for k in range(3):
        arrive(k)
        found = S.run_available(stream(), each=lambda b, n: deals(b.withColumn("ask", F.col("value")), n), path=path, then=S.merging(prices, ["at"], "scan", quotes_of))
    return found.select("event_id", "user_id", F.col("batch").cast("long").alias("batch"), "ask", "price_twd", F.round("margin", 6).alias("margin"))


@query("SELECT CAST(event_id AS VARCHAR) AS id, epoch_us(ts) AS at FROM events ORDER BY ts DESC, id DESC LIMIT 5000")
def stream_newest_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5,000 newest event ids, as a stream with bounded state keeps them."""
    path = new_folder(spark, "stream")
    S.run_available(dedupe_newest(event_stream(spark, sf_dir), "event_id", "ts", shards=4), path=path)
    return kept_ids(spark, f"{path}/checkpoint")


@query("""WITH h AS (SELECT a.event_id, q.event_id AS quote_id, q.value AS quote, row_number() OVER (PARTITION BY a.event_id ORDER BY q.ts DESC, q.event_id DESC) AS rn
  FROM events a JOIN events q ON a.user_id = q.user_id AND q.event_type <> 'purchase' AND q.ts <= a.ts AND epoch_us(a.ts) - epoch_us(q.ts) < 86400000000 WHERE a.event_type = 'purchase')
  SELECT event_id, quote_id, quote FROM h WHERE rn = 1""")
def stream_fresh_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases and the newest quote of their user within a day, both streamed: files come in order of time, but for rows up to 12 hours late."""
    folder, events = new_folder(spark, "arriving"), table(spark, sf_dir, "events")
    comes = F.unix_timestamp(F.col("ts").cast("timestamp")) + F.col("event_id") % 3 * 21600
    least, most = events.agg(F.min(comes), F.max(comes)).first()
    part = F.floor((comes - least) * 4 / ((most or 0) - (least or 0) + 1))
    for k in range(4):
        events.filter(part == k).coalesce(1).write.parquet(f"{folder}/part={k}")
    stream = lambda: S.stream_listings(spark, f"{folder}/part=*", events.schema, "ts", 1)
    asks = stream().filter("event_type = 'purchase'").select("event_id", "user_id", "ts")
    quotes = stream().filter("event_type <> 'purchase'").select("user_id", F.col("ts").alias("quoted_at"), F.col("event_id").alias("quote_id"), F.col("value").alias("quote"))
    newest = lambda pairs, n=0: newest_quote(pairs.select("event_id", "quoted_at", "quote_id", "quote"), "event_id", ["quoted_at", "quote_id"])
    return newest(S.run_available(fresh_quotes_live(asks, quotes, "user_id", "ts", "quoted_at", 86400), each=newest)).drop("quoted_at")
