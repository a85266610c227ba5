"""Deals: screened, bundled, counted, shown."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.money import economics, fmt_money, fmt_pct, fmt_sign, to_twd, ts_short
from ..functions.text import canonical_name, extract_price, has_id, is_special, map_get, match_category, valid_name, wear_to_en
from .prices import match_price_exact
from .terms import dictionary_lookup

# The marks of the three risks.
RISKS = {"low": "🟢 低", "medium": "🟡 中", "high": "🔴 高"}


def new_listings(listings: DataFrame, processed: DataFrame, key: str = "id") -> DataFrame:
    """Listings that have an id which isn't processed yet."""
    return listings.filter(has_id(F.col(key).cast("string"))).join(processed.select(key), key, "left_anti")


def add_processed(old: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    return old.select(key).unionByName(new.select(key)).filter(has_id(F.col(key).cast("string"))).distinct()


def priced(df: DataFrame, col: str = "ask") -> DataFrame:
    return df.filter(F.col(col) > 0)


def score(df: DataFrame, price: str = "price_twd", ask: str = "ask") -> DataFrame:
    """``df`` with net, profit, margin."""
    return df.withColumn("__e", economics(F.col(price), F.col(ask))).select("*", "__e.*").drop("__e")


def screen(df: DataFrame, min_margin: float = 5, min_volume: float = 50, allow_unknown_volume: bool = False) -> DataFrame:
    """Rows whose margin and daily volume are both above their bounds."""
    traded = F.col("volume") > min_volume
    return df.filter((F.col("margin") > min_margin) & (traded | F.col("volume").isNull() if allow_unknown_volume else traded))


def latest_deals(deals: DataFrame, n: int = 50, order: str = "created_at", tie: str = "post_id") -> DataFrame:
    return deals.orderBy(F.desc(order), F.desc(tie)).limit(n)


def deals_view(deals: DataFrame) -> DataFrame:
    """Display columns of deals with created_at, author, skin_name, seller_price, market_price, profit, profit_margin, volume, risk."""
    gain = F.concat(fmt_sign(F.col("profit")), fmt_money(F.col("profit")), F.lit(" ("), fmt_pct(F.col("profit_margin")), F.lit(")"))
    return deals.select(F.coalesce(ts_short(F.col("created_at")), F.lit("")).alias("time"), "author", "skin_name", fmt_money(F.col("seller_price")).alias("ask"),
                        fmt_money(F.col("market_price")).alias("market"), gain.alias("gain"), F.format_number("volume", 0).alias("volume"),
                        map_get(RISKS, F.col("risk"), "").alias("risk"))


def bundle_listings(df: DataFrame) -> DataFrame:
    """author, name, price, pos rows bundled by the author's first four letters and the price: first author, items, text."""
    rows = df.filter(valid_name(F.col("name")) & (F.col("price") > 0))
    grouped = rows.groupBy(F.substring("author", 1, 4).alias("author_key"), "price").agg(
        F.min_by("author", "pos").alias("author"), F.min_by("name", "pos").alias("first_name"), F.count("*").alias("items"))
    text = F.when(F.col("items") == 1, F.col("first_name")).otherwise(F.concat("first_name", F.lit(" 等 "), F.col("items").cast("string"), F.lit(" 件")))
    return grouped.select("author_key", "price", "author", "items", F.concat(F.lit("【售】"), text, F.lit("\n賣 "), F.col("price").cast("string"), F.lit(" 台幣")).alias("content"))


def daily_counts(df: DataFrame, ts: str = "posted_at") -> DataFrame:
    return df.groupBy(F.to_date(ts).alias("day")).agg(F.count("*").alias("n"))


def run_summary(deals: DataFrame, batch: str, ts: str) -> DataFrame:
    return deals.groupBy(batch).agg(F.count("*").alias("deals"), F.max(ts).alias("last"))


def named_listings(listings: DataFrame, full: DataFrame, patterns: DataFrame, text_col: str = "content") -> DataFrame:
    """Listings (id, text) whose text has a term and a number: name, mode, ask (TWD) beside their other columns.

    The name comes from the dictionaries (``full``, then ``patterns``), wear, edition and category of the text, the ask from the number in it,
    in RMB unless the text says TWD. All that a text says is read before the look-up, which Spark moves no expression across: read after it, it would be
    read again for the filter and for each mention in the name.
    """
    text = F.col(text_col)
    read = listings.withColumns({"wear": wear_to_en(text), "special": is_special(text), "category": match_category(text), "said": extract_price(text), "currency": F.when(text.contains("TWD"), "TWD").otherwise("RMB")})
    read = read.withColumn("ask", to_twd(F.col("said"), F.col("currency")).cast("double"))
    read = dictionary_lookup(read, full, patterns, "id", text_col)
    name = F.when(F.col("mode") == "full", canonical_name(F.col("target"), F.col("category"), F.col("wear"), F.col("special"), "full")).otherwise(
        canonical_name(F.col("target"), F.col("category"), F.col("wear"), F.col("special")))
    return priced(read.withColumn("name", name))


def deals_of_texts(listings: DataFrame, full: DataFrame, patterns: DataFrame, prices: DataFrame, text_col: str = "content", min_margin: float = 5, min_volume: float = 50) -> DataFrame:
    """Screened deals of ``named_listings`` at the prices of their very names: price_twd, volume, net, profit, margin beside their columns."""
    named = named_listings(listings, full, patterns, text_col)
    return screen(score(match_price_exact(named, prices).filter("matched")), min_margin, min_volume)
