"""The price table: upserts, summaries, and the ways from a listing to a price."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import has_id, parse_item_name, slug_v1, strip
from ..sources.versioned import VersionedTable
from ..staging import staged
from .asof import asof
from .common import first_match, latest
from .containment import shortest_holder

Source = Callable[[DataFrame], DataFrame]


def upsert_prices(base: DataFrame, updates: DataFrame, key: str = "item", order: list[str] | None = None) -> DataFrame:
    """Latest row of each key over both; among equals the update wins."""
    both = base.withColumn("__src", F.lit(0)).unionByName(updates.withColumn("__src", F.lit(1)))
    return latest(both, [key], [*(order or ["last_updated"]), "__src"]).drop("__src")


def price_summary(prices: DataFrame) -> DataFrame:
    """items, volume (0 when empty), mean_price, newest (never when empty)."""
    newest = F.substring(F.max("last_updated").cast("string"), 1, 19)
    return prices.agg(F.count("*").alias("items"), F.coalesce(F.sum("volume"), F.lit(0)).alias("volume"), F.round(F.avg("price_twd"), 4).alias("mean_price"),
                      F.coalesce(newest, F.lit("never")).alias("newest"))


def price_sorted(prices: DataFrame) -> DataFrame:
    return prices.orderBy(F.desc("price_twd"), "item")


def match_price_exact(listings: DataFrame, prices: DataFrame, name: str = "name") -> DataFrame:
    """``listings`` with price_twd, volume and matched: whether there is an item of exactly that name, even one without a price."""
    table = prices.select(F.col("item").alias("__item"), "price_twd", "volume", F.lit(True).alias("matched"))
    return listings.join(table, F.col(name) == F.col("__item"), "left").drop("__item").withColumn("matched", F.coalesce("matched", F.lit(False)))


def match_price_fuzzy(names: DataFrame, prices: DataFrame, name: str = "name") -> DataFrame:
    """name, item, price_twd, volume: the shortest, then least price name that contains the name, ASCII case aside; names without one are left out."""
    fold = lambda c: F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    asked = names.select(F.col(name).alias("__name")).filter("__name <> ''").distinct().withColumn("__a", fold(F.col("__name")))
    table = prices.filter("item is not null").withColumn("__b", fold(F.col("item")))
    held = shortest_holder(asked.select("__a").distinct(), table)
    best = first_match(table.select("__b", "item", "price_twd", "volume"), ["__b"], ["item", "price_twd", "volume"])
    return asked.join(held, "__a").join(best, "__b").select(F.col("__name").alias(name), "item", "price_twd", "volume")


def match_price(listings: DataFrame, prices: DataFrame, name: str = "name") -> DataFrame:
    """``listings`` with matched_item, price_twd, volume, match_kind: exact, else fuzzy, else none.

    An item of exactly the name is taken even if it has no price. Only distinct names without one are looked for inside others.
    """
    exact = match_price_exact(listings, prices, name)
    items = prices.select(F.col("item").alias("__item"))
    missed = staged(listings.select(name).distinct().join(items, F.col(name) == F.col("__item"), "left_anti"), "names")
    fuzzy = match_price_fuzzy(missed, prices, name).select(F.col(name).alias("__n"), F.col("item").alias("__i"), F.col("price_twd").alias("__p"), F.col("volume").alias("__v"))
    joined = exact.join(fuzzy, F.col(name) == F.col("__n"), "left")
    kind = F.when(F.col("matched"), "exact").when(F.col("__i").isNotNull(), "fuzzy").otherwise("none")
    own = lambda mine, other: F.when(F.col("matched"), F.col(mine)).otherwise(F.col(other))
    return joined.select(*listings.columns, own(name, "__i").alias("matched_item"), own("price_twd", "__p").alias("price_twd"), own("volume", "__v").alias("volume"), kind.alias("match_kind"))


def guarded_price(df: DataFrame, prices: DataFrame, name: str, wanted: Column) -> DataFrame:
    """``df`` with price_twd of the item named ``name``, looked up only for the rows that are ``wanted``; null for the others, which meet no join."""
    asked = F.coalesce(wanted & has_id(F.col(name)), F.lit(False))
    table = prices.select(F.col("item").alias("__item"), F.col("price_twd").alias("__price"))
    found = df.filter(asked).join(table, F.col(name) == F.col("__item"), "left").drop("__item")
    return found.unionByName(df.filter(~asked).withColumn("__price", F.lit(None).cast("double"))).withColumnRenamed("__price", "price_twd")


def fresh_quote(asks: DataFrame, quotes: DataFrame, key: str, at: str, quoted_at: str, ttl_seconds: int = 300, tie: list[str] | None = None) -> DataFrame:
    """``asks`` with the columns of the newest quote of the same key (ties: the greatest by ``tie``) that is not later and younger than the time to live."""
    age = F.unix_micros(F.col(at).cast("timestamp")) - F.unix_micros(F.col(quoted_at).cast("timestamp"))
    return asof(asks, quotes, key, at, quoted_at, tie).filter(age < ttl_seconds * 1_000_000)


def resolve_price(listings: DataFrame, ranked: DataFrame, name: str = "name") -> DataFrame:
    """``listings`` with price_twd, volume, source of the source of lowest rank that has the item; volume is null for fallback sources."""
    best = first_match(ranked.filter("price_twd is not null").select("item", "source_rank", "source", "price_twd", "volume"), ["item"], ["source_rank", "source", "price_twd"])
    best = best.withColumn("volume", F.when(F.col("source_rank") == 0, F.col("volume"))).drop("source_rank").withColumnRenamed("item", "__item")
    return listings.join(best, F.col(name) == F.col("__item"), "left").drop("__item")


def price_cascade(listings: DataFrame, prices: VersionedTable, sources: list[tuple[str, Source]], name: str = "name", version: int | None = None,
                  writer: str = "", batch: int | None = None) -> DataFrame:
    """``listings`` with price_twd, volume, source: from the price table, else from the first of ``sources`` that has the item; null without any.

    A source is a function from missed names (a column item, distinct) to quotes (item, price_twd); it gets only what the table and the sources before
    missed, and isn't asked when nothing is left. Of several quotes for an item it gives, the least price is taken. What sources found is
    merged into the price table without a volume, so the next lookup finds it there. ``version`` is the table's version to look in, the last one by
    default; a ``batch`` of a ``writer`` is merged once.
    """
    known = prices.read(version).select("item", "price_twd", "volume").filter("price_twd is not null")
    names = staged(listings.select(F.col(name).alias("item")).filter(has_id(F.col(name).cast("string"))).distinct(), "names")
    found = [names.join(known, "item").withColumn("source", F.lit("table"))]
    missed = staged(names.join(known, "item", "left_anti"), "missed")
    for label, source in sources:
        if missed.isEmpty():
            break
        got = source(missed).filter("price_twd is not null").join(missed, "item", "left_semi").groupBy("item").agg(F.min("price_twd").alias("price_twd"))
        got = staged(got.select("item", "price_twd", F.lit(None).cast("long").alias("volume"), F.lit(label).alias("source")), "found")
        missed = staged(missed.join(got, "item", "left_anti"), "missed")
        found.append(got)
    every = staged(reduce(DataFrame.unionByName, found), "prices-found")
    new = every.filter("source <> 'table'")
    if not new.isEmpty():
        prices.merge(new.select("item", "price_twd", "volume", F.current_timestamp().alias("last_updated")), ["last_updated"], writer, batch)
    return listings.join(every.withColumnRenamed("item", "__item"), F.col(name) == F.col("__item"), "left").drop("__item")


def best_candidate(watch: DataFrame, candidates: DataFrame, name: str = "name") -> DataFrame:
    """For each watched name its candidate: the one of the same name (case aside), else the first by pos."""
    both = watch.join(candidates, name).withColumn("exact", F.lower(F.col(name)) == F.lower("candidate"))
    return first_match(both, [name], [~F.col("exact"), "pos"])


def verify_items(df: DataFrame, catalogue: DataFrame, name: str = "name", catalogue_name: str = "item") -> DataFrame:
    """``df`` with verified: whether the catalogue has an item of the same slug."""
    slugs = catalogue.select(slug_v1(F.col(catalogue_name)).alias("__slug")).distinct().withColumn("__hit", F.lit(True))
    return df.withColumn("__slug", slug_v1(F.col(name))).join(slugs, "__slug", "left").withColumn("verified", F.coalesce("__hit", F.lit(False))).drop("__slug", "__hit")


def sync_coverage(watch: DataFrame, results: DataFrame, key: str = "item") -> DataFrame:
    """ok, total: watched keys that have a result, and all of them."""
    have = results.select(key).distinct().withColumn("__ok", F.lit(True))
    return watch.select(key).distinct().join(have, key, "left").agg(F.count_if("__ok").alias("ok"), F.count("*").alias("total"))


def wide_pivot(df: DataFrame, key: str, wear: str, wears: list[str], order: Column) -> DataFrame:
    """One row for each key with price and volume columns of each wear; the last row of a cell wins."""
    return df.groupBy(key).pivot(wear, wears).agg(F.max_by("price_twd", order).alias("price"), F.max_by("volume", order).alias("vol"))


def with_local_name(df: DataFrame, watch: DataFrame, name: str = "name") -> DataFrame:
    """``df`` with local_name: the Chinese name, without wear, of the watched item with the same base; empty without one.

    ``watch`` is a table like the watch list (name_en, name_zh), of any size.
    """
    base = lambda c: parse_item_name(F.col(c))["base"]
    bare = strip(F.regexp_replace("name_zh", r"\s*\([^()]*\)$", ""))
    known = watch.select(base("name_en").alias("__base"), bare.alias("local_name")).groupBy("__base").agg(F.min("local_name").alias("local_name"))
    joined = df.withColumn("__b", base(name)).join(known, F.col("__b") == F.col("__base"), "left")
    return joined.drop("__b", "__base").withColumn("local_name", F.coalesce("local_name", F.lit("")))
