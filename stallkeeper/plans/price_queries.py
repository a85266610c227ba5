"""Queries over prices and deals."""

from __future__ import annotations

import uuid
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import money as M
from ..functions import text as X
from ..functions.text import WEARS, falsy_coalesce, safe_number, wear_rank
from ..operators import deals, prices
from ..operators.scan import scan
from ..operators.common import keep_last, latest, number_rows
from ..sources import readers
from ..sources.processed import ProcessedIds
from ..sources.schemas import DEALS
from ..sources.versioned import VersionedTable
from ..staging import new_folder, staged, table
from .listing_queries import LISTED_WEARS, LISTING_SQL, NAMES_SQL, PRICE_SQL, TERMS_SQL, WEAR_SQL, dictionaries, item_names, listing_text
from .registry import query

PRICES_SQL = """SELECT p_partkey AS item, p_retailprice AS price_twd, CAST(coalesce(v, 0) AS BIGINT) AS volume, u AS last_updated FROM part
  LEFT JOIN (SELECT l_partkey, sum(l_quantity) AS v, max(l_shipdate) AS u FROM lineitem GROUP BY 1) ON l_partkey = p_partkey"""


def price_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """item, price_twd, volume, last_updated: part's prices with the traded quantity."""
    traded = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.sum("l_quantity").alias("v"), F.max("l_shipdate").alias("u"))
    joined = table(spark, sf_dir, "part").join(traded, F.col("p_partkey") == F.col("l_partkey"), "left")
    return joined.select(F.col("p_partkey").alias("item"), F.col("p_retailprice").alias("price_twd"), F.coalesce(F.col("v").cast("long"), F.lit(0)).alias("volume"), F.col("u").alias("last_updated"))


_DEALS_SQL = f"""WITH p AS ({PRICES_SQL}), d AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice / l_quantity AS ask, price_twd, volume FROM lineitem JOIN p ON l_partkey = item),
  e AS (SELECT *, price_twd * 0.985::DOUBLE AS net, price_twd * 0.985::DOUBLE - ask AS profit, CASE WHEN ask > 0 THEN (price_twd * 0.985::DOUBLE - ask) / ask * 100 ELSE 0.0 END AS margin FROM d WHERE ask > 0),
  s AS (SELECT * FROM e WHERE margin > 5 AND volume > 700)"""


def scored_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", (F.col("l_extendedprice") / F.col("l_quantity")).alias("ask"))
    joined = lines.join(price_table(spark, sf_dir), F.col("l_partkey") == F.col("item")).drop("item", "last_updated")
    return deals.score(deals.priced(joined))


@query(_DEALS_SQL + " SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, ask, price_twd, volume, net, profit, margin FROM s ORDER BY margin DESC, l_orderkey, l_linenumber, l_partkey, l_suppkey LIMIT 50")
def deal_screen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 best deals: margin over 5 %, volume over 700."""
    found = deals.screen(scored_lines(spark, sf_dir), 5, 700)
    return found.orderBy(F.desc("margin"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").limit(50)


@query(_DEALS_SQL + " SELECT l_partkey, count(*) AS deals, round(max(margin), 6) AS best_margin, CAST(sum(CAST(floor(profit) AS BIGINT)) AS BIGINT) AS profit FROM s GROUP BY 1")
def deals_by_item(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = deals.screen(scored_lines(spark, sf_dir), 5, 700)
    return found.groupBy("l_partkey").agg(F.count("*").alias("deals"), F.round(F.max("margin"), 6).alias("best_margin"), F.sum(F.floor("profit")).alias("profit"))


@query(_DEALS_SQL + """, v AS (SELECT *, CASE l_linenumber % 4 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' WHEN 2 THEN 'high' ELSE 'none' END AS risk, make_timestamp(1704067200000000 + l_orderkey * 60000000) AS created_at FROM s)
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, strftime(created_at, '%m-%d %H:%M') AS "time", printf('NT$%s', format('{:,}', CAST(round_even(ask, 0) AS BIGINT))) AS ask, printf('NT$%s', format('{:,}', CAST(round_even(price_twd, 0) AS BIGINT))) AS market,
  '+NT$' || format('{:,}', CAST(round_even(profit, 0) AS BIGINT)) || ' (' || printf('%.1f', margin) || '%)' AS gain, format('{:,}', volume) AS volume,
  CASE risk WHEN 'low' THEN '🟢 低' WHEN 'medium' THEN '🟡 中' WHEN 'high' THEN '🔴 高' ELSE '' END AS risk FROM v ORDER BY created_at DESC, l_orderkey DESC, l_linenumber DESC, l_partkey DESC, l_suppkey DESC LIMIT 20""")
def deals_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 latest deals as they are shown."""
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    found = deals.screen(scored_lines(spark, sf_dir), 5, 700)
    found = found.withColumn("created_at", F.timestamp_seconds(F.lit(1704067200) + F.col("l_orderkey") * 60)).withColumn("post_id", F.struct(*keys))
    last = deals.latest_deals(found, 20)
    risk = F.get(F.array(*map(F.lit, ["low", "medium", "high", "none"])), (F.col("l_linenumber") % 4).cast("int"))
    named = last.select("created_at", F.to_json("post_id").alias("author"), F.lit("").alias("skin_name"), F.col("ask").alias("seller_price"), F.col("price_twd").alias("market_price"),
                        "profit", F.col("margin").alias("profit_margin"), "volume", risk.alias("risk"))
    shown = deals.deals_view(named).withColumn("k", F.from_json("author", "l_orderkey bigint, l_linenumber int, l_partkey bigint, l_suppkey bigint"))
    return shown.select("k.*", "time", "ask", "market", "gain", "volume", "risk")


@query(f"SELECT count(*) AS items, CAST(sum(volume) AS BIGINT) AS volume, round(avg(price_twd), 4) AS mean_price, coalesce(strftime(max(last_updated), '%Y-%m-%d %H:%M:%S'), 'never') AS newest FROM ({PRICES_SQL})")
def price_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prices.price_summary(price_table(spark, sf_dir))


@query(f"SELECT item, price_twd, volume FROM ({PRICES_SQL}) ORDER BY price_twd DESC, item")
def price_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prices.price_sorted(price_table(spark, sf_dir).select("item", "price_twd", "volume"))


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events) SELECT user_id, event_type, event_id, value FROM r WHERE rn = 1""")
def latest_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest(table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "value", "ts"), ["user_id", "event_type"], ["ts", "event_id"]).drop("ts")


@query(f"""WITH b AS (SELECT *, 0 AS src FROM ({PRICES_SQL})), u AS (SELECT item, price_twd * 2 AS price_twd, volume + 1 AS volume, last_updated + INTERVAL 1 DAY AS last_updated, 1 AS src FROM b WHERE volume % 100 < 40
  UNION ALL SELECT item + 1000000000, price_twd, volume, last_updated, 1 FROM b WHERE volume % 100 > 80), a AS (SELECT * FROM b UNION ALL SELECT * FROM u),
  r AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY last_updated DESC, src DESC) AS rn FROM a) SELECT item, price_twd, volume FROM r WHERE rn = 1""")
def upsert_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = price_table(spark, sf_dir).filter("last_updated is not null or item is not null")
    changed = base.filter("volume % 100 < 40").select("item", (F.col("price_twd") * 2).alias("price_twd"), (F.col("volume") + 1).alias("volume"), F.expr("last_updated + interval 1 day").alias("last_updated"))
    new = base.filter("volume % 100 > 80").withColumn("item", F.col("item") + 1000000000)
    return prices.upsert_prices(base, changed.unionByName(new)).drop("last_updated")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')")
def new_listings_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    done = deals.add_processed(seen, seen.limit(0), "o_orderkey")
    return deals.new_listings(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), done, "o_orderkey")


@query("SELECT DISTINCT k FROM (SELECT l_orderkey AS k FROM lineitem UNION ALL SELECT o_orderkey FROM orders) WHERE k IS NOT NULL")
def add_processed(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k")), table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"))
    return deals.add_processed(old, new, "k")


_CENTS = "CAST(CAST(round(l_extendedprice * 100) AS BIGINT) % 1000 AS BIGINT) * CASE WHEN l_linenumber % 2 = 0 THEN 1 ELSE 100 END"


@query(f"""WITH l AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {_CENTS} AS x, CASE (l_orderkey + l_linenumber) % 3 WHEN 0 THEN 'RMB' WHEN 1 THEN 'USD' ELSE 'TWD' END AS c FROM lineitem),
  r AS (SELECT *, CASE WHEN c = 'USD' THEN (x * 72 + 5) // 10 ELSE x END AS rmb FROM l), t AS (SELECT *, rmb * 45 AS m FROM r),
  w AS (SELECT *, m // 1000 AS q, m % 1000 AS rest, (m + 5) // 10 AS cent FROM t)
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN c = 'TWD' THEN x ELSE 100 * (q + CASE WHEN rest > 500 OR rest = 500 AND q % 2 = 1 THEN 1 ELSE 0 END) END AS whole, CASE WHEN c = 'TWD' THEN x ELSE cent END AS cents,
  CASE WHEN c = 'TWD' THEN x ELSE 100 * q END AS truncated, c <> 'TWD' AND rest = 500 AS tie FROM w""")
def fx_rounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Amounts with cents converted by the three rounding policies, in hundredths; ``tie`` marks those halfway between whole ones."""
    currency = F.get(F.array(F.lit("RMB"), F.lit("USD"), F.lit("TWD")), ((F.col("l_orderkey") + F.col("l_linenumber")) % 3).cast("int"))
    cents = F.round(F.col("l_extendedprice") * 100).cast("long") % 1000 * F.when(F.col("l_linenumber") % 2 == 0, 1).otherwise(100)
    amount = (cents.cast("decimal(18,2)") / 100).cast("decimal(18,2)")
    to = lambda policy: (M.to_twd(amount, currency, policy) * 100).cast("long")
    half = F.abs(M.to_twd(amount, currency, "cents") - M.to_twd(amount, currency, "truncate")) == 0.5
    exact = F.when(currency == "USD", F.round(amount * F.lit(Decimal("7.2")), 2)).otherwise(amount) * F.lit(Decimal("4.5"))
    tie = half & (currency != "TWD") & (exact * 2 == F.floor(exact * 2))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", to("whole").alias("whole"), to("cents").alias("cents"), to("truncate").alias("truncated"), tie.alias("tie"))


_NAMED = "SELECT p_partkey, p_brand || ' ' || p_name || ' ' || p_partkey AS item, p_retailprice AS price_twd, CAST(p_size AS BIGINT) AS volume FROM part"


def named_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat_ws(" ", "p_brand", "p_name", F.col("p_partkey").cast("string"))
    return table(spark, sf_dir, "part").select("p_partkey", name.alias("item"), F.col("p_retailprice").alias("price_twd"), F.col("p_size").cast("long").alias("volume"))


@query(f"""WITH p AS ({_NAMED}), q AS (SELECT DISTINCT CASE p_partkey % 3 WHEN 0 THEN item WHEN 1 THEN upper(substr(item, 9)) ELSE item || ' gone' END AS name FROM p),
  f AS (SELECT q.name, p.item, p.price_twd, p.volume, row_number() OVER (PARTITION BY q.name ORDER BY length(p.item), p.item) AS rn FROM q JOIN p ON contains(lower(p.item), lower(q.name)) WHERE q.name NOT IN (SELECT item FROM p))
  SELECT q.name, coalesce(CASE WHEN e.item IS NOT NULL THEN q.name END, f.item) AS matched_item, coalesce(e.price_twd, f.price_twd) AS price_twd, coalesce(e.volume, f.volume, -1) AS volume,
  CASE WHEN e.item IS NOT NULL THEN 'exact' WHEN f.item IS NOT NULL THEN 'fuzzy' ELSE 'none' END AS match_kind FROM q LEFT JOIN p e ON e.item = q.name LEFT JOIN f ON f.name = q.name AND rn = 1""")
def match_exact_fuzzy(spark: SparkSession, sf_dir: str) -> DataFrame:
    table_ = named_prices(spark, sf_dir)
    part = F.col("p_partkey") % 3
    names = table_.select(F.when(part == 0, F.col("item")).when(part == 1, F.upper(F.substring("item", 9, 200))).otherwise(F.concat("item", F.lit(" gone"))).alias("name")).distinct()
    return prices.match_price(names, table_.drop("p_partkey")).withColumn("volume", F.coalesce("volume", F.lit(-1)))


@query("""WITH q AS (SELECT user_id AS item, CASE event_type WHEN 'purchase' THEN 1 WHEN 'click' THEN 2 ELSE 3 END AS source_rank, event_type AS source, value AS price_twd FROM events),
  s AS (SELECT p_partkey AS item, 0 AS source_rank, 'table' AS source, p_retailprice AS price_twd, CAST(p_size AS BIGINT) AS volume FROM part WHERE p_size <= 25 UNION ALL SELECT item, source_rank, source, price_twd, NULL FROM q),
  b AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY source_rank, source, price_twd) AS rn FROM s WHERE price_twd IS NOT NULL)
  SELECT p_partkey AS name, b.source, b.price_twd, coalesce(b.volume, -1) AS volume FROM part LEFT JOIN b ON item = p_partkey AND rn = 1""")
def price_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    part, events = table(spark, sf_dir, "part"), table(spark, sf_dir, "events")
    own = part.filter("p_size <= 25").select(F.col("p_partkey").alias("item"), F.lit(0).alias("source_rank"), F.lit("table").alias("source"), F.col("p_retailprice").alias("price_twd"), F.col("p_size").cast("long").alias("volume"))
    rank = F.when(F.col("event_type") == "purchase", 1).when(F.col("event_type") == "click", 2).otherwise(3)
    quotes = events.select(F.col("user_id").alias("item"), rank.alias("source_rank"), F.col("event_type").alias("source"), F.col("value").alias("price_twd"), F.lit(0).cast("long").alias("volume"))
    return prices.resolve_price(part.select(F.col("p_partkey").alias("name")), own.unionByName(quotes)).withColumn("volume", F.coalesce("volume", F.lit(-1)))


@query("""WITH t AS (SELECT p_partkey AS item, p_retailprice AS price FROM part WHERE p_size <= 25),
  q AS (SELECT user_id AS item, event_type, min(value) AS price FROM events GROUP BY 1, 2),
  f AS (SELECT p_partkey AS name, coalesce(t.price, a.price, b.price) AS price_twd, CASE WHEN t.price IS NOT NULL THEN 'table' WHEN a.price IS NOT NULL THEN 'purchase' WHEN b.price IS NOT NULL THEN 'click' END AS source
    FROM part LEFT JOIN t ON t.item = p_partkey LEFT JOIN q a ON a.item = p_partkey AND a.event_type = 'purchase' LEFT JOIN q b ON b.item = p_partkey AND b.event_type = 'click')
  SELECT 1 AS run, * FROM f UNION ALL SELECT 2, name, price_twd, CASE WHEN source IS NOT NULL THEN 'table' END FROM f""")
def price_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part priced from the table, else from purchases, else from clicks, twice: the second time all that was found is in the table."""
    part, events = table(spark, sf_dir, "part"), table(spark, sf_dir, "events")
    own = VersionedTable(spark, new_folder(spark, "prices"), "item int, price_twd double, volume long, last_updated timestamp")
    known = part.filter("p_size <= 25").select(F.col("p_partkey").cast("int").alias("item"), F.col("p_retailprice").alias("price_twd"), F.col("p_size").cast("long").alias("volume"))
    own.merge(known.withColumn("last_updated", F.lit("2000-01-01").cast("timestamp")), ["last_updated"])
    quotes = lambda kind: (kind, lambda missed: missed.join(events.filter(F.col("event_type") == kind), F.col("item") == F.col("user_id")).select("item", F.col("value").alias("price_twd")))
    asked = part.select(F.col("p_partkey").cast("int").alias("name"))
    runs = [staged(prices.price_cascade(asked, own, [quotes("purchase"), quotes("click")]).withColumn("run", F.lit(k)), "run") for k in (1, 2)]
    return runs[0].unionByName(runs[1]).select("run", "name", "price_twd", "source")


def _fresh_sql(seconds: int) -> str:
    return f"""WITH h AS (SELECT a.event_id, q.event_id AS quote_id, q.value AS quote, row_number() OVER (PARTITION BY a.event_id ORDER BY q.ts DESC, q.event_id DESC) AS rn
      FROM events a JOIN events q ON a.user_id = q.user_id AND q.event_type <> 'purchase' AND q.ts <= a.ts AND epoch_us(a.ts) - epoch_us(q.ts) < {seconds * 1000000} WHERE a.event_type = 'purchase')
      SELECT event_id, quote_id, quote FROM h WHERE rn = 1"""


def _fresh(spark: SparkSession, sf_dir: str, seconds: int) -> DataFrame:
    events = table(spark, sf_dir, "events")
    asks = events.filter("event_type = 'purchase'").select("event_id", "user_id", "ts")
    quotes = events.filter("event_type <> 'purchase'").select("user_id", F.col("ts").alias("quoted_at"), F.col("event_id").alias("quote_id"), F.col("value").alias("quote"))
    return prices.fresh_quote(asks, quotes, "user_id", "ts", "quoted_at", seconds, ["quote_id"]).select("event_id", "quote_id", "quote")


@query(_fresh_sql(300))
def fresh_quote_5min(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fresh(spark, sf_dir, 300)


@query(_fresh_sql(86400))
def fresh_quote_1day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fresh(spark, sf_dir, 86400)


@query("""WITH w AS (SELECT p_name AS name, min(p_partkey) AS k FROM part GROUP BY 1), c AS (SELECT p_name AS name, CASE WHEN p_partkey % 11 = 3 THEN upper(p_name) ELSE p_brand END AS candidate, p_partkey AS pos, p_retailprice AS price FROM part),
  r AS (SELECT c.*, lower(c.name) = lower(candidate) AS exact, row_number() OVER (PARTITION BY c.name ORDER BY lower(c.name) = lower(candidate) DESC, pos) AS rn FROM w JOIN c USING (name)) SELECT name, candidate, pos, price, exact FROM r WHERE rn = 1""")
def best_candidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    candidate = F.when(F.col("p_partkey") % 11 == 3, F.upper("p_name")).otherwise(F.col("p_brand"))
    cands = part.select(F.col("p_name").alias("name"), candidate.alias("candidate"), F.col("p_partkey").alias("pos"), F.col("p_retailprice").alias("price"))
    return prices.best_candidate(part.select(F.col("p_name").alias("name")).distinct(), cands)


@query(f"""WITH n AS ({NAMES_SQL}), s AS (SELECT DISTINCT trim(regexp_replace(replace(replace(replace(replace(replace(lower(name), '(', ''), ')', ''), '★ ', ''), ' | ', '-'), ' ', '-'), '-({"|".join(w.lower().replace(" ", "-") for w in WEARS)})$', ''), '-') AS slug, p_partkey FROM n)
  SELECT p_partkey, slug IN (SELECT slug FROM s JOIN part USING (p_partkey) WHERE p_size <= 12) AS verified FROM s""")
def verify_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = item_names(spark, sf_dir)
    listed = names.join(table(spark, sf_dir, "part").filter("p_size <= 12").select("p_partkey"), "p_partkey", "left_semi")
    return prices.verify_items(names, listed, "name", "name").select("p_partkey", "verified")


@query("""SELECT CAST(count(*) FILTER (WHERE k IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)) AS BIGINT) AS ok, count(*) AS total FROM (SELECT DISTINCT p_partkey AS k FROM part)""")
def sync_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    watch = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("item"))
    return prices.sync_coverage(watch, table(spark, sf_dir, "lineitem").filter("l_quantity > 45").select(F.col("l_partkey").alias("item")))


_CELL = "arg_max(l_extendedprice, o) FILTER (WHERE wear = '{w}') AS \"{w}_price\", arg_max(CAST(l_quantity AS BIGINT), o) FILTER (WHERE wear = '{w}') AS \"{w}_vol\""


@query("""WITH l AS (SELECT p_brand, l_returnflag || l_linestatus AS wear, l_extendedprice, l_quantity, (l_orderkey * 100 + l_linenumber) * 100000000 + l_partkey AS o FROM lineitem JOIN part ON p_partkey = l_partkey)
  SELECT p_brand, """ + ", ".join(_CELL.format(w=w) for w in ("AF", "AO", "NF", "NO", "RF", "RO")) + " FROM l GROUP BY 1")
def wear_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("p_partkey") == F.col("l_partkey"))
    order = (F.col("l_orderkey") * 100 + F.col("l_linenumber")) * 100000000 + F.col("l_partkey")
    rows = lines.select("p_brand", F.concat("l_returnflag", "l_linestatus").alias("wear"), F.col("l_extendedprice").alias("price_twd"), F.col("l_quantity").cast("long").alias("volume"), order.alias("o"))
    return prices.wide_pivot(rows, "p_brand", "wear", ["AF", "AO", "NF", "NO", "RF", "RO"], F.col("o"))


@query("SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n FROM events GROUP BY 1")
def daily_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deals.daily_counts(table(spark, sf_dir, "events"), "ts").select(F.col("day").cast("string").alias("day"), "n")


@query("SELECT event_id, user_id FROM events WHERE CAST(ts AS TIME) BETWEEN TIME '08:00:00' AND TIME '23:00:00'")
def active_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").filter(M.in_hours(F.col("ts"))).select("event_id", "user_id")


@query("SELECT event_type, count(*) AS deals, max(event_id) AS last FROM events GROUP BY 1")
def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deals.run_summary(table(spark, sf_dir, "events"), "event_type", "event_id")


@query("""SELECT event_id, CASE WHEN value >= 0 THEN '+' ELSE '' END AS sign, CAST(coalesce(TRY_CAST(TRY_CAST(replace(format('{:,.2f}', value * 1000), ',', '') AS DOUBLE) AS DOUBLE), -1) AS DOUBLE) AS back,
  coalesce(nullif(user_id % 3, 0), nullif(event_id % 2, 0), 0) AS falsy FROM events""")
def safe_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.format_number(F.col("value") * 1000, 2)
    whole = safe_number(said)
    cents = (F.replace(said, F.lit(","), F.lit("")).try_cast("double") - whole)
    rows = table(spark, sf_dir, "events").select("event_id", M.fmt_sign(F.col("value")).alias("sign"), F.round(whole + cents, 2).alias("back"),
                                                 falsy_coalesce(F.col("user_id") % 3, F.col("event_id") % 2, default=0).alias("falsy"))
    return rows


@query("SELECT event_id, user_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 5000")
def keep_last_5000(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keep_last(table(spark, sf_dir, "events").select("event_id", "user_id", F.struct("ts", "event_id").alias("o")), F.col("o")).drop("o")


@query("SELECT 'p' || (row_number() OVER (ORDER BY ts, event_id) - 1) AS id, event_id FROM events")
def numbered_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return number_rows(table(spark, sf_dir, "events").select("ts", "event_id"), ["ts", "event_id"]).select("id", "event_id")


@query(f"WITH n AS ({NAMES_SQL}), w AS (SELECT p_partkey, regexp_extract(name, '\\(({'|'.join(WEARS)})\\)$', 1) AS wear FROM n) SELECT p_partkey, CAST(CASE wear {' '.join(f'''WHEN '{w}' THEN {i + 1}''' for i, w in enumerate(WEARS))} ELSE 0 END AS BIGINT) AS rank FROM w")
def wear_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    wear = F.regexp_extract("name", r"\((" + "|".join(WEARS) + r")\)$", 1)
    return item_names(spark, sf_dir).select("p_partkey", wear_rank(wear).alias("rank"))


@query(f"SELECT item, price_twd, volume FROM ({PRICES_SQL})")
def csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The price table exported as CSV and read back."""
    path = new_folder(spark, "csv")
    readers.export_csv(price_table(spark, sf_dir).select("item", "price_twd", "volume"), path)
    return spark.read.schema("item bigint, price_twd double, volume bigint").option("header", True).csv(path)


@query(_DEALS_SQL + """ SELECT l_orderkey || '/' || l_linenumber || '/' || l_partkey || '/' || l_suppkey AS post_id, price_twd AS market_price, ask AS seller_price FROM s
  ORDER BY l_linenumber DESC, post_id DESC LIMIT 50""")
def deal_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deals appended in two stamped batches, the newest 50 of the history read back."""
    path = new_folder(spark, "deals")
    found = deals.screen(scored_lines(spark, sf_dir), 5, 700)
    none = F.lit(None).cast("string")
    named = found.select(F.concat_ws("/", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("post_id"), none.alias("author"), none.alias("skin_name"), none.alias("link"),
                         F.col("price_twd").alias("market_price"), F.col("ask").alias("seller_price"), "profit", F.col("margin").alias("profit_margin"), "volume", none.alias("reason"),
                         none.alias("risk"), "l_linenumber")
    for batch in (named.filter("l_linenumber < 4"), named.filter("l_linenumber >= 4")):
        readers.append_deals(batch, path, F.timestamp_seconds(F.lit(1704067200) + F.col("l_linenumber") * 60))
    history = spark.read.schema(DEALS).parquet(path)
    return deals.latest_deals(history, 50).select("post_id", "market_price", "seller_price")


@query("SELECT 'full' AS kind, p_name AS term, min(p_brand) AS target, min(p_partkey) AS ord FROM part GROUP BY p_name UNION ALL SELECT 'weapon', p_brand, min(p_type), min(p_partkey) FROM part GROUP BY p_brand")
def term_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two kinds of terms written to a dictionary store and read back."""
    path, part = new_folder(spark, "terms"), table(spark, sf_dir, "part")

    def kind(name: str, term: str, target: str) -> DataFrame:
        rows = part.groupBy(F.col(term).alias("term")).agg(F.min(target).alias("target"), F.min("p_partkey").alias("ord"))
        return rows.select(F.lit(name).alias("kind"), "term", "target", F.lit("part").alias("source"), F.lit(1).alias("priority"), "ord")

    readers.write_terms(kind("full", "p_name", "p_brand").unionByName(kind("weapon", "p_brand", "p_type")), path)
    return readers.read_terms(spark, path).select("kind", "term", "target", "ord")


@query(f"SELECT CAST(item AS VARCHAR) AS item, price_twd, volume FROM ({PRICES_SQL}) ORDER BY price_twd DESC, item")
def price_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The price table created (twice: the second does nothing), filled, read back and sorted."""
    path, name = new_folder(spark, "prices"), f"stallkeeper_prices_{uuid.uuid4().hex}"
    readers.create_prices(spark, name, path)
    rows = price_table(spark, sf_dir).select(F.col("item").cast("string").alias("item"), "price_twd", "volume", F.col("last_updated").cast("timestamp").alias("last_updated"))
    rows.write.insertInto(name)
    readers.create_prices(spark, name, path)
    spark.sql(f"DROP TABLE {name}")  # the files under ``path`` stay
    return prices.price_sorted(readers.read_prices(spark, path).select("item", "price_twd", "volume"))


@query("""SELECT CAST(o_orderkey AS VARCHAR) AS id, CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 2 END AS run, count(*) AS n FROM orders GROUP BY 1, 2""")
def scan_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs over the orders: each handles those that no run before it has stored as processed, then stores them."""
    store = ProcessedIds(spark, new_folder(spark, "processed"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("id"), "o_orderkey")
    handled = []
    for run, seen in ((1, orders.filter("o_orderkey % 3 = 0")), (2, orders)):
        new = staged(deals.new_listings(seen, store.seen(seen)).withColumn("run", F.lit(run)), "run")
        store.append(new, run)
        handled.append(new)
    return handled[0].unionByName(handled[1]).groupBy("id", "run").agg(F.count("*").alias("n"))


@query("""SELECT event_id, CASE WHEN event_id % 3 = 0 AND value < 50 THEN p_retailprice END AS price_twd FROM events LEFT JOIN part ON user_id = p_partkey""")
def guarded_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices looked up only for the rows that are checked and have no answer of their own."""
    table_ = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("item"), F.col("p_retailprice").alias("price_twd"))
    rows = table(spark, sf_dir, "events").select("event_id", F.col("user_id").cast("string").alias("name"), "value")
    return prices.guarded_price(rows, table_, "name", (F.col("event_id") % 3 == 0) & (F.col("value") < 50)).select("event_id", "price_twd")


@query(f"""WITH n AS ({NAMES_SQL}) SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN '' WHEN p_partkey % 3 = 0 THEN 'AK-47 | 火蛇' WHEN p_partkey % 3 = 1 THEN 'AK-47 | 红线' ELSE '' END AS local_name FROM n""")
def local_names_by_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Localised names by the base of full names, whatever wear and prefix they have; names without a wear have none."""
    key = F.col("p_partkey")
    base = F.get(F.array(F.lit("AK-47 | Fire Serpent"), F.lit("AK-47 | Redline"), F.lit("P90 | None")), (key % 3).cast("int"))
    wear = F.get(F.array(*map(F.lit, WEARS)), (key % 5).cast("int"))
    start = F.when(key % 2 == 0, "StatTrak™ ").otherwise("")
    name = F.when(key % 7 == 0, "unknown").otherwise(F.concat(start, base, F.lit(" ("), wear, F.lit(")")))
    rows = prices.with_local_name(table(spark, sf_dir, "part").select("p_partkey", name.alias("name")), readers.watchlist(spark))
    return rows.select("p_partkey", "local_name")


_WEAR_EN = "CASE p_partkey % 6 " + " ".join(f"WHEN {i} THEN '{w}'" for i, w in enumerate(["Factory New", "Minimal Wear", "Field-Tested", "Battle-Scarred", "Well-Worn", "Field-Tested"])) + " END"
_MARK = "CASE WHEN part_key % 5 = 0 THEN ' 暗金' ELSE '' END"
#: Prices by canonical name: of the full names and of the patterns of all parts, each in the part's wear and edition.
_NAMED_PRICES_SQL = f"""SELECT item, max(price) AS price_twd, CAST(sum(size) AS BIGINT) AS volume FROM (SELECT unnest([CASE WHEN p_partkey % 5 = 0 THEN 'StatTrak™ ' ELSE '' END || upper(p_name || ' ' || p_brand) || ' (' || {_WEAR_EN} || ')',
  CASE WHEN p_partkey % 5 = 0 THEN 'StatTrak™ ' ELSE '' END || upper(p_name) || ' (' || {_WEAR_EN} || ')']) AS item, p_retailprice * 2 AS price, p_size AS size FROM part) GROUP BY 1"""


def canonical_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    wear = X.wear_to_en(F.get(F.array(*map(F.lit, LISTED_WEARS)), (key % 6).cast("int")))
    named = lambda target, mode: X.canonical_name(F.upper(target), F.lit(None).cast("string"), wear, key % 5 == 0, mode)
    names = F.array(named(F.concat_ws(" ", "p_name", "p_brand"), "full"), named(F.col("p_name"), "pattern"))
    rows = table(spark, sf_dir, "part").select(F.explode(names).alias("item"), (F.col("p_retailprice") * 2).alias("price"), "p_size")
    return rows.groupBy("item").agg(F.max("price").alias("price_twd"), F.sum("p_size").cast("long").alias("volume"))


@query(f"""WITH l AS MATERIALIZED (SELECT row_number() OVER () AS row, id, content || {_MARK} AS content, part_key % 5 = 0 AS special, {PRICE_SQL} AS said FROM ({LISTING_SQL})), {TERMS_SQL},
  h AS (SELECT row, id, content, special, said, mode, term, row_number() OVER (PARTITION BY row ORDER BY k, ord, term) AS rn FROM l JOIN d ON contains(content, term)),
  n AS (SELECT id, CASE WHEN special THEN 'StatTrak™ ' ELSE '' END || upper(term) || ' (' || {WEAR_SQL} || ')' AS name, mode, CAST(CASE WHEN contains(content, 'TWD') THEN said * 100 ELSE said * 450 END AS DOUBLE) / 100 AS ask FROM h WHERE rn = 1 AND said > 0),
  s AS (SELECT id, name, mode, ask, price_twd, volume, price_twd * 0.985::DOUBLE - ask AS profit, (price_twd * 0.985::DOUBLE - ask) / ask * 100 AS margin FROM n JOIN ({_NAMED_PRICES_SQL}) ON item = name)
  SELECT id, name, mode, ask, price_twd, volume, round(profit, 6) AS profit, round(margin, 6) AS margin FROM s WHERE margin > 5 AND volume > 50""")
def text_to_deals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From a listing's text to a deal: dictionaries, wear, edition, asking price and currency, canonical name, price, economics, screen."""
    mark = F.when(F.col("part_key") % 5 == 0, " 暗金").otherwise("")
    listings = listing_text(spark, sf_dir).select("id", F.concat("content", mark).alias("content"))
    found = deals.deals_of_texts(listings, *dictionaries(spark, sf_dir), canonical_prices(spark, sf_dir))
    return found.select("id", "name", "mode", "ask", "price_twd", "volume", F.round("profit", 6).alias("profit"), F.round("margin", 6).alias("margin"))


def _scan_sql(run: int, listings: str, prices: str) -> str:
    """CTEs of a run: asks aR, priced rows pR and the sources' prices wR that it writes back."""
    return f"""l{run} AS MATERIALIZED (SELECT row_number() OVER () AS row, id, content, special, said FROM ({listings})),
  h{run} AS (SELECT row, id, content, special, said, mode, term, row_number() OVER (PARTITION BY row ORDER BY k, ord, term) AS rn FROM l{run} JOIN d ON contains(content, term)),
  a{run} AS (SELECT id, CASE WHEN special THEN 'StatTrak™ ' ELSE '' END || upper(term) || ' (' || {WEAR_SQL} || ')' AS name, mode, CAST(CASE WHEN contains(content, 'TWD') THEN said * 100 ELSE said * 450 END AS DOUBLE) / 100 AS ask FROM h{run} WHERE rn = 1 AND said > 0),
  n{run} AS (SELECT DISTINCT name FROM a{run}), t{run} AS ({prices}),
  f{run} AS (SELECT name, item, price_twd, volume, row_number() OVER (PARTITION BY name ORDER BY item <> name, length(item), lower(item), item) AS rn FROM n{run} JOIN t{run} ON item = name OR contains(lower(item), lower(name))),
  w{run} AS (SELECT name AS item, price AS price_twd FROM n{run} JOIN (SELECT item, min(price) AS price FROM q GROUP BY 1) ON item = name WHERE name NOT IN (SELECT name FROM f{run})),
  p{run} AS (SELECT {run} AS run, id, a.name, mode, ask, coalesce(f.price_twd, w.price_twd) AS price_twd, f.volume, CASE WHEN f.item = a.name THEN 'exact' WHEN f.item IS NOT NULL THEN 'fuzzy' ELSE 'quotes' END AS match_kind
    FROM a{run} a LEFT JOIN f{run} f ON f.name = a.name AND rn = 1 LEFT JOIN w{run} w ON w.item = a.name WHERE coalesce(f.price_twd, w.price_twd) IS NOT NULL)"""


_SCANNED = f"SELECT id, content || {_MARK} AS content, part_key % 5 = 0 AS special, {PRICE_SQL} AS said FROM ({LISTING_SQL})"


@query(f"""WITH {TERMS_SQL}, b AS ({_NAMED_PRICES_SQL}), q AS (SELECT upper(p_name) || ' (' || {_WEAR_EN} || ')' AS item, p_retailprice * 3 AS price FROM part WHERE p_size % 2 = 1),
  {_scan_sql(1, _SCANNED + " WHERE part_key % 2 = 0", "SELECT * FROM b WHERE length(item) % 2 = 0")},
  {_scan_sql(2, _SCANNED + " WHERE part_key % 2 <> 0", "SELECT * FROM t1 UNION ALL SELECT item, price_twd, NULL FROM w1")},
  s AS (SELECT *, (price_twd * 0.985::DOUBLE - ask) / ask * 100 AS margin FROM (SELECT * FROM p1 UNION ALL SELECT * FROM p2))
  SELECT run, id, name, mode, ask, price_twd, volume, match_kind, round(margin, 6) AS margin FROM s WHERE margin > 5 AND (volume > 50 OR volume IS NULL)""")
def scan_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs over the listings, the second over all of them: dictionaries, exact, fuzzy and fallback prices with write-back, deals and processed ids stored."""
    mark = F.when(F.col("part_key") % 5 == 0, " 暗金").otherwise("")
    listings = listing_text(spark, sf_dir).select("id", F.concat("content", mark).alias("content"), "part_key")
    known = VersionedTable(spark, new_folder(spark, "prices"), "item string, price_twd double, volume long, last_updated timestamp")
    base = canonical_prices(spark, sf_dir).filter(F.length("item") % 2 == 0)
    known.merge(base.withColumn("last_updated", F.lit("2000-01-01").cast("timestamp")), ["last_updated"])
    wear = X.wear_to_en(F.get(F.array(*map(F.lit, LISTED_WEARS)), (F.col("p_partkey") % 6).cast("int")))
    quotes = table(spark, sf_dir, "part").filter("p_size % 2 = 1").select(F.concat(F.upper("p_name"), F.lit(" ("), wear, F.lit(")")).alias("item"), (F.col("p_retailprice") * 3).alias("price_twd"))
    source, folder = ("quotes", lambda missed: quotes.join(missed, "item", "left_semi")), new_folder(spark, "scan")
    seen = (listings.filter("part_key % 2 = 0"), listings)
    runs = [scan(df.select("id", "content"), folder, k, *dictionaries(spark, sf_dir), known, [source]).withColumn("run", F.lit(k)) for k, df in enumerate(seen, 1)]
    return runs[0].unionByName(runs[1]).select("run", "id", "name", "mode", "ask", "price_twd", "volume", "match_kind", F.round("margin", 6).alias("margin"))
