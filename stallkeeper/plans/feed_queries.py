"""Queries over feeds, pages, tiles and readings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import parse_model_json
from ..operators import deals, enrich, feed, tiles
from ..operators.common import first_match, lookahead_first
from ..sources.readers import explode_candidates, parse_usd_quote, watchlist
from ..staging import table
from .registry import query


def conversation_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, body: the turns of a conversation as JSON objects one after the other; every tenth conversation ends in a broken one."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.to_json(F.struct("turn", "role", "text")).alias("j"))
    block = turns.groupBy("conv_id", F.floor(F.col("turn") / 100).alias("b")).agg(F.array_sort(F.collect_list(F.struct("turn", "j"))).alias("js"))
    tail = F.when(F.col("conv_id") % 10 == 0, F.lit(' {"turn": ')).otherwise("")
    return block.select("conv_id", "b", F.concat(F.array_join(F.transform("js", lambda x: x["j"]), "\n "), tail).alias("body"))


@query("SELECT conv_id, turn, role, text FROM conversations")
def concat_json_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = feed.split_json(conversation_bodies(spark, sf_dir))
    return parts.withColumn("o", F.from_json("obj", "turn bigint, role string, text string")).select("conv_id", "o.turn", "o.role", "o.text")


@query("SELECT conv_id, turn, role, length(text) AS chars FROM conversations")
def concat_json_lateral(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The split as a table function that SQL calls for each row."""
    feed.register_split_json(spark)
    return spark.sql("""SELECT conv_id, o.turn, o.role, length(o.text) AS chars FROM (
        SELECT b.conv_id, from_json(s.obj, 'turn bigint, role string, text string') AS o FROM {bodies} b, LATERAL split_json(b.body) s)""", bodies=conversation_bodies(spark, sf_dir))


@query("""SELECT 'c' || conv_id || '_' || turn AS id, role AS author, text, CASE WHEN turn % 2 = 0 THEN 'http://x/' || turn || '.png' ELSE '' END AS image, CASE WHEN turn % 3 = 0 THEN 'c' || conv_id || '_' || turn || '_item0' ELSE 'c' || conv_id || '_' || turn END AS listing_id,
  CASE WHEN turn % 3 = 0 THEN role END AS item_name FROM conversations WHERE role <> 'system' AND turn % 5 <> 4""")
def feed_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns nested as feed posts in JSON bodies, split, flattened and expanded again."""
    t = table(spark, sf_dir, "conversations").filter("role <> 'system'")
    message = F.struct(F.col("text").alias("text"))
    first = F.struct(F.struct(F.when(F.col("turn") % 2 == 0, message).alias("message")).alias("comet_sections"), message.alias("message"))
    node = F.struct(
        F.when(F.col("turn") % 5 == 4, "Ad").otherwise("Story").alias("__typename"), F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("_"), F.col("turn").cast("string")).alias("id"),
        F.lit(None).cast("string").alias("url"), F.lit(1700000000).alias("creation_time"), F.array(F.struct(F.col("role").alias("name"))).alias("actors"),
        F.array(F.struct(F.struct(F.struct(F.when(F.col("turn") % 2 == 0, F.concat(F.lit("http://x/"), F.col("turn").cast("string"), F.lit(".png"))).otherwise("").alias("uri")).alias("image")).alias("media"))).alias("attachments"),
        F.when(F.col("turn") % 3 == 0, F.array(F.struct(F.col("role").alias("name")))).alias("items"),
        F.struct(F.struct(first.alias("story")).alias("content")).alias("comet_sections"))
    edges = t.select("conv_id", "turn", F.struct(node.alias("node")).alias("edge"))
    body = edges.groupBy("conv_id", F.floor(F.col("turn") / 50).alias("b")).agg(F.collect_list("edge").alias("edges"))
    body = body.select(F.to_json(F.struct(F.struct(F.struct(F.struct("edges").alias("group_feed")).alias("node")).alias("data"))).alias("body"))
    posts = feed.flatten_feed(feed.split_json(feed.feed_bodies(body)))
    rows = feed.expand_items(posts)
    return rows.select("id", "author", "text", F.coalesce(F.get("images", F.lit(0)), F.lit("")).alias("image"), "listing_id", F.col("item.name").alias("item_name"))


@query("""SELECT page_id, url, CASE WHEN page_id % 2 = 0 THEN 'http://x/' || page_id || '.png' ELSE url END AS link FROM pages WHERE page_id % 4 <> 3 AND page_id % 5 <> 0""")
def image_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("page_id").cast("string")
    image = F.struct(F.when(F.col("page_id") % 4 == 3, F.concat(F.lit("data:"), n)).otherwise(F.col("url")).alias("src"),
                     F.when(F.col("page_id") % 4 != 3, F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("http://x/"), n, F.lit(".png 2x, b 3x")))).alias("srcset"),
                     F.when(F.col("page_id") % 5 == 0, 50).otherwise(51).alias("width"))
    return table(spark, sf_dir, "pages").select("page_id", "url", F.explode(feed.clean_images(F.array(image, image))).alias("link"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem WHERE l_quantity - 5 > 0 AND l_quantity * l_linenumber > 0 AND l_quantity * l_linenumber - (l_quantity - 5) >= 60""")
def box_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    box = feed.valid_box(F.col("l_quantity") - 5, F.col("l_quantity") * F.col("l_linenumber"))
    return table(spark, sf_dir, "lineitem").filter(box).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents),
  m AS (SELECT doc_id, pos, line, CASE WHEN length(line) % 3 = 0 THEN CAST(length(line) AS DOUBLE) END AS price FROM l),
  w AS (SELECT doc_id, pos, line, first_value(price IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING) AS found FROM m)
  SELECT doc_id, CAST(pos AS INTEGER) AS pos, found FROM w WHERE length(line) % 7 = 2""")
def lookahead_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.when(F.length("x") % 7 == 2, "MARK").otherwise(F.when(F.length("x") % 3 == 0, F.concat(F.lit("¥"), F.length("x").cast("string"))).otherwise("-"))
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "x"))

    price = F.when(F.length("x") % 3 == 0, F.length("x").cast("double"))
    return lookahead_first(lines.withColumn("line", line).withColumn("p", price), "doc_id", "pos", F.col("line") == "MARK", F.col("p")).select("doc_id", "pos", "found")


@query("SELECT p_partkey, CAST(p_retailprice AS DOUBLE) AS found FROM part WHERE p_size % 2 = 0")
def page_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = F.format_number("p_retailprice", 2)
    page = F.concat_ws("\n", F.lit("header"), F.lit(" MARKET "), F.col("p_name"), F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("from ¥"), price)).otherwise("sold out"), F.lit("end"))
    found = feed.page_price(table(spark, sf_dir, "part").select("p_partkey", page.alias("t")), "p_partkey", "t", "MARKET")
    return found.filter("found is not null").select("p_partkey", "found")


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def props_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("```json\n"), "props", F.lit("\n```"))).otherwise(F.concat(F.lit("["), "props", F.lit("]")))
    rows = table(spark, sf_dir, "events").select("event_id", parse_model_json(said, "k bigint").alias("a"))
    return rows.select("event_id", F.get("a", F.lit(0))["k"].alias("k"))


@query("""SELECT p_partkey, 0 AS pos, p_name AS candidate, p_retailprice AS price_rmb, CAST(p_size AS BIGINT) AS volume FROM part WHERE p_partkey % 3 <> 0
  UNION ALL SELECT p_partkey, 1, p_brand, p_retailprice * 2, 7 FROM part WHERE p_partkey % 3 <> 0""")
def candidate_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    item = lambda full, name, price, num, vol: F.struct(full.alias("market_hash_name"), name.alias("name"), price.cast("string").alias("sell_min_price"), num.alias("sell_num"), vol.alias("volume"))
    items = F.array(item(F.col("p_name"), F.lit("x"), F.col("p_retailprice"), F.col("p_size").cast("long"), F.lit(1).cast("long")),
                    item(F.lit(""), F.col("p_brand"), F.col("p_retailprice") * 2, F.lit(0).cast("long"), F.lit(7).cast("long")))
    body = F.to_json(F.struct(F.when(F.col("p_partkey") % 3 == 0, "Login Required").otherwise("OK").alias("code"), F.struct(items.alias("items")).alias("data")))
    return explode_candidates(table(spark, sf_dir, "part").select("p_partkey", body.alias("body"))).drop("body")


@query("SELECT event_id, value AS ask_usd FROM events WHERE value > 0 AND event_id % 4 <> 0")
def usd_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    ask = F.when(F.col("event_id") % 4 == 0, F.lit(0.0)).otherwise(F.col("value"))
    return parse_usd_quote(table(spark, sf_dir, "events").select("event_id", F.to_json(F.struct(ask.cast("string").alias("ask"))).alias("body"))).drop("body")


@query("""WITH g AS (SELECT p_partkey, p_size * 13 + 50 AS width, p_size * 7 + 40 AS height, coalesce(nullif(p_partkey % 9, 0), 7) AS nr, coalesce(nullif(p_partkey % 4, 0), 3) AS nc FROM part),
  t AS (SELECT *, unnest(range(nr)) AS r FROM g), u AS (SELECT *, unnest(range(nc)) AS c, width // nc AS w, height // nr AS h FROM t)
  SELECT p_partkey AS image_id, CAST(r * nc + c AS INTEGER) AS item_id, CAST(greatest(0, c * w - floor(w * 0.15::DOUBLE)) AS BIGINT) AS "left", CAST(greatest(0, r * h - floor(h * 0.15::DOUBLE)) AS BIGINT) AS upper,
  CAST(least(width, (c + 1) * w + floor(w * 0.15::DOUBLE)) AS BIGINT) AS "right", CAST(least(height, (r + 1) * h + floor(h * 0.15::DOUBLE)) AS BIGINT) AS lower FROM u""")
def tile_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    images = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("image_id"), (F.col("p_size") * 13 + 50).alias("width"), (F.col("p_size") * 7 + 40).alias("height"),
                                                 (F.col("p_partkey") % 9).alias("rows"), (F.col("p_partkey") % 4).alias("cols"))
    return tiles.tile_grid(images)


#: Up to three readings of each tile (user, hour) out of the events, in order of their time.
READINGS_SQL = """SELECT * FROM (SELECT user_id AS image_id, CAST(floor(epoch_us(ts) / 86400000000) AS INTEGER) AS item_id,
  CAST(row_number() OVER (PARTITION BY user_id, floor(epoch_us(ts) / 86400000000) ORDER BY ts, event_id) AS INTEGER) AS attempt, CASE WHEN event_id % 11 = 0 THEN '' ELSE event_type || ' ' || event_id % 2 END AS name,
  CASE WHEN event_id % 2 = 0 THEN 'FN' ELSE 'MW' END AS wear, event_id % 3 <> 0 AS is_checked, (event_id % 10) / 10.0::DOUBLE AS confidence, value AS price, CASE WHEN event_id % 2 = 0 THEN 'TWD' ELSE 'RMB' END AS currency FROM events) WHERE attempt <= 3"""


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:

    e, k = table(spark, sf_dir, "events"), F.col("event_id")
    day = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 86400000000).cast("int")
    place = F.row_number().over(Window.partitionBy("image_id", "item_id").orderBy("ts", "event_id"))
    rows = e.select("ts", "event_id", F.col("user_id").alias("image_id"), day.alias("item_id"), F.when(k % 11 == 0, "").otherwise(F.concat("event_type", F.lit(" "), (k % 2).cast("string"))).alias("name"),
                    F.when(k % 2 == 0, "FN").otherwise("MW").alias("wear"), (k % 3 != 0).alias("is_checked"), ((k % 10) / 10.0).alias("confidence"), F.col("value").alias("price"),
                    F.when(k % 2 == 0, "TWD").otherwise("RMB").alias("currency"))
    return rows.withColumn("attempt", place).filter("attempt <= 3").drop("ts", "event_id")


@query(f"""WITH r AS ({READINGS_SQL}), j AS (SELECT a.image_id, a.item_id, a.name AS n1, coalesce(b.name, '') AS n2, coalesce(c.name, '') AS n3, a.is_checked AS k1, b.is_checked AS k2, a.confidence AS c1, b.confidence AS c2, b.attempt IS NOT NULL AND a.confidence < 0.7 AS unsure,
  a.wear, a.price, a.currency FROM r a LEFT JOIN r b ON b.image_id = a.image_id AND b.item_id = a.item_id AND b.attempt = 2 LEFT JOIN r c ON c.image_id = a.image_id AND c.item_id = a.item_id AND c.attempt = 3 WHERE a.attempt = 1),
  m AS (SELECT *, CASE WHEN unsure AND k1 = k2 THEN greatest(c1, c2) WHEN unsure THEN least(c1, c2) ELSE c1 END AS conf, CASE WHEN unsure AND k1 <> k2 THEN k2 ELSE k1 END AS chk, CASE WHEN unsure AND k1 = k2 AND n2 <> '' THEN n2 ELSE n1 END AS nm, CASE WHEN unsure THEN n3 ELSE n2 END AS nx FROM j),
  e AS (SELECT *, CASE WHEN chk AND nm <> '' AND nx <> '' AND nm <> nx AND NOT (contains(nm, substr(nx, 1, 4)) OR contains(nx, substr(nm, 1, 4))) THEN 'Unstable name, skipped' WHEN conf < 0.7 THEN 'Low confidence bypass' ELSE '' END AS err FROM m)
  SELECT image_id, item_id, nm AS name, chk AS is_checked, conf AS confidence, CASE WHEN err = '' AND chk THEN price ELSE 0.0 END AS price, CASE WHEN err = '' THEN wear ELSE '' END AS wear, CASE WHEN err = '' THEN currency ELSE 'RMB' END AS currency, err = '' AS success, err AS error_msg FROM e""")
def reading_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiles.consensus(readings(spark, sf_dir))


@query(f"""WITH r AS (SELECT image_id, item_id, attempt, name, price, confidence >= 0.5 AS verified FROM ({READINGS_SQL})), f AS (SELECT image_id, item_id, price AS first_price FROM r WHERE attempt = 1),
  b AS (SELECT *, row_number() OVER (PARTITION BY image_id, item_id ORDER BY verified DESC, attempt) AS rn FROM r) SELECT image_id || '/' || item_id AS id, attempt, name, f.first_price AS price, verified FROM b JOIN f USING (image_id, item_id) WHERE rn = 1""")
def accept_verified(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.concat(F.col("image_id").cast("string"), F.lit("/"), F.col("item_id").cast("string"))
    return enrich.accept_verified(readings(spark, sf_dir).select(key.alias("id"), "attempt", "name", "price", (F.col("confidence") >= 0.5).alias("verified")))


@query("SELECT doc_id, 'L' || n_chars % 7 AS verdict FROM documents WHERE n_chars > 1000")
def enrich_hook(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hook with a caller's function over the rows that a rule leaves."""

    def verdict(frame):
        return frame.assign(verdict="L" + (frame.n_chars % 7).astype(str))[["doc_id", "verdict"]]

    return enrich.enrich_with(table(spark, sf_dir, "documents").filter("n_chars > 1000").select("doc_id", "n_chars"), verdict, "doc_id bigint, verdict string")


@query("""WITH w(i, n) AS (VALUES (0, 'AK-47 | 火蛇 (略有磨损)'), (1, 'AK-47 | 火蛇 (久经沙场)'), (2, '')) SELECT p_partkey, n AS local_name FROM part JOIN w ON i = p_partkey % 3""")
def local_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Localised names out of the watch list, empty where it has none."""
    name = F.get(F.array(F.lit("AK-47 | Fire Serpent (Minimal Wear)"), F.lit("AK-47 | Fire Serpent (Field-Tested)"), F.lit("none")), (F.col("p_partkey") % 3).cast("int"))
    rows = table(spark, sf_dir, "part").select("p_partkey", name.alias("name_en")).join(F.broadcast(watchlist(spark)), "name_en", "left")
    return rows.select("p_partkey", F.coalesce("name_zh", F.lit("")).alias("local_name"))


@query("SELECT p_brand, arg_min(p_name, p_partkey) AS p_name, min(p_partkey) AS p_partkey FROM part GROUP BY 1")
def first_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return first_match(table(spark, sf_dir, "part").select("p_brand", "p_name", "p_partkey"), ["p_brand"], ["p_partkey"])


@query("""WITH b AS (SELECT page_id AS pos, url, trim(substr(url, 1, 40)) AS s FROM pages), a AS (SELECT page_id AS id, substr(url, 1, 25) AS t, trim(substr(url, 1, 25)) AS s FROM pages),
  m AS (SELECT a.id, a.t, min(b.pos) AS pos FROM a LEFT JOIN b ON contains(b.s, substr(a.s, 1, 15)) OR contains(a.s, substr(b.s, 1, 15)) GROUP BY 1, 2)
  SELECT id, CASE WHEN b.pos % 5 = 0 THEN 'none' ELSE concat_ws(',', 'i0', 'i1', 'i2') END AS images, coalesce(CASE WHEN length(b.url) > length(m.t) THEN b.url END, '') AS alt_text FROM m LEFT JOIN b USING (pos)""")
def post_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    posts = pages.select(F.col("page_id").alias("id"), F.substring("url", 1, 25).alias("text"), F.array(F.lit("none")).alias("images"))
    found = F.when(F.col("page_id") % 5 == 0, F.array().cast("array<string>")).otherwise(F.array(*[F.lit(f"i{k}") for k in range(5)]))
    rows = feed.attach_images(posts, pages.select(F.col("page_id").alias("pos"), F.col("url").alias("text"), found.alias("images")))
    return rows.select("id", F.array_join("images", ",").alias("images"), F.coalesce("alt_text", F.lit("")).alias("alt_text"))


@query("""SELECT conv_id, turn, role FROM conversations WHERE role IS NOT NULL QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY role) = 1""")
def post_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts of two rounds appended: the second brings all posts, those of the first once more; posts are told apart by id."""
    t = table(spark, sf_dir, "conversations").filter("role is not null")
    posts = t.groupBy("conv_id", "turn").agg(F.min("role").alias("role")).withColumn("id", F.concat_ws("_", "conv_id", "turn"))
    first = posts.filter("turn % 2 = 0")
    second = deals.new_listings(posts.withColumn("alt_text", F.lit("")), first)
    return feed.append_posts(first, second).select("conv_id", "turn", "role")


@query("""SELECT event_id, CASE WHEN event_id % 3 <> 2 THEN CAST(json_extract_string(props, '$.k') AS BIGINT) END AS k, CASE event_id % 3 WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 0 END AS n FROM events""")
def object_or_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON texts that hold two objects in an array, one object, or neither: the first object and their number."""
    part = F.col("event_id") % 3
    said = F.when(part == 0, F.concat(F.lit(" ["), "props", F.lit(", "), "props", F.lit("]"))).when(part == 1, F.concat(F.lit("\n"), "props")).otherwise("none")
    rows = table(spark, sf_dir, "events").select("event_id", feed.as_array(said, "k: bigint").alias("a"))
    return rows.select("event_id", F.get("a", F.lit(0))["k"].alias("k"), F.coalesce(F.size("a"), F.lit(0)).alias("n"))
