"""Feeds: concatenated JSON bodies, nested posts, items, images, page text."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import strip
from .common import lookahead_first

#: The part of a feed body that posts are read from.
FEED_SCHEMA = """data struct<node: struct<group_feed: struct<edges: array<struct<node: struct<
  __typename: string, id: string, url: string, creation_time: bigint, actors: array<struct<name: string>>,
  attachments: array<struct<media: struct<image: struct<uri: string>>>>,
  items: array<struct<name: string, wear: string, price: double, currency: string, stattrak: boolean>>,
  comet_sections: struct<content: struct<story: struct<message: struct<text: string>, comet_sections: struct<message: struct<text: string>>>>>
>>>>>>"""


def json_objects(body: str | None) -> list[str]:
    """The JSON values of a string that follow each other, up to the first that isn't valid; none if it starts with white space."""
    decoder, at, out = json.JSONDecoder(), 0, []
    while body and at < len(body):
        try:
            _, end = decoder.raw_decode(body, at)
        except ValueError:
            break
        out.append(body[at:end])
        at = end
        while at < len(body) and body[at].isspace():
            at += 1
    return out


def split_json(df: DataFrame, body: str = "body") -> DataFrame:
    """``df`` with one row for each JSON object of ``body``: pos, obj."""
    where = df.columns.index(body)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 64):
                part = b.slice(at, 64)
                found = [json_objects(x.as_py()) for x in part.column(where)]
                row = pa.array([i for i, objs in enumerate(found) for _ in objs], pa.int64())
                pos, objs = [k for objs in found for k in range(len(objs))], [o for objs in found for o in objs]
                yield pa.RecordBatch.from_arrays([*part.take(row).columns, pa.array(pos, pa.int32()), pa.array(objs, pa.string())], names)

    names = [*df.columns, "pos", "obj"]
    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField("pos", T.IntegerType()), T.StructField("obj", T.StringType())]))


class SplitJson:
    """``json_objects`` as a table function: pos, obj of each object of a string."""

    def eval(self, body: str | None) -> Iterator[tuple[int, str]]:
        yield from enumerate(json_objects(body))


def register_split_json(spark: SparkSession, name: str = "split_json") -> None:
    """Make ``SplitJson`` a table function of SQL: SELECT ... FROM t, LATERAL split_json(t.body). Null and other bodies without objects give no rows."""
    spark.udtf.register(name, F.udtf(SplitJson, returnType="pos int, obj string"))


def feed_bodies(df: DataFrame, body: str = "body") -> DataFrame:
    return df.filter(F.col(body).contains("group_feed") & F.col(body).contains("edges"))


def post_text(node: Column) -> Column:
    story = node["comet_sections"]["content"]["story"]
    return F.coalesce(story["comet_sections"]["message"]["text"], story["message"]["text"], F.lit(""))


def image_uris(attachments: Column) -> Column:
    uris = F.transform(attachments, lambda a: a["media"]["image"]["uri"])
    return F.coalesce(F.filter(uris, lambda u: u.isNotNull() & (u != "")), F.array().cast("array<string>"))


def first_actor(actors: Column) -> Column:
    return F.coalesce(F.get(actors, F.lit(0))["name"], F.lit(""))


def flatten_feed(df: DataFrame, obj: str = "obj") -> DataFrame:
    """Posts (id, author, text, posted_at, images, url, items) of the stories in parsed feed objects."""
    edges = df.select(F.explode(F.from_json(obj, FEED_SCHEMA)["data"]["node"]["group_feed"]["edges"]).alias("e")).select("e.node.*")
    node = F.struct("comet_sections")
    return edges.filter("__typename = 'Story'").select("id", first_actor(F.col("actors")).alias("author"), post_text(node).alias("text"),
                                                       F.timestamp_seconds("creation_time").alias("posted_at"), image_uris(F.col("attachments")).alias("images"), "url", "items")


def expand_items(posts: DataFrame) -> DataFrame:
    """One row for each item of a post (id <post>_item<j>), or the post itself where it has none."""
    rows = posts.select("*", F.posexplode_outer("items").alias("j", "item")).drop("items")
    return rows.withColumn("listing_id", F.coalesce(F.concat("id", F.lit("_item"), F.col("j").cast("string")), F.col("id")))


def as_array(text: Column, schema: str) -> Column:
    """Array of structs of a JSON text that holds an array or one object; null otherwise."""
    kept = strip(text)
    return F.when(kept.startswith("["), F.from_json(text, f"array<struct<{schema}>>")).when(kept.startswith("{"), F.array(F.from_json(text, f"struct<{schema}>")))


def append_posts(old: DataFrame, new: DataFrame) -> DataFrame:
    """The posts of two rounds, one after the other; columns that only one has are null in the other."""
    return old.unionByName(new, allowMissingColumns=True)


def prefix_match(left: DataFrame, right: DataFrame, left_id: str, left_text: str, right_pos: str, right_text: str, probe: int = 15, span: int = 40) -> DataFrame:
    """left id, right pos: the first right row whose start holds the left's probe, or whose probe the left's start holds.

    A start is the first ``span`` characters, trimmed, a probe the start's first ``probe``. A start holds a probe where one of its runs of
    that length is the probe: starts are few runs each, so both ways are equal joins of distinct runs and probes, each with its least pos.
    """
    start = lambda c: F.trim(F.substring(c, 1, span))
    a = left.select(F.col(left_id).alias("__l"), start(F.col(left_text)).alias("s")).filter("s <> ''")
    b = right.select(F.col(right_pos).alias("r"), start(F.col(right_text)).alias("s")).filter("s <> ''").groupBy("s").agg(F.min("r").alias("r"))
    mine, head = a.select("s").distinct(), F.substring("s", 1, probe)
    lengths = lambda df: sorted(r[0] for r in df.select(F.length(head)).distinct().collect())

    def runs_of(n: int) -> Column:
        each = F.transform(F.sequence(F.lit(1), F.length("s") - n + 1), lambda i: F.substring("s", i, F.lit(n)))
        return F.when(F.length("s") >= n, each).otherwise(F.array().cast("array<string>"))

    def held(starts: DataFrame, sizes: list[int]) -> DataFrame:
        every = F.flatten(F.array(*map(runs_of, sizes or [1])))
        return starts.withColumn("run", F.explode(F.array_distinct(every)))

    runs = held(b, lengths(mine)).groupBy("run").agg(F.min("r").alias("r"))
    probes = b.groupBy(head.alias("run")).agg(F.min("r").alias("r"))
    found = mine.withColumn("run", head).join(runs, "run").select("s", "r").unionByName(held(mine, lengths(b)).join(probes, "run").select("s", "r"))
    best = found.groupBy("s").agg(F.min("r").alias("r"))
    return a.join(best, "s").select(F.col("__l").alias(left_id), F.col("r").alias(right_pos))


def valid_box(top: Column, bottom: Column, least: int = 60) -> Column:
    return (top > 0) & (bottom > 0) & (bottom - top >= least)


def clean_images(images: Column) -> Column:
    """Distinct links of structs (src, srcset, width): no data: or static ones, wider than 50, the first of a srcset preferred."""
    link = lambda x: F.coalesce(F.nullif(F.get(F.split(F.trim(x["srcset"]), r"[\s,]+"), F.lit(0)), F.lit("")), x["src"])
    kept = F.filter(images, lambda x: (x["width"] > 50) & ~link(x).startswith("data:") & ~link(x).contains("static"))
    return F.array_distinct(F.transform(kept, link))


def page_price(pages: DataFrame, doc: str, text: str, marker: str, rows: int = 8) -> DataFrame:
    """doc, pos, found: the first ¥ price at or within the lines after a line that is ``marker``."""
    lines = pages.select(doc, F.posexplode(F.split(text, "\n")).alias("pos", "line"))
    price = F.replace(F.nullif(F.regexp_extract("line", r"¥([0-9,]+\.?[0-9]*)", 1), F.lit("")), F.lit(","), F.lit("")).try_cast("double")
    return lookahead_first(lines.withColumn("__p", price), doc, "pos", F.trim("line") == marker, F.col("__p"), rows).select(doc, "pos", "found")


def head_items(items: Column, n: int = 3) -> Column:
    return F.slice(items, 1, n)


def attach_images(posts: DataFrame, rendered: DataFrame) -> DataFrame:
    """``posts`` (id, text, images) with the images and longer text of the first ``rendered`` (pos, text, images) that matches by prefix.

    At most three images are taken, and only where there are some; alt_text is set where the rendered text is longer.
    """
    matched = prefix_match(posts, rendered, "id", "text", "pos", "text")
    seen = rendered.select("pos", F.col("text").alias("__t"), F.col("images").alias("__i"))
    joined = posts.join(matched, "id", "left").join(seen, "pos", "left")
    images = F.when(F.size("__i") > 0, head_items(F.col("__i"))).otherwise(F.col("images"))
    return joined.withColumns({"images": images, "alt_text": F.when(F.length("__t") > F.length("text"), F.col("__t"))}).drop("pos", "__t", "__i")
