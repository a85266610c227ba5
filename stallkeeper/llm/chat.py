"""Multi-party perspective rotation: the dialogue once for each participant, who is the assistant in it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


END = "<|end|>\n"


def head(own: Column, name: Column) -> Column:
    return F.when(own, F.lit("<|assistant|>\n")).otherwise(F.concat(F.lit("<|user name="), name, F.lit("|>\n")))


def block_starts(rows: DataFrame) -> DataFrame:
    """k, block, starts (array of perspective and the characters before the block in its dialogue).

    ``rows`` has k, block, role, as_user and as_own, the turn's rendered length either way. Only sums for each block and
    role are shuffled; a window runs over the blocks of one dialogue.
    """
    sums = rows.groupBy("k", "block", "role").agg(F.sum("as_user").alias("u"), F.sum(F.col("as_own") - F.col("as_user")).alias("more"))
    who = rows.filter("role is not null").select("k", F.col("role").alias("perspective")).distinct()
    size = sums.groupBy("k", "block").agg(F.sum("u").alias("u")).join(who, "k")
    own = sums.filter("role is not null").select("k", "block", F.col("role").alias("perspective"), "more")
    size = size.join(own, ["k", "block", "perspective"], "left").withColumn("size", F.col("u") + F.coalesce("more", F.lit(0)))
    before = Window.partitionBy("k", "perspective").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    base = size.select("k", "block", "perspective", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("base"))
    return base.groupBy("k", "block").agg(F.collect_list(F.struct("perspective", "base")).alias("starts"))


def rotate(turns: DataFrame, block_turns: int = 64) -> DataFrame:
    """Every conversation rendered once for each of its participants (the distinct non-null roles).

    ``turns`` has conv_id, turn, role, text. Returns one row for each (conversation, perspective, turn): conv_id, perspective, turn, role
    (assistant for the perspective's own turns, else user), name (the speaker, null for the assistant), rendered, start and end
    (characters in the rendered dialogue), mask_start and mask_end (the characters to learn: the own text and its end mark; equal
    when the turn is another's). Texts are shuffled once, by conversation and block of turns, so a long conversation is spread over tasks.
    Null texts are empty; turns without a role are said by a user named unknown and have no perspective; a null conv_id is a
    conversation like any other; repeated rows are rendered as often as they come, ordered by turn, name, text; an empty table
    gives no rows.
    """
    rows = turns.select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("k", F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("")))
    rows = rows.withColumn("block", F.coalesce(F.floor(F.col("turn") / block_turns), F.lit(-1)))
    name, body = F.coalesce("role", F.lit("unknown")), F.length("text") + len(END)
    lengths = [(F.length(head(F.lit(own), name)) + body).cast("long").alias(c) for own, c in ((False, "as_user"), (True, "as_own"))]
    starts = block_starts(rows.select("k", "block", "role", *lengths))
    both = rows.join(starts, ["k", "block"]).select("conv_id", "k", "block", "turn", F.col("role").alias("speaker"), "text", F.explode("starts").alias("p"))
    own = F.coalesce(F.col("speaker") == F.col("p.perspective"), F.lit(False))
    name = F.coalesce("speaker", F.lit("unknown"))
    both = both.select("conv_id", "k", "block", "turn", "p.perspective", "p.base", own.alias("own"), F.when(~own, name).alias("name"), "text",
                       F.concat(head(own, name), "text", F.lit(END)).alias("rendered"), F.length(head(own, name)).cast("long").alias("head"))
    size = F.length("rendered").cast("long")
    order = Window.partitionBy("k", "block", "perspective").orderBy("turn", "name", "text").rowsBetween(Window.unboundedPreceding, 0)
    placed = both.withColumn("end", F.col("base") + F.sum(size).over(order)).withColumn("start", F.col("end") - size)
    return placed.select("conv_id", "perspective", "turn", F.when(F.col("own"), "assistant").otherwise("user").alias("role"), "name", "rendered", "start", "end",
                         F.when(F.col("own"), F.col("start") + F.col("head")).otherwise(F.col("end")).alias("mask_start"), F.col("end").alias("mask_end"))
