"""Image tiles and the consensus of repeated readings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def grid_defaults(rows: Column, cols: Column) -> tuple[Column, Column]:
    return F.coalesce(F.nullif(rows, F.lit(0)), F.lit(7)), F.coalesce(F.nullif(cols, F.lit(0)), F.lit(3))


def tile_grid(df: DataFrame, overlap: float = 0.15) -> DataFrame:
    """image_id, item_id, left, upper, right, lower of every tile of images (image_id, width, height, rows, cols)."""
    n_rows, n_cols = grid_defaults(F.col("rows"), F.col("cols"))
    g = df.select("image_id", "width", "height", n_rows.alias("n_rows"), n_cols.alias("n_cols"))
    g = g.withColumn("r", F.explode(F.sequence(F.lit(0), F.col("n_rows") - 1))).withColumn("c", F.explode(F.sequence(F.lit(0), F.col("n_cols") - 1)))
    w, h = F.floor(F.col("width") / F.col("n_cols")), F.floor(F.col("height") / F.col("n_rows"))
    ow, oh = F.floor(w * overlap), F.floor(h * overlap)
    return g.select("image_id", (F.col("r") * F.col("n_cols") + F.col("c")).cast("int").alias("item_id"),
                    F.greatest(F.lit(0), F.col("c") * w - ow).cast("long").alias("left"), F.greatest(F.lit(0), F.col("r") * h - oh).cast("long").alias("upper"),
                    F.least(F.col("width"), (F.col("c") + 1) * w + ow).cast("long").alias("right"),
                    F.least(F.col("height"), (F.col("r") + 1) * h + oh).cast("long").alias("lower"))


def consensus(readings: DataFrame, threshold: float = 0.7) -> DataFrame:
    """One row for each tile (image_id, item_id) from its readings by attempt 1, 2, 3; price is that of the caller's table, looked up only when checked.

    An unsure first reading is merged with the second: equal ticks keep the higher confidence and a non-empty second name,
    different ticks take the second's tick and the lower confidence. A ticked name needs the next unused reading to agree with it
    (one name's first four characters within the other) unless that one is empty. A confidence still under the threshold fails.
    """
    r = readings.groupBy("image_id", "item_id").pivot("attempt", [1, 2, 3]).agg(F.first(F.struct("name", "wear", "is_checked", "confidence", "price", "currency"), ignorenulls=True))
    r = r.select("image_id", "item_id", F.col("1").alias("r1"), F.col("2").alias("r2"), F.col("3").alias("r3"))
    name = lambda x: F.coalesce(F.col(f"{x}.name"), F.lit(""))
    unsure = (F.col("r1.confidence") < threshold) & F.col("r2").isNotNull()
    same = F.col("r1.is_checked") == F.col("r2.is_checked")
    r = r.withColumns({
        "conf": F.when(unsure & same, F.greatest("r1.confidence", "r2.confidence")).when(unsure, F.least("r1.confidence", "r2.confidence")).otherwise(F.col("r1.confidence")),
        "checked": F.when(unsure & ~same, F.col("r2.is_checked")).otherwise(F.col("r1.is_checked")),
        "name": F.when(unsure & same & (name("r2") != ""), name("r2")).otherwise(name("r1")),
        "next_name": F.when(unsure, name("r3")).otherwise(name("r2")),
    })
    agree = F.col("name").contains(F.substring("next_name", 1, 4)) | F.col("next_name").contains(F.substring("name", 1, 4))
    unstable = F.col("checked") & (F.col("name") != "") & (F.col("next_name") != "") & (F.col("name") != F.col("next_name")) & ~agree
    error = F.when(F.coalesce(unstable, F.lit(False)), "Unstable name, skipped").when(F.col("conf") < threshold, "Low confidence bypass")
    r = r.withColumn("error_msg", error)
    ok = F.col("error_msg").isNull()
    return r.select("image_id", "item_id", "name", F.col("checked").alias("is_checked"), F.col("conf").alias("confidence"),
                    F.when(ok & F.col("checked"), F.col("r1.price")).otherwise(0.0).alias("price"), F.when(ok, F.col("r1.wear")).otherwise("").alias("wear"),
                    F.when(ok, F.col("r1.currency")).otherwise("RMB").alias("currency"), ok.alias("success"), F.coalesce("error_msg", F.lit("")).alias("error_msg"))
