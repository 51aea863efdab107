"""Tiles: grid positions, shuffled order, sliding windows, global tile numbers.

Cross products are made of metadata only; pixels are cut from the frame that a tile names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqforge.functions import pixels


def _starts(size: Column, tile: int) -> Column:
    return F.when(size >= tile, F.sequence(F.lit(0).cast("long"), (size - tile).cast("long"), F.lit(tile).cast("long"))).otherwise(F.array().cast("array<bigint>"))


def grid(images: DataFrame, tile_w: int, tile_h: int, width: str = "width", height: str = "height") -> DataFrame:
    """x, y, tile_idx (row by row from 0) of the whole tiles of each image; none if the image is smaller than a tile."""
    rows = images.withColumn("y", F.explode(_starts(F.col(height), tile_h))).withColumn("x", F.explode(_starts(F.col(width), tile_w)))
    across = F.floor(F.col(width) / tile_w)
    return rows.withColumn("tile_idx", (F.floor(F.col("y") / tile_h) * across + F.floor(F.col("x") / tile_w)).cast("long"))


def shuffled(tiles: DataFrame, group: str, seed: int) -> DataFrame:
    """Renumbers the tiles of each group in the order of a keyed hash: the same seed gives the same order everywhere."""
    order = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(group).cast("string"), F.col("x").cast("string"), F.col("y").cast("string")))
    place = F.row_number().over(Window.partitionBy(group).orderBy(order, "y", "x"))
    return tiles.withColumn("tile_idx", (place - 1).cast("long"))


def windows(frames: DataFrame, group: str, order: str, length: int) -> DataFrame:
    """Sliding windows of ``length`` consecutive rows: window_no from 0, offset from 0, and the row's columns."""
    over = Window.partitionBy(group)
    placed = frames.withColumns({"_place": F.row_number().over(over.orderBy(order)) - 1, "_n": F.count("*").over(over)})
    first, last = F.greatest(F.col("_place") - (length - 1), F.lit(0)), F.least(F.col("_place"), F.col("_n").cast("int") - length)
    rows = placed.withColumn("window_no", F.explode(F.when(last >= first, F.sequence(first, last))))
    return rows.withColumn("offset", F.col("_place") - F.col("window_no")).drop("_place", "_n")


#: Ranges of names into which ``numbered`` deals its scenes, and names that are looked at to find their bounds.
RANGES, SAMPLE = 256, 4096


def _range_of(scenes: DataFrame, order: str) -> Column:
    """Number of the range of a name: ranges hold about equally many scenes, whatever their names begin with.

    The bounds come from the names of the smallest hashes, a sample that no partitioning changes.
    """
    rows = scenes.where(F.col(order).isNotNull()).select(F.col(order).alias("n")).orderBy(F.xxhash64("n"), "n").limit(SAMPLE)
    names = sorted({r["n"] for r in rows.collect()})
    bounds = [names[len(names) * k // RANGES] for k in range(1, RANGES)] if len(names) >= RANGES else names
    return F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b <= F.col(order))) if bounds else F.lit(0)


def numbered(scenes: DataFrame, order: str, n_windows: str, n_tiles: str, name: str = "first_show") -> DataFrame:
    """The show number of each scene's first tile: 1 plus windows times tiles of the scenes before it.

    Scenes are summed by ranges of ``order``, so that only those sums meet in one task.
    """
    load = F.col(n_windows) * F.col(n_tiles)
    keyed = scenes.withColumns({"_key": _range_of(scenes, order), "_load": load})
    sums = keyed.groupBy("_key").agg(F.sum("_load").alias("_sum"))
    bases = sums.select("_key", F.coalesce(F.sum("_sum").over(Window.orderBy("_key").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    within = Window.partitionBy("_key").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    placed = keyed.withColumn("_before", F.coalesce(F.sum("_load").over(within), F.lit(0))).join(F.broadcast(bases), "_key")  # at most RANGES rows
    return placed.withColumn(name, (F.col("_base") + F.col("_before") + 1).cast("long")).drop("_key", "_load", "_base", "_before")


def cut(frames: DataFrame, tile_w: int, tile_h: int) -> DataFrame:
    """tile_pixels of rows with pixels, width, x, y."""
    return frames.withColumn("tile_pixels", pixels.crop(F.col("pixels"), F.col("width"), F.col("x"), F.col("y"), F.lit(tile_w), F.lit(tile_h)))


def low_size(tile: int, hundredths: int) -> int:
    """Size of the degraded tile."""
    return tile * hundredths // 100
