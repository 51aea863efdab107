"""Where tables go: Parquet folders. Nothing is replaced unless that is asked for or is what the step means."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqforge.functions import names, png
from seqforge.operators import sequences
from seqforge.sources import shared_files


def write_encodes(encodes: DataFrame, path: str) -> None:
    """The plan of every degraded chunk (chunk_no, filter, encoder options, ...); what was planned before is replaced."""
    encodes.write.mode("overwrite").parquet(path)


def write_sequences(rows: DataFrame, path: str, high: DataFrame, low: DataFrame, length: int) -> None:
    """Frames of sequences (seq_id, chunk_no, start) under their new names, for those whose frames exist on both sides; added to what is there.

    ``high`` and ``low``: chunk_no, src_frame and the frame's path.
    """
    frames = sequences.expanded(rows, length)
    keys = ["chunk_no", "src_frame"]
    done = sequences.complete(frames, high, low, keys, ["seq_id"], length)
    named = done.join(high.withColumnRenamed("path", "hr_source"), keys).join(low.withColumnRenamed("path", "lr_source"), keys)
    named.withColumn("filename", names.frame_name(F.col("seq_id"), F.col("frame_no"))).write.mode("append").parquet(path)


def write_tiles(tiles: DataFrame, path: str) -> None:
    """Rows of tiles (show, frame_no, tile_pixels, ...), in folders of a thousand shows each."""
    tiles.withColumn("folder", F.expr("show div 1000")).write.mode("error").partitionBy("folder").parquet(path)


def write_chunks(chunks: DataFrame, path: str, existing: int, replace: bool = False) -> None:
    """Chunks (chunk_no, ...). With ``replace`` and no numbered chunk yet (``existing`` is 0), leftovers are cleared; else chunks are added."""
    chunks.write.mode("overwrite" if replace and not existing else "append").parquet(path)


def _images(rows: DataFrame, folder: str, name: Column, planes: list[str]) -> None:
    """What cannot be encoded has no content, and so no file."""
    content = png.encoded(F.col("width"), F.col("height"), *map(F.col, planes))
    shared_files.write_files(rows.select(name.alias("name"), content.alias("content")), folder)


def write_sequence_images(rows: DataFrame, folder: str, high: DataFrame, low: DataFrame, length: int, planes: tuple[str, ...] = ("pixels",)) -> None:
    """The frames of sequences (seq_id, chunk_no, start) as PNG files ``hr/show00001_Frame00001.png`` and ``lr/...`` below the folder's parts.

    ``high`` and ``low``: chunk_no, src_frame, width, height and planes. A sequence of which a frame
    is missing on either side has no file; both sides are committed at once.
    """
    keys = ["chunk_no", "src_frame"]
    done = sequences.complete(sequences.expanded(rows, length), high.select(keys), low.select(keys), keys, ["seq_id"], length)
    own = [*keys, "width", "height", *planes]
    sides = [done.join(side.select(own), keys).withColumn("side", F.lit(name)) for name, side in (("hr", high), ("lr", low))]
    _images(sides[0].unionByName(sides[1]), folder, F.concat("side", F.lit("/"), names.frame_name(F.col("seq_id"), F.col("frame_no"))), list(planes))


def write_tile_images(tiles: DataFrame, folder: str) -> None:
    """Tiles (show, frame_no, width, height, tile_pixels) as PNG files, in folders of a thousand shows each."""
    name = F.concat(F.expr("show div 1000").cast("string"), F.lit("/"), names.frame_name(F.col("show"), F.col("frame_no")))
    _images(tiles, folder, name, ["tile_pixels"])
