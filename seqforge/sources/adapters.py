"""Model tables (frames, signals, clips, sizes, file lists) derived from the test tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pixels() -> Column:
    return F.transform("embedding", lambda e: F.least(F.greatest(F.floor((e.cast("double") + 1) * 128).cast("int"), F.lit(0)), F.lit(255)))


def embedding_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five consecutive vectors are the frames of a sequence, each an 8 x 8 image. Adds label and vec_id."""
    return frames_of(table(spark, sf_dir, "embeddings"))


def frames_of(embeddings: DataFrame) -> DataFrame:
    """The frames of vectors that were read."""
    return embeddings.select(
        F.expr("vec_id div 5").alias("seq"),
        (F.col("vec_id") % 5 + 1).cast("int").alias("frame_no"),
        F.lit(8).alias("width"),
        F.lit(8).alias("height"),
        _pixels().alias("pixels"),
        "label",
        "vec_id",
    )


def gapped_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without the frames of label 7."""
    return embedding_frames(spark, sf_dir).where("label <> 7")


def letterboxed_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every seventh frame has dark rows 0, 1, 6 and 7."""
    dark = F.transform("pixels", lambda v, i: F.when(i.between(16, 47), v).otherwise(0))
    return embedding_frames(spark, sf_dir).withColumn("pixels", F.when(F.col("vec_id") % 7 == 0, dark).otherwise(F.col("pixels")))


def stitched_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four consecutive vectors as a 16 x 16 mosaic, the first dark in every fifth; seq, frame_no of the group."""
    part = F.when((F.col("vec_id") % 20 < 2), F.transform("pixels", lambda v: F.lit(0))).otherwise(F.col("pixels"))
    parts = embedding_frames(spark, sf_dir).select(F.expr("vec_id div 4").alias("seq"), (F.col("vec_id") % 4).alias("k"), part.alias("p"))
    four = parts.groupBy("seq").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "p"))), lambda x: x["p"]).alias("ps")).where(F.size("ps") == 4)
    row = lambda a, b, r: F.concat(F.slice(F.get("ps", a), r * 8 + 1, 8), F.slice(F.get("ps", b), r * 8 + 1, 8))
    rows = [row(a, b, r) for a, b in ((0, 1), (2, 3)) for r in range(8)]
    return four.select("seq", F.lit(1).alias("frame_no"), F.lit(16).alias("width"), F.lit(16).alias("height"), F.concat(*rows).alias("pixels"))


def recordings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gapped frames, with their sequence as the recording (video_id)."""
    return gapped_frames(spark, sf_dir).withColumnRenamed("seq", "video_id")


def shots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Colour frames: three consecutive vectors are blue, green and red, seven frames a recording (video_id); without those whose blue has label 7."""
    rows = embedding_frames(spark, sf_dir).select(F.expr("vec_id div 3").alias("n"), (F.col("vec_id") % 3).alias("k"), "pixels", "label")
    channel = lambda k: F.max(F.when(F.col("k") == k, F.col("pixels")))
    whole = rows.groupBy("n").agg(channel(0).alias("blue"), channel(1).alias("green"), channel(2).alias("red"), F.max(F.when(F.col("k") == 0, F.col("label"))).alias("label"))
    whole = whole.where("blue IS NOT NULL AND green IS NOT NULL AND red IS NOT NULL AND label <> 7")
    return whole.select(F.expr("n div 7").alias("video_id"), (F.col("n") % 7 + 1).cast("int").alias("frame_no"), F.lit(8).alias("width"), F.lit(8).alias("height"), "blue", "green", "red")


def conversation_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations are sequences, turns their frames from 1."""
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("seq"), (F.col("turn") + 1).alias("frame_no"))


def event_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users are videos, their events the frames from 0; score is the change of value since the frame before."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("video_id"),
        (F.row_number().over(order) - 1).cast("long").alias("frame_no"),
        F.abs(F.col("value") - F.lag("value").over(order)).alias("score"),
    )


def clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders are chunks, their summed quantities the number of frames; 24, 25 or 30 frames a second by key."""
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("chunk_no")).agg(F.sum("l_quantity").cast("long").alias("n_frames"))
    return rows.withColumn("fps", F.element_at(F.array(F.lit(24.0), F.lit(25.0), F.lit(30.0)), (F.col("chunk_no") % 3 + 1).cast("int")))


def geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of images by part; colour tags from its brand and type."""
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"),
        (F.col("p_size") * 64 + F.col("p_partkey") % 7).cast("long").alias("width"),
        (F.col("p_size") * 36 + F.col("p_partkey") % 5).cast("long").alias("height"),
        F.when(F.col("p_partkey") % 4 == 0, "smpte2084").when(F.col("p_partkey") % 4 == 1, "bt709").alias("color_transfer"),
        F.when(F.col("p_partkey") % 6 == 1, "bt2020nc").otherwise("bt709").alias("color_space"),
        F.when(F.col("p_partkey") % 9 == 2, "bt2020").alias("color_primaries"),
        F.element_at(F.array(*map(F.lit, ["25/1", "30000/1001", "0/0", "24", "x", "30/0"])), (F.col("p_partkey") % 6 + 1).cast("int")).alias("frame_rate"),
    )


def high_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One chunk file for each order."""
    return table(spark, sf_dir, "orders").select(F.format_string("chunk_%04d.mkv", "o_orderkey").alias("basename"))


def low_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One chunk file for each order with lines, but those of keys that 11 divides; and some that no order has."""
    keys = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k")).distinct().where("k % 11 <> 0")
    extra = keys.where("k % 13 = 0").select((F.col("k") + 10_000_000).alias("k"))
    return keys.union(extra).select(F.format_string("chunk_%04d.mkv", "k").alias("basename"))
