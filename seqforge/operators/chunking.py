"""Cutting recordings into chunks: by duration, by count, at scene changes.

Inputs are tables of recordings (one row each) or of frame signals (one row per frame). No
operator needs a global sort: numbers run per video, and global chunk numbers come from
per-video counts.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def total_frames(nb_frames: Column, duration: Column, fps: Column) -> Column:
    """The stated number of frames, else duration times rate; null if there is neither."""
    return F.coalesce(nb_frames, (duration * fps).cast("long"))


def by_step(videos: DataFrame, total: Column, step: Column) -> DataFrame:
    """One row for each half-open range of ``step`` frames; the last may be shorter. Steps below 1 give none."""
    starts = F.when((total > 0) & (step >= 1), F.sequence(F.lit(0).cast("long"), total.cast("long") - 1, step.cast("long")))
    cut = videos.withColumns({"_total": total, "_step": step}).withColumn("start_frame", F.explode(starts))
    return cut.withColumn("end_frame", F.least(F.col("start_frame") + F.col("_step"), F.col("_total"))).drop("_total", "_step")


def by_duration(videos: DataFrame, seconds: float, total: Column, fps: Column) -> DataFrame:
    return by_step(videos, total, (F.lit(float(seconds)) * fps).cast("long"))


def scenes(signal: DataFrame, threshold: float, max_cuts: int = 0, min_scene_len: int = 1) -> DataFrame:
    """Scenes (video_id, scene_no, start_frame, end_frame) of a signal (video_id, frame_no, score).

    A frame starts a scene if its score reaches the threshold and the scene before it has at
    least ``min_scene_len`` frames (1: every such frame); with ``max_cuts``, later cuts are ignored.
    """
    frames = Window.partitionBy("video_id").orderBy("frame_no")
    cut = F.coalesce(F.col("score") >= threshold, F.lit(False))
    if min_scene_len > 1:
        cut = _spaced(signal, cut, min_scene_len)
        signal = signal.join(cut, ["video_id", "frame_no"], "left")
        cut = F.coalesce("is_cut", F.lit(False))
    numbered = signal.withColumn("scene_no", F.sum(cut.cast("long")).over(frames.rowsBetween(Window.unboundedPreceding, 0)))
    if max_cuts:
        numbered = numbered.withColumn("scene_no", F.least("scene_no", F.lit(max_cuts).cast("long")))
    return numbered.groupBy("video_id", "scene_no").agg(F.min("frame_no").alias("start_frame"), (F.max("frame_no") + 1).alias("end_frame"))


def _spaced(signal: DataFrame, cut: Column, min_len: int) -> DataFrame:
    """The cuts that a greedy walk keeps when each scene needs ``min_len`` frames; walks the cuts of one video at a time."""
    cuts = signal.where(cut).select("video_id", F.col("frame_no").cast("long").alias("frame_no"))

    def walk(group: pd.DataFrame) -> pd.DataFrame:
        last, kept = 0, []
        for n in sorted(group["frame_no"].tolist()):
            if n - last >= min_len:
                kept.append(n)
                last = n
        return pd.DataFrame({"video_id": group["video_id"].iloc[:1].repeat(len(kept)).to_numpy(), "frame_no": kept})

    return cuts.groupBy("video_id").applyInPandas(walk, cuts.schema).withColumn("is_cut", F.lit(True))


def keep_long(scenes_: DataFrame, min_frames: Column) -> DataFrame:
    """Scenes of at least so many frames, numbered densely per video as ``chunk_in_video`` from 1."""
    order = Window.partitionBy("video_id").orderBy("start_frame")
    kept = scenes_.where(F.col("end_frame") - F.col("start_frame") >= min_frames)
    return kept.withColumn("chunk_in_video", F.row_number().over(order).cast("long"))


def number_groups(rows: DataFrame, group: str, within: str, existing: Column | None = None, name: str = "chunk_no", bucket: int = 4096) -> DataFrame:
    """Global numbers in the order of (group, within), continuing after ``existing``.

    Rows are counted per group; groups are summed per bucket of ids (group div bucket), so the
    only ordered single task sees one row per bucket. ``group`` is an integer.
    """
    counts = rows.groupBy(group).agg(F.count("*").alias("_n")).withColumn("_bucket", F.expr(f"{group} div {bucket}"))
    totals = counts.groupBy("_bucket").agg(F.sum("_n").alias("_total"))
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("_bucket", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_base"))
    earlier = Window.partitionBy("_bucket").orderBy(group).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).join(bases, "_bucket")
    offsets = offsets.select(group, (F.col("_base") + F.col("_before")).alias("_offset"))
    place = F.row_number().over(Window.partitionBy(group).orderBy(within))
    start = F.lit(0) if existing is None else existing
    numbered = rows.withColumn("_place", place).join(offsets, group)
    return numbered.withColumn(name, (start + F.col("_offset") + F.col("_place")).cast("long")).drop("_place", "_offset")
