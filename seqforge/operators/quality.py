"""Verdicts on frames and sequences: blank, motion, completeness; and on file sets.

All verdicts of a sequence come from its own frames, so one shuffle by sequence serves the
``lag`` and every aggregate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqforge.functions import pixels


def details(frames: DataFrame, border_limit: int = 10, edge_limit: int = 30, min_content_px: int = 100) -> DataFrame:
    """edge_num, n_px, var_num and border_num of each frame (pixels, width, height).

    Borders are cropped unless they fill 90 % of the frame or leave fewer than ``min_content_px`` pixels.
    """
    w, h = F.col("width"), F.col("height")
    df = frames.withColumn("_b", pixels.border(F.col("pixels"), w, h, border_limit))
    top, bottom, left, right = (F.col("_b")[s] for s in ("top", "bottom", "left", "right"))
    df = df.withColumns({"_cw": w - left - right, "_ch": h - top - bottom, "border_num": (top + bottom) * w + (left + right) * (h - top - bottom)})
    cropped = (F.col("border_num") * 10 < w * h * 9) & (F.col("_cw") * F.col("_ch") >= min_content_px)
    df = df.withColumns({
        "_px": F.when(cropped, pixels.crop(F.col("pixels"), w, left, top, F.col("_cw"), F.col("_ch"))).otherwise(F.col("pixels")),
        "_cw": F.when(cropped, F.col("_cw")).otherwise(w),
        "_ch": F.when(cropped, F.col("_ch")).otherwise(h),
    })
    df = df.withColumns({"edge_num": pixels.edges(F.col("_px"), F.col("_cw"), F.col("_ch"), edge_limit), "n_px": F.size("_px").cast("long"), "var_num": pixels.spread(F.col("_px"))})
    return df.drop("_b", "_cw", "_ch", "_px")


def is_blank(edge_percent: float, variance: float, border_percent: float = 40.0) -> Column:
    """Over the columns of ``details``: large borders, or few edges and little variance."""
    plain = (F.col("edge_num") * 100 < F.col("n_px") * edge_percent) & (F.col("var_num") < F.col("n_px") * F.col("n_px") * variance)
    return (F.col("border_num") * 100 > F.col("width") * F.col("height") * border_percent) | plain


def motion(frames: DataFrame, threshold: int = 30, group: str = "seq", order: str = "frame_no") -> DataFrame:
    """changed_px and n_px of each frame against the frame before it that exists; the first of a sequence gives no row."""
    before = F.lag("pixels").over(Window.partitionBy(group).orderBy(order))
    df = frames.withColumn("_before", before).where("_before IS NOT NULL")
    return df.withColumns({"changed_px": pixels.changed(F.col("pixels"), F.col("_before"), threshold), "n_px": F.size("pixels").cast("long")}).drop("_before")


def motion_label(least: float, most: float) -> Column:
    """LOW, HIGH or OK over changed_px and n_px; a negative limit is off."""
    score = F.col("changed_px") * 100
    low = (score < F.col("n_px") * least) if least >= 0 else F.lit(False)
    high = (score > F.col("n_px") * most) if most >= 0 else F.lit(False)
    return F.when(low, "LOW").when(high, "HIGH").otherwise("OK")


def completeness(frames: DataFrame, length: int, group: str = "seq", order: str = "frame_no") -> DataFrame:
    """n_frames and ``complete`` (exactly the frames 1..length) of each sequence."""
    n, distinct = F.count("*"), F.count_distinct(order)
    whole = (n == length) & (distinct == length) & (F.min(order) == 1) & (F.max(order) == length)
    return frames.groupBy(group).agg(n.alias("n_frames"), whole.alias("complete"))


def verdicts(frames: DataFrame, edge_percent: float, variance: float, min_blank: int, least: float, most: float, length: int, pixel_threshold: int = 30) -> DataFrame:
    """status (kept or bad) and reason of each sequence: blank, motion or incomplete, the first that holds.

    As every filter reads its sequence alone, deciding all three at once equals running them one after another.
    """
    judged = details(frames).withColumn("_blank", is_blank(edge_percent, variance).cast("int"))
    before = F.lag("pixels").over(Window.partitionBy("seq").orderBy("frame_no"))
    judged = judged.withColumn("_before", before)
    judged = judged.withColumn("changed_px", F.when(F.col("_before").isNotNull(), pixels.changed(F.col("pixels"), F.col("_before"), pixel_threshold)))
    judged = judged.withColumn("_n_px", F.size("pixels"))
    score = F.col("changed_px") * 100
    off = F.lit(False)
    moved = ((score < F.col("_n_px") * least) if least >= 0 else off) | ((score > F.col("_n_px") * most) if most >= 0 else off)
    whole = (F.count("*") == length) & (F.count_distinct("frame_no") == length) & (F.min("frame_no") == 1) & (F.max("frame_no") == length)
    per = judged.groupBy("seq").agg(
        F.count("*").alias("n_frames"),
        F.sum("_blank").cast("long").alias("blank_frames"),
        F.coalesce(F.bool_or(moved), off).alias("motion_bad"),
        whole.alias("complete"),
    )
    reason = F.when(F.col("blank_frames") >= min_blank, "blank").when(F.col("motion_bad"), "motion").when(~F.col("complete"), "incomplete")
    return per.withColumns({"reason": reason, "status": F.when(reason.isNull(), "kept").otherwise("bad")})


def orphans(high: DataFrame, low: DataFrame, path: str = "rel_path") -> DataFrame:
    """Degraded files whose high-quality twin is gone."""
    return low.join(high, path, "left_anti")


def compared(base: DataFrame, other: DataFrame, path: str = "rel_path") -> DataFrame:
    """rel_path and side of the files that only one set has."""
    a = base.select(path).distinct().withColumn("_a", F.lit(True))
    b = other.select(path).distinct().withColumn("_b", F.lit(True))
    odd = a.join(b, path, "full_outer").where("_a IS NULL OR _b IS NULL")
    return odd.select(path, F.when(F.col("_b").isNull(), "baseline_only").otherwise("secondary_only").alias("side"))


def quarantined(rows: DataFrame, path: str) -> None:
    """Writes rows with a ``status`` under one folder per status."""
    rows.write.mode("error").partitionBy("status").parquet(path)
