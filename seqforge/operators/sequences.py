"""Choosing, thinning, numbering and expanding fixed-length sequences of frames.

Start lists are arrays on the chunk's row, so nothing is shuffled until sequences get global
numbers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pairs(high: DataFrame, low: DataFrame, name: str = "basename") -> DataFrame:
    """Files that both sides have."""
    return high.join(low, name, "inner")


def unpaired(high: DataFrame, low: DataFrame, name: str = "basename") -> DataFrame:
    """High-quality files without a degraded twin."""
    return high.join(low, name, "left_anti")


def _stepped(last: Column, step: Column) -> Column:
    """1, 1 + step, ... up to ``last``; empty if ``last`` is below 1."""
    return F.when(last >= 1, F.sequence(F.lit(1).cast("long"), last.cast("long"), step.cast("long"))).otherwise(F.array().cast("array<bigint>"))


def full_starts(n_frames: Column, length: int) -> Column:
    """Starts of sequences side by side."""
    return _stepped(n_frames - length + 1, F.lit(length))


def gap_starts(n_frames: Column, length: int, fps: Column, time_gap: float | None, frame_skip: int = 0, zero_gap_uses_skip: bool = False) -> Column:
    """Starts with a gap after each sequence: of ``time_gap`` seconds, or of ``frame_skip`` frames if that is None.

    ``zero_gap_uses_skip``: a gap of 0 counts as None.
    """
    if time_gap is None or (zero_gap_uses_skip and not time_gap):
        skip = F.lit(frame_skip).cast("long")
    else:
        skip = (F.lit(float(time_gap)) * fps).cast("long")
    return _stepped(n_frames - length + 1, skip + length)


def scene_starts(scene_starts_: Column, n_frames: Column, length: int) -> Column:
    """First frames (from 1) of scenes whose sequence ends before the last frame; one frame stricter than the others."""
    return F.filter(F.transform(scene_starts_, lambda s: s + 1), lambda s: s + length <= n_frames)


def thinned(starts: Column, most: int | None) -> Column:
    """At most ``most`` starts, evenly spread with the first and last; one keeps the first, none keeps nothing."""
    if most is None:
        return starts
    if most < 1:
        return F.slice(starts, 1, 0)
    if most == 1:
        return F.slice(starts, 1, 1)
    n = F.size(starts)
    step = (n - 1) / F.lit(float(most - 1))
    even = F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda i: F.get(starts, (i * step).cast("int")))
    return F.when(n > most, even).otherwise(starts)


def next_number(names: DataFrame, pattern: str = r"^show(\d+)_") -> int:
    """The largest number in existing names plus 1, or 1."""
    found = names.agg(F.max(F.regexp_extract("filename", pattern, 1).try_cast("long"))).first()[0]
    return (found or 0) + 1


def missing(sequences: DataFrame, existing: DataFrame, keys: list[str]) -> DataFrame:
    """Sequences that do not exist yet."""
    return sequences.join(existing, keys, "left_anti")


def expanded(sequences: DataFrame, length: int) -> DataFrame:
    """frame_no 1..length and src_frame of each sequence (start)."""
    rows = sequences.withColumn("frame_no", F.explode(F.sequence(F.lit(1), F.lit(length))))
    return rows.withColumn("src_frame", F.col("start") + F.col("frame_no") - 1)


def complete(frames: DataFrame, high: DataFrame, low: DataFrame, keys: list[str], group: list[str], length: int) -> DataFrame:
    """Expanded frames of the sequences all of whose frames exist on both sides."""
    both = frames.join(high, keys, "left_semi").join(low, keys, "left_semi")
    whole = both.groupBy(*group).agg(F.count("*").alias("_n")).where(F.col("_n") == length).drop("_n")
    return both.join(whole, group, "left_semi")
