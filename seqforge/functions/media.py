"""Numbers of video streams: rates, frame counts, sizes, colour."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Transfer functions of high dynamic range.
HDR_TRANSFERS = ("smpte2084", "arib-std-b67")

PROBE_SCHEMA = (
    "format struct<duration: string>, streams array<struct<codec_type: string, codec_name: string, r_frame_rate: string, avg_frame_rate: string,"
    " width: int, height: int, pix_fmt: string, nb_frames: string, color_transfer: string, color_space: string, color_primaries: string>>"
)


def rate(text: Column) -> Column:
    """``num/den`` or a plain number as double; null if it is neither or den is 0."""
    parts = F.split(text, "/")
    return F.try_divide(F.get(parts, 0).try_cast("double"), F.when(F.size(parts) > 1, F.get(parts, 1).try_cast("double")).otherwise(F.lit(1.0)))


def fps(real: Column, average: Column, default: float = 30.0) -> Column:
    """The real rate, else the average one, else the default."""
    return F.coalesce(rate(real), rate(average), F.lit(default))


def frames_of(seconds: Column, rate_: Column) -> Column:
    """Whole frames, truncated."""
    return (seconds * rate_).cast("long")


def even(n: Column) -> Column:
    """The next even number below, at least 2."""
    return F.greatest(F.floor(n / 2) * 2, F.lit(2)).cast("long")


def odd(n: Column) -> Column:
    """The next odd number above."""
    return n + 1 - n % 2


def is_hdr(transfer: Column, space: Column, primaries: Column) -> Column:
    text = lambda c: F.coalesce(c, F.lit(""))
    return text(transfer).isin(*HDR_TRANSFERS) | text(space).contains("bt2020") | text(primaries).contains("bt2020")


def video_stream(json: Column) -> Column:
    """The first video stream of a probe's JSON; null if there is none."""
    return F.get(F.filter(F.from_json(json, PROBE_SCHEMA)["streams"], lambda s: s["codec_type"] == "video"), 0)


def sequence_probe(json: Column) -> Column:
    """The second way to read a probe's JSON: struct of duration, width, height, fps (0 where the denominator is 0), codec and nb_frames (0 where none is stated); null without a video stream."""
    stream, duration = video_stream(json), F.from_json(json, PROBE_SCHEMA)["format"]["duration"]
    found = F.struct(
        duration.try_cast("double").alias("duration"),
        stream["width"].alias("width"),
        stream["height"].alias("height"),
        F.coalesce(rate(stream["r_frame_rate"]), F.lit(0.0)).alias("fps"),
        stream["codec_name"].alias("codec"),
        F.coalesce(stream["nb_frames"].try_cast("long"), F.lit(0).cast("long")).alias("nb_frames"),
    )
    return F.when(stream.isNotNull(), found)
