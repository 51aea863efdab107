"""Degradations carried out on decoded frames, as DataFrame operations.

Frames have a recording (``video_id``), a number (``frame_no``), a size and one column of pixels for
each plane. What reads one frame is a projection; what reads its neighbours is a window over the
recording, and one shuffle by ``video_id`` serves all of them. Nothing here draws at random:
parameters are columns or values, as the degradation plans give them.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqforge.functions import raster
from seqforge.sources import kept


def _size() -> tuple[Column, Column]:
    return F.col("width"), F.col("height")


def order() -> Window:
    return Window.partitionBy("video_id").orderBy("frame_no")


def planes(blue: Column, green: Column, red: Column) -> dict[str, Column]:
    """Full-range luma and the two chroma planes of 8-bit channels, all of the frame's size."""
    mix = lambda b, g, r, add: lambda p: F.shiftright(p["b"] * b + p["g"] * g + p["r"] * r + add, 16)
    zipped = F.arrays_zip(blue.alias("b"), green.alias("g"), red.alias("r"))
    half, middle = 1 << 15, (128 << 16) + (1 << 15) - 1
    #: Weights of the channels in 65536ths.
    weights = {"y": (7471, 38470, 19595, half), "u": (32768, -21709, -11059, middle), "v": (-5329, -27439, 32768, middle)}
    return {name: F.transform(zipped, mix(*w)).cast("array<int>") for name, w in weights.items()}


def halved_chroma(frames: DataFrame) -> DataFrame:
    """Frames of y, u, v where u and v are halved in both directions (odd sides round up), as 4:2:0 video stores them; adds chroma_width and chroma_height."""
    w, h = _size()
    frames = frames.withColumns({"chroma_width": F.ceil(w / 2).cast("int"), "chroma_height": F.ceil(h / 2).cast("int")})
    return frames.withColumns({c: raster.scaled(F.col(c), w, h, F.col("chroma_width"), F.col("chroma_height"), "area") for c in ("u", "v")})


def resized(frames: DataFrame, width: Column, height: Column, kind: str, columns: tuple[str, ...] = ("pixels",)) -> DataFrame:
    """Planes at a new size, by the area, the bilinear or the bicubic filter; a cubic is not widened where the frame shrinks."""
    done = frames.withColumns({"_w": width.cast("int"), "_h": height.cast("int")})
    done = done.withColumns({c: raster.scaled(F.col(c), *_size(), F.col("_w"), F.col("_h"), kind) for c in columns})
    return done.withColumns({"width": F.col("_w"), "height": F.col("_h")}).drop("_w", "_h")


def box_blurred(frames: DataFrame, radius: Column, power: Column, columns: tuple[str, ...] = ("pixels",)) -> DataFrame:
    """Means over squares of the radius, so many times over."""
    return frames.withColumns({c: raster.over_stacks(raster.boxed, *_size(), [F.col(c)], by=[radius, power]) for c in columns})


def gaussian_blurred(frames: DataFrame, sigma: float, steps: int = 1, columns: tuple[str, ...] = ("pixels",)) -> DataFrame:
    """A gaussian of the spread ``sigma`` as three boxes, so many times over."""
    radii = raster.box_radii(sigma) * steps
    return frames.withColumns({c: raster.over_stacks(lambda s: raster.gaussian(s, radii), *_size(), [F.col(c)]) for c in columns})


def motion_blurred(frames: DataFrame, n: int, columns: tuple[str, ...] = ("pixels",)) -> DataFrame:
    """Each frame averaged with the one before it, n - 1 times over; the first has none before it and stays."""
    for _ in range(n - 1):
        before = {f"_{c}": F.lag(c).over(order()) for c in columns}
        blend = {c: F.when(F.col(f"_{c}").isNull(), F.col(c)).otherwise(F.zip_with(c, f"_{c}", lambda a, b: F.shiftright(a + b, 1))) for c in columns}
        frames = frames.withColumns(before).withColumns(blend).drop(*before)
    return frames


def haloed(frames: DataFrame, kx: Column, ky: Column, amount: Column, columns: tuple[str, ...] = ("y",)) -> DataFrame:
    """Unsharp masking of luma: odd kernel sizes, ``amount`` in thousandths; chroma stays."""
    return frames.withColumns({c: raster.over_stacks(raster.sharpened, *_size(), [F.col(c)], by=[kx, ky], each=[amount]) for c in columns})


def noised(frames: DataFrame, seed: Column, strength: Column, gaussian: bool = True, column: str = "pixels") -> DataFrame:
    """Noise by (seed, frame number, pixel), so that neither order nor partitions matter."""
    draws = F.lit(4 if gaussian else 1)
    return frames.withColumn(column, raster.over_stacks(raster.noisy, *_size(), [F.col(column)], by=[draws], each=[seed, F.col("frame_no"), strength]))


def interlaced(frames: DataFrame, top: bool, columns: tuple[str, ...] = ("pixels",)) -> DataFrame:
    """Two consecutive frames woven into one, which halves the rate: numbers start at 1 again, and a last frame without its second goes.

    Frames that exist are paired in order, whatever gaps their numbers have; both frames of a pair have one size.
    """
    place = F.row_number().over(order())
    paired = frames.withColumn("_place", place).withColumns({f"_{c}": F.lead(c).over(order()) for c in columns})
    paired = paired.withColumn("_last", F.lead("frame_no").over(order()).isNull()).where("_place % 2 = 1 AND NOT _last")
    weave = {c: raster.over_stacks(raster.woven, *_size(), [F.col(c), F.col(f"_{c}")], by=[F.lit(int(top))]) for c in columns}
    return paired.withColumns(weave).withColumn("frame_no", F.expr("(_place + 1) div 2").cast("int")).drop("_place", "_last", *[f"_{c}" for c in columns])


def chroma_interlaced(frames: DataFrame, top: bool) -> DataFrame:
    """Luma stays; the chroma of both frames of a pair is woven. A last frame without its second keeps its chroma."""
    first = F.row_number().over(order()) % 2 == 1
    paired = frames.withColumn("_first", first)
    for c in "uv":
        before, after = F.lag(c).over(order()), F.lead(c).over(order())
        paired = paired.withColumns({f"_a{c}": F.when(F.col("_first"), F.col(c)).otherwise(before), f"_b{c}": F.when(F.col("_first"), after).otherwise(F.col(c))})
    size = F.col("chroma_width"), F.col("chroma_height")
    weave = {c: raster.over_stacks(raster.woven, *size, [F.col(f"_a{c}"), F.col(f"_b{c}")], by=[F.lit(int(top))]) for c in "uv"}
    done = paired.withColumns({f"_{c}": v for c, v in weave.items()}).withColumns({c: F.coalesce(f"_{c}", c) for c in "uv"})
    return done.drop("_first", *[f"_{k}{c}" for c in "uv" for k in ("a", "b", "")])


def chroma_delayed(frames: DataFrame, delay: float, columns: tuple[str, ...] = ("u", "v")) -> DataFrame:
    """Luma with the chroma of ``delay`` frames before: the last one that was due by then; until one is, the first.

    Times are frame numbers, so that a gap delays no longer than it should; half a frame of delay
    shows the frame before, as a picture stays until the next one is due.
    """
    back = -int(-delay // 1) if delay > 0 else 0  # up
    due = order().rangeBetween(Window.unboundedPreceding, -back)
    first = Window.partitionBy("video_id").orderBy("frame_no").rowsBetween(Window.unboundedPreceding, 0)
    return frames.withColumns({c: F.coalesce(F.last(c, ignorenulls=True).over(due), F.first(c, ignorenulls=True).over(first)) for c in columns})


def median(window: Column) -> Column:
    """The lower median of each pixel over an array of frames of one size; null frames are passed over."""

    @F.pandas_udf("array<int>")
    def middle(frames: pd.Series) -> pd.Series:
        stacks = ([p for p in f if p is not None] if f is not None else [] for f in frames)
        return pd.Series([np.sort(np.stack(s), axis=0)[(len(s) - 1) // 2] if s else None for s in stacks], dtype=object)

    return middle(window)


def ghosted(frames: DataFrame, ghosts: list[dict[str, int]], column: str = "pixels") -> DataFrame:
    """Trails over each frame, one after another: the median of the frames within ``delay``, softened, moved and mixed in by ``opacity``.

    A ghost has delay (frames), offset_x, offset_y (pixels), opacity (thousandths) and, as its shift of the plane's colour, gain
    (thousandths, 1000 if there is none).
    """
    around = {f"_g{k}": F.collect_list(column).over(order().rowsBetween(-g["delay"], g["delay"])) for k, g in enumerate(ghosts)}
    trails = frames.withColumns(around).withColumns({name: median(F.col(name)) for name in around})

    def overlaid(under: np.ndarray, *trails: np.ndarray) -> np.ndarray:
        for trail, g in zip(trails, ghosts, strict=True):
            soft = raster.clipped(raster.rounded(raster.boxed(trail, 1) * g.get("gain", 1000), 1000))
            under = raster.mixed(under, raster.shifted(soft, g["offset_x"], g["offset_y"]), g["opacity"])
        return under

    if not ghosts:
        return frames
    return trails.withColumn(column, raster.over_stacks(overlaid, *_size(), [F.col(column), *map(F.col, around)])).drop(*around)


# tone mapping


def histogram(values: Column, bins: int = 256) -> Column:
    """How often each of 0 .. bins - 1 occurs in an array."""

    @F.pandas_udf("array<long>")
    def counted(px: pd.Series) -> pd.Series:
        return pd.Series([np.bincount(np.clip(np.asarray([] if p is None else p, dtype=np.int64), 0, bins - 1), minlength=bins) for p in px], dtype=object)

    return counted(values)


def peaks(frames: DataFrame, columns: tuple[str, ...], share: int = 999) -> DataFrame:
    """video_id, peak: the value that ``share`` thousandths of a recording's pixels do not exceed, at least 1.

    A frame leaves its task as at most 256 counts; tasks merge theirs by recording, and only those are shuffled.
    """
    brightest = F.transform(F.arrays_zip(*columns), lambda p: F.greatest(*[p[c] for c in columns])) if len(columns) > 1 else F.col(columns[0])
    counts = frames.select("video_id", F.posexplode(histogram(brightest)).alias("v", "n")).where("n > 0")
    return counts.groupBy("video_id").agg(F.greatest(F.floor(F.percentile("v", share / 1000, F.col("n"))), F.lit(1)).cast("int").alias("peak"))


def _filmic(v: int, unit: int) -> tuple[int, int]:
    """Numerator and denominator of the filmic curve at v / unit."""
    #: Fixed values, in hundredths: shoulder, linear strength, linear angle, toe strength, toe numerator, toe denominator.
    a, b, c, d, e, f = 15, 50, 10, 20, 2, 30
    num = 100 * a * v * v + b * c * v * unit + d * e * unit * unit
    den = 100 * a * v * v + 100 * b * v * unit + d * f * unit * unit
    return num * f - den * e, den * f


def curve(kind: str, peak: int, unit: int = 128) -> list[int]:
    """The lookup table of a curve, where 255 is what the peak becomes and ``unit`` is the value of one.

    reinhard: x / (x + 1); hable: the filmic curve; clip: a straight line.
    """
    parts = {"reinhard": lambda v: (v, v + unit), "hable": lambda v: _filmic(v, unit), "clip": lambda v: (v, 1)}[kind]
    white, under = parts(peak)
    table = []
    for v in range(256):
        num, den = parts(v)
        table.append(min((510 * num * under + den * white) // (2 * den * white), 255))
    return table


def tonemapped(frames: DataFrame, kind: str, columns: tuple[str, ...] = ("pixels",), share: int = 999) -> DataFrame:
    """Values up to each recording's peak brought to 0..255 by a curve; adds ``peak``. Only histograms are shuffled.

    The peaks are kept and broadcast if they are few; a table by peak has at most 255 rows. Recordings without a pixel stay as they are.
    """
    tables = frames.sparkSession.createDataFrame([(p, curve(kind, p)) for p in range(1, 256)], "peak int, _lut array<int>")
    known = kept.sized(kept.cut(peaks(frames, columns, share)))
    joined = frames.join(known, "video_id", "left").join(F.broadcast(tables), "peak", "left")
    looked = {c: F.transform(c, lambda v: F.coalesce(F.get("_lut", F.least(F.greatest(v, F.lit(0)), F.lit(255))), v)) for c in columns}
    return joined.withColumns(looked).drop("_lut")


# scene signal


def scene_signal(frames: DataFrame, factor: int, channels: tuple[str, str, str] = ("blue", "green", "red")) -> DataFrame:
    """video_id, frame_no, score_num, n_px, score: the mean change of hue, saturation and value since the frame before, on shrunk frames.

    Frames are shrunk before the shuffle by recording, so what is shuffled is smaller by the square of the
    factor. The first frame of a recording, and one whose size differs from the frame before, has no score.
    """
    def small(blue: np.ndarray, green: np.ndarray, red: np.ndarray) -> np.ndarray:
        return np.stack(raster.hsv(*[raster.shrunk(c, factor) for c in (blue, green, red)]), 1)

    seen = frames.select("video_id", "frame_no", raster.over_stacks(small, *_size(), [F.col(c) for c in channels]).alias("_hsv"))
    seen = seen.withColumn("_before", F.lag("_hsv").over(order()))
    change = F.aggregate(F.zip_with("_hsv", "_before", lambda a, b: F.abs(a - b)), F.lit(0).cast("long"), lambda a, v: a + v)
    fits = F.size("_hsv") == F.size("_before")
    scored = seen.select("video_id", "frame_no", F.when(fits, change).alias("score_num"), (F.size("_hsv") / 3).cast("long").alias("n_px"))
    return scored.withColumn("score", F.col("score_num") / (F.col("n_px") * 3))
