"""Arithmetic on planes of pixels: numpy over stacks of the frames of an Arrow batch that share a size.

A stack has the shape (frames, rows, columns), in 64-bit integers. Every kernel is exact: weights
are integers, and one division with a stated rounding comes last, so that results can be
held against SQL pixel by pixel. Frames whose pixels, size or parameters are null, or whose
pixels are fewer than their size says, become null.
"""

from __future__ import annotations

import sys
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F

# Kernels travel with the job, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def over_stacks(kernel: Callable[..., np.ndarray], width: Column, height: Column, planes: list[Column], by: list[Column] = (), each: list[Column] = ()) -> Column:
    """``kernel(*stacks, *by, *each)`` of planes of one size, as an array of integers.

    Frames of a batch are stacked by size and by the values of ``by``, which the kernel gets as
    integers; ``each`` are integers of a frame, given as arrays over the stack. The kernel
    gives one array for each frame, of any shape.
    """
    n_planes, n_by = len(planes), len(by)

    def task(*columns: pd.Series) -> pd.Series:
        w, h, rest = columns[0], columns[1], columns[2:]
        pixels, keys, values = rest[:n_planes], rest[n_planes : n_planes + n_by], rest[n_planes + n_by :]
        out: list = [None] * len(w)
        known = pd.concat([w, h, *keys, *values], axis=1).notna().all(axis=1) & (w > 0) & (h > 0)
        for p in pixels:
            known &= p.notna()
        stacked: dict[tuple, list[int]] = {}
        for k in np.flatnonzero(known.to_numpy()):
            if all(len(p.iloc[k]) >= w.iloc[k] * h.iloc[k] for p in pixels):
                stacked.setdefault((int(w.iloc[k]), int(h.iloc[k]), *[int(v.iloc[k]) for v in keys]), []).append(k)
        for (columns_, rows, *by_values), places in stacked.items():
            stacks = [np.stack([np.asarray(p.iloc[k], dtype=np.int64)[: rows * columns_] for k in places]).reshape(len(places), rows, columns_) for p in pixels]
            done = kernel(*stacks, *by_values, *[v.iloc[places].to_numpy(dtype=np.int64) for v in values])
            for k, frame in zip(places, done, strict=True):
                out[k] = frame.reshape(-1)
        return pd.Series(out, dtype=object)

    return F.pandas_udf(task, "array<int>")(width, height, *planes, *by, *each)


def rounded(total: np.ndarray, parts: np.ndarray | int) -> np.ndarray:
    """total / parts, halves up."""
    return (2 * total + parts) // (2 * parts)


def clipped(values: np.ndarray) -> np.ndarray:
    return np.clip(values, 0, 255)


# resampling

#: Filters of a new size; unit of the weights of a cubic.
FILTERS, CUBIC = ("area", "bilinear", "bicubic"), 1 << 14


@lru_cache(maxsize=256)
def taps(size: int, new: int, kind: str) -> tuple[np.ndarray, np.ndarray, int]:
    """(sources, weights, sum of weights) of each new sample of a line: the table that a pass reads.

    area: lengths that a source and a new sample share, in parts of 1 / new; bilinear: the two nearest centres;
    bicubic: the cubic through the four nearest centres, in parts of CUBIC, of which the nearest takes what rounding leaves.
    """
    at = np.arange(new, dtype=np.int64)
    if kind == "bicubic":
        place, d = (2 * at + 1) * size - new, 2 * new
        left = place // d
        s = place - left * d
        parts = np.stack([-(s**3) + 2 * s * s * d - s * d * d, 3 * s**3 - 5 * s * s * d + 2 * d**3, -3 * s**3 + 4 * s * s * d + s * d * d, s**3 - s * s * d], 1)
        weights = (parts * CUBIC + d**3) // (2 * d**3)
        weights[at, np.where(2 * s < d, 1, 2)] += CUBIC - weights.sum(axis=1)
        return np.clip(left[:, None] + np.arange(-1, 3), 0, size - 1), weights, CUBIC
    if kind == "bilinear":
        place = np.clip((2 * at + 1) * size - new, 0, 2 * new * (size - 1))
        left = place // (2 * new)
        share = place - left * 2 * new
        return np.stack([left, np.minimum(left + 1, size - 1)], 1), np.stack([2 * new - share, share], 1), 2 * new
    if kind == "area":
        first = at * size // new
        sources = first[:, None] + np.arange(-(-size // new) + 1)
        weights = np.minimum((sources + 1) * new, (at[:, None] + 1) * size) - np.maximum(sources * new, at[:, None] * size)
        return np.minimum(sources, size - 1), np.maximum(weights, 0), size
    raise ValueError(f"unknown filter {kind}")


def resampled(stack: np.ndarray, kind: str, width: int, height: int) -> np.ndarray:
    """Two passes, along the rows and along the columns, and one rounding."""
    across, across_weights, across_sum = taps(stack.shape[2], width, kind)
    down, down_weights, down_sum = taps(stack.shape[1], height, kind)
    wide = sum(stack[:, :, across[:, k]] * across_weights[:, k] for k in range(across.shape[1]))
    done = sum(wide[:, down[:, k]] * down_weights[:, k][:, None] for k in range(down.shape[1]))
    return clipped(rounded(done, across_sum * down_sum))


def scaled(pixels: Column, width: Column, height: Column, new_width: Column, new_height: Column, kind: str) -> Column:
    if kind not in FILTERS:
        raise ValueError(f"unknown filter {kind}")
    return over_stacks(lambda s, w, h: resampled(s, kind, w, h), width, height, [pixels], by=[new_width, new_height])


def shrunk(stack: np.ndarray, factor: int) -> np.ndarray:
    """Means of squares of factor x factor pixels; what is left over at the right and below is dropped, a side shorter than the factor is one square."""
    n, h, w = stack.shape
    fh, fw = min(factor, h), min(factor, w)
    cut = stack[:, : h // fh * fh, : w // fw * fw].reshape(n, h // fh, fh, w // fw, fw)
    return rounded(cut.sum(axis=(2, 4)), fh * fw)


# box sums


def summed(stack: np.ndarray) -> np.ndarray:
    """The summed-area table: sums of all pixels above and left of each corner."""
    n, h, w = stack.shape
    table = np.zeros((n, h + 1, w + 1), dtype=np.int64)
    np.cumsum(np.cumsum(stack, axis=1), axis=2, out=table[:, 1:, 1:])
    return table


def box(stack: np.ndarray, rx: int, ry: int) -> tuple[np.ndarray, np.ndarray]:
    """(sum, number) of the pixels within rx columns and ry rows, inside the frame: four reads of the table each, whatever the radius."""
    table, (_, h, w) = summed(stack), stack.shape
    top, bottom = np.maximum(np.arange(h) - ry, 0), np.minimum(np.arange(h) + ry + 1, h)
    left, right = np.maximum(np.arange(w) - rx, 0), np.minimum(np.arange(w) + rx + 1, w)
    lower, upper = table[:, bottom], table[:, top]
    return lower[:, :, right] - lower[:, :, left] - upper[:, :, right] + upper[:, :, left], (bottom - top)[:, None] * (right - left)


def boxed(stack: np.ndarray, radius: int, power: int = 1) -> np.ndarray:
    for _ in range(power):
        stack = rounded(*box(stack, radius, radius))
    return stack


def box_radii(sigma: float, boxes: int = 3) -> list[int]:
    """Radii of boxes that, one after another, have the spread of a gaussian."""
    low = int((12 * sigma * sigma / boxes + 1) ** 0.5)
    low -= low % 2 == 0
    small = round((12 * sigma * sigma - boxes * (low * low + 4 * low + 3)) / (-4 * low - 4))
    return [(low - 1) // 2 if k < small else (low + 1) // 2 for k in range(boxes)]


def gaussian(stack: np.ndarray, radii: list[int]) -> np.ndarray:
    for radius in radii:
        stack = boxed(stack, radius)
    return stack


def borders(stack: np.ndarray, limit: int) -> np.ndarray:
    """top, bottom, left, right: lines from each side with a mean of at most the limit, up to the middle (bottom and right one less), from the summed-area table."""
    table, (_, h, w) = summed(stack), stack.shape
    rows, columns = np.diff(table[:, :, w], axis=1) > limit * w, np.diff(table[:, h], axis=1) > limit * h

    def leading(bright: np.ndarray, most: int) -> np.ndarray:
        seen = np.concatenate([bright[:, :most], np.ones((len(bright), 1), dtype=bool)], axis=1)
        return seen.argmax(axis=1)

    return np.stack([leading(rows, h // 2), leading(rows[:, ::-1], h - 1 - h // 2), leading(columns, w // 2), leading(columns[:, ::-1], w - 1 - w // 2)], 1)


def sharpened(stack: np.ndarray, kx: int, ky: int, amount: np.ndarray) -> np.ndarray:
    """Pixels moved away from the mean of kx x ky around them, by thousandths of the difference."""
    sums, number = box(stack, kx // 2, ky // 2)
    moved = stack * 1000 * number + amount[:, None, None] * (stack * number - sums)
    return clipped(rounded(moved, 1000 * number))


# fields and blends


def lowpass(stack: np.ndarray) -> np.ndarray:
    """Rows mixed with those above and below, one to two to one; the frame's edge repeats."""
    padded = np.pad(stack, ((0, 0), (1, 1), (0, 0)), mode="edge")
    return (padded[:, :-2] + 2 * padded[:, 1:-1] + padded[:, 2:] + 1) >> 2


def woven(first: np.ndarray, second: np.ndarray, top: int) -> np.ndarray:
    """Even rows of the first frame and odd rows of the second (``top``), or the other way round; both low-passed."""
    first, second = lowpass(first), lowpass(second)
    even = (np.arange(first.shape[1]) % 2 == 0)[:, None]
    return np.where(even, first, second) if top else np.where(even, second, first)


def shifted(stack: np.ndarray, dx: int, dy: int) -> np.ndarray:
    """Moved right by dx and down by dy; black comes in."""
    n, h, w = stack.shape
    out = np.zeros_like(stack)
    if abs(dx) < w and abs(dy) < h:
        out[:, max(dy, 0) : h + min(dy, 0), max(dx, 0) : w + min(dx, 0)] = stack[:, max(-dy, 0) : h + min(-dy, 0), max(-dx, 0) : w + min(-dx, 0)]
    return out


def mixed(under: np.ndarray, over: np.ndarray, opacity: int) -> np.ndarray:
    """Thousandths of the upper frame over the lower."""
    return rounded(under * (1000 - opacity) + over * opacity, 1000)


# colour


def hsv(blue: np.ndarray, green: np.ndarray, red: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hue in 0..179, saturation and value in 0..255."""
    value = np.maximum(np.maximum(blue, green), red)
    span = value - np.minimum(np.minimum(blue, green), red)
    saturation = np.where(value > 0, (510 * span + value) // np.maximum(2 * value, 1), 0)
    sector = np.where(value == red, 0, np.where(value == green, 60, 120))
    turn = np.where(value == red, green - blue, np.where(value == green, blue - red, red - green))
    hue = (sector + (60 * turn + 361 * span) // np.maximum(2 * span, 1)) % 180
    return np.where(span > 0, hue, 0), saturation, value


# noise


def scrambled(x: np.ndarray) -> np.ndarray:
    """A 32-bit permutation: one step of a permuted congruential generator on a counter."""
    x = (x * np.uint64(747796405) + np.uint64(2891336453)) & np.uint64(0xFFFFFFFF)
    x = (((x >> ((x >> np.uint64(28)) + np.uint64(4))) ^ x) * np.uint64(277803737)) & np.uint64(0xFFFFFFFF)
    return (x >> np.uint64(22)) ^ x


def noisy(stack: np.ndarray, draws: int, seed: np.ndarray, frame: np.ndarray, strength: np.ndarray) -> np.ndarray:
    """Noise of at most the strength, a function of (seed, frame, pixel) alone: the mean of ``draws`` uniform values (one: uniform, four: nearly gaussian)."""
    n, h, w = stack.shape
    base = scrambled(frame.astype(np.uint64) & np.uint64(0xFFFFFFFF) ^ scrambled(seed.astype(np.uint64) & np.uint64(0xFFFFFFFF)))
    total = np.zeros(stack.shape, dtype=np.int64)
    for k in range(draws):
        counter = (np.arange(h * w, dtype=np.uint64) * np.uint64(draws) + np.uint64(k)).reshape(h, w)
        word = scrambled((counter[None] ^ base[:, None, None]) & np.uint64(0xFFFFFFFF))
        total += (word * (2 * strength[:, None, None] + 1).astype(np.uint64) >> np.uint64(32)).astype(np.int64) - strength[:, None, None]
    return clipped(stack + (2 * total + draws) // (2 * draws))
