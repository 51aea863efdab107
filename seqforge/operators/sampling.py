"""Weighted choices over small dimension tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from seqforge.functions import draws
from seqforge.sources.config import Codec


def normalized(codecs: list[Codec]) -> list[Codec]:
    """Weights divided by their sum, if that is positive and outside [0.99, 1.01]."""
    total = sum(c.probability for c in codecs)
    if total > 0 and not 0.99 <= total <= 1.01:
        return [c.scaled(1 / total) for c in codecs]
    return codecs


def pick(u: Column, codecs: list[Codec]) -> Column:
    """The first codec whose cumulative weight reaches the draw, else the last one."""
    sums = [sum(c.probability for c in codecs[: k + 1]) for k in range(len(codecs))]
    chosen = reduce(lambda w, k: w.when(u <= sums[k], codecs[k].name), range(1, len(codecs)), F.when(u <= sums[0], codecs[0].name))
    return chosen.otherwise(codecs[-1].name)


def per_codec(codec: Column, codecs: list[Codec], value) -> Column:
    """``value(codec settings)`` for each codec; null values are allowed."""
    return reduce(lambda w, c: w.when(codec == c.name, value(c)), codecs[1:], F.when(codec == codecs[0].name, value(codecs[0])))


def quality(codec: Column, u: Column, codecs: list[Codec]) -> Column:
    return per_codec(codec, codecs, lambda c: draws.randint(u, *c.quality))


def preset(codec: Column, u: Column, codecs: list[Codec]) -> Column:
    """One of the presets, else a number of the preset range, else null."""

    def of(c: Codec) -> Column:
        if c.presets:
            return draws.choice(u, list(c.presets))
        if c.preset_range:
            return draws.randint(u, *c.preset_range).cast("string")
        return F.lit(None).cast("string")

    return per_codec(codec, codecs, of)


#: Encoder of each codec and the preset it falls back to.
ENCODERS = {"h264": ("libx264", "veryslow"), "h265": ("libx265", "veryslow"), "vp9": ("libvpx-vp9", None), "av1": ("libsvtav1", "2"), "mpeg2": ("mpeg2video", None)}


def encoder_options(codec: Column, quality_: Column, preset_: Column, gop: int = 60, pix_fmt: str = "yuv420p") -> Column:
    """Encoder options as ``name=value`` joined by spaces, common ones first."""

    def of(name: str) -> Column:
        encoder, fallback = ENCODERS[name]
        q = quality_.cast("string")
        own = {
            "mpeg2": F.concat(F.lit("b="), q, F.lit("k")),
            "vp9": F.concat(F.lit("crf="), q, F.lit(" b=0")),
        }.get(name, F.concat(F.lit("crf="), q, F.lit(" preset="), F.coalesce(preset_, F.lit(fallback))))
        return F.concat(F.lit(f"fps_mode=cfr pix_fmt={pix_fmt} g={gop} colorspace=bt709 vcodec={encoder} "), own)

    names = list(ENCODERS)
    return reduce(lambda w, n: w.when(codec == n, of(n)), names[1:], F.when(codec == names[0], of(names[0])))
