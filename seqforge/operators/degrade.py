"""Filter plans: what each degradation draws for a chunk, as an encoder's filter text.

A builder maps (key column, stream columns, parameters, seed) to the filter text of one
chunk. Draws are named after the degradation, so adding one changes no other. ``compose``
joins the filters of a chunk into one graph.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqforge.functions import draws, media
from seqforge.sources import config

SEED = 1024


def _u(name: str, key: Column, seed: int) -> Column:
    return draws.unit(seed, name, key)


def scaled(size: Column, hundredths: Column) -> Column:
    """Even size of ``size`` times a scale in hundredths."""
    return media.even(F.floor(size * hundredths / 100))


def resize(key: Column, video: dict[str, Column], p: config.Resize, seed: int = SEED) -> Column:
    down, up = draws.choice(_u("resize.down", key, seed), list(p.filters)), draws.choice(_u("resize.up", key, seed), list(p.filters))
    fixed = F.lit(round(p.fixed_scale * 100))
    scale = lambda s, flags: F.concat(F.lit("scale="), scaled(video["width"], s).cast("string"), F.lit(":"), scaled(video["height"], s).cast("string"), F.lit(":sws_flags="), flags)
    direct = scale(fixed, down)
    if not p.down_up:
        return direct
    middle = draws.uniform(_u("resize.middle", key, seed), *p.down_up_range, 2)
    twice = F.concat_ws(",", scale(middle, down), scale(fixed, up))
    return F.when(draws.bernoulli(_u("resize.down_up", key, seed), p.down_up_probability), twice).otherwise(direct)


def noise(key: Column, video: dict[str, Column], p: config.Noise, seed: int = SEED) -> Column:
    y = draws.decimal_text(draws.uniform(_u("noise.y", key, seed), *p.y_strength, 2), 2)
    uv = draws.decimal_text(draws.uniform(_u("noise.uv", key, seed), *p.uv_strength, 2), 2)
    seeds = [draws.randint(_u(f"noise.seed{i}", key, seed), 0, 2**31 - 1).cast("string") for i in range(4)]
    planes = [F.concat(F.lit(f"c{i}_seed="), seeds[i], F.lit(f":c{i}_strength="), y if i == 0 else uv) for i in range(3)]
    last = F.concat(F.lit("all_seed="), seeds[3], F.lit(":allf="), draws.choice(_u("noise.type", key, seed), list(p.types)))
    return F.concat(F.lit("noise="), F.concat_ws(":", *planes, last))


def halo(key: Column, video: dict[str, Column], p: config.Halo, seed: int = SEED) -> Column:
    x = media.odd(draws.randint(_u("halo.x", key, seed), *p.luma_x)).cast("string")
    y = media.odd(draws.randint(_u("halo.y", key, seed), *p.luma_y)).cast("string")
    amount = draws.decimal_text(draws.uniform(_u("halo.amount", key, seed), *p.amount, 3), 3)
    return F.concat(F.lit("unsharp=lx="), x, F.lit(":ly="), y, F.lit(":la="), amount, F.lit(":cx=3:cy=3:ca=0"))


def _chained(text: Column, times: Column) -> Column:
    return F.array_join(F.array_repeat(text, F.greatest(times, F.lit(0)).cast("int")), ",")


def blur(key: Column, video: dict[str, Column], p: config.Blur, seed: int = SEED) -> Column:
    kind = draws.choice(_u("blur.type", key, seed), list(p.types))
    sigma = draws.decimal_text(draws.uniform(_u("blur.sigma", key, seed), *p.sigma, 2), 2)
    gaussian = _chained(F.concat(F.lit("gblur=sigma="), sigma), draws.randint(_u("blur.steps", key, seed), *p.steps))
    radius = draws.decimal_text(draws.uniform(_u("blur.radius", key, seed), *p.radius, 2), 2)
    one_box = F.concat(F.lit("boxblur=luma_radius="), radius, F.lit(":luma_power=1:chroma_radius="), radius, F.lit(":chroma_power=1"))
    box = _chained(one_box, draws.randint(_u("blur.power", key, seed), *p.power))
    frames, angle = draws.randint(_u("blur.frames", key, seed), *p.frames), draws.randint(_u("blur.angle", key, seed), *p.angle)
    blend = F.lit("tblend=all_mode=average:all_opacity=0.5")
    turn = draws.decimal_text(F.floor((angle * 1000 + 180) / 360), 3)
    smart = F.concat(blend, F.lit(",smartblur=lr="), (frames * 2).cast("string"), F.lit(":ls="), turn, F.lit(":lt=-1"))
    motion = F.when(angle == 0, _chained(blend, frames - 1)).otherwise(smart)
    return F.when(kind == "gaussian", gaussian).when(kind == "box", box).otherwise(motion)


def ghosting(key: Column, video: dict[str, Column], p: config.Ghosting, seed: int = SEED) -> Column:
    n = draws.randint(_u("ghosting.n", key, seed), *p.ghosts).cast("int")
    text = lambda c: c.cast("string")

    def ghost(i: Column) -> Column:
        draw = lambda name: draws.unit(seed, f"ghosting.{name}", key, i)
        x, y = draws.randint(draw("x"), *p.offset_x), draws.randint(draw("y"), *p.offset_y)
        label = lambda name: F.concat(F.lit(f"[{name}"), text(i), F.lit("]"))
        moved = (x != 0) | (y != 0)
        grow = lambda v: F.concat(F.lit("abs("), text(v * 2), F.lit(")"))
        pad = F.concat(label("blur"), F.lit("pad=w=iw+"), grow(x), F.lit(":h=ih+"), grow(y), F.lit(":x="), text(F.greatest(x, F.lit(0))), F.lit(":y="), text(F.greatest(y, F.lit(0))), label("pad"))
        cut = F.concat(label("pad"), F.lit("crop=w=iw-"), grow(x), F.lit(":h=ih-"), grow(y), F.lit(":x="), text(F.abs(F.least(x, F.lit(0)))), F.lit(":y="), text(F.abs(F.least(y, F.lit(0)))), label("pos"))
        placed = F.when(moved, label("pos")).otherwise(label("blur"))
        shift = lambda c: draws.decimal_text(draws.uniform(draw(c), *p.shift, 3) - 1000, 3)
        colour = F.concat(placed, F.lit("colorbalance=rh="), shift("r"), F.lit(":gh="), shift("g"), F.lit(":bh="), shift("b"), label("color"))
        opacity = draws.decimal_text(draws.uniform(draw("opacity"), *p.opacity, 3), 3)
        mixed = F.concat(label("color") if p.color_shift else placed, F.lit("colorchannelmixer=aa="), opacity, F.lit(":rb=0.05:bg=0.05"), label("ghost"))
        parts = [
            F.concat(label("copy"), F.lit("tmedian=radius="), text(draws.randint(draw("delay"), *p.delay)), label("delayed")),
            F.concat(label("delayed"), F.lit("boxblur=luma_radius=1:luma_power=1"), label("blur")),
            F.when(moved, pad),
            F.when(moved, cut),
            *([colour] if p.color_shift else []),
            mixed,
        ]
        return F.concat_ws(";", *parts)

    def overlay(i: Column) -> Column:
        before = F.when(i == 0, F.lit("[main]")).otherwise(F.concat(F.lit("[overlay"), text(i - 1), F.lit("]")))
        after = F.when(i < n - 1, F.concat(F.lit("[overlay"), text(i), F.lit("]"))).otherwise(F.lit(""))
        return F.concat(before, F.lit("[ghost"), text(i), F.lit("]overlay"), after)

    each = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    copies = F.array_join(F.transform(each, lambda i: F.concat(F.lit("[copy"), text(i), F.lit("]"))), "")
    split = F.concat(F.lit("split="), text(n + 1), F.lit("[main]"), copies)
    graph = F.concat_ws(";", split, F.array_join(F.transform(each, ghost), ";"), F.array_join(F.transform(each, overlay), ";"))
    return F.when(n > 0, graph).otherwise(F.lit(""))


def interlace(key: Column, video: dict[str, Column], p: config.Interlace, seed: int = SEED) -> Column:
    mode = F.when(draws.choice(_u("interlace.order", key, seed), list(p.field_orders)) == "top", F.lit("4")).otherwise(F.lit("5"))
    one = F.concat(F.lit("tinterlace=mode="), mode, F.lit(":flags=vlpf"))
    if not p.chroma_only:
        return one
    planes = [F.concat(F.lit(f"[{c}]"), one, F.lit(f"[{c}_int]")) for c in "uv"]
    split = F.lit("format=yuv420p,split=2[base][for_chroma];[for_chroma]extractplanes=u+v[u][v]")
    return F.concat_ws(";", split, *planes, F.lit("[base]extractplanes=y[y]"), F.lit("[y][u_int][v_int]mergeplanes=0x001020:yuv420p"))


def chroma_delay(key: Column, video: dict[str, Column], p: config.ChromaDelay, seed: int = SEED) -> Column:
    """Delay in seconds with six decimals; an unknown or zero rate counts as 25."""
    fps = media.rate(video["frame_rate"])
    fps = F.when(fps > 0, fps).otherwise(F.lit(25.0))
    delay = draws.decimal_text(F.floor(F.lit(p.delay_frames * 1e6) / fps + 0.5).cast("long"), 6)
    planes = [F.concat(F.lit(f"[{c}]setpts=PTS+"), delay, F.lit(f"/TB[{c}_delayed]")) for c in "uv"]
    split = F.lit("format=yuv420p,split=2[base][for_chroma];[for_chroma]format=yuv420p,extractplanes=u+v[u][v]")
    return F.concat_ws(";", split, *planes, F.lit("[base]format=yuv420p,extractplanes=y[y]"), F.lit("[y][u_delayed][v_delayed]mergeplanes=0x001020:yuv420p"))


def tonemap(key: Column, video: dict[str, Column], p: config.Tonemap, seed: int = SEED, pix_fmt: str = "yuv420p") -> Column:
    """Null for a stream that is not of high dynamic range, unless detection is off."""
    algorithm = draws.choice(_u("tonemap.algorithm", key, seed), list(p.algorithms))
    desat = draws.decimal_text(draws.uniform(_u("tonemap.desat", key, seed), *p.desat, 2), 2)
    chain = F.concat(
        F.lit("zscale=transfer=linear:primaries=bt709,tonemap="), algorithm, F.lit(":desat="), desat,
        F.lit(f":peak={p.target_nits},zscale=transfer=bt709:primaries=bt709:matrix=bt709,format={pix_fmt}"),
    )
    if not p.auto_detect:
        return chain
    return F.when(media.is_hdr(video["color_transfer"], video["color_space"], video["color_primaries"]), chain)


#: Builders by name; a new degradation is added here and in ``config.PARAMS``.
REGISTRY: dict[str, Callable[..., Column]] = {
    "resize": resize, "noise": noise, "halo": halo, "blur": blur, "ghosting": ghosting,
    "interlace": interlace, "chroma_delay": chroma_delay, "tonemap": tonemap,
}


def plans(chunks: DataFrame, listed: tuple[config.Degradation, ...], key: Column, video: dict[str, Column], seed: int = SEED) -> DataFrame:
    """One row for each chunk and enabled degradation: pos, name, probability, applied, filter (null if not applied)."""
    entries = []
    for pos, d in enumerate(listed):
        if d.name not in REGISTRY:
            raise config.ConfigError(f"unknown degradation {d.name}")
        if d.enabled:
            applied = draws.bernoulli(_u(f"{d.name}.apply", key, seed), d.probability)
            text = F.when(applied, REGISTRY[d.name](key, video, d.params or config.PARAMS[d.name](), seed))
            entries.append(F.struct(F.lit(pos).alias("pos"), F.lit(d.name).alias("name"), F.lit(float(d.probability)).alias("probability"), applied.alias("applied"), text.alias("filter")))
    return chunks.withColumn("_plan", F.explode(F.array(*entries))).select("*", "_plan.*").drop("_plan")


def compose(filters: Column) -> Column:
    """One graph of an ordered array of filter texts: simple ones joined first, then complex ones (with ``;``) chained by labels."""
    used = F.filter(filters, lambda f: f.isNotNull() & (f != ""))
    simple = F.array_join(F.filter(used, lambda f: ~f.contains(";")), ",")
    graphs = F.filter(used, lambda f: f.contains(";"))
    last = F.size(graphs) - 1
    label = lambda i: F.concat(F.lit("[_chain_"), i.cast("string"), F.lit("]"))
    chained = F.transform(graphs, lambda g, i: F.concat(F.when(i > 0, label(i - 1)).otherwise(F.lit("")), g, F.when(i < last, label(i)).otherwise(F.lit(""))))
    return F.concat_ws(",", F.nullif(simple, F.lit("")), F.nullif(F.array_join(chained, ";"), F.lit("")))


def composed(planned: DataFrame, key: str) -> DataFrame:
    """``filter_complex`` of each chunk, from the rows of ``plans``."""
    ordered = F.sort_array(F.collect_list(F.struct("pos", "filter")))
    return planned.groupBy(key).agg(compose(F.transform(ordered, lambda x: x["filter"])).alias("filter_complex"))


def split_plan(chunks: DataFrame, fps: Column, video: dict[str, Column], hdr: config.Tonemap | None, scale: float | None, filters: tuple[str, ...] = ("lanczos",), seed: int = SEED) -> DataFrame:
    """How to cut each chunk (video_id, start_frame, end_frame): coarse seek, fine seek, duration in seconds, filter text.

    The scaling filter is drawn once per video.
    """
    start = F.col("start_frame") / fps
    seek = F.greatest(F.lit(0.0), start - 2)
    parts = []
    if hdr is not None:
        parts.append(tonemap(F.col("video_id"), video, hdr, seed, "yuv422p"))
    if scale is not None:
        s = F.lit(round(scale * 100))
        flags = draws.choice(_u("split.filter", F.col("video_id"), seed), list(filters))
        parts.append(F.concat(F.lit("scale="), scaled(video["width"], s).cast("string"), F.lit(":"), scaled(video["height"], s).cast("string"), F.lit(":sws_flags="), flags))
    text = F.concat_ws(",", *parts) if parts else F.lit("")
    return chunks.withColumns({"seek_offset": seek, "fine_seek": start - seek, "seconds": (F.col("end_frame") - F.col("start_frame")) / fps, "vf": text})
