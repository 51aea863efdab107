"""Queries on degradation plans: the filter text that each chunk draws."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqforge.functions import draws, media
from seqforge.operators import degrade
from seqforge.plans import sql
from seqforge.plans.sql import choice, decimal, randint, uniform, unit
from seqforge.sources import adapters, config

RESIZE = config.Resize(0.5, True, 0.7, (0.25, 0.9), ("bicubic", "bilinear", "area"))
NOISE = config.Noise((1, 10), (1, 10), ("u", "t", "a"))
HALO = config.Halo((3, 5), (3, 5), (0, 0.5))
BLUR = config.Blur(("gaussian", "box", "motion"), (0.7, 2), (1, 3), (0.25, 1), (1, 2), (1, 4), (0, 3))
GHOSTING = config.Ghosting((0, 3), (0.05, 0.15), (1, 2), (-3, 3), (-2, 2), True)
INTERLACE = config.Interlace(("top", "bottom"), True)
TONEMAP = config.Tonemap(("hable", "mobius", "reinhard"), (0.0, 1.0), 100, True)


def _video() -> dict:
    return {c: F.col(c) for c in ("width", "height", "frame_rate", "color_transfer", "color_space", "color_primaries")}


def _plan(name: str, params: object):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return adapters.geometry(spark, sf_dir).select("id", degrade.REGISTRY[name](F.col("id"), _video(), params).alias("filter"))

    return query


def _of(text: str) -> str:
    return f"WITH {sql.GEOMETRY} SELECT id, {text} AS filter FROM geometry"


def _scale(hundredths: str, flags: str) -> str:
    w, h = (sql.even(f"({c} * {hundredths}) // 100") for c in ("width", "height"))
    return f"('scale=' || {w} || ':' || {h} || ':sws_flags=' || {flags})"


_DOWN, _UP = (choice(f"resize.{d}", "id", ["bicubic", "bilinear", "area"]) for d in ("down", "up"))
_RESIZE = f"""CASE WHEN {unit("resize.down_up", "id")} < 0.7 THEN {_scale(uniform("resize.middle", "id", 0.25, 0.9, 2), _DOWN)} || ',' || {_scale("50", _UP)} ELSE {_scale("50", _DOWN)} END"""

_SEEDS = [randint(f"noise.seed{i}", "id", 0, 2**31 - 1) for i in range(4)]
_Y, _UV = (decimal(uniform(f"noise.{c}", "id", 1, 10, 2), 2) for c in ("y", "uv"))
_NOISE = f"""'noise=c0_seed=' || {_SEEDS[0]} || ':c0_strength=' || {_Y} || ':c1_seed=' || {_SEEDS[1]} || ':c1_strength=' || {_UV} || ':c2_seed=' || {_SEEDS[2]} || ':c2_strength=' || {_UV}
 || ':all_seed=' || {_SEEDS[3]} || ':allf=' || {choice("noise.type", "id", ["u", "t", "a"])}"""

_HALO = f"""'unsharp=lx=' || CASE WHEN {randint("halo.x", "id", 3, 5)} = 3 THEN 3 ELSE 5 END || ':ly=' || CASE WHEN {randint("halo.y", "id", 3, 5)} = 3 THEN 3 ELSE 5 END
 || ':la=' || {decimal(uniform("halo.amount", "id", 0, 0.5, 3), 3)} || ':cx=3:cy=3:ca=0'"""


def _times(text: str, n: str) -> str:
    return f"array_to_string(list_transform(range({n}), lambda i: {text}), ',')"


_BLEND = "'tblend=all_mode=average:all_opacity=0.5'"
_RADIUS = decimal(uniform("blur.radius", "id", 0.25, 1, 2), 2)
_FRAMES, _ANGLE = randint("blur.frames", "id", 1, 4), randint("blur.angle", "id", 0, 3)
_BLUR = f"""CASE {choice("blur.type", "id", ["gaussian", "box", "motion"])}
 WHEN 'gaussian' THEN {_times(f"'gblur=sigma=' || {decimal(uniform('blur.sigma', 'id', 0.7, 2, 2), 2)}", randint("blur.steps", "id", 1, 3))}
 WHEN 'box' THEN {_times(f"'boxblur=luma_radius=' || {_RADIUS} || ':luma_power=1:chroma_radius=' || {_RADIUS} || ':chroma_power=1'", randint("blur.power", "id", 1, 2))}
 ELSE CASE WHEN {_ANGLE} = 0 THEN {_times(_BLEND, f"{_FRAMES} - 1")} ELSE {_BLEND} || ',smartblur=lr=' || {_FRAMES} * 2 || ':ls=' || {decimal(f"(({_ANGLE} * 1000 + 180) // 360)", 3)} || ':lt=-1' END END"""


def _ghost(name: str) -> str:
    return unit(f"ghosting.{name}", "id, i")


def _ghost_int(name: str, low: int, high: int) -> str:
    return f"({low} + floor({_ghost(name)} * {high - low + 1})::BIGINT)"


_GHOSTING = f"""WITH {sql.GEOMETRY}, n AS (SELECT id, {randint("ghosting.n", "id", 0, 3)} AS n FROM geometry),
draw AS (SELECT id, n, i, {_ghost_int("x", -3, 3)} AS x, {_ghost_int("y", -2, 2)} AS y, {_ghost_int("delay", 1, 2)} AS delay, {_ghost_int("opacity", 50, 150)} AS opacity,
  {_ghost_int("r", 850, 1150)} - 1000 AS r, {_ghost_int("g", 850, 1150)} - 1000 AS g, {_ghost_int("b", 850, 1150)} - 1000 AS b FROM (SELECT id, n, unnest(range(n)) AS i FROM n)),
part AS (SELECT id, n, i, '[copy' || i || ']tmedian=radius=' || delay || '[delayed' || i || '];[delayed' || i || ']boxblur=luma_radius=1:luma_power=1[blur' || i || '];'
  || CASE WHEN x <> 0 OR y <> 0 THEN '[blur' || i || ']pad=w=iw+abs(' || x * 2 || '):h=ih+abs(' || y * 2 || '):x=' || greatest(x, 0) || ':y=' || greatest(y, 0) || '[pad' || i || '];[pad' || i
    || ']crop=w=iw-abs(' || x * 2 || '):h=ih-abs(' || y * 2 || '):x=' || abs(least(x, 0)) || ':y=' || abs(least(y, 0)) || '[pos' || i || '];[pos' || i || ']' ELSE '[blur' || i || ']' END
  || 'colorbalance=rh=' || {decimal("r", 3)} || ':gh=' || {decimal("g", 3)} || ':bh=' || {decimal("b", 3)} || '[color' || i || '];[color' || i || ']colorchannelmixer=aa=' || {decimal("opacity", 3)}
  || ':rb=0.05:bg=0.05[ghost' || i || ']' AS graph,
  CASE WHEN i = 0 THEN '[main]' ELSE '[overlay' || (i - 1) || ']' END || '[ghost' || i || ']overlay' || CASE WHEN i < n - 1 THEN '[overlay' || i || ']' ELSE '' END AS over FROM draw),
joined AS (SELECT id, 'split=' || (any_value(n) + 1) || '[main]' || string_agg('[copy' || i || ']', '' ORDER BY i) || ';' || string_agg(graph, ';' ORDER BY i) || ';' || string_agg(over, ';' ORDER BY i) AS filter FROM part GROUP BY id)
SELECT n.id, coalesce(filter, '') AS filter FROM n LEFT JOIN joined j ON n.id = j.id"""

_MODE = f"CASE {choice('interlace.order', 'id', ['top', 'bottom'])} WHEN 'top' THEN '4' ELSE '5' END"
_INTERLACE = f"""'format=yuv420p,split=2[base][for_chroma];[for_chroma]extractplanes=u+v[u][v];[u]tinterlace=mode=' || {_MODE} || ':flags=vlpf[u_int];[v]tinterlace=mode=' || {_MODE}
 || ':flags=vlpf[v_int];[base]extractplanes=y[y];[y][u_int][v_int]mergeplanes=0x001020:yuv420p'"""

_DELAY = "(floor(1000000.0::DOUBLE / CASE frame_rate WHEN '25/1' THEN 25.0::DOUBLE WHEN '30000/1001' THEN 30000.0::DOUBLE / 1001.0::DOUBLE WHEN '24' THEN 24.0::DOUBLE ELSE 25.0::DOUBLE END + 0.5)::BIGINT)"
_CHROMA = f"""'format=yuv420p,split=2[base][for_chroma];[for_chroma]format=yuv420p,extractplanes=u+v[u][v];[u]setpts=PTS+' || {decimal(_DELAY, 6)} || '/TB[u_delayed];[v]setpts=PTS+' || {decimal(_DELAY, 6)}
 || '/TB[v_delayed];[base]format=yuv420p,extractplanes=y[y];[y][u_delayed][v_delayed]mergeplanes=0x001020:yuv420p'"""

_HDR = "(coalesce(color_transfer, '') IN ('smpte2084', 'arib-std-b67') OR contains(coalesce(color_space, ''), 'bt2020') OR contains(coalesce(color_primaries, ''), 'bt2020'))"
_TONEMAP = f"""CASE WHEN {_HDR} THEN 'zscale=transfer=linear:primaries=bt709,tonemap=' || {choice("tonemap.algorithm", "id", ["hable", "mobius", "reinhard"])} || ':desat='
 || {decimal(uniform("tonemap.desat", "id", 0.0, 1.0, 2), 2)} || ':peak=100,zscale=transfer=bt709:primaries=bt709:matrix=bt709,format=yuv420p' END"""

LISTED = (
    config.Degradation("resize", 1.0, True, RESIZE),
    config.Degradation("halo", 0.5, True, HALO),
    config.Degradation("interlace", 0.4, True, INTERLACE),
    config.Degradation("noise", 0.3, False, NOISE),
    config.Degradation("blur", 0.6, True, BLUR),
    config.Degradation("ghosting", 0.3, True, GHOSTING),
)


def degradation_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which degradations each chunk gets, and how many filters each has."""
    planned = degrade.plans(adapters.geometry(spark, sf_dir), LISTED, F.col("id"), _video())
    return planned.select("id", F.col("pos").cast("long").alias("pos"), "name", "probability", "applied", F.md5(F.coalesce("filter", F.lit("-"))).alias("filter_md5"))


_FILTERS = {"resize": _RESIZE, "halo": _HALO, "interlace": _INTERLACE, "blur": _BLUR}
_ROWS = " UNION ALL ".join(
    f"""SELECT g.id, {pos} AS pos, '{d.name}' AS name, {d.probability}::DOUBLE AS probability, {unit(f"{d.name}.apply", "g.id")} < {d.probability} AS applied, """
    + ("ghosts.filter AS raw FROM geometry g JOIN ghosts ON g.id = ghosts.id" if d.name == "ghosting" else f"{_FILTERS[d.name]} AS raw FROM geometry g")
    for pos, d in enumerate(LISTED)
    if d.enabled
)
_PLANNED = f"ghosts AS ({_GHOSTING}), {sql.GEOMETRY}, raw AS ({_ROWS}), planned AS (SELECT id, pos, name, probability, applied, CASE WHEN applied THEN raw END AS filter FROM raw)"
DEGRADATION_PLANS = f"WITH {_PLANNED} SELECT id, pos::BIGINT AS pos, name, probability, applied, md5(coalesce(filter, '-')) AS filter_md5 FROM planned"


def compose_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One filter graph for each chunk."""
    planned = degrade.plans(adapters.geometry(spark, sf_dir), LISTED, F.col("id"), _video())
    return degrade.composed(planned, "id")


COMPOSE_FILTERS = f"""WITH {_PLANNED}, used AS (SELECT id, pos, filter, contains(filter, ';') AS complex FROM planned WHERE filter <> ''),
ranked AS (SELECT *, row_number() OVER (PARTITION BY id, complex ORDER BY pos) - 1 AS k, count(*) OVER (PARTITION BY id, complex) AS n FROM used),
parted AS (SELECT id, string_agg(filter, ',' ORDER BY pos) FILTER (NOT complex) AS simple,
  string_agg(CASE WHEN k > 0 THEN '[_chain_' || (k - 1) || ']' ELSE '' END || filter || CASE WHEN k < n - 1 THEN '[_chain_' || k || ']' ELSE '' END, ';' ORDER BY pos) FILTER (complex) AS graph FROM ranked GROUP BY id)
SELECT g.id, coalesce(CASE WHEN simple IS NULL THEN graph WHEN graph IS NULL THEN simple ELSE simple || ',' || graph END, '') AS filter_complex FROM geometry g LEFT JOIN parted b ON g.id = b.id"""


def draw_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line for each applied degradation."""
    planned = degrade.plans(adapters.geometry(spark, sf_dir), LISTED, F.col("id"), _video()).where("applied")
    line = F.concat(F.lit("  [+] "), F.initcap("name"), F.lit(" (prob="), F.col("probability").cast("string"), F.lit(")"))
    return planned.select("id", F.col("pos").cast("long").alias("pos"), line.alias("line"))


DRAW_LOG = f"WITH {_PLANNED} SELECT id, pos::BIGINT AS pos, '  [+] ' || upper(name[1]) || name[2:] || ' (prob=' || probability || ')' AS line FROM planned WHERE applied"


def split_command(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How to cut the two-second ranges of the first frames of every part as a video."""
    videos = adapters.geometry(spark, sf_dir).withColumn("video_id", F.col("id")).withColumn("total", F.col("width") % 100 + 30)
    from seqforge.operators import chunking

    chunks = chunking.by_step(videos, F.col("total"), F.lit(50).cast("long"))
    plan = degrade.split_plan(chunks, F.lit(25.0), _video(), TONEMAP, 0.33, ("lanczos", "bicubic"))
    return plan.select("video_id", "start_frame", "end_frame", "seek_offset", "fine_seek", "seconds", "vf")


_SPLIT_SCALE = "33"
SPLIT_COMMAND = f"""WITH {sql.GEOMETRY}, r AS (SELECT *, unnest(range(0, width % 100 + 30, 50)) AS start_frame FROM geometry), e AS (SELECT *, least(start_frame + 50, width % 100 + 30) AS end_frame FROM r),
s AS (SELECT *, {_TONEMAP.replace("format=yuv420p", "format=yuv422p")} AS tone, {_scale(_SPLIT_SCALE, choice("split.filter", "id", ["lanczos", "bicubic"]))} AS sized FROM e)
SELECT id AS video_id, start_frame, end_frame, greatest(0.0, start_frame / 25.0::DOUBLE - 2) AS seek_offset, start_frame / 25.0::DOUBLE - greatest(0.0, start_frame / 25.0::DOUBLE - 2) AS fine_seek,
(end_frame - start_frame) / 25.0::DOUBLE AS seconds, CASE WHEN tone IS NULL THEN sized ELSE tone || ',' || sized END AS vf FROM s"""


def even_dims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Even sizes at a third."""
    df = adapters.geometry(spark, sf_dir)
    return df.select("id", media.even(F.col("width")).alias("w"), degrade.scaled(F.col("width"), F.lit(33)).alias("w33"), degrade.scaled(F.col("height"), F.lit(1)).alias("h01"))


EVEN_DIMS = f"WITH {sql.GEOMETRY} SELECT id, {sql.even('width')} AS w, {sql.even('(width * 33) // 100')} AS w33, {sql.even('height // 100')} AS h01 FROM geometry"


def odd_kernel(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = draws.randint(draws.unit(degrade.SEED, "kernel", F.col("id")), 3, 8)
    return adapters.geometry(spark, sf_dir).select("id", media.odd(size).alias("kernel"))


ODD_KERNEL = f"WITH {sql.GEOMETRY} SELECT id, k + 1 - k % 2 AS kernel FROM (SELECT id, {randint('kernel', 'id', 3, 8)} AS k FROM geometry)"


def hdr_predicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    video = _video()
    return adapters.geometry(spark, sf_dir).select("id", media.is_hdr(video["color_transfer"], video["color_space"], video["color_primaries"]).alias("is_hdr"))


HDR_PREDICATE = f"WITH {sql.GEOMETRY} SELECT id, {_HDR} AS is_hdr FROM geometry"


def fps_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three fallbacks: 30, 0 and 25 frames a second."""
    rate = media.rate(F.col("frame_rate"))
    df = adapters.geometry(spark, sf_dir)
    return df.select("id", media.fps(F.col("frame_rate"), F.lit("0/0")).alias("fps30"), F.coalesce(rate, F.lit(0.0)).alias("fps0"), F.coalesce(rate, F.lit(25.0)).alias("fps25"))


_RATE = "CASE frame_rate WHEN '25/1' THEN 25.0::DOUBLE WHEN '30000/1001' THEN 30000.0::DOUBLE / 1001.0::DOUBLE WHEN '24' THEN 24.0::DOUBLE END"
FPS_PARSE = f"WITH {sql.GEOMETRY} SELECT id, coalesce({_RATE}, 30.0::DOUBLE) AS fps30, coalesce({_RATE}, 0.0::DOUBLE) AS fps0, coalesce({_RATE}, 25.0::DOUBLE) AS fps25 FROM geometry"


def probe_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata from a probe's JSON, made up for every part."""
    kind = F.when(F.col("id") % 5 == 0, "audio").otherwise("video")
    frames = F.when(F.col("id") % 3 == 0, F.col("id").cast("string")).when(F.col("id") % 3 == 1, "N/A")

    def stream(kind_: Column, rate: Column, count: Column) -> Column:
        return F.struct(kind_.alias("codec_type"), rate.alias("r_frame_rate"), F.lit("25/1").alias("avg_frame_rate"), "width", "height", count.alias("nb_frames"))

    streams = F.array(stream(F.lit("data"), F.lit("1/1"), F.lit("7")), stream(kind, F.col("frame_rate"), frames))
    text = F.to_json(F.struct(F.struct(F.lit("12.5").alias("duration")).alias("format"), streams.alias("streams")))
    df = adapters.geometry(spark, sf_dir).select("id", text.alias("json"))
    df = df.withColumn("v", media.video_stream(F.col("json"))).where("v IS NOT NULL")
    nb = F.col("v.nb_frames").try_cast("long")
    return df.select(
        "id", F.col("v.width").cast("long").alias("width"), media.fps(F.col("v.r_frame_rate"), F.col("v.avg_frame_rate")).alias("fps"),
        F.coalesce("v.pix_fmt", F.lit("yuv420p")).alias("pix_fmt"), nb.alias("nb_frames"), F.coalesce(nb, F.lit(0)).cast("long").alias("frame_count"),
    )


PROBE_PARSE = f"""WITH {sql.GEOMETRY} SELECT id, width, coalesce({_RATE}, 25.0::DOUBLE) AS fps, 'yuv420p' AS pix_fmt, CASE WHEN id % 3 = 0 THEN id END::BIGINT AS nb_frames,
CASE WHEN id % 3 = 0 THEN id ELSE 0 END::BIGINT AS frame_count FROM geometry WHERE id % 5 <> 0"""

QUERIES = {
    "plan_resize": _plan("resize", RESIZE), "plan_noise": _plan("noise", NOISE), "plan_halo": _plan("halo", HALO), "plan_blur": _plan("blur", BLUR),
    "plan_ghosting": _plan("ghosting", GHOSTING), "plan_interlace": _plan("interlace", INTERLACE), "plan_chroma_delay": _plan("chroma_delay", config.ChromaDelay(1)),
    "plan_tonemap": _plan("tonemap", TONEMAP), "degradation_plans": degradation_plans, "compose_filters": compose_filters, "draw_log": draw_log, "split_command": split_command,
    "even_dims": even_dims, "odd_kernel": odd_kernel, "hdr_predicate": hdr_predicate, "fps_parse": fps_parse, "probe_parse": probe_parse,
}
ORACLES = {
    "plan_resize": _of(_RESIZE), "plan_noise": _of(_NOISE), "plan_halo": _of(_HALO), "plan_blur": _of(_BLUR), "plan_ghosting": _GHOSTING, "plan_interlace": _of(_INTERLACE),
    "plan_chroma_delay": _of(_CHROMA), "plan_tonemap": _of(_TONEMAP), "degradation_plans": DEGRADATION_PLANS, "compose_filters": COMPOSE_FILTERS, "draw_log": DRAW_LOG,
    "split_command": SPLIT_COMMAND, "even_dims": EVEN_DIMS, "odd_kernel": ODD_KERNEL, "hdr_predicate": HDR_PREDICATE, "fps_parse": FPS_PARSE, "probe_parse": PROBE_PARSE,
}
