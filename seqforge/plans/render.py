"""Queries on pixels that change: scene signal, resize, blur, halo, interlacing, delays, ghosts, tone mapping, noise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqforge.functions import raster
from seqforge.operators import chunking, render
from seqforge.plans import frames, sql
from seqforge.sources import adapters

#: A change between frames that tells the test recordings apart, and the shrinking before it is measured.
CUT, FACTOR = 31.0, 2
SEED, STRENGTH, SIGMA, DELAY = 1024, 12, 1.5, 1.5
GHOSTS = [{"delay": 1, "offset_x": 2, "offset_y": -1, "opacity": 150}, {"delay": 2, "offset_x": -3, "offset_y": 0, "opacity": 50, "gain": 1150}]


def text(column: str = "pixels") -> Column:
    return F.array_join(column, ",").alias(column)


def scene_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Change of hue, saturation and value of every colour frame since the frame before."""
    return render.scene_signal(adapters.shots(spark, sf_dir), FACTOR).select("video_id", "frame_no", "score_num", "n_px")


_SIGNAL = f"""{sql.SHOTS},
channel AS (SELECT video_id, frame_no, c, i % 8 // {FACTOR} AS x, i // 8 // {FACTOR} AS y, v FROM (SELECT video_id, frame_no, c, unnest(px) AS v, unnest(range(64)) AS i FROM
  (SELECT video_id, frame_no, unnest([blue, green, red]) AS px, unnest(['b', 'g', 'r']) AS c FROM shots))),
tiny AS (SELECT video_id, frame_no, x, y, c, (2 * sum(v) + count(*))::BIGINT // (2 * count(*)) AS v FROM channel GROUP BY ALL),
bgr AS (SELECT video_id, frame_no, x, y, max(v) FILTER (c = 'b') AS b, max(v) FILTER (c = 'g') AS g, max(v) FILTER (c = 'r') AS r FROM tiny GROUP BY ALL),
span AS (SELECT *, greatest(b, g, r) AS val, greatest(b, g, r) - least(b, g, r) AS span FROM bgr),
hsv AS (SELECT video_id, frame_no, x, y, val, CASE WHEN val > 0 THEN (510 * span + val) // (2 * val) ELSE 0 END AS sat,
  CASE WHEN span = 0 THEN 0 ELSE (CASE val WHEN r THEN 0 WHEN g THEN 60 ELSE 120 END + (60 * CASE val WHEN r THEN g - b WHEN g THEN b - r ELSE r - g END + 361 * span) // (2 * span)) % 180 END AS hue FROM span),
step AS (SELECT video_id, frame_no, abs(hue - lag(hue) OVER w) + abs(sat - lag(sat) OVER w) + abs(val - lag(val) OVER w) AS d FROM hsv WINDOW w AS (PARTITION BY video_id, x, y ORDER BY frame_no)),
signal AS (SELECT video_id, frame_no, sum(d)::BIGINT AS score_num, count(*) AS n_px FROM step GROUP BY ALL)"""

SCENE_SCORE = f"WITH {_SIGNAL} SELECT video_id, frame_no, score_num, n_px FROM signal"


def scene_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scenes of the colour recordings, cut where their frames change."""
    return chunking.scenes(render.scene_signal(adapters.shots(spark, sf_dir), FACTOR), CUT)


SCENE_PIXELS = f"""WITH {_SIGNAL}, numbered AS (SELECT video_id, frame_no,
  count(*) FILTER (score_num / (3.0 * n_px) >= {CUT}) OVER (PARTITION BY video_id ORDER BY frame_no) AS scene_no FROM signal)
SELECT video_id, scene_no, min(frame_no) AS start_frame, max(frame_no) + 1 AS end_frame FROM numbered GROUP BY ALL"""


def _resize(kind: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        width, height = F.col("vec_id") % 9 + 4, F.col("vec_id") % 7 + 3
        return render.resized(adapters.embedding_frames(spark, sf_dir), width, height, kind).select("vec_id", "width", "height", text())

    query.__doc__ = f"Every frame at another size by the {kind} filter, some smaller and some larger."
    return query


_OVERLAP = "greatest(least((c.{0} + 1) * o.{1}, (o.o{0} + 1) * c.{2}) - greatest(c.{0} * o.{1}, o.o{0} * c.{2}), 0)"
_TENT = "greatest(2 * o.{1} - abs(least(greatest((2 * o.o{0} + 1) * c.{2} - o.{1}, 0), 2 * o.{1} * (c.{2} - 1)) - c.{0} * 2 * o.{1}), 0)"


def _resize_sql(weight: str, parts: str) -> str:
    return f"""WITH {sql.FRAMES}, {sql.cells("c", "frames", "vec_id", "pixels")},
size AS (SELECT vec_id, vec_id % 9 + 4 AS w, vec_id % 7 + 3 AS h FROM frames), o AS (SELECT vec_id, w, h, ox, oy FROM size, range(12) a(ox), range(9) b(oy) WHERE ox < w AND oy < h),
weighed AS (SELECT o.vec_id, o.w, o.h, o.ox AS x, o.oy AS y, {weight.format("x", "w", "width")} * {weight.format("y", "h", "height")} AS weight, c.v, {parts} AS parts FROM o JOIN c ON c.vec_id = o.vec_id),
done AS (SELECT vec_id, w, h, x, y, (2 * sum(weight * v) + any_value(parts))::BIGINT // (2 * any_value(parts)) AS v FROM weighed WHERE weight > 0 GROUP BY vec_id, w, h, x, y)
SELECT vec_id, w::INTEGER AS width, h::INTEGER AS height, string_agg(v::VARCHAR, ',' ORDER BY y, x) AS pixels FROM done GROUP BY ALL"""


RESIZE_AREA, RESIZE_BILINEAR = _resize_sql(_OVERLAP, "c.width * c.height"), _resize_sql(_TENT, "4 * o.w * o.h")


def _cubic_sql(name: str, axis: str, new: str, size: str) -> str:
    """Weights ``w`` of the sources ``src`` of each new sample ``o{axis}`` of a line, in parts of CUBIC."""
    unit = raster.CUBIC
    return f"""{name}0 AS (SELECT DISTINCT vec_id, o{axis}, {size} AS size, 2 * {new} AS d, (2 * o{axis} + 1) * {size} - {new} AS place FROM o),
{name}1 AS (SELECT *, floor(place / d::DOUBLE)::BIGINT AS l, place - floor(place / d::DOUBLE)::BIGINT * d AS s FROM {name}0),
{name}2 AS (SELECT vec_id, o{axis}, size, l, s, d, k, CASE k WHEN 0 THEN -s * s * s + 2 * s * s * d - s * d * d WHEN 1 THEN 3 * s * s * s - 5 * s * s * d + 2 * d * d * d
  WHEN 2 THEN -3 * s * s * s + 4 * s * s * d + s * d * d ELSE s * s * s - s * s * d END AS part FROM {name}1, range(4) t(k)),
{name}3 AS (SELECT *, floor((part * {unit} + d * d * d) / (2.0 * d * d * d))::BIGINT AS w FROM {name}2),
{name} AS (SELECT vec_id, o{axis}, least(greatest(l + k - 1, 0), size - 1) AS src,
  w + CASE WHEN k = CASE WHEN 2 * s < d THEN 1 ELSE 2 END THEN {unit} - sum(w) OVER (PARTITION BY vec_id, o{axis}) ELSE 0 END AS w FROM {name}3)"""


RESIZE_BICUBIC = f"""WITH {sql.FRAMES}, {sql.cells("c", "frames", "vec_id", "pixels")},
size AS (SELECT vec_id, width, height, vec_id % 9 + 4 AS w, vec_id % 7 + 3 AS h FROM frames), o AS (SELECT vec_id, width, height, w, h, ox, oy FROM size, range(12) a(ox), range(9) b(oy) WHERE ox < w AND oy < h),
{_cubic_sql("across", "x", "w", "width")}, {_cubic_sql("down", "y", "h", "height")},
done AS (SELECT o.vec_id, o.w, o.h, o.ox AS x, o.oy AS y, least(greatest(floor((2 * sum(a.w * b.w * c.v) + {raster.CUBIC**2}) / {2.0 * raster.CUBIC**2}), 0), 255)::BIGINT AS v
  FROM o JOIN across a ON a.vec_id = o.vec_id AND a.ox = o.ox JOIN down b ON b.vec_id = o.vec_id AND b.oy = o.oy JOIN c ON c.vec_id = o.vec_id AND c.x = a.src AND c.y = b.src GROUP BY ALL)
SELECT vec_id, w::INTEGER AS width, h::INTEGER AS height, string_agg(v::VARCHAR, ',' ORDER BY y, x) AS pixels FROM done GROUP BY ALL"""


def blur_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of two radii, twice over."""
    return render.box_blurred(adapters.embedding_frames(spark, sf_dir), F.col("vec_id") % 2 * 2 + 1, F.lit(2)).select("vec_id", text())


def _boxes(radii: list[str]) -> str:
    """Pixels ``c{n}`` after boxes of the radii, from ``c0``."""
    steps = []
    for k, r in enumerate(radii):
        steps.append(f"r{k} AS (SELECT *, {r} AS r FROM c{k})")
        steps.append(sql.box(f"b{k}", f"r{k}", "vec_id", "r"))
        steps.append(f"c{k + 1} AS (SELECT vec_id, width, height, x, y, (2 * s + n) // (2 * n) AS v FROM b{k})")
    return ", ".join(steps)


BLUR_BOX = f"WITH {sql.FRAMES}, {sql.cells('c0', 'frames', 'vec_id', 'pixels')}, {_boxes(['vec_id % 2 * 2 + 1'] * 2)} {sql.texted('c2', 'vec_id')}"


def blur_gaussian(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A gaussian as three boxes."""
    return render.gaussian_blurred(adapters.embedding_frames(spark, sf_dir), SIGMA).select("vec_id", text())


BLUR_GAUSSIAN = f"WITH {sql.FRAMES}, {sql.cells('c0', 'frames', 'vec_id', 'pixels')}, {_boxes(['1', '1', '1'])} {sql.texted('c3', 'vec_id')}"


def blur_motion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each frame averaged with the one before, twice over."""
    return render.motion_blurred(adapters.recordings(spark, sf_dir), 3).select("video_id", "frame_no", text())


def _averaged(source: str) -> str:
    return f"SELECT video_id, frame_no, x, y, coalesce((v + lag(v) OVER (PARTITION BY video_id, x, y ORDER BY frame_no)) >> 1, v) AS v FROM {source}"


BLUR_MOTION = f"WITH {sql.RECORDINGS}, {sql.cells('c', 'recordings', 'video_id, frame_no', 'pixels')}, once AS ({_averaged('c')}), twice AS ({_averaged('once')}) {sql.texted('twice', 'video_id, frame_no')}"


def border_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dark lines from each side of letterboxed frames, from the summed-area table that boxes are read from."""
    found = raster.over_stacks(lambda s: raster.borders(s, 10), F.col("width"), F.col("height"), [F.col("pixels")])
    sides = adapters.letterboxed_frames(spark, sf_dir).select("vec_id", found.alias("b"))
    return sides.select("vec_id", *[F.get("b", k).cast("long").alias(s) for k, s in enumerate(("top", "bottom", "left", "right"))])


def _planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The colour frames as y, u and v, chroma halved."""
    rows = adapters.shots(spark, sf_dir)
    rows = rows.withColumns(render.planes(*map(F.col, ("blue", "green", "red")))).drop("blue", "green", "red")
    return render.halved_chroma(rows)


_PLANES = f"""{sql.SHOTS}, px AS (SELECT video_id, frame_no, video_id * 100 + frame_no AS id, i % 8 AS x, i // 8 AS y, b, g, r FROM
  (SELECT video_id, frame_no, unnest(blue)::BIGINT AS b, unnest(green)::BIGINT AS g, unnest(red)::BIGINT AS r, unnest(range(64)) AS i FROM shots)),
yuv AS (SELECT *, (19595 * r + 38470 * g + 7471 * b + 32768) >> 16 AS luma, (32768 * b - 21709 * g - 11059 * r + 8421375) >> 16 AS cb, (32768 * r - 27439 * g - 5329 * b + 8421375) >> 16 AS cr FROM px),
half AS (SELECT video_id, frame_no, x // 2 AS x, y // 2 AS y, (2 * sum(cb) + 4)::BIGINT // 8 AS u, (2 * sum(cr) + 4)::BIGINT // 8 AS v FROM yuv GROUP BY ALL)"""


def planes_420(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Luma and halved chroma of every colour frame."""
    return _planes(spark, sf_dir).select("video_id", "frame_no", text("y"), text("u"), text("v"))


PLANES_420 = f"""WITH {_PLANES} SELECT * FROM (SELECT video_id, frame_no, string_agg(luma::VARCHAR, ',' ORDER BY y, x) AS y FROM yuv GROUP BY ALL)
JOIN (SELECT video_id, frame_no, string_agg(u::VARCHAR, ',' ORDER BY y, x) AS u, string_agg(v::VARCHAR, ',' ORDER BY y, x) AS v FROM half GROUP BY ALL) USING (video_id, frame_no)"""


def halo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Luma sharpened with kernels of two widths and several amounts; chroma stays."""
    done = render.haloed(_planes(spark, sf_dir), F.col("frame_no") % 2 * 2 + 3, F.lit(3), F.col("frame_no") * 300)
    return done.select("video_id", "frame_no", text("y"), text("u"))


HALO = f"""WITH {_PLANES}, r0 AS (SELECT video_id, frame_no, id, x, y, luma AS v, frame_no % 2 + 1 AS rx, 1 AS ry FROM yuv), {sql.box('b0', 'r0', 'id', 'rx', 'ry')},
sharp AS (SELECT video_id, frame_no, x, y, least(greatest(2 * (v * 1000 * n + 300 * frame_no * (v * n - s)) + 1000 * n, 0) // (2000 * n), 255) AS luma FROM b0)
SELECT * FROM (SELECT video_id, frame_no, string_agg(luma::VARCHAR, ',' ORDER BY y, x) AS y FROM sharp GROUP BY ALL)
JOIN (SELECT video_id, frame_no, string_agg(u::VARCHAR, ',' ORDER BY y, x) AS u FROM half GROUP BY ALL) USING (video_id, frame_no)"""


def interlace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of frame pairs woven, upper field first; recordings have gaps and odd numbers of frames."""
    return render.interlaced(adapters.recordings(spark, sf_dir), True).select("video_id", "frame_no", text())


def _lowpass(value: str, keys: str) -> str:
    """A value mixed with those above and below, over a window named by its keys."""
    w = f"OVER (PARTITION BY {keys}, x ORDER BY y)"
    return f"(coalesce(lag({value}) {w}, {value}) + 2 * {value} + coalesce(lead({value}) {w}, {value}) + 1) >> 2"


INTERLACE = f"""WITH {sql.RECORDINGS}, placed AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY frame_no) - 1 AS place FROM recordings),
{sql.cells('c', 'placed', 'video_id, place', 'pixels')}, low AS (SELECT video_id, place, x, y, {_lowpass('v', 'video_id, place')} AS v FROM c),
pair AS (SELECT video_id, place // 2 AS pair FROM placed GROUP BY ALL HAVING count(*) = 2),
field AS (SELECT video_id, (pair + 1)::INTEGER AS frame_no, x, y, v FROM low JOIN pair USING (video_id) WHERE place // 2 = pair AND place % 2 = y % 2) {sql.texted('field', 'video_id, frame_no')}"""


def interlace_chroma(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Luma progressive, chroma woven, lower field first."""
    return render.chroma_interlaced(_planes(spark, sf_dir), False).select("video_id", "frame_no", text("y"), text("u"), text("v"))


INTERLACE_CHROMA = f"""WITH {_PLANES}, placed AS (SELECT *, dense_rank() OVER (PARTITION BY video_id ORDER BY frame_no) - 1 AS place, count(*) OVER (PARTITION BY video_id, x, y) AS n FROM half),
low AS (SELECT *, {_lowpass('u', 'video_id, frame_no')} AS lu, {_lowpass('v', 'video_id, frame_no')} AS lv FROM placed),
woven AS (SELECT a.video_id, a.frame_no, a.x, a.y, coalesce(b.lu, a.u) AS u, coalesce(b.lv, a.v) AS v FROM low a LEFT JOIN low b ON b.video_id = a.video_id AND b.x = a.x AND b.y = a.y
  AND b.place // 2 = a.place // 2 AND b.place % 2 = 1 - b.y % 2 AND (a.place - a.place % 2 + 1) < a.n)
SELECT * FROM (SELECT video_id, frame_no, string_agg(luma::VARCHAR, ',' ORDER BY y, x) AS y FROM yuv GROUP BY ALL)
JOIN (SELECT video_id, frame_no, string_agg(u::VARCHAR, ',' ORDER BY y, x) AS u, string_agg(v::VARCHAR, ',' ORDER BY y, x) AS v FROM woven GROUP BY ALL) USING (video_id, frame_no)"""


def chroma_delay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chroma one and a half frames late, in recordings with gaps."""
    return render.chroma_delayed(_planes(spark, sf_dir), DELAY).select("video_id", "frame_no", text("y"), text("u"), text("v"))


CHROMA_DELAY = f"""WITH {_PLANES}, luma AS (SELECT video_id, frame_no, string_agg(luma::VARCHAR, ',' ORDER BY y, x) AS y FROM yuv GROUP BY ALL),
chroma AS (SELECT video_id, frame_no, string_agg(u::VARCHAR, ',' ORDER BY y, x) AS u, string_agg(v::VARCHAR, ',' ORDER BY y, x) AS v FROM half GROUP BY ALL),
due AS (SELECT a.video_id, a.frame_no, a.y, coalesce(max(c.frame_no) FILTER (c.frame_no + {DELAY} <= a.frame_no), min(c.frame_no)) AS shown FROM luma a JOIN chroma c ON c.video_id = a.video_id GROUP BY ALL)
SELECT d.video_id, d.frame_no, d.y, c.u, c.v FROM due d JOIN chroma c ON c.video_id = d.video_id AND c.frame_no = d.shown"""


def ghosting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two trails over every frame."""
    return render.ghosted(adapters.recordings(spark, sf_dir), GHOSTS).select("video_id", "frame_no", text())


def _ghost_sql(k: int, g: dict[str, int]) -> str:
    return f"""g{k} AS (SELECT a.id, a.x, a.y, list_sort(list(b.v))[(count(*) + 1) // 2] AS v, 1 AS r FROM c a JOIN c b ON b.video_id = a.video_id AND b.x = a.x AND b.y = a.y
  AND b.place BETWEEN a.place - {g["delay"]} AND a.place + {g["delay"]} GROUP BY a.id, a.x, a.y), {sql.box(f"s{k}", f"g{k}", "id", "r")},
o{k + 1} AS (SELECT o.* EXCLUDE (v), (2 * (o.v * {1000 - g["opacity"]} + least(coalesce((2 * ((2 * s.s + s.n) // (2 * s.n)) * {g.get("gain", 1000)} + 1000) // 2000, 0), 255) * {g["opacity"]}) + 1000) // 2000 AS v
  FROM o{k} o LEFT JOIN s{k} s ON s.id = o.id AND s.x = o.x - {g["offset_x"]} AND s.y = o.y - {g["offset_y"]})"""


GHOSTING = f"""WITH {sql.RECORDINGS}, placed AS (SELECT *, video_id * 100 + frame_no AS id, row_number() OVER (PARTITION BY video_id ORDER BY frame_no) AS place FROM recordings),
{sql.cells('c', 'placed', 'video_id, frame_no, id, place', 'pixels')}, o0 AS (SELECT * FROM c), {", ".join(_ghost_sql(k, g) for k, g in enumerate(GHOSTS))} {sql.texted('o2', 'video_id, frame_no')}"""


def _tonemap(kind: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        done = render.tonemapped(adapters.shots(spark, sf_dir), kind, ("blue", "green", "red"))
        return done.select("video_id", "frame_no", "peak", text("blue"), text("green"), text("red"))

    query.__doc__ = f"Colour frames brought to the range of their recording's peak by the {kind} curve."
    return query


_FILMIC = tuple(
    part.format(num="(1500 * {0} * {0} + 500 * 128 * {0} + 40 * 16384)", den="(1500 * {0} * {0} + 5000 * 128 * {0} + 600 * 16384)")
    for part in ("({num} * 30 - {den} * 2)", "({den} * 30)")
)


def _tonemap_sql(num: str, den: str) -> str:
    (n, d), (white, under) = [[f"({part.format(v)})::HUGEINT" for part in (num, den)] for v in ("v", "peak")]
    table = f"(510 * {n} * {under} + {d} * {white}) // (2 * {d} * {white})"
    return f"""WITH {sql.SHOTS}, px AS (SELECT video_id, frame_no, unnest(range(64)) AS i, unnest(blue) AS b, unnest(green) AS g, unnest(red) AS r FROM shots),
placed AS (SELECT video_id, greatest(b, g, r) AS m, row_number() OVER (PARTITION BY video_id ORDER BY greatest(b, g, r)) - 1 AS k, (count(*) OVER (PARTITION BY video_id) - 1) * 0.999::DOUBLE AS pos FROM px),
ends AS (SELECT video_id, any_value(pos) AS pos, max(m) FILTER (k = floor(pos)) AS low, max(m) FILTER (k = ceil(pos)) AS high FROM placed GROUP BY video_id),
peaks AS (SELECT video_id, greatest(floor(CASE WHEN low = high THEN low ELSE (ceil(pos) - pos) * low + (pos - floor(pos)) * high END), 1)::INTEGER AS peak FROM ends),
curve AS (SELECT peak, v, least({table}, 255)::BIGINT AS t FROM range(1, 256) a(peak), range(256) b(v)),
looked AS (SELECT p.video_id, p.frame_no, q.peak, p.i, x.t AS b, y.t AS g, z.t AS r FROM px p JOIN peaks q ON q.video_id = p.video_id
  JOIN curve x ON x.peak = q.peak AND x.v = p.b JOIN curve y ON y.peak = q.peak AND y.v = p.g JOIN curve z ON z.peak = q.peak AND z.v = p.r)
SELECT video_id, frame_no, peak, string_agg(b::VARCHAR, ',' ORDER BY i) AS blue, string_agg(g::VARCHAR, ',' ORDER BY i) AS green, string_agg(r::VARCHAR, ',' ORDER BY i) AS red FROM looked GROUP BY ALL"""


TONEMAP_REINHARD, TONEMAP_HABLE = _tonemap_sql("{0}", "({0} + 128)"), _tonemap_sql(*_FILMIC)


def _noise(gaussian: bool):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = adapters.recordings(spark, sf_dir)
        return render.noised(rows, F.col("video_id") + SEED, F.lit(STRENGTH), gaussian).select("video_id", "frame_no", text())

    query.__doc__ = f"{'Nearly gaussian' if gaussian else 'Uniform'} noise on every pixel, by seed, frame and pixel."
    return query


def _noise_sql(draws: int) -> str:
    seeds = sql.scramble(f"SELECT *, video_id + {SEED} AS k0 FROM c", "k0", "k1")
    bases = sql.scramble(f"SELECT *, xor(frame_no, k1) AS k2 FROM ({seeds})", "k2", "base")
    words = sql.scramble(f"SELECT *, xor((y * width + x) * {draws} + d, base) AS k3 FROM ({bases}), range({draws}) t(d)", "k3", "word")
    return f"""WITH {sql.RECORDINGS}, {sql.cells('c', 'recordings', 'video_id, frame_no', 'pixels')}, words AS ({words}),
total AS (SELECT video_id, frame_no, x, y, any_value(v) AS v, sum((word * {2 * STRENGTH + 1} >> 32) - {STRENGTH})::BIGINT AS s FROM words GROUP BY video_id, frame_no, x, y),
noisy AS (SELECT video_id, frame_no, x, y, least(greatest(v + floor((2 * s + {draws}) / (2.0 * {draws}))::BIGINT, 0), 255) AS v FROM total) {sql.texted('noisy', 'video_id, frame_no')}"""


QUERIES = {
    "scene_score": scene_score,
    "scene_pixels": scene_pixels,
    "resize_area": _resize("area"),
    "resize_bilinear": _resize("bilinear"),
    "resize_bicubic": _resize("bicubic"),
    "blur_box": blur_box,
    "blur_gaussian": blur_gaussian,
    "blur_motion": blur_motion,
    "border_table": border_table,
    "planes_420": planes_420,
    "halo": halo,
    "interlace": interlace,
    "interlace_chroma": interlace_chroma,
    "chroma_delay": chroma_delay,
    "ghosting": ghosting,
    "tonemap_reinhard": _tonemap("reinhard"),
    "tonemap_hable": _tonemap("hable"),
    "noise_gaussian": _noise(True),
    "noise_uniform": _noise(False),
}
ORACLES = {
    "scene_score": SCENE_SCORE,
    "scene_pixels": SCENE_PIXELS,
    "resize_area": RESIZE_AREA,
    "resize_bilinear": RESIZE_BILINEAR,
    "resize_bicubic": RESIZE_BICUBIC,
    "blur_box": BLUR_BOX,
    "blur_gaussian": BLUR_GAUSSIAN,
    "blur_motion": BLUR_MOTION,
    "border_table": frames.BORDER_SCAN,
    "planes_420": PLANES_420,
    "halo": HALO,
    "interlace": INTERLACE,
    "interlace_chroma": INTERLACE_CHROMA,
    "chroma_delay": CHROMA_DELAY,
    "ghosting": GHOSTING,
    "tonemap_reinhard": TONEMAP_REINHARD,
    "tonemap_hable": TONEMAP_HABLE,
    "noise_gaussian": _noise_sql(4),
    "noise_uniform": _noise_sql(1),
}
