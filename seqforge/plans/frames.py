"""Queries on pixels: statistics, motion, blankness, verdicts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqforge.functions import pixels
from seqforge.operators import quality
from seqforge.plans import sql
from seqforge.sources import adapters

#: Thresholds that tell the test frames apart.
EDGE, VARIANCE, MIN_BLANK, LOW, HIGH, LENGTH = 72.0, 253.0, 2, 10.0, 28.0, 5


def gray(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three consecutive vectors as blue, green and red channels: sum and ends of the gray values."""
    rows = adapters.embedding_frames(spark, sf_dir).select(F.expr("vec_id div 3").alias("id"), F.pmod("vec_id", F.lit(3)).alias("k"), "pixels")
    channel = lambda k: F.max(F.when(F.col("k") == k, F.col("pixels")))
    three = rows.groupBy("id").agg(*[channel(k).alias("bgr"[k]) for k in range(3)]).where("b IS NOT NULL AND g IS NOT NULL AND r IS NOT NULL")
    values = F.transform(F.arrays_zip("b", "g", "r"), lambda p: pixels.gray(p["b"], p["g"], p["r"]))
    three = three.withColumn("v", values)
    return three.select("id", F.aggregate("v", F.lit(0).cast("long"), lambda a, x: a + x).alias("gray_sum"), F.array_min("v").cast("long").alias("gray_min"), F.array_max("v").cast("long").alias("gray_max"))


GRAY = f"""WITH {sql.FRAMES}, three AS (SELECT vec_id // 3 AS id, max(pixels) FILTER (vec_id % 3 = 0) AS b, max(pixels) FILTER (vec_id % 3 = 1) AS g, max(pixels) FILTER (vec_id % 3 = 2) AS r FROM frames GROUP BY 1),
v AS (SELECT id, list_transform(range(1, 65), lambda i: (3735 * b[i] + 19235 * g[i] + 9798 * r[i] + 16384) >> 15) AS v FROM three WHERE b IS NOT NULL AND g IS NOT NULL AND r IS NOT NULL)
SELECT id, list_sum(v)::BIGINT AS gray_sum, list_min(v)::BIGINT AS gray_min, list_max(v)::BIGINT AS gray_max FROM v"""


def crop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 4 x 3 rectangle at (2, 3) of every frame."""
    part = pixels.crop(F.col("pixels"), F.col("width"), F.lit(2), F.lit(3), F.lit(4), F.lit(3))
    return adapters.embedding_frames(spark, sf_dir).select("vec_id", F.array_join(part, ",").alias("crop"))


CROP = f"""WITH {sql.FRAMES} SELECT vec_id, string_agg(pixels[i + 1]::VARCHAR, ',' ORDER BY i) AS crop FROM frames, range(64) t(i)
WHERE i % 8 BETWEEN 2 AND 5 AND i // 8 BETWEEN 3 AND 5 GROUP BY vec_id"""


def frame_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number, sum and spread of the pixels, and the mean."""
    df = adapters.embedding_frames(spark, sf_dir)
    total = F.aggregate("pixels", F.lit(0).cast("long"), lambda a, v: a + v)
    return df.select("vec_id", F.size("pixels").cast("long").alias("n_px"), total.alias("sum_px"), pixels.spread(F.col("pixels")).alias("var_num"), (total / F.size("pixels")).alias("mean_px"))


FRAME_STATS = f"""WITH {sql.FRAMES}, p AS (SELECT vec_id, unnest(pixels) AS v FROM frames)
SELECT vec_id, count(*) AS n_px, sum(v)::BIGINT AS sum_px, (count(*) * sum(v * v) - sum(v) * sum(v))::BIGINT AS var_num, sum(v)::DOUBLE / count(*) AS mean_px FROM p GROUP BY vec_id"""



def sobel_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels with a strong edge."""
    df = adapters.embedding_frames(spark, sf_dir)
    strong = pixels.edges(F.col("pixels"), F.col("width"), F.col("height"))
    return df.select("vec_id", strong.alias("edge_num")).withColumn("edge_density", F.col("edge_num") * 100 / F.lit(64.0))


def _edges_sql(source: str, key: str, w: str = "width", h: str = "height") -> str:
    """edge_num by key: pixels joined with an eight-neighbour kernel."""
    return f"""px AS (SELECT {key}, {w} AS w, {h} AS h, i % {w} AS x, i // {w} AS y, pixels[i + 1]::BIGINT AS v FROM (SELECT *, unnest(range(len(pixels))) AS i FROM {source})),
kernel(dx, dy, kx, ky) AS (VALUES (-1, -1, -1, -1), (0, -1, 0, -2), (1, -1, 1, -1), (-1, 0, -2, 0), (1, 0, 2, 0), (-1, 1, -1, 1), (0, 1, 0, 2), (1, 1, 1, 1)),
around AS (SELECT {key}, x, y, kx, ky, CASE WHEN w = 1 THEN 0 WHEN x + dx < 0 THEN 1 WHEN x + dx >= w THEN w - 2 ELSE x + dx END AS nx,
  CASE WHEN h = 1 THEN 0 WHEN y + dy < 0 THEN 1 WHEN y + dy >= h THEN h - 2 ELSE y + dy END AS ny FROM px, kernel),
slope AS (SELECT a.{key}, a.x, a.y, sum(kx * v) AS gx, sum(ky * v) AS gy FROM around a JOIN px p ON a.{key} = p.{key} AND a.nx = p.x AND a.ny = p.y GROUP BY ALL),
edged AS (SELECT {key}, count(*) FILTER (gx * gx + gy * gy > 900) AS edge_num FROM slope GROUP BY {key})"""


SOBEL_DENSITY = f"WITH {sql.FRAMES}, {_edges_sql('frames', 'vec_id')} SELECT vec_id, edge_num, edge_num * 100 / 64.0::DOUBLE AS edge_density FROM edged"


def border_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dark lines from each side of letterboxed frames."""
    df = adapters.letterboxed_frames(spark, sf_dir).withColumn("b", pixels.border(F.col("pixels"), F.col("width"), F.col("height")))
    return df.select("vec_id", *[F.col(f"b.{s}").alias(s) for s in ("top", "bottom", "left", "right")])


def _border_sql(source: str, key: str) -> str:
    """top, bottom, left, right by key."""
    return f"""cell AS (SELECT {key}, width AS w, height AS h, i % width AS x, i // width AS y, pixels[i + 1] AS v FROM (SELECT *, unnest(range(len(pixels))) AS i FROM {source})),
rowsum AS (SELECT {key}, w, h, y, sum(v) > 10 * w AS bright FROM cell GROUP BY {key}, w, h, y), colsum AS (SELECT {key}, w, h, x, sum(v) > 10 * h AS bright FROM cell GROUP BY {key}, w, h, x),
vertical AS (SELECT {key}, coalesce(min(y) FILTER (bright AND y < h // 2), any_value(h) // 2) AS top,
  coalesce(min(h - 1 - y) FILTER (bright AND y > h // 2), any_value(h) - 1 - any_value(h) // 2) AS bottom FROM rowsum GROUP BY {key}),
horizontal AS (SELECT {key}, coalesce(min(x) FILTER (bright AND x < w // 2), any_value(w) // 2) AS "left",
  coalesce(min(w - 1 - x) FILTER (bright AND x > w // 2), any_value(w) - 1 - any_value(w) // 2) AS "right" FROM colsum GROUP BY {key}),
bordered AS (SELECT {key}, top::BIGINT AS top, bottom::BIGINT AS bottom, "left"::BIGINT AS "left", "right"::BIGINT AS "right" FROM vertical JOIN horizontal USING ({key}))"""


BORDER_SCAN = f'WITH {sql.BOXED}, {_border_sql("boxed", "vec_id")} SELECT vec_id, top, bottom, "left", "right" FROM bordered'


def _blank(frames: DataFrame, key: str) -> DataFrame:
    df = quality.details(frames).withColumn("is_blank", quality.is_blank(EDGE, VARIANCE))
    return df.select(key, "edge_num", "n_px", "var_num", F.col("border_num").cast("long").alias("border_num"), "is_blank")


def blank_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Details and verdict of 16 x 16 mosaics, some with dark borders."""
    return _blank(adapters.stitched_frames(spark, sf_dir), "seq")


def _blank_sql(source: str, key: str) -> str:
    """edge_num, n_px, var_num, border_num, is_blank by key, of the frame or of its content."""
    return f"""{_border_sql(source, key)},
area AS (SELECT f.{key}, f.pixels, f.width, f.height, ((top + bottom) * width + ("left" + "right") * (height - top - bottom))::BIGINT AS border_num, top, "left" AS lft,
  width - "left" - "right" AS cw, height - top - bottom AS ch FROM {source} f JOIN bordered b ON f.{key} = b.{key}),
content AS (SELECT {key}, border_num, width AS full_w, height AS full_h,
  CASE WHEN border_num * 10 < width * height * 9 AND cw * ch >= 100 THEN list_transform(range(cw * ch), lambda i: pixels[(top + i // cw) * width + lft + i % cw + 1]) ELSE pixels END AS pixels,
  CASE WHEN border_num * 10 < width * height * 9 AND cw * ch >= 100 THEN cw ELSE width END AS width,
  CASE WHEN border_num * 10 < width * height * 9 AND cw * ch >= 100 THEN ch ELSE height END AS height FROM area),
{_edges_sql("content", key)},
spread AS (SELECT {key}, count(*) AS n_px, (count(*) * sum(v * v) - sum(v) * sum(v))::BIGINT AS var_num FROM px GROUP BY {key}),
blank AS (SELECT c.{key}, edge_num, n_px, var_num, border_num,
  (border_num * 100 > full_w * full_h * 40 OR (edge_num * 100 < n_px * {EDGE} AND var_num < n_px * n_px * {VARIANCE})) AS is_blank
  FROM content c JOIN edged e ON c.{key} = e.{key} JOIN spread s ON c.{key} = s.{key})"""


BLANK_FRAMES = f"WITH {sql.STITCHED}, {_blank_sql('stitched', 'seq')} SELECT seq, edge_num, n_px, var_num, border_num, is_blank FROM blank"


def blank_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blank frames of each sequence, and whether it is rejected."""
    df = quality.details(adapters.letterboxed_frames(spark, sf_dir)).withColumn("b", quality.is_blank(EDGE, VARIANCE))
    n = F.count_if("b")
    return df.groupBy("seq").agg(n.alias("blank_frames"), (n >= MIN_BLANK).alias("rejected"))


BLANK_SEQUENCES = f"""WITH {sql.BOXED}, {_blank_sql("boxed", "vec_id")}
SELECT vec_id // 5 AS seq, count(*) FILTER (is_blank) AS blank_frames, count(*) FILTER (is_blank) >= {MIN_BLANK} AS rejected FROM blank GROUP BY 1"""


def motion_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changed pixels of each frame against the one before."""
    df = quality.motion(adapters.gapped_frames(spark, sf_dir))
    return df.select("seq", F.col("frame_no").cast("long").alias("frame_no"), "changed_px", "n_px", (F.col("changed_px") / F.col("n_px") * 100).alias("score"))


_MOVED = """moved AS (SELECT seq, frame_no, pixels, lag(pixels) OVER (PARTITION BY seq ORDER BY frame_no) AS before FROM {source}),
motion AS (SELECT seq, frame_no::BIGINT AS frame_no, len(list_filter(range(1, len(pixels) + 1), lambda i: abs(pixels[i] - before[i]) > 30))::BIGINT AS changed_px, len(pixels)::BIGINT AS n_px
  FROM moved WHERE before IS NOT NULL)"""
_GAPPED = f"{sql.FRAMES}, gapped AS (SELECT * FROM frames WHERE label <> 7)"

MOTION_SCORE = f"WITH {_GAPPED}, {_MOVED.format(source='gapped')} SELECT seq, frame_no, changed_px, n_px, changed_px / n_px * 100 AS score FROM motion"


def motion_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """LOW, HIGH or OK for every adjacent pair."""
    df = quality.motion(adapters.embedding_frames(spark, sf_dir))
    return df.select("seq", F.col("frame_no").cast("long").alias("frame_no"), "changed_px", quality.motion_label(LOW, HIGH).alias("label"))


MOTION_REPORT = f"""WITH {sql.FRAMES}, {_MOVED.format(source="frames")} SELECT seq, frame_no, changed_px,
CASE WHEN changed_px * 100 < n_px * {LOW} THEN 'LOW' WHEN changed_px * 100 > n_px * {HIGH} THEN 'HIGH' ELSE 'OK' END AS label FROM motion"""


def motion_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each sequence with a pair is rejected for its motion."""
    df = quality.motion(adapters.embedding_frames(spark, sf_dir)).withColumn("label", quality.motion_label(LOW, HIGH))
    return df.groupBy("seq").agg(F.min("changed_px").alias("least_px"), F.max("changed_px").alias("most_px"), F.bool_or(F.col("label") != "OK").alias("rejected"))


MOTION_SEQUENCES = f"""WITH {sql.FRAMES}, {_MOVED.format(source="frames")} SELECT seq, min(changed_px) AS least_px, max(changed_px) AS most_px,
bool_or(changed_px * 100 < n_px * {LOW} OR changed_px * 100 > n_px * {HIGH}) AS rejected FROM motion GROUP BY seq"""


def completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations of exactly five turns."""
    return quality.completeness(adapters.conversation_frames(spark, sf_dir), LENGTH)


COMPLETENESS = f"""SELECT conv_id AS seq, count(*) AS n_frames, count(*) = {LENGTH} AND count(DISTINCT turn) = {LENGTH} AND min(turn) = 0 AND max(turn) = {LENGTH - 1} AS complete
FROM conversations GROUP BY conv_id"""


def quality_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status and reason of every sequence after all filters."""
    df = quality.verdicts(adapters.gapped_frames(spark, sf_dir), EDGE, VARIANCE, MIN_BLANK, LOW, HIGH, LENGTH)
    return df.select("seq", "n_frames", "blank_frames", "motion_bad", "complete", "status", "reason")


_PIPELINE = f"""{_GAPPED}, {_blank_sql("gapped", "vec_id")}, {_MOVED.format(source="gapped")},
b AS (SELECT vec_id // 5 AS seq, count(*) AS n_frames, count(*) FILTER (is_blank) AS blank_frames FROM blank GROUP BY 1),
m AS (SELECT seq, bool_or(changed_px * 100 < n_px * {LOW} OR changed_px * 100 > n_px * {HIGH}) AS motion_bad FROM motion GROUP BY seq),
done AS (SELECT b.seq, n_frames, blank_frames, coalesce(motion_bad, false) AS motion_bad, n_frames = {LENGTH} AS complete,
  CASE WHEN blank_frames >= {MIN_BLANK} THEN 'blank' WHEN coalesce(motion_bad, false) THEN 'motion' WHEN n_frames <> {LENGTH} THEN 'incomplete' END AS reason FROM b LEFT JOIN m ON b.seq = m.seq)"""
QUALITY_PIPELINE = f"WITH {_PIPELINE} SELECT seq, n_frames, blank_frames, motion_bad, complete, CASE WHEN reason IS NULL THEN 'kept' ELSE 'bad' END AS status, reason FROM done"


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole curation: sequences by verdict, with their frames and the degraded frames to set aside with them."""
    frames = adapters.gapped_frames(spark, sf_dir)
    judged = quality.verdicts(frames, EDGE, VARIANCE, MIN_BLANK, LOW, HIGH, LENGTH).select("seq", "status", "reason", "n_frames")
    low = adapters.embedding_frames(spark, sf_dir).select("seq", "frame_no")
    kept_high = frames.select("seq", "frame_no").join(judged.where("status = 'kept'"), "seq", "left_semi")
    astray = low.join(kept_high, ["seq", "frame_no"], "left_anti").groupBy("seq").agg(F.count("*").alias("astray"))
    joined = judged.join(astray, "seq", "left")
    return joined.groupBy("status", F.coalesce("reason", F.lit("")).alias("reason")).agg(
        F.count("*").alias("sequences"), F.sum("n_frames").alias("frames"), F.coalesce(F.sum("astray"), F.lit(0)).alias("low_frames_astray")
    )


FLAGSHIP = f"""WITH {_PIPELINE}, low AS (SELECT f.seq, count(*) AS astray FROM frames f WHERE NOT EXISTS
  (SELECT 1 FROM gapped g JOIN done d ON g.seq = d.seq AND d.reason IS NULL WHERE g.seq = f.seq AND g.frame_no = f.frame_no) GROUP BY f.seq)
SELECT CASE WHEN reason IS NULL THEN 'kept' ELSE 'bad' END AS status, coalesce(reason, '') AS reason, count(*) AS sequences, sum(n_frames)::BIGINT AS frames,
coalesce(sum(astray), 0)::BIGINT AS low_frames_astray FROM done LEFT JOIN low ON done.seq = low.seq GROUP BY 1, 2"""

QUERIES = {
    "gray": gray, "crop": crop, "frame_stats": frame_stats, "sobel_density": sobel_density, "border_scan": border_scan, "blank_frames": blank_frames,
    "blank_sequences": blank_sequences, "motion_score": motion_score, "motion_report": motion_report, "motion_sequences": motion_sequences,
    "completeness": completeness, "quality_pipeline": quality_pipeline, "flagship": flagship,
}
ORACLES = {
    "gray": GRAY, "crop": CROP, "frame_stats": FRAME_STATS, "sobel_density": SOBEL_DENSITY, "border_scan": BORDER_SCAN, "blank_frames": BLANK_FRAMES,
    "blank_sequences": BLANK_SEQUENCES, "motion_score": MOTION_SCORE, "motion_report": MOTION_REPORT, "motion_sequences": MOTION_SEQUENCES,
    "completeness": COMPLETENESS, "quality_pipeline": QUALITY_PIPELINE, "flagship": FLAGSHIP,
}
