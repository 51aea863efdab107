"""Queries on chunks: ranges, scenes, numbering, draws, encoding plans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqforge.functions import draws
from seqforge.operators import chunking, degrade, sampling
from seqforge.plans import sql
from seqforge.sources import adapters, config

CUT, SEED, MIN_SCENE = 100.0, degrade.SEED, 3


def chunk_by_duration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranges of two seconds of every clip."""
    df = chunking.by_duration(adapters.clips(spark, sf_dir), 2.0, F.col("n_frames"), F.col("fps"))
    return df.select("chunk_no", "start_frame", "end_frame")


CHUNK_BY_DURATION = f"""WITH {sql.CLIPS}, s AS (SELECT chunk_no, n_frames, trunc(2.0 * fps)::BIGINT AS step FROM clips),
r AS (SELECT chunk_no, n_frames, step, unnest(range(0, n_frames, step)) AS start_frame FROM s)
SELECT chunk_no, start_frame, least(start_frame + step, n_frames) AS end_frame FROM r"""


def chunk_by_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranges of 20 frames of every video."""
    videos = adapters.event_signal(spark, sf_dir).groupBy("video_id").agg(F.count("*").alias("total"))
    return chunking.by_step(videos, F.col("total"), F.lit(20).cast("long")).select("video_id", "start_frame", "end_frame")


CHUNK_BY_COUNT = """WITH v AS (SELECT user_id AS video_id, count(*) AS total FROM events GROUP BY 1), r AS (SELECT video_id, total, unnest(range(0, total, 20)) AS start_frame FROM v)
SELECT video_id, start_frame, least(start_frame + 20, total) AS end_frame FROM r"""


def scene_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.scenes(adapters.event_signal(spark, sf_dir), CUT)


def _scene_sql(cut_no: str = "cuts") -> str:
    return f"""{sql.SIGNAL}, cut AS (SELECT *, sum((coalesce(score >= {CUT}, false))::INTEGER) OVER (PARTITION BY video_id ORDER BY frame_no) AS cuts FROM signal),
scene AS (SELECT video_id, {cut_no}::BIGINT AS scene_no, min(frame_no) AS start_frame, max(frame_no) + 1 AS end_frame FROM cut GROUP BY 1, 2)"""


SCENE_DETECT = f"WITH {_scene_sql()} SELECT * FROM scene"


def scene_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only the first five cuts of a video count."""
    return chunking.scenes(adapters.event_signal(spark, sf_dir), CUT, max_cuts=5)


SCENE_LIMIT = f"WITH {_scene_sql('least(cuts, 5)')} SELECT * FROM scene"


def scene_spaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cuts at least five frames apart: a greedy walk."""
    return chunking.scenes(adapters.event_signal(spark, sf_dir), CUT, min_scene_len=5)


SCENE_SPACED = f"""WITH RECURSIVE {sql.SIGNAL}, cut AS (SELECT video_id, frame_no FROM signal WHERE score >= {CUT}),
walk AS (SELECT video_id, min(frame_no) AS frame_no FROM cut WHERE frame_no >= 5 GROUP BY video_id
  UNION ALL SELECT video_id, frame_no FROM (SELECT w.video_id, min(c.frame_no) AS frame_no FROM walk w JOIN cut c ON c.video_id = w.video_id AND c.frame_no >= w.frame_no + 5 GROUP BY w.video_id, w.frame_no)),
no AS (SELECT s.video_id, s.frame_no, (SELECT count(*) FROM walk w WHERE w.video_id = s.video_id AND w.frame_no <= s.frame_no) AS scene_no FROM signal s)
SELECT video_id, scene_no, min(frame_no) AS start_frame, max(frame_no) + 1 AS end_frame FROM no GROUP BY 1, 2"""


def chunk_by_scene(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scenes of at least three frames, numbered over all videos."""
    scenes = chunking.keep_long(chunking.scenes(adapters.event_signal(spark, sf_dir), CUT), F.lit(MIN_SCENE))
    return chunking.number_groups(scenes, "video_id", "chunk_in_video").select("video_id", "start_frame", "end_frame", "chunk_no")


CHUNK_BY_SCENE = f"""WITH {_scene_sql()} SELECT video_id, start_frame, end_frame, row_number() OVER (ORDER BY video_id, start_frame) AS chunk_no FROM scene
WHERE end_frame - start_frame >= {MIN_SCENE}"""


def chunk_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers go on after the existing chunk files."""
    names = adapters.high_files(spark, sf_dir).where(F.col("basename").rlike(r"^chunk_0[0-9]{3}\."))
    existing = names.agg(F.max(F.regexp_extract("basename", r"_(\d+)\.", 1).try_cast("long"))).first()[0] or 0
    new = chunking.scenes(adapters.event_signal(spark, sf_dir), CUT)
    return chunking.number_groups(new, "video_id", "scene_no", F.lit(existing)).select("video_id", "scene_no", "chunk_no")


CHUNK_RESUME = f"""WITH {_scene_sql()}, have AS (SELECT coalesce(max(regexp_extract(n, '_(\\d+)\\.', 1)::BIGINT), 0) AS n FROM (SELECT printf('chunk_%04d.mkv', o_orderkey) AS n FROM orders)
  WHERE regexp_matches(n, '^chunk_0[0-9]{{3}}\\.'))
SELECT video_id, scene_no, row_number() OVER (ORDER BY video_id, scene_no) + (SELECT n FROM have) AS chunk_no FROM scene"""


def bernoulli(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = draws.unit(SEED, "apply", F.col("chunk_no"))
    return adapters.clips(spark, sf_dir).select("chunk_no", draws.bernoulli(u, 0.6).alias("applied"))


BERNOULLI = f"WITH {sql.CLIPS} SELECT chunk_no, {sql.unit('apply', 'chunk_no')} < 0.6 AS applied FROM clips"

#: Weights that sum to 0.995: the last codec gets what is left.
GAPPED_CODECS = (
    config.Codec("h264", 0.5, (23, 33), ("veryslow", "fast")),
    config.Codec("h265", 0.245, (18, 28), ("medium", "slow", "veryslow")),
    config.Codec("vp9", 0.125, (22, 28)),
    config.Codec("av1", 0.125, (25, 30), (), (2, 8)),
    config.Codec("mpeg2", 0.0, (6000, 10000)),
)


def _codec():
    return sampling.pick(draws.unit(SEED, "codec", F.col("chunk_no")), GAPPED_CODECS)


def codec_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapters.clips(spark, sf_dir).select("chunk_no", _codec().alias("codec"))


_DIMENSION = "codecs(pos, codec, p, lo, hi) AS (VALUES (1, 'h264', 0.5::DOUBLE, 23, 33), (2, 'h265', 0.245, 18, 28), (3, 'vp9', 0.125, 22, 28), (4, 'av1', 0.125, 25, 30), (5, 'mpeg2', 0.0, 6000, 10000))"
_PICKED = f"""{sql.CLIPS}, {_DIMENSION}, cum AS (SELECT *, sum(p) OVER (ORDER BY pos) AS total FROM codecs),
picked AS (SELECT chunk_no, coalesce((SELECT min_by(codec, pos) FROM cum WHERE {sql.unit("codec", "chunk_no")} <= total), 'mpeg2') AS codec FROM clips)"""
CODEC_PICK = f"WITH {_PICKED} SELECT chunk_no, codec FROM picked"


def weight_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four weight sets: sums 1, 0.995, 0.5 and 0."""
    sets = {"full": (0.6, 0.4), "near": (0.595, 0.4), "half": (0.25, 0.25), "none": (0.0, 0.0)}
    rows = [(n, c.name, float(c.probability)) for n, w in sets.items() for c in sampling.normalized([config.Codec(f"c{i}", p, (0, 1)) for i, p in enumerate(w)])]
    return spark.createDataFrame(rows, "weights string, codec string, probability double")


WEIGHT_NORMALIZE = """WITH w(weights, codec, p) AS (VALUES ('full', 'c0', 0.6::DOUBLE), ('full', 'c1', 0.4), ('near', 'c0', 0.595), ('near', 'c1', 0.4), ('half', 'c0', 0.25), ('half', 'c1', 0.25), ('none', 'c0', 0.0), ('none', 'c1', 0.0))
SELECT weights, codec, CASE WHEN total > 0 AND total NOT BETWEEN 0.99 AND 1.01 THEN p / total ELSE p END AS probability FROM (SELECT *, sum(p) OVER (PARTITION BY weights) AS total FROM w)"""


def quality_draw(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = sampling.quality(F.col("codec"), draws.unit(SEED, "quality", F.col("chunk_no")), GAPPED_CODECS)
    return codec_pick(spark, sf_dir).withColumn("quality", q)


_QUALITY = f"(lo + floor({sql.unit('quality', 'chunk_no')} * (hi - lo + 1))::BIGINT)"
QUALITY_DRAW = f"WITH {_PICKED} SELECT chunk_no, p.codec, {_QUALITY} AS quality FROM picked p JOIN codecs c ON p.codec = c.codec"


def encode_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codec, quality and preset of each clip."""
    u = draws.unit(SEED, "preset", F.col("chunk_no"))
    return quality_draw(spark, sf_dir).withColumn("preset", sampling.preset(F.col("codec"), u, GAPPED_CODECS))


_PRESET = f"""CASE p.codec WHEN 'h264' THEN {sql.choice("preset", "chunk_no", ["veryslow", "fast"])} WHEN 'h265' THEN {sql.choice("preset", "chunk_no", ["medium", "slow", "veryslow"])}
  WHEN 'av1' THEN {sql.randint("preset", "chunk_no", 2, 8)}::VARCHAR END"""
_PLAN = f"SELECT chunk_no, p.codec, {_QUALITY} AS quality, {_PRESET} AS preset FROM picked p JOIN codecs c ON p.codec = c.codec"
ENCODE_PLAN = f"WITH {_PICKED} {_PLAN}"


def codec_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encoder options of each clip; the group of pictures is two seconds."""
    df = encode_plan(spark, sf_dir)
    return df.select("chunk_no", sampling.encoder_options(F.col("codec"), F.col("quality"), F.col("preset")).alias("options"))


CODEC_PARAMS = f"""WITH {_PICKED}, plan AS ({_PLAN}) SELECT chunk_no, 'fps_mode=cfr pix_fmt=yuv420p g=60 colorspace=bt709 vcodec=' || CASE codec
  WHEN 'h264' THEN 'libx264 crf=' || quality || ' preset=' || preset WHEN 'h265' THEN 'libx265 crf=' || quality || ' preset=' || preset
  WHEN 'vp9' THEN 'libvpx-vp9 crf=' || quality || ' b=0' WHEN 'av1' THEN 'libsvtav1 crf=' || quality || ' preset=' || preset ELSE 'mpeg2video b=' || quality || 'k' END AS options FROM plan"""


def first_working(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The working encoder of the highest priority on each of some machines (suppliers)."""
    tried = adapters.table(spark, sf_dir, "supplier").select("s_suppkey", F.posexplode(F.array(*map(F.lit, ["hevc_nvenc", "ffv1", "libx264"]))).alias("priority", "encoder"))
    works = (F.col("s_suppkey") + F.col("priority")) % 3 != 0
    return tried.where(works).groupBy("s_suppkey").agg(F.min_by("encoder", "priority").alias("encoder"))


FIRST_WORKING = """WITH e(priority, encoder) AS (VALUES (0, 'hevc_nvenc'), (1, 'ffv1'), (2, 'libx264'))
SELECT s_suppkey, min_by(encoder, priority) AS encoder FROM supplier, e WHERE (s_suppkey + priority) % 3 <> 0 GROUP BY s_suppkey"""


def batch_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of a batch."""
    df = adapters.table(spark, sf_dir, "labels")
    return df.agg(F.count("*").alias("total"), F.count_if(F.col("quality") == 1).alias("successes"), F.count_if(F.col("quality") == 0).alias("failures"))


BATCH_SUMMARY = "SELECT count(*) AS total, count(*) FILTER (quality = 1) AS successes, count(*) FILTER (quality = 0) AS failures FROM labels"


def batch_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = adapters.table(spark, sf_dir, "labels").where("quality = 0")
    return df.select(F.col("doc_id").alias("video"), F.lit("failed").alias("error"))


BATCH_FAILURES = "SELECT doc_id AS video, 'failed' AS error FROM labels WHERE quality = 0"

QUERIES = {
    "chunk_by_duration": chunk_by_duration, "chunk_by_count": chunk_by_count, "scene_detect": scene_detect, "scene_limit": scene_limit, "scene_spaced": scene_spaced,
    "chunk_by_scene": chunk_by_scene, "chunk_resume": chunk_resume, "bernoulli": bernoulli, "codec_pick": codec_pick, "weight_normalize": weight_normalize,
    "quality_draw": quality_draw, "encode_plan": encode_plan, "codec_params": codec_params, "first_working": first_working,
    "batch_summary": batch_summary, "batch_failures": batch_failures,
}
ORACLES = {
    "chunk_by_duration": CHUNK_BY_DURATION, "chunk_by_count": CHUNK_BY_COUNT, "scene_detect": SCENE_DETECT, "scene_limit": SCENE_LIMIT, "scene_spaced": SCENE_SPACED,
    "chunk_by_scene": CHUNK_BY_SCENE, "chunk_resume": CHUNK_RESUME, "bernoulli": BERNOULLI, "codec_pick": CODEC_PICK, "weight_normalize": WEIGHT_NORMALIZE,
    "quality_draw": QUALITY_DRAW, "encode_plan": ENCODE_PLAN, "codec_params": CODEC_PARAMS, "first_working": FIRST_WORKING,
    "batch_summary": BATCH_SUMMARY, "batch_failures": BATCH_FAILURES,
}
