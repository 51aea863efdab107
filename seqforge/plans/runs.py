"""Queries on whole steps of a run: strategies, isolation, logs, listings, quarantine, tiles of paired sequences."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqforge.functions import media, names
from seqforge.operators import pipeline, quality, render
from seqforge.plans import degradations, frames, sequences, sql
from seqforge.sources import adapters, images, kept, shared_files
from seqforge.sources.config import Settings

#: Settings of the test run: chunks of three seconds or fifty frames; tiles of four pixels, windows of three frames.
SPLIT = {"duration": Settings(chunk_duration=3), "frame_count": Settings(chunk_strategy="frame_count", frames_per_chunk=50)}
TILES = Settings(tile_width=4, tile_height=4, sequence_length=3, seed=7)


def _folder(spark: SparkSession, name: str) -> str:
    return f"{kept.shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _videos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clips as videos, of which every third states a duration instead of a number of frames."""
    stated = F.col("chunk_no") % 3 != 0
    length = (F.col("n_frames") / F.col("fps")).alias("duration")
    return adapters.clips(spark, sf_dir).select(F.col("chunk_no").alias("video_id"), F.when(stated, F.col("n_frames")).alias("nb_frames"), length, "fps")


def split_strategies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All videos cut by the strategies that need no signal, with global chunk numbers after 40 existing ones."""
    cut = [pipeline.split(_videos(spark, sf_dir), None, s, 40).withColumn("strategy", F.lit(name)) for name, s in SPLIT.items()]
    return cut[0].unionByName(cut[1])


SPLIT_STRATEGIES = f"""WITH {sql.CLIPS}, v AS (SELECT chunk_no AS video_id, CASE WHEN chunk_no % 3 <> 0 THEN n_frames ELSE trunc((n_frames / fps) * fps)::BIGINT END AS total, trunc(3 * fps)::BIGINT AS step FROM clips),
r AS (SELECT 'duration' AS strategy, video_id, total, step, unnest(range(0, total, step)) AS start_frame FROM v UNION ALL SELECT 'frame_count', video_id, total, 50, unnest(range(0, total, 50)) FROM v)
SELECT strategy, video_id, start_frame, least(start_frame + step, total) AS end_frame, 40 + row_number() OVER (PARTITION BY strategy ORDER BY video_id, start_frame) AS chunk_no FROM r"""


def attempted_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Work on every clip that fails for some of them: the failure is a result and stops no other."""

    def work(row: dict) -> None:
        if row["chunk_no"] % 13 == 0:
            raise ValueError(f"no frames in {row['chunk_no']}")

    return pipeline.attempted(adapters.clips(spark, sf_dir).select("chunk_no", "n_frames"), work)


ATTEMPTED_CHUNKS = f"""WITH {sql.CLIPS} SELECT chunk_no, n_frames, chunk_no % 13 <> 0 AS success, CASE WHEN chunk_no % 13 = 0 THEN 'ValueError: no frames in ' || chunk_no END AS error FROM clips"""


def chunk_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines that are logged of every chunk."""
    done = adapters.table(spark, sf_dir, "labels").select(F.col("doc_id").alias("chunk_no"), (F.col("quality") == 1).alias("success"), F.when(F.col("toxic") == 1, "encoder").alias("error"))
    return pipeline.chunk_log(done)


CHUNK_LOG = """WITH d AS (SELECT doc_id AS chunk_no, printf('chunk_%04d.mkv', doc_id) AS name, quality = 1 AS success, CASE WHEN toxic = 1 THEN 'encoder' ELSE '' END AS error FROM labels)
SELECT chunk_no, 0 AS line_no, 'Processing: ' || name AS line FROM d UNION ALL SELECT chunk_no, 1, CASE WHEN success THEN 'Complete: ' || name ELSE 'Failed: ' || name || ': ' || error END FROM d"""


def second_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second way to read a probe's JSON, of every part."""
    df = adapters.geometry(spark, sf_dir)
    stream = F.struct(F.when(F.col("id") % 5 == 0, "audio").otherwise("video").alias("codec_type"), F.lit("h264").alias("codec_name"), F.col("frame_rate").alias("r_frame_rate"), "width", "height", F.when(F.col("id") % 3 == 0, F.col("id").cast("string")).alias("nb_frames"))
    text = F.to_json(F.struct(F.struct(F.lit("12.5").alias("duration")).alias("format"), F.array(stream).alias("streams")))
    return df.select("id", media.sequence_probe(text).alias("p")).where("p IS NOT NULL").select("id", "p.duration", F.col("p.width").cast("long").alias("width"), "p.fps", "p.codec", "p.nb_frames")


SECOND_PROBE = f"""WITH {sql.GEOMETRY} SELECT id, 12.5::DOUBLE AS duration, width, coalesce({degradations._RATE}, 0.0::DOUBLE) AS fps, 'h264' AS codec, CASE WHEN id % 3 = 0 THEN id ELSE 0 END::BIGINT AS nb_frames FROM geometry WHERE id % 5 <> 0"""


def tile_naming(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prefix and digits that tiles of each hundred conversations are named after, from the first name of all."""
    return images.tile_naming(sequences._names(spark, sf_dir))


TILE_NAMING = rf"""WITH {sequences._NAMES}, t AS (SELECT filename, regexp_extract(filename, '^(.*?)(\d+)_[fF]rame(\d+)\.[A-Za-z]+$', ['prefix', 'number', 'frame']) AS g FROM n
  WHERE regexp_matches(filename, '^(.*?)(\d+)_[fF]rame(\d+)\.[A-Za-z]+$') AND regexp_matches(filename, '(?i)\.(png|jpg|jpeg|bmp|tiff)$'))
SELECT arg_min(g.prefix, filename) AS prefix, length(arg_min(g.number, filename))::INTEGER AS digits FROM t"""


def _written(spark: SparkSession, name: str, rows: DataFrame) -> str:
    folder = _folder(spark, name)
    shared_files.write_files(rows, folder)
    return folder


def relative_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file for every page in folders of folders, listed by its path below the folder that holds it."""
    name = F.concat(F.lit("host"), (F.col("page_id") % 7).cast("string"), F.lit("/p"), (F.col("page_id") % 3).cast("string"), F.lit("/"), F.col("page_id").cast("string"), F.lit(".html"))
    folder = _written(spark, "pages", adapters.table(spark, sf_dir, "pages").select(name.alias("name"), F.coalesce("html", F.lit("")).cast("binary").alias("content")))
    base = folder.split(":", 1)[-1]
    return images.relative(images.listing(spark, folder, recursive=True), base).select(F.regexp_replace("rel_path", "^/?part-[^/]*/", "").alias("rel_path"))


RELATIVE_FILES = "SELECT 'host' || page_id % 7 || '/p' || page_id % 3 || '/' || page_id || '.html' AS rel_path FROM pages"


def chunk_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A chunk file for every supplier and some that are none, listed with their degraded twins' paths."""
    suppliers = adapters.table(spark, sf_dir, "supplier")
    name = F.format_string("chunk_%04d.%s", "s_suppkey", F.when(F.col("s_suppkey") % 4 == 0, "txt").when(F.col("s_suppkey") % 4 == 1, "mp4").otherwise("mkv"))
    folder = _written(spark, "chunks", suppliers.select(name.alias("name"), F.lit(b"x").alias("content")))
    found = images.existing_chunks(spark, f"{folder}/*", "/low/")
    return found.select(names.basename(F.col("hr_path")).alias("basename"), "lr_path")


CHUNK_FOLDER = """WITH f AS (SELECT printf('chunk_%04d.', s_suppkey) || CASE s_suppkey % 4 WHEN 0 THEN 'txt' WHEN 1 THEN 'mp4' ELSE 'mkv' END AS basename, s_suppkey AS k FROM supplier)
SELECT basename, '/low/' || basename AS lr_path FROM f WHERE k % 4 <> 0"""


def quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts of all sequences in a folder for each status, read back."""
    folder = _folder(spark, "verdicts")
    quality.quarantined(frames.quality_pipeline(spark, sf_dir), folder)
    return spark.read.parquet(folder).select("seq", "reason", "status")


QUARANTINE = f"SELECT seq, reason, status FROM ({frames.QUALITY_PIPELINE})"


def _tile_text() -> Column:
    return F.array_join("tile_pixels", ",").alias("pixels")


def tiled_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of three frames times the shuffled tiles of paired sequences, both sides."""
    high = adapters.gapped_frames(spark, sf_dir).select("seq", "frame_no", "width", "height", "pixels")
    low = render.resized(high, F.lit(4), F.lit(4), "area")
    sides = [side.select(F.col("show").alias("show_no"), "frame_no", F.lit(name).alias("side"), "width", "height", _tile_text()) for name, side in zip(("hr", "lr"), pipeline.tiled(high, low, TILES), strict=True)]
    return sides[0].unionByName(sides[1])


TILED_PAIRS = f"""WITH {sql.FRAMES}, f AS (SELECT *, row_number() OVER (PARTITION BY seq ORDER BY frame_no) - 1 AS p, count(*) OVER (PARTITION BY seq) AS n FROM frames WHERE label <> 7),
scene AS (SELECT seq, any_value(n) AS n FROM f GROUP BY seq HAVING any_value(n) >= 3), first AS (SELECT seq, n, 1 + coalesce(sum((n - 2) * 4) OVER (ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS first_show FROM scene),
place AS (SELECT seq, first_show, n, x, y, row_number() OVER (PARTITION BY seq ORDER BY md5(concat_ws('|', '7', seq, x, y)), y, x) - 1 AS tile FROM first, (VALUES (0), (4)) a(x), (VALUES (0), (4)) b(y)),
shown AS (SELECT (first_show + w * 4 + tile)::BIGINT AS show_no, (f.p - w + 1)::INTEGER AS frame_no, q.x, q.y, f.pixels FROM place q JOIN range(8) t(w) ON w <= q.n - 3 JOIN f ON f.seq = q.seq AND f.p BETWEEN w AND w + 2),
cell AS (SELECT show_no, frame_no, i % 8 - x AS cx, i // 8 - y AS cy, v FROM (SELECT *, unnest(pixels) AS v, unnest(range(64)) AS i FROM shown) WHERE i % 8 BETWEEN x AND x + 3 AND i // 8 BETWEEN y AND y + 3),
half AS (SELECT show_no, frame_no, cx // 2 AS cx, cy // 2 AS cy, (2 * sum(v) + 4)::BIGINT // 8 AS v FROM cell GROUP BY ALL)
SELECT show_no, frame_no, 'hr' AS side, 4 AS width, 4 AS height, string_agg(v::VARCHAR, ',' ORDER BY cy, cx) AS pixels FROM cell GROUP BY show_no, frame_no
UNION ALL SELECT show_no, frame_no, 'lr', 2, 2, string_agg(v::VARCHAR, ',' ORDER BY cy, cx) FROM half GROUP BY show_no, frame_no"""

QUERIES = {
    "split_strategies": split_strategies,
    "attempted_chunks": attempted_chunks,
    "chunk_log": chunk_log,
    "second_probe": second_probe,
    "tile_naming": tile_naming,
    "relative_files": relative_files,
    "chunk_folder": chunk_folder,
    "quarantine": quarantine,
    "tiled_pairs": tiled_pairs,
}
ORACLES = {name: globals()[name.upper()] for name in QUERIES}
