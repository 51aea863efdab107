"""Queries through files: uncompressed video and images, written and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqforge.functions import names
from seqforge.operators import chunking, render, sequences, tiling
from seqforge.plans import render as plans
from seqforge.plans import sql
from seqforge.sources import adapters, images, kept, sinks, y4m

LENGTH, TILE = 2, 4
#: Least number of tasks that write tiles: executors may not have come yet when it is chosen.
WRITERS = 16


def _folder(spark: SparkSession, name: str) -> str:
    return f"{kept.shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def y4m_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The colour recordings as Y4M files, read back in ranges of two frames."""
    folder = _folder(spark, "y4m")
    y4m.write(plans._planes(spark, sf_dir), folder)
    back = y4m.read(spark, folder, split_bytes=220)
    video = names.stem(F.col("path")).cast("long").alias("video_id")
    return back.select(video, "frame_no", "width", "chroma_width", plans.text("y"), plans.text("u"), plans.text("v"))


Y4M_FRAMES = f"""SELECT video_id, (row_number() OVER (PARTITION BY video_id ORDER BY frame_no))::INTEGER AS frame_no, 8 AS width, 4 AS chroma_width, y, u, v FROM ({plans.PLANES_420})"""


def sequence_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequences of two frames and their blurred halves as PNG files under global names, read back as images."""
    folder = _folder(spark, "sequences")
    high = adapters.gapped_frames(spark, sf_dir).select(F.col("seq").alias("chunk_no"), F.col("frame_no").alias("src_frame"), "width", "height", "pixels")
    low = render.resized(high, F.lit(4), F.lit(4), "area")
    lengths = high.groupBy("chunk_no").agg(F.max("src_frame").alias("n"))
    starts = lengths.select("chunk_no", F.explode(sequences.full_starts(F.col("n"), LENGTH)).alias("start"))
    sinks.write_sequence_images(chunking.number_groups(starts, "chunk_no", "start", name="seq_id"), folder, high, low, LENGTH)
    side = F.element_at(F.split("path", "/"), -2).alias("side")
    return images.png_frames(spark, folder).select(side, "seq", "frame_no", "width", "height", plans.text())


SEQUENCE_IMAGES = f"""WITH {sql.FRAMES}, f AS (SELECT * FROM frames WHERE label <> 7), n AS (SELECT seq, max(frame_no) AS n FROM f GROUP BY seq),
s AS (SELECT seq, start, row_number() OVER (ORDER BY seq, start) AS id FROM (SELECT seq, unnest(range(1, n - {LENGTH - 2}, {LENGTH})) AS start FROM n)),
e AS (SELECT s.id, f.*, (f.frame_no - s.start + 1)::INTEGER AS no, count(*) OVER (PARTITION BY s.id) AS found FROM s JOIN f ON f.seq = s.seq AND f.frame_no BETWEEN s.start AND s.start + {LENGTH - 1}),
named AS (SELECT printf('show%05d', id) AS seq, no AS frame_no, pixels FROM e WHERE found = {LENGTH}),
small AS (SELECT seq, frame_no, x // 2 AS x, y // 2 AS y, (2 * sum(v) + 4)::BIGINT // 8 AS v FROM (SELECT seq, frame_no, i % 8 AS x, i // 8 AS y, v FROM (SELECT *, unnest(pixels) AS v, unnest(range(64)) AS i FROM named)) GROUP BY ALL)
SELECT 'hr' AS side, seq, frame_no, 8 AS width, 8 AS height, array_to_string(pixels, ',') AS pixels FROM named
UNION ALL SELECT 'lr', seq, frame_no, 4, 4, string_agg(v::VARCHAR, ',' ORDER BY y, x) FROM small GROUP BY seq, frame_no"""


def tile_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four tiles of every frame as PNG files of their own shows, read back as images. Vectors are dealt anew, as a table of few large files gives few tasks."""
    folder = _folder(spark, "tiles")
    frames = adapters.frames_of(adapters.table(spark, sf_dir, "embeddings").repartition(max(WRITERS, 2 * spark.sparkContext.defaultParallelism)))
    grid = tiling.grid(spark.createDataFrame([(8, 8)], "width int, height int"), TILE, TILE).select("x", "y", "tile_idx")
    tiles = tiling.cut(frames.crossJoin(F.broadcast(grid)), TILE, TILE)  # four rows
    show = (F.col("seq") * 4 + F.col("tile_idx") + 1).alias("show")
    sinks.write_tile_images(tiles.select(show, "frame_no", F.lit(TILE).alias("width"), F.lit(TILE).alias("height"), "tile_pixels"), folder)
    return images.png_frames(spark, folder).select("seq", "frame_no", "width", "height", plans.text())


TILE_IMAGES = f"""WITH {sql.FRAMES}, p AS (SELECT seq, frame_no, i % 8 AS x, i // 8 AS y, v FROM (SELECT seq, frame_no, unnest(pixels) AS v, unnest(range(64)) AS i FROM frames))
SELECT printf('show%05d', seq * 4 + (y // {TILE}) * 2 + x // {TILE} + 1) AS seq, frame_no, {TILE} AS width, {TILE} AS height, string_agg(v::VARCHAR, ',' ORDER BY y, x) AS pixels FROM p
GROUP BY seq, frame_no, y // {TILE}, x // {TILE}"""

QUERIES = {"y4m_frames": y4m_frames, "sequence_images": sequence_images, "tile_images": tile_images}
ORACLES = {"y4m_frames": Y4M_FRAMES, "sequence_images": SEQUENCE_IMAGES, "tile_images": TILE_IMAGES}
