"""The three steps of a run, from settings: split into chunks, extract sequences, curate them.

Each is a function from tables to tables; writing is left to the caller, so a step can be
repeated without touching what another wrote.
"""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqforge.functions import media, names, pixels
from seqforge.operators import chunking, quality, sequences, tiling
from seqforge.sources import images, sinks
from seqforge.sources.config import ConfigError, Settings

log = logging.getLogger(__name__)


def split(videos: DataFrame, signal: DataFrame | None, s: Settings, existing: int = 0) -> DataFrame:
    """video_id, start_frame, end_frame, chunk_no by the settings' strategy.

    ``videos``: video_id (integer), nb_frames, duration, fps. ``signal`` (video_id, frame_no,
    score) is needed for scenes only. Numbers continue after ``existing``.
    """
    total = chunking.total_frames(F.col("nb_frames"), F.col("duration"), F.col("fps"))
    if s.chunk_strategy == "duration":
        chunks = chunking.by_duration(videos, s.chunk_duration, total, F.col("fps"))
    elif s.chunk_strategy == "frame_count":
        chunks = chunking.by_step(videos, total, F.lit(s.frames_per_chunk).cast("long"))
    elif s.chunk_strategy == "scene_detection":
        if signal is None:
            raise ConfigError("scenes need a signal")
        found = chunking.scenes(signal, s.scene_threshold, s.max_scenes).join(videos.select("video_id", "fps"), "video_id")
        chunks = chunking.keep_long(found, (F.lit(float(s.min_chunk_duration)) * F.col("fps")).cast("long"))
    else:
        raise ConfigError(f"unknown chunk strategy {s.chunk_strategy}")
    numbered = chunking.number_groups(chunks, "video_id", "start_frame", F.lit(existing))
    return numbered.select("video_id", "start_frame", "end_frame", "chunk_no")


def extract(pairs: DataFrame, s: Settings, existing: int = 0) -> DataFrame:
    """seq_id, chunk_no, start of the sequences of paired chunks: chunk_no, hr_frames, lr_frames, fps, and scene_starts for scenes.

    Scenes go before full chunks, full chunks before gaps; each chunk gives at most ``max_sequences``, evenly spread.
    """
    n = F.least("hr_frames", "lr_frames")
    if s.use_scene_detection:
        starts = sequences.scene_starts(F.col("scene_starts"), n, s.sequence_length)
    elif s.extract_full_chunks:
        starts = sequences.full_starts(n, s.sequence_length)
    else:
        starts = sequences.gap_starts(n, s.sequence_length, F.col("fps"), s.time_gap, s.frame_skip)
    rows = pairs.select("chunk_no", F.explode(sequences.thinned(starts, s.max_sequences)).alias("start"))
    return chunking.number_groups(rows, "chunk_no", "start", F.lit(existing), name="seq_id").select("seq_id", "chunk_no", "start")


def curate(frames: DataFrame, low: DataFrame, s: Settings) -> tuple[DataFrame, DataFrame]:
    """Verdicts of the sequences, and the degraded frames (seq, frame_no) that have to go with the rejected ones."""
    least, most = (s.min_motion, s.max_motion) if s.motion_detection else (-1, -1)
    judged = quality.verdicts(frames, s.edge_threshold, s.variance_threshold, s.min_blank_frames, least, most, s.sequence_length, s.motion_threshold)
    kept = frames.select("seq", "frame_no").join(judged.where("status = 'kept'"), "seq", "left_semi")
    return judged, low.join(kept, ["seq", "frame_no"], "left_anti")


def attempted(rows: DataFrame, work: Callable[[dict], None]) -> DataFrame:
    """``rows`` with success and error: ``work`` is called for each row on the executors, and a row whose call fails stops no other."""

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            errors = []
            for row in batch.to_dict("records"):
                try:
                    work(row)
                    errors.append(None)
                except Exception as error:  # the point of this operator: the error is the result
                    errors.append(f"{type(error).__name__}: {error}")
            yield batch.assign(success=[e is None for e in errors], error=pd.Series(errors, dtype=object, index=batch.index))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInPandas(task, f"{schema}, success boolean, error string")


def videos(spark: SparkSession, s: Settings, probes: DataFrame) -> DataFrame:
    """video_id, path, nb_frames, duration, fps of the input's videos: a file's, or all of a folder. ``probes``: path, json (a prober's output).

    Videos are numbered from 1 in the order of their paths.
    """
    files = images.inputs(spark, s.input)
    if files.isEmpty():
        raise ConfigError(f"no video in {s.input}")
    stream, one = media.video_stream(F.col("json")), F.lit(1).cast("long")
    files = tiling.numbered(files.select("path", one.alias("_n"), one.alias("_k")), "path", "_n", "_k", "video_id")
    return files.join(probes, "path").select(
        "video_id",
        "path",
        stream["nb_frames"].try_cast("long").alias("nb_frames"),
        F.from_json("json", media.PROBE_SCHEMA)["format"]["duration"].try_cast("double").alias("duration"),
        media.fps(stream["r_frame_rate"], stream["avg_frame_rate"]).alias("fps"),
    )


def run(spark: SparkSession, s: Settings, probes: DataFrame, encode: Callable[[dict], None], signal: DataFrame | None = None, existing: int = 0) -> tuple[DataFrame, DataFrame]:
    """A batch from settings: every chunk with success and error, and the summary over videos (a video fails if none of its chunks succeeds).

    ``encode`` makes the files of one chunk (a dict of path, start_frame, end_frame, chunk_no, ...) with whatever encoder the cluster has.
    The chunks are kept by ``persist``; what a lost executor held is encoded again, so ``encode`` has to allow that.
    """
    found = videos(spark, s, probes)
    chunks = split(found, signal, s, existing).join(found.select("video_id", "path", "fps"), "video_id")
    log.info("encoding chunks of %s", s.input)
    done = attempted(chunks, encode).persist()
    per_video = done.groupBy("video_id").agg(F.bool_or("success").alias("success"), F.first("error", ignorenulls=True).alias("error"))
    counted = summary(per_video)
    if not done.where("success").isEmpty():
        log.info("chunks done")
    else:
        log.warning("no chunk was encoded")
    return done, counted


def summary(results: DataFrame) -> DataFrame:
    """total, successes, failures of a batch (video, success, error)."""
    return results.agg(F.count("*").alias("total"), F.count_if(F.col("success")).alias("successes"), F.count_if(~F.col("success")).alias("failures"))


def chunk_log(done: DataFrame) -> DataFrame:
    """chunk_no, line_no, line: what is logged of every chunk, when it starts and when it is complete or why it failed."""
    name = names.chunk_name(F.col("chunk_no"))
    ended = F.when(F.col("success"), F.concat(F.lit("Complete: "), name)).otherwise(F.concat(F.lit("Failed: "), name, F.lit(": "), F.coalesce("error", F.lit(""))))
    lines = F.posexplode(F.array(F.concat(F.lit("Processing: "), name), ended)).alias("line_no", "line")
    return done.select("chunk_no", lines)


def sequence_frames(frames: DataFrame, rows: DataFrame, length: int) -> DataFrame:
    """Frames (chunk_no, src_frame, ...) of sequences (seq_id, chunk_no, start), as seq and frame_no."""
    wanted = sequences.expanded(rows, length).select(F.col("seq_id").alias("seq"), "frame_no", "chunk_no", "src_frame")
    return wanted.join(frames, ["chunk_no", "src_frame"]).drop("chunk_no", "src_frame")


def tiled(high: DataFrame, low: DataFrame, s: Settings) -> tuple[DataFrame, DataFrame]:
    """Tiles of paired sequences (seq, frame_no, width, height, pixels), both sides as show, frame_no, width, height, tile_pixels.

    Every window of the settings' length gives a show for each tile; a degraded tile is the same part of
    its frame. Windows times tiles are made of metadata; pixels are attached last. Sequences
    shorter than a window or smaller than a tile give nothing.
    """
    length = s.sequence_length
    scenes = high.groupBy("seq").agg(F.count("*").alias("_n"), F.min("width").alias("width"), F.min("height").alias("height"))
    scenes = scenes.withColumns({"n_windows": F.col("_n") - length + 1, "n_tiles": F.floor(F.col("width") / s.tile_width) * F.floor(F.col("height") / s.tile_height)})
    numbered = tiling.numbered(scenes.where("n_windows > 0 AND n_tiles > 0"), "seq", "n_windows", "n_tiles")
    places = tiling.shuffled(tiling.grid(numbered.select("seq", "width", "height"), s.tile_width, s.tile_height), "seq", s.seed).select("seq", "x", "y", "tile_idx")
    windows = tiling.windows(high.select("seq", "frame_no"), "seq", "frame_no", length)
    shows = windows.join(numbered.select("seq", "first_show", "n_tiles", F.col("width").alias("_w"), F.col("height").alias("_h")), "seq").join(places, "seq")
    shows = shows.withColumn("show", F.col("first_show") + F.col("window_no") * F.col("n_tiles") + F.col("tile_idx"))
    sides = []
    for side in (high, low):
        part = {"_x": (F.col("x"), "_w", "width"), "_y": (F.col("y"), "_h", "height"), "_tw": (F.lit(s.tile_width), "_w", "width"), "_th": (F.lit(s.tile_height), "_h", "height")}
        placed = shows.join(side, ["seq", "frame_no"]).withColumns({name: (v * F.col(own) / F.col(full)).cast("int") for name, (v, full, own) in part.items()})
        cut = placed.withColumn("tile_pixels", pixels.crop(F.col("pixels"), F.col("width"), *map(F.col, part)))
        sides.append(cut.select("show", (F.col("offset") + 1).cast("int").alias("frame_no"), F.col("_tw").alias("width"), F.col("_th").alias("height"), "tile_pixels"))
    return sides[0], sides[1]


def finish(high: DataFrame, low: DataFrame, fps: float, s: Settings, folder: str, existing: int = 0) -> DataFrame:
    """What follows the chunks, by the settings: sequences as images below ``folder/sequences``, and with post-processing their tiles, judged, below ``folder/tiles``.

    ``high`` and ``low``: decoded frames (chunk_no, src_frame, width, height, pixels) of paired chunks. Gives the
    verdicts: seq (the show of a tile, or the sequence), status and reason; without post-processing
    every sequence is kept. Degraded tiles without their kept twin go.
    """
    counted = [side.groupBy("chunk_no").agg(F.max("src_frame").alias(name)) for side, name in ((high, "hr_frames"), (low, "lr_frames"))]
    pairs = counted[0].join(counted[1], "chunk_no").withColumn("fps", F.lit(float(fps)))
    rows = extract(pairs, s, existing)
    sinks.write_sequence_images(rows, f"{folder}/sequences", high, low, s.sequence_length)
    sides = [sequence_frames(side, rows, s.sequence_length) for side in (high, low)]
    if not s.post_processing:
        return rows.select(F.col("seq_id").alias("seq"), F.lit("kept").alias("status"), F.lit(None).cast("string").alias("reason"))
    if s.tiling:
        tiles = [side.withColumnsRenamed({"show": "seq", "tile_pixels": "pixels"}) for side in tiled(*sides, s)]
    else:
        tiles = sides
    judged, orphans = curate(*tiles, s)
    kept = tiles[0].join(judged.where("status = 'kept'"), "seq", "left_semi")
    paired = tiles[1].join(orphans.select("seq", "frame_no"), ["seq", "frame_no"], "left_anti")
    for name, side in (("hr", kept), ("lr", paired)):
        sinks.write_tile_images(side.select(F.col("seq").alias("show"), "frame_no", "width", "height", F.col("pixels").alias("tile_pixels")), f"{folder}/tiles/{name}")
    return judged.select("seq", "status", "reason")
