"""The steps of a run, by settings."""

import pytest

from seqforge.operators import pipeline
from seqforge.sources.config import ConfigError, Settings


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


@pytest.fixture(scope="module")
def videos(spark):
    return spark.createDataFrame([(1, 100, 4.0, 25.0), (2, None, 2.0, 25.0), (3, None, None, 25.0)], "video_id long, nb_frames long, duration double, fps double")


def test_split_by_duration_and_count(videos):
    got = rows(pipeline.split(videos, None, Settings(chunk_duration=3), 7), "video_id", "start_frame", "end_frame", "chunk_no")
    assert got == [(1, 0, 75, 8), (1, 75, 100, 9), (2, 0, 50, 10)]
    got = rows(pipeline.split(videos, None, Settings(chunk_strategy="frame_count", frames_per_chunk=60)), "video_id", "start_frame", "end_frame", "chunk_no")
    assert got == [(1, 0, 60, 1), (1, 60, 100, 2), (2, 0, 50, 3)]


def test_split_by_scene_drops_short_scenes(spark, videos):
    signal = spark.createDataFrame([(1, f, 50.0 if f in (30, 40) else 1.0) for f in range(100)], "video_id long, frame_no long, score double")
    s = Settings(chunk_strategy="scene_detection", scene_threshold=27.0, min_chunk_duration=1)
    assert rows(pipeline.split(videos, signal, s), "start_frame", "end_frame", "chunk_no") == [(0, 30, 1), (40, 100, 2)]
    with pytest.raises(ConfigError):
        pipeline.split(videos, None, s)
    with pytest.raises(ConfigError):
        pipeline.split(videos, None, Settings(chunk_strategy="?"))


def test_extract_modes(spark):
    pairs = spark.createDataFrame([(4, 24, 22, 10.0, [0, 9, 17]), (9, 4, 30, 10.0, [0])], "chunk_no long, hr_frames long, lr_frames long, fps double, scene_starts array<long>")
    got = lambda **k: rows(pipeline.extract(pairs, Settings(sequence_length=5, **k), 3), "seq_id", "chunk_no", "start")
    assert got(extract_full_chunks=True) == [(4, 4, 1), (5, 4, 6), (6, 4, 11), (7, 4, 16)]
    assert got(extract_full_chunks=True, max_sequences=2) == [(4, 4, 1), (5, 4, 16)]
    assert got(time_gap=0.3) == [(4, 4, 1), (5, 4, 9), (6, 4, 17)]
    assert got(use_scene_detection=True, extract_full_chunks=True) == [(4, 4, 1), (5, 4, 10)]


def test_curate_keeps_pairs_together(spark):
    flat, busy = [5] * 16, [0, 255] * 8
    frames = spark.createDataFrame([(1, f, 4, 4, busy) for f in (1, 2)] + [(2, f, 4, 4, flat) for f in (1, 2)] + [(3, 1, 4, 4, busy)], "seq long, frame_no int, width int, height int, pixels array<int>")
    low = spark.createDataFrame([(s, f) for s in (1, 2, 3, 4) for f in (1, 2)], "seq long, frame_no int")
    judged, astray = pipeline.curate(frames, low, Settings(sequence_length=2, min_blank_frames=2))
    assert rows(judged, "seq", "status", "reason")[0][:2] == (1, "kept")
    assert {r.seq: r.reason for r in judged.collect()} == {1: None, 2: "blank", 3: "incomplete"}
    assert rows(astray, "seq", "frame_no") == [(s, f) for s in (2, 3, 4) for f in (1, 2)]


def test_summary(spark):
    df = spark.createDataFrame([("a", True, None), ("b", False, "x")], "video string, success boolean, error string")
    assert tuple(pipeline.summary(df).first()) == (2, 1, 1)
