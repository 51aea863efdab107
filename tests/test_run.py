"""Settings, inputs, sinks and a whole run."""

import json

import pytest

from seqforge.operators import pipeline
from seqforge.sources import config, images, sinks
from seqforge.sources.config import ConfigError, Settings


def test_paths_are_normalised_and_ranges_checked():
    s = config.settings({"input": "a//b/../c.mp4", "frame_extraction": {"output_directory": "x/./y"}, "logging": {"directory": 3}}, strict=False)
    assert (s.input, s.output_directory, s.logging_directory) == ("a/c.mp4", "x/y", "")
    entry = lambda value: {"name": "resize", "enabled": True, "probability": 1, "params": {"down_up_range": value}}
    assert config.degradation(entry([0.2, 0.4])).params.down_up_range == (0.2, 0.4)
    for bad in ([1], 3, [1, 2, 3]):
        with pytest.raises(ConfigError):
            config.degradation(entry(bad))
    codec = {"name": "codec", "enabled": True, "probability": 1, "params": {"h264": {"probability": 1, "quality_range": [20]}}}
    with pytest.raises(ConfigError):
        config.settings({"degradations": [codec]}, strict=False)


def test_loader_strict_about_the_file_only(tmp_path):
    with pytest.raises(OSError):
        config.load(str(tmp_path / "none.yaml"), strict=False, file_required=True)
    (tmp_path / "c.yaml").write_text("chunk_strategy: odd")
    assert config.load(str(tmp_path / "c.yaml"), strict=False, file_required=True).chunk_strategy == "odd"


def test_post_processing_overrides():
    s = config.post_processing(Settings(), no_tiling=True, tile_width=64, seed=0, min_motion=None)
    assert (s.post_processing, s.tiling, s.motion_detection, s.tile_width, s.seed, s.min_motion) == (True, False, True, 64, 0, -1)


def test_chunks_of_a_folder_and_tile_names(spark, tmp_path):
    with pytest.raises(ConfigError):
        images.existing_chunks(spark, str(tmp_path), "/low")
    for name in ("chunk_0002.mkv", "x.txt"):
        (tmp_path / name).write_bytes(b"1")
    assert [r.lr_path for r in images.existing_chunks(spark, str(tmp_path), "/low/").collect()] == ["/low/chunk_0002.mkv"]
    files = spark.createDataFrame([("show012_Frame1.png",), ("clip00001_frame2.png",), ("a.txt",)], "filename string")
    assert tuple(images.tile_naming(files).first()) == ("clip", 5)
    assert tuple(images.tile_naming(files.limit(0)).first()) == (None, None)


def test_second_probe(spark):
    from pyspark.sql import functions as F

    from seqforge.functions import media

    stream = {"codec_type": "video", "codec_name": "h264", "r_frame_rate": "30/0", "width": 4, "height": 2}
    rows = [(json.dumps({"format": {"duration": "2.5"}, "streams": s}),) for s in ([{"codec_type": "audio"}, stream], [])]
    got = [r.p for r in spark.createDataFrame(rows, "j string").select(media.sequence_probe(F.col("j")).alias("p")).collect()]
    assert tuple(got[0]) == (2.5, 4, 2, 0.0, "h264", 0) and got[1] is None


def test_sinks(spark, tmp_path):
    chunks = spark.createDataFrame([(1,), (2,)], "chunk_no long")
    for existing, replace, n in ((0, False, 2), (2, True, 4), (0, True, 2)):
        sinks.write_chunks(chunks, str(tmp_path / "chunks"), existing, replace)
        assert spark.read.parquet(str(tmp_path / "chunks")).count() == n
    for _ in range(2):
        sinks.write_encodes(chunks, str(tmp_path / "encodes"))
    assert spark.read.parquet(str(tmp_path / "encodes")).count() == 2
    files = lambda side, last: spark.createDataFrame([(7, f, f"{side}/{f}.png") for f in range(1, last + 1)], "chunk_no long, src_frame long, path string")
    rows = spark.createDataFrame([(1, 7, 1), (2, 7, 3)], "seq_id long, chunk_no long, start long")
    sinks.write_sequences(rows, str(tmp_path / "seq"), files("h", 4), files("l", 3), 2)
    got = sorted((r.filename, r.hr_source, r.lr_source) for r in spark.read.parquet(str(tmp_path / "seq")).collect())
    assert got == [("show00001_Frame00001.png", "h/1.png", "l/1.png"), ("show00001_Frame00002.png", "h/2.png", "l/2.png")]
    sinks.write_tiles(spark.createDataFrame([(1, [1, 2]), (2500, [3])], "show long, tile_pixels array<int>"), str(tmp_path / "tiles"))
    assert {r.folder for r in spark.read.parquet(str(tmp_path / "tiles")).collect()} == {0, 2}


def test_run_from_settings(spark, tmp_path):
    for name in ("a.mp4", "b.MKV", "c.txt"):
        (tmp_path / name).write_bytes(b"1")
    probe = json.dumps({"format": {"duration": "4.0"}, "streams": [{"codec_type": "video", "r_frame_rate": "25/1", "nb_frames": "100"}]})
    probes = spark.createDataFrame([(f"file:{tmp_path}/{n}", probe) for n in ("a.mp4", "b.MKV", "c.txt")], "path string, json string")

    def encode(chunk):
        if chunk["path"].endswith("MKV") or chunk["start_frame"] == 75:
            raise ValueError("broken")

    done, counted = pipeline.run(spark, Settings(input=str(tmp_path), chunk_duration=1), probes, encode)
    assert sorted((r.path[-5:], r.start_frame, r.error) for r in done.collect() if not r.success) == [("a.mp4"[-5:], 75, "ValueError: broken"), *((("b.MKV"), f, "ValueError: broken") for f in (0, 25, 50, 75))]
    assert tuple(counted.first()) == (2, 1, 1)
    one, _ = pipeline.run(spark, Settings(input=f"{tmp_path}/a.mp4", chunk_duration=2), probes, lambda chunk: None)
    assert one.count() == 2 and one.where("success").count() == 2
    with pytest.raises(ConfigError):
        (tmp_path / "none").mkdir()
        pipeline.run(spark, Settings(input=f"{tmp_path}/none"), probes, encode)


def test_videos_are_numbered_densely_by_path(spark, tmp_path):
    for k in range(300):
        (tmp_path / f"v{k:03d}.mp4").write_bytes(b"1")
    probe = json.dumps({"format": {"duration": "4.0"}, "streams": [{"codec_type": "video", "r_frame_rate": "25/1"}]})
    probes = images.listing(spark, str(tmp_path)).selectExpr("path", f"'{probe}' AS json")
    got = sorted((r.path, r.video_id) for r in pipeline.videos(spark, Settings(input=str(tmp_path)), probes).collect())
    assert [v for _, v in got] == list(range(1, 301))


def test_a_folder_is_what_its_file_system_says(spark, tmp_path):
    dotted = tmp_path / "clips.2024"
    dotted.mkdir()
    for name in ("a.mp4", "b.txt"):
        (dotted / name).write_bytes(b"1")
    (tmp_path / "noext").write_bytes(b"1")
    names = lambda p: [r.path.rsplit("/", 1)[-1] for r in images.inputs(spark, str(p)).collect()]
    assert names(dotted) == ["a.mp4"] and names(tmp_path / "noext") == ["noext"] and names(dotted / "b.txt") == ["b.txt"]
    with pytest.raises(ConfigError, match="no such"):
        images.inputs(spark, str(tmp_path / "absent"))


def test_edges_of_null_sizes(spark):
    from pyspark.sql import functions as F

    from seqforge.functions import pixels

    rows = spark.createDataFrame([([0, 255, 0, 255], None, 2), ([0, 255, 0, 255], 2, None), (None, 2, 2), ([], 0, 0), ([0, 255, 0, 255], 2, 2)], "p array<int>, w int, h int")
    assert [r[0] for r in rows.select(pixels.edges(F.col("p"), F.col("w"), F.col("h"))).collect()] == [None, None, None, 0, 0]


def test_finish_writes_sequences_and_judged_tiles(spark, tmp_path):
    """One chunk that moves and one that stands still; the still one's tiles go, on both sides."""
    frame = lambda c, f: [(x * 37 + x * x * 11 + (f * 90 if c == 1 else 0)) % 256 for x in range(64)]
    schema = "chunk_no long, src_frame int, width int, height int, pixels array<int>"
    high = spark.createDataFrame([(c, f, 8, 8, frame(c, f)) for c in (1, 2) for f in range(1, 7)], schema)
    low = high.selectExpr("chunk_no", "src_frame", "4 AS width", "4 AS height", "slice(pixels, 1, 16) AS pixels")
    s = Settings(sequence_length=3, extract_full_chunks=True, post_processing=True, tile_width=4, tile_height=4, edge_threshold=0, variance_threshold=0, min_motion=5)
    judged = pipeline.finish(high, low, 25.0, s, str(tmp_path / "out"))
    got = {r.seq: (r.status, r.reason) for r in judged.collect()}
    assert len(got) == 16  # four sequences, one window of four tiles each
    assert {got[k] for k in range(1, 9)} == {("kept", None)} and {got[k] for k in range(9, 17)} == {("bad", "motion")}
    found = lambda part: {"/".join(str(p).split("/")[-2:]) for p in (tmp_path / "out" / part).rglob("*.png")}
    assert len(found("sequences")) == 24
    want = {f"0/show{k:05d}_Frame{f:05d}.png" for k in range(1, 9) for f in (1, 2, 3)}
    assert found("tiles/hr") == want == found("tiles/lr")
    plain = pipeline.finish(high, low, 25.0, Settings(sequence_length=3, extract_full_chunks=True), str(tmp_path / "plain"))
    assert sorted(tuple(r) for r in plain.collect()) == [(k, "kept", None) for k in (1, 2, 3, 4)] and not (tmp_path / "plain" / "tiles").exists()
