"""Y4M files at any split, images from tasks, commits in two phases."""

import random
import struct
import subprocess
import sys
import textwrap
import zlib

import pytest
from pyspark.sql import functions as F

from seqforge.functions import png
from seqforge.plans import files
from seqforge.sources import images, kept, shared_files, sinks, y4m

PLANES = "video_id long, frame_no int, width int, height int, y array<int>, u array<int>, v array<int>"


def plain_frames(data):
    """(y, u, v) of every whole frame, by a plain reader."""
    made = y4m.layout(data)
    at, out = made.head, []
    while (end := data.find(b"\n", at)) >= 0:
        parts, at = [], end + 1
        for n in made.planes:
            parts.append(list(data[at : at + n]))
            at += n
        if len(parts[-1]) == made.planes[-1]:
            out.append(parts)
    return out


def video(rng, head, planes, n, frame=b"FRAME\n"):
    return head + b"".join(frame + bytes(rng.randrange(256) for _ in range(planes)) for _ in range(n))


def read(spark, path, split):
    rows = y4m.read(spark, path, split).orderBy("path", "frame_no").collect()
    return [(r.path.rsplit("/", 1)[-1], r.frame_no, [p for p in (r.y, r.u, r.v) if p is not None]) for r in rows]


@pytest.mark.parametrize("split", [1, 40, 100, 1 << 20])
def test_y4m_equals_a_plain_reader_at_any_split(spark, tmp_path, split):
    """Odd sizes, all kinds of chroma, frame headers with parameters, an incomplete last frame, no frame at all, other files."""
    rng = random.Random(split)
    files = {
        "a.y4m": video(rng, b"YUV4MPEG2 W5 H3 F25:1 Ip A1:1 C420jpeg XYSCSS=420JPEG\n", 15 + 2 * 6, 9),
        "b.Y4M": video(rng, b"YUV4MPEG2 W4 H2 F30000:1001\n", 12, 4),
        "c.y4m": video(rng, b"YUV4MPEG2 W3 H2 C444\n", 18, 3),
        "d.y4m": video(rng, b"YUV4MPEG2 W3 H2 Cmono\n", 6, 5),
        "e.y4m": video(rng, b"YUV4MPEG2 W3 H2 C422\n", 6 + 2 * 4, 5)[:-3],
        "f.y4m": video(rng, b"YUV4MPEG2 W4 H2\n", 12, 3, b"FRAME Ip\n") + video(rng, b"", 12, 2),
        "g.y4m": b"YUV4MPEG2 W4 H2\n",
    }
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    (tmp_path / "other.txt").write_bytes(b"no video")
    want = [(name, k, parts) for name, data in sorted(files.items()) for k, parts in enumerate(plain_frames(data), 1)]
    assert read(spark, str(tmp_path), split) == want
    assert read(spark, f"{tmp_path}/a.y4m", split) == [w for w in want if w[0] == "a.y4m"]


def test_one_file_is_read_in_parallel(spark, tmp_path):
    (tmp_path / "a.y4m").write_bytes(video(random.Random(0), b"YUV4MPEG2 W4 H2\n", 12, 64))
    assert y4m.read(spark, f"{tmp_path}/a.y4m", 36).rdd.getNumPartitions() == 32


def test_many_small_ranges_share_tasks(spark, tmp_path, monkeypatch):
    """Files of frames of their own: no more tasks than the limit, each frame once and in order."""
    monkeypatch.setattr(y4m, "TASKS", 8)
    rng = random.Random(1)
    for k in range(50):
        (tmp_path / f"{k:02d}.y4m").write_bytes(video(rng, b"YUV4MPEG2 W4 H2\n", 12, 3))
    parts = y4m.Y4mReader(str(tmp_path), 18).partitions()
    assert len(parts) == 8 and max(len(p.ranges) for p in parts) <= 20
    assert [(r.path[-6:-4], r.first) for p in parts for r in p.ranges] == [(f"{k:02d}", f) for k in range(50) for f in (1, 2, 3)]
    want = [(f"{k:02d}.y4m", n, p) for k in range(50) for n, p in enumerate(plain_frames((tmp_path / f"{k:02d}.y4m").read_bytes()), 1)]
    assert read(spark, str(tmp_path), 18) == want


@pytest.mark.parametrize("data, message", [(b"RIFF", "not a Y4M"), (b"YUV4MPEG2 W4 H2 C420p10\n", "more than 8 bits"), (b"YUV4MPEG2 W4 H2 C411\n", "unknown chroma")])
def test_other_files_are_errors(data, message):
    with pytest.raises(ValueError, match=message):
        y4m.layout(data)


def test_y4m_round_trip(spark, tmp_path):
    rng = random.Random(3)
    rows = [(v, f, 5, 3, *[[rng.randrange(256) for _ in range(n)] for n in (15, 6, 6)]) for v in (1, 2) for f in (4, 1, 9)]
    y4m.write(spark.createDataFrame(rows, PLANES), str(tmp_path / "out"))
    back = read(spark, str(tmp_path / "out"), 50)
    want = [(f"{v}.y4m", k, list(r[4:])) for v in (1, 2) for k, r in enumerate(sorted(x for x in rows if x[0] == v), 1)]
    assert back == want


def test_png_survives_the_image_source(spark, tmp_path):
    rng = random.Random(5)
    gray, red = [[rng.randrange(256) for _ in range(12)] for _ in range(2)]
    rows = spark.createDataFrame([("a.png", 4, 3, gray, red), ("b.png", 4, 3, None, red), ("c.png", 0, 3, gray, red), ("d.png", 4, 4, gray, red)], "name string, width int, height int, p array<int>, q array<int>")
    both = rows.select("name", png.encoded(F.col("width"), F.col("height"), F.col("p")).alias("content")).unionByName(
        rows.select(F.concat(F.lit("rgb-"), "name").alias("name"), png.encoded(F.col("width"), F.col("height"), F.col("p"), F.col("q"), F.col("p")).alias("content"))
    )
    shared_files.write_files(both, str(tmp_path / "img"))
    got = {r.origin.rsplit("/", 1)[-1]: r for r in spark.read.format("image").option("recursiveFileLookup", True).load(str(tmp_path / "img")).select("image.*").collect()}
    assert set(got) == {"a.png", "rgb-a.png"}
    assert list(got["a.png"].data) == gray and got["a.png"].nChannels == 1
    assert list(got["rgb-a.png"].data) == [v for g, r in zip(gray, red, strict=True) for v in (g, r, g)]  # blue, green, red


def test_sequences_of_which_a_frame_is_missing_have_no_file(spark, tmp_path):
    side = lambda last: spark.createDataFrame([(7, f, 1, 1, [f]) for f in range(1, last + 1)], "chunk_no long, src_frame long, width int, height int, pixels array<int>")
    rows = spark.createDataFrame([(1, 7, 1), (2, 7, 3)], "seq_id long, chunk_no long, start long")
    sinks.write_sequence_images(rows, str(tmp_path / "seq"), side(4), side(3), 2)
    found = sorted("/".join(str(p).split("/")[-2:]) for p in (tmp_path / "seq").rglob("*.png"))
    assert found == [f"{s}/show00001_Frame0000{k}.png" for s in ("hr", "lr") for k in (1, 2)]
    sinks.write_tile_images(spark.createDataFrame([(1, 1, 1, 1, [5]), (2500, 1, 1, 1, [6])], "show long, frame_no int, width int, height int, tile_pixels array<int>"), str(tmp_path / "tiles"))
    assert {(r.seq, r.pixels[0]) for r in images.gray_frames(spark, str(tmp_path / "tiles"), recursive=True).collect()} == {("show00001", 5), ("show2500".replace("show", "show0"), 6)}


def png_file(width, height, lines, bits=8, colour=0, interlace=0):
    """A PNG of rows that are given with their filter bytes, with a comment and its data in two parts."""
    data = zlib.compress(lines)
    parts = [(b"IHDR", struct.pack(">IIBBBBB", width, height, bits, colour, 0, 0, interlace)), (b"tEXt", b"a\0b"), (b"IDAT", data[:5]), (b"IDAT", data[5:]), (b"IEND", b"")]
    return png.SIGNATURE + b"".join(struct.pack(">I", len(b)) + k + b + struct.pack(">I", zlib.crc32(k + b)) for k, b in parts)


def test_png_frames_equal_the_image_source(spark, tmp_path):
    """Gray and colour, rows stored in three ways, at several depths; files of other names and hidden ones are none."""
    rng = random.Random(9)
    (tmp_path / "a" / "b").mkdir(parents=True)
    (tmp_path / "_attempts").mkdir()
    for k, (folder, colour) in enumerate([(".", 0), ("a", 2), ("a/b", 0), ("a/b", 2), ("a/b", 2)]):
        n = 3 if colour else 1
        lines = b"".join(bytes([how]) + rng.randbytes(5 * n) for how in ([2] * 3 if k == 4 else [2, 0, 1, 2, 1][k : k + 1] + [1, 2]))
        (tmp_path / folder / f"show{k:05d}_Frame00001.{'PNG' if k == 2 else 'png'}").write_bytes(png_file(5, 3, lines, colour=colour))
    (tmp_path / "a" / "other_Frame00007.png").write_bytes(png_file(1, 1, b"\0\7"))
    for name in ("a/notes.txt", "_attempts/show00009_Frame00001.png", ".show00009_Frame00001.png"):
        (tmp_path / name).write_bytes(b"no image")
    rows = lambda df: sorted(map(repr, df.select("seq", "frame_no", "width", "height", "pixels").collect()))
    got = images.png_frames(spark, str(tmp_path))
    (tmp_path / "a" / "notes.txt").unlink()
    assert rows(got) == rows(images.gray_frames(spark, str(tmp_path), recursive=True)) and got.count() == 6
    assert {r.path.rsplit("/", 2)[1] for r in got.collect()} == {tmp_path.name, "a", "b"}


def test_no_png_at_all(spark, tmp_path):
    assert images.png_frames(spark, str(tmp_path)).collect() == []


GOOD = png_file(2, 1, b"\0\1\2")


@pytest.mark.parametrize(
    "data, message",
    [
        (b"RIFF", "not a PNG"),
        (GOOD[:-5], "breaks off"),
        (GOOD[:-20] + b"x" + GOOD[-19:], "wrong check sum"),
        (png_file(2, 1, b"\4\1\2"), "two neighbours"),
        (png_file(2, 1, b"\0\1\2\3\4", bits=16), "another kind"),
        (png_file(2, 1, b"\0\1\2", colour=3), "another kind"),
        (png_file(2, 1, b"\0\1\2", interlace=1), "another kind"),
        (png_file(2, 2, b"\0\1\2"), "reshape"),
    ],
)
def test_a_png_of_another_kind_is_an_error(spark, tmp_path, data, message):
    (tmp_path / "show00001_Frame00001.png").write_bytes(data)
    assert png.decoded(GOOD).tolist() == [[1, 2]]
    with pytest.raises(ValueError, match=message):
        png.decoded(data)
    with pytest.raises(Exception, match=f"show00001_Frame00001.png: .*{message}"):
        images.png_frames(spark, str(tmp_path)).collect()


def test_many_small_images_share_tasks(spark, tmp_path, monkeypatch):
    """2,000 tiles of one small table: several tasks write them, the driver is given no list of them, and a task reads many."""
    monkeypatch.setattr(kept, "shared_dir", lambda _: str(tmp_path))
    df = files.tile_images(spark, "/root/testdata/sf0.001")
    written = list(tmp_path.rglob("*.png"))
    assert len(written) == 2000 and len({p.relative_to(tmp_path).parts[1] for p in written}) > 1
    assert not [f for f in df.inputFiles() if f.endswith(".png")] and df.rdd.getNumPartitions() == 1
    monkeypatch.setattr(images, "FILES", 150)
    again = images.png_frames(spark, str(tmp_path))
    assert again.rdd.getNumPartitions() == 14 and again.select("seq", "frame_no").distinct().count() == df.count() == 2000


def test_overwrite_and_append(spark, tmp_path):
    one = lambda name: spark.createDataFrame([(name, bytearray(b"x"))], "name string, content binary")
    names = lambda: sorted(p.name for p in tmp_path.rglob("*") if p.is_file())
    shared_files.write_files(one("a"), str(tmp_path))
    shared_files.write_files(one("b"), str(tmp_path))
    assert names() == ["a", "b"]
    shared_files.write_files(one("c"), str(tmp_path), overwrite=True)
    assert names() == ["c"] and not (tmp_path / shared_files.ATTEMPTS).exists()
    shared_files.write_files(one("d").limit(0), str(tmp_path))
    assert names() == ["c"]


@pytest.mark.parametrize("bad", [None, "/etc/x", "a/../../x"])
def test_a_job_that_fails_leaves_nothing(spark, tmp_path, bad):
    rows = spark.createDataFrame([("good", bytearray(b"x")), (bad, bytearray(b"y"))], "name string, content binary").coalesce(1)
    with pytest.raises(Exception, match="not a name"):
        shared_files.write_files(rows, str(tmp_path / "out"))
    assert not [p for p in tmp_path.rglob("*") if p.is_file()] and not (tmp_path / "out" / shared_files.ATTEMPTS).exists()


def test_a_failed_task_that_runs_again_leaves_each_file_once(tmp_path):
    """In a session of its own, whose tasks may fail: each task breaks off in its first attempt, after some files."""
    script = textwrap.dedent(f"""
        from pyspark import TaskContext
        from pyspark.sql import SparkSession
        from seqforge.sources import shared_files

        spark = SparkSession.builder.master("local[3,4]").config("spark.ui.enabled", "false").config("spark.sql.warehouse.dir", "{tmp_path}/w").getOrCreate()

        def broken(batches):
            for batch in batches:
                yield batch
                if TaskContext.get().attemptNumber() == 0 and TaskContext.get().partitionId() % 2:
                    raise RuntimeError("lost")

        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
        rows = spark.range(0, 60, 1, 4).selectExpr("concat('f', id) AS name", "cast(concat('text ', id) AS binary) AS content")
        shared_files.write_files(rows.mapInPandas(broken, rows.schema), "{tmp_path}/out")
    """)
    done = subprocess.run([sys.executable, "-c", script], capture_output=True, text=True, timeout=180, cwd=str(__import__("pathlib").Path(__file__).parents[1]))
    assert done.returncode == 0, done.stderr[-2000:]
    assert "lost" in done.stderr  # a task did fail
    files = [p for p in (tmp_path / "out").rglob("*") if p.is_file()]
    assert sorted(p.name for p in files) == sorted(f"f{k}" for k in range(60))
    assert all(p.read_text() == f"text {p.name[1:]}" for p in files) and not (tmp_path / "out" / shared_files.ATTEMPTS).exists()
