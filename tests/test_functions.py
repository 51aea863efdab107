"""Scalar functions, planning and quirks, against hand-computed values and plain loops."""

import random
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from seqforge.functions import draws, media, names, pixels
from seqforge.operators import chunking, degrade, quality, sampling, sequences, tiling
from seqforge.sources import config, images


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def test_rates_and_sizes(spark):
    rate = lambda t: media.rate(F.lit(t))
    assert one(spark, rate("24000/1001"), rate("0/0"), rate("30"), rate("x"), rate("5/0")) == (24000 / 1001, None, 30.0, None, None)
    assert one(spark, media.fps(F.lit("0/0"), F.lit("25/1")), media.fps(F.lit(None).cast("string"), F.lit("0/0"))) == (25.0, 30.0)
    assert one(spark, *[media.even(F.lit(n)) for n in (0, 1, 2, 3, 1079)]) == (2, 2, 2, 2, 1078)
    assert one(spark, *[media.odd(F.lit(n)) for n in (3, 4, 5)]) == (3, 5, 5)
    assert one(spark, media.is_hdr(F.lit(None).cast("string"), F.lit("bt2020nc"), F.lit(None).cast("string"))) == (True,)


def test_names(spark):
    paths = ["/a/b.mp4", "b.tar.gz", "/x/.hidden", "noext", "/d.e/f"]
    assert one(spark, *[names.stem(F.lit(p)) for p in paths]) == ("b", "b.tar", ".hidden", "noext", "f")
    assert one(spark, names.chunk_name(F.lit(123456)), names.frame_name(F.lit(279), F.lit(1))) == ("chunk_123456.mkv", "show00279_Frame00001.png")
    assert one(spark, names.parsed(F.lit("show00279_Frame00001.png"), names.TILE_NAME, 2), names.parsed(F.lit("nope"), names.TILE_NAME, 2)) == ("00279", None)
    assert one(spark, names.chunk_number(F.lit("chunk_0012.mkv")), names.chunk_number(F.lit("other.mkv"))) == (12, None)


def test_draws_are_uniform_and_keyed(spark):
    df = spark.range(15000).select(draws.unit(1, "x", F.col("id")).alias("u"))
    n = df.where(draws.bernoulli(F.col("u"), 0.6)).count()
    assert abs(n - 9000) < 4 * 60
    assert df.repartition(17).agg(F.sum(F.floor(F.col("u") * 2**32))).first() == df.coalesce(1).agg(F.sum(F.floor(F.col("u") * 2**32))).first()
    assert one(spark, draws.decimal_text(F.lit(-5), 3), draws.decimal_text(F.lit(1234), 2)) == ("-0.005", "12.34")


def test_codec_choice_quirks(spark):
    codecs = [config.Codec("a", 0.5, (1, 2)), config.Codec("b", 0.495, (1, 2)), config.Codec("c", 0.0, (1, 2))]
    assert one(spark, *[sampling.pick(F.lit(u), codecs) for u in (0.0, 0.5, 0.5001, 0.994, 0.999)]) == ("a", "a", "b", "b", "c")
    zero = [config.Codec("a", 0.0, (1, 2)), config.Codec("b", 0.0, (1, 2))]
    assert one(spark, sampling.pick(F.lit(0.3), zero)) == ("b",) and sampling.normalized(zero) == zero
    assert [c.probability for c in sampling.normalized([config.Codec("a", 0.25, (1, 2))] * 2)] == [0.5, 0.5]
    with pytest.raises(config.ConfigError):
        config.Codec("a", 1.0, (3, 2))


def plain_starts(n, length, skip):
    return list(range(1, n - length + 2, length + skip))


@pytest.mark.parametrize("n", [0, 4, 5, 6, 23])
def test_starts_and_thinning(spark, n):
    assert one(spark, sequences.full_starts(F.lit(n), 5)) == (plain_starts(n, 5, 0),)
    assert one(spark, sequences.gap_starts(F.lit(n), 5, F.lit(25.0), 0.1)) == (plain_starts(n, 5, 2),)
    assert one(spark, sequences.gap_starts(F.lit(n), 5, F.lit(25.0), 0, 3)) == (plain_starts(n, 5, 0),)
    assert one(spark, sequences.gap_starts(F.lit(n), 5, F.lit(25.0), 0, 3, True)) == (plain_starts(n, 5, 3),)
    starts = plain_starts(n, 2, 0)
    for most in (0, 1, 3, 50):
        want = starts[:most] if most < 2 or len(starts) <= most else [starts[int(i * ((len(starts) - 1) / (most - 1)))] for i in range(most)]
        assert one(spark, sequences.thinned(F.array(*map(F.lit, starts)) if starts else F.array().cast("array<int>"), most)) == (want,)


def test_scene_starts_are_one_stricter(spark):
    assert one(spark, sequences.scene_starts(F.array(F.lit(0), F.lit(4), F.lit(5)), F.lit(10), 5)) == ([1, 5],)


def test_ranges_tile_the_recording(spark):
    df = spark.createDataFrame([(i, t, s) for i, (t, s) in enumerate([(10, 3), (9, 3), (1, 5), (0, 3), (7, 0)])], "id int, t long, s long")
    got = [tuple(r) for r in chunking.by_step(df, F.col("t"), F.col("s")).select("id", "start_frame", "end_frame").orderBy("id", "start_frame").collect()]
    assert got == [(0, 0, 3), (0, 3, 6), (0, 6, 9), (0, 9, 10), (1, 0, 3), (1, 3, 6), (1, 6, 9), (2, 0, 1)]


def test_global_numbers_continue_and_ignore_partitions(spark):
    rng = random.Random(1)
    rows = sorted({(rng.randrange(20000), rng.randrange(9)) for _ in range(500)})
    df = spark.createDataFrame(rows, "g long, w long")
    for parts in (1, 17):
        got = {(r.g, r.w): r.chunk_no for r in chunking.number_groups(df.repartition(parts), "g", "w", F.lit(40), bucket=100).collect()}
        assert got == {k: 41 + i for i, k in enumerate(rows)}


def plain_border(px, w, h):
    def lines(sums, most, across):
        n = 0
        for s in sums[:most]:
            if s / across > 10:
                break
            n += 1
        return n

    rows, cols = [sum(px[r * w : r * w + w]) for r in range(h)], [sum(px[c::w]) for c in range(w)]
    return lines(rows, h // 2, w), lines(rows[::-1], h - 1 - h // 2, w), lines(cols, w // 2, h), lines(cols[::-1], w - 1 - w // 2, h)


def plain_edges(px, w, h):
    at = lambda x, y: px[(0 if h == 1 else -y if y < 0 else 2 * h - 2 - y if y >= h else y) * w + (0 if w == 1 else -x if x < 0 else 2 * w - 2 - x if x >= w else x)]
    n = 0
    for y in range(h):
        for x in range(w):
            gx = sum(k * (at(x + 1, y + d) - at(x - 1, y + d)) for d, k in ((-1, 1), (0, 2), (1, 1)))
            gy = sum(k * (at(x + d, y + 1) - at(x + d, y - 1)) for d, k in ((-1, 1), (0, 2), (1, 1)))
            n += gx * gx + gy * gy > 900
    return n


def test_pixels_match_plain_loops(spark):
    rng = random.Random(2)
    pictures = [([0] * 64, 8, 8), ([200] * 12, 4, 3), ([7], 1, 1), ([rng.randrange(256) for _ in range(35)], 7, 5)]
    for dark in range(4):
        px = [rng.randrange(60) for _ in range(81)]
        pictures.append(([0 if i // 9 < dark or i % 9 >= 9 - dark else v for i, v in enumerate(px)], 9, 9))
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pictures)], "id int, px array<int>, w int, h int")
    rows = df.select("id", pixels.border(F.col("px"), F.col("w"), F.col("h")).alias("b"), pixels.edges(F.col("px"), F.col("w"), F.col("h")).alias("e"), pixels.spread(F.col("px")).alias("v"), pixels.crop(F.col("px"), F.col("w"), F.lit(0), F.lit(0), F.col("w"), F.col("h")).alias("c"))
    for r in rows.collect():
        px, w, h = pictures[r.id]
        assert tuple(r.b) == plain_border(px, w, h) and r.e == plain_edges(px, w, h)
        assert r.v == len(px) * sum(v * v for v in px) - sum(px) ** 2 and r.c == px


def test_equal_to_threshold_is_unchanged(spark):
    assert one(spark, pixels.changed(F.array(F.lit(0), F.lit(0)), F.array(F.lit(30), F.lit(31)), 30)) == (1,)


def test_compose_orders_simple_before_complex(spark):
    cases = [["a", "b"], ["x;y"], ["x;y", "a"], ["x;y", "", None, "p;q", "a", "r;s"], [""], []]
    want = ["a,b", "x;y", "a,x;y", "a,x;y[_chain_0];[_chain_0]p;q[_chain_1];[_chain_1]r;s", "", ""]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, f array<string>")
    assert [r[0] for r in df.orderBy("i").select(degrade.compose(F.col("f"))).collect()] == want


def test_unknown_degradations_are_errors(spark):
    with pytest.raises(config.ConfigError):
        degrade.plans(spark.range(1), (config.Degradation("nope"),), F.col("id"), {})
    with pytest.raises(config.ConfigError):
        config.settings({"input": "x", "degradations": [{"name": "blurr", "enabled": True, "probability": 1}]})


def test_settings():
    codec = {"name": "codec", "enabled": True, "probability": 1, "params": {"h264": {"probability": 1, "quality_range": [20, 30]}}}
    made = config.settings({"input": "v.mp4", "chunk_strategy": "frame_count", "degradations": [{"name": "halo", "enabled": True, "probability": 0.5, "params": {"amount": [0, 1]}}, codec]})
    assert made.degradations[0].params.amount == (0, 1) and made.codecs[0].quality == (20, 30)
    assert config.overlaid(made, chunk_duration=3, min_motion=None).chunk_duration == 3
    for bad in ({"input": ""}, {"input": "x", "chunk_strategy": "?"}, {"input": "x"}):
        with pytest.raises(config.ConfigError):
            config.settings(bad)
    assert config.settings({}, strict=False).chunk_strategy == "duration"


def test_motion_limits_can_be_off(spark):
    df = spark.createDataFrame([(1, 100), (50, 100), (99, 100)], "changed_px long, n_px long")
    label = lambda a, b: [r[0] for r in df.orderBy("changed_px").select(quality.motion_label(a, b)).collect()]
    assert label(10, 60) == ["LOW", "OK", "HIGH"] and label(-1, -1) == ["OK"] * 3


def test_verdicts_equal_the_chain(spark):
    rng = random.Random(4)
    rows = []
    for s in range(40):
        base = [rng.randrange(256) for _ in range(16)]
        for f in range(1, 6):
            if rng.random() < 0.05:
                continue
            if rng.random() < 0.3:
                base = [rng.randrange(256) for _ in range(16)]
            rows.append((s, f, 4, 4, [0] * 16 if rng.random() < 0.2 else base))
    df = spark.createDataFrame(rows, "seq int, frame_no int, width int, height int, pixels array<int>")
    got = {r.seq: r.reason for r in quality.verdicts(df, 50.0, 500.0, 2, -1, 60.0, 5).collect()}
    for s in {r[0] for r in rows}:
        mine = sorted(r for r in rows if r[0] == s)

        def blank(px):
            t, b, le, ri = plain_border(px, 4, 4)
            wide = ((t + b) * 4 + (le + ri) * (4 - t - b)) / 16 * 100 > 40
            mean = sum(px) / 16
            return wide or (plain_edges(px, 4, 4) / 16 * 100 < 50 and sum((v - mean) ** 2 for v in px) / 16 < 500)

        moves = [sum(abs(a - b) > 30 for a, b in zip(x[4], y[4], strict=True)) / 16 * 100 for x, y in zip(mine, mine[1:])]
        want = "blank" if sum(blank(r[4]) for r in mine) >= 2 else "motion" if any(m > 60 for m in moves) else None if [r[1] for r in mine] == [1, 2, 3, 4, 5] else "incomplete"
        assert got[s] == want, s


def test_windows_and_grid(spark):
    frames = spark.createDataFrame([("a", i) for i in range(4)] + [("b", 0)], "scene string, frame int")
    got = sorted(tuple(r) for r in tiling.windows(frames, "scene", "frame", 3).select("scene", "window_no", "offset", "frame").collect())
    assert got == [("a", w, o, w + o) for w in range(2) for o in range(3)]
    sizes = spark.createDataFrame([(1, 10, 7), (2, 4, 4), (3, 3, 9)], "id int, width int, height int")
    got = sorted(tuple(r) for r in tiling.grid(sizes, 4, 3).select("id", "x", "y", "tile_idx").collect())
    assert got == [(1, 0, 0, 0), (1, 0, 3, 2), (1, 4, 0, 1), (1, 4, 3, 3), (2, 0, 0, 0)]


def test_image_files(spark, tmp_path):
    def png(path, w, h, rgb):
        chunk = lambda t, d: struct.pack(">I", len(d)) + t + d + struct.pack(">I", zlib.crc32(t + d))
        raw = b"".join(b"\0" + bytes(c for p in rgb[r * w : r * w + w] for c in p) for r in range(h))
        path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))

    rgb = [(200, 100, 0), (0, 0, 0), (255, 255, 255), (10, 20, 30), (1, 2, 3), (90, 80, 70)]
    png(tmp_path / "show00001_Frame00002.png", 3, 2, rgb)
    row = images.gray_frames(spark, str(tmp_path)).first()
    assert (row.seq, row.frame_no, row.width, row.height) == ("show00001", 2, 3, 2)
    assert row.pixels == [(3735 * b + 19235 * g + 9798 * r + 16384) >> 15 for r, g, b in rgb]
    assert images.relative(images.listing(spark, str(tmp_path), ("png",)), str(tmp_path)).first()[0] == "show00001_Frame00002.png"


def test_quarantine_keeps_every_row(spark, tmp_path):
    df = spark.createDataFrame([(1, "kept"), (2, "bad"), (3, "kept")], "seq int, status string")
    quality.quarantined(df, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3 and (tmp_path / "out" / "status=bad").exists()
