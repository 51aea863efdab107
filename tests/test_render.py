"""Pixels that change: kernels against plain loops, operators on odd tables, plans."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqforge.functions import pixels, raster
from seqforge.operators import chunking, render

FRAMES = "video_id long, frame_no int, width int, height int, pixels array<int>"


def image(rng, h, w, n=1):
    return np.array([rng.randrange(256) for _ in range(n * h * w)], dtype=np.int64).reshape(n, h, w)


def frames(spark, rows):
    return spark.createDataFrame(rows, FRAMES)


def shown(df, *columns):
    return {(r.video_id, r.frame_no): tuple(r[c] for c in columns or ("pixels",)) for r in df.collect()}


def half_up(total, parts):
    return (2 * total + parts) // (2 * parts)


@pytest.mark.parametrize("h, w, new_h, new_w", [(1, 1, 3, 2), (5, 7, 5, 7), (6, 9, 3, 4), (4, 3, 9, 8), (2, 50, 7, 3)])
def test_resampling_matches_plain_loops(h, w, new_h, new_w):
    a = image(random.Random(w), h, w)[0]
    area, lines = raster.resampled(a[None], "area", new_w, new_h)[0], raster.resampled(a[None], "bilinear", new_w, new_h)[0]

    def overlap(src, dst, size, new):
        return max(0, min((src + 1) * new, (dst + 1) * size) - max(src * new, dst * size))

    def tent(src, dst, size, new):
        at = min(max((2 * dst + 1) * size - new, 0), 2 * new * (size - 1))
        return max(0, 2 * new - abs(at - 2 * new * src))

    for got, weight, parts in ((area, overlap, w * h), (lines, tent, 4 * new_w * new_h)):
        for y in range(new_h):
            for x in range(new_w):
                total = sum(int(a[j, i]) * weight(j, y, h, new_h) * weight(i, x, w, new_w) for j in range(h) for i in range(w))
                assert got[y, x] == half_up(total, parts)
    assert (raster.resampled(a[None], "area", w, h)[0] == a).all() and (raster.resampled(a[None], "bicubic", w, h)[0] == a).all()


@pytest.mark.parametrize("size, new", [(1, 3), (5, 5), (9, 4), (4, 9), (50, 7), (1920, 1280)])
def test_cubic_weights_are_those_of_the_cubic(size, new):
    sources, weights, unit = raster.taps(size, new, "bicubic")
    assert (weights.sum(axis=1) == unit).all() and sources.min() >= 0 and sources.max() < size
    for at in range(0, new, max(1, new // 20)):
        centre = (at + 0.5) * size / new - 0.5
        for k, left in enumerate(range(int(np.floor(centre)) - 1, int(np.floor(centre)) + 3)):
            x = abs(centre - left)
            want = 1.5 * x**3 - 2.5 * x**2 + 1 if x <= 1 else -0.5 * x**3 + 2.5 * x**2 - 4 * x + 2
            assert abs(weights[at, k] / unit - want) < 3 / unit and sources[at, k] == min(max(left, 0), size - 1)


def test_cubic_keeps_flat_frames_and_clips():
    flat, edge = np.full((1, 6, 6), 77), np.zeros((1, 4, 8), dtype=np.int64)
    edge[:, :, 4:] = 255
    assert (raster.resampled(flat, "bicubic", 9, 4) == 77).all()
    done = raster.resampled(edge, "bicubic", 16, 4)
    assert done.min() == 0 and done.max() == 255 and ((done > 0) & (done < 255)).any()


@pytest.mark.parametrize("radius", [0, 1, 3, 20])
def test_boxes_match_plain_loops(radius):
    a = image(random.Random(radius), 6, 9)[0]
    got, sharp = raster.boxed(a[None], radius)[0], raster.sharpened(a[None], 2 * radius + 1, 3, np.array([750]))[0]
    for y in range(6):
        for x in range(9):
            part = a[max(y - radius, 0) : y + radius + 1, max(x - radius, 0) : x + radius + 1]
            assert got[y, x] == half_up(int(part.sum()), part.size)
            part = a[max(y - 1, 0) : y + 2, max(x - radius, 0) : x + radius + 1]
            v = int(a[y, x])
            assert sharp[y, x] == min(max(half_up(v * 1000 * part.size + 750 * (v * part.size - int(part.sum())), 1000 * part.size), 0), 255)


def test_boxes_have_the_spread_of_their_gaussian():
    for sigma in (0.7, 1.5, 3.0, 10.0):
        radii = raster.box_radii(sigma)
        assert abs(sum(((2 * r + 1) ** 2 - 1) / 12 for r in radii) - sigma * sigma) < 0.35 * sigma * sigma + 0.5


def test_borders_of_the_table_are_those_of_the_arrays(spark):
    rng, rows = random.Random(4), []
    for k, (h, w) in enumerate([(1, 1), (2, 3), (8, 8), (9, 5), (16, 4)] * 3):
        a = image(rng, h, w)[0]
        a[: k % 4], a[:, : k % 3] = 0, 5
        if k == 7:
            a[:] = 0
        rows.append((k, 1, w, h, a.reshape(-1).tolist()))
    table = raster.over_stacks(lambda s: raster.borders(s, 10), F.col("width"), F.col("height"), [F.col("pixels")])
    for r in frames(spark, rows).select(table.alias("t"), pixels.border(F.col("pixels"), F.col("width"), F.col("height")).alias("b")).collect():
        assert r.t == [r.b.top, r.b.bottom, r.b.left, r.b.right]


def test_hue_saturation_value():
    rng = random.Random(2)
    import colorsys

    b, g, r = (image(rng, 20, 20) for _ in range(3))
    hue, sat, val = raster.hsv(b, g, r)
    for k in range(400):
        x, y = k % 20, k // 20
        h, s, v = colorsys.rgb_to_hsv(int(r[0, y, x]) / 255, int(g[0, y, x]) / 255, int(b[0, y, x]) / 255)
        turn = abs(hue[0, y, x] - h * 180) % 180
        assert min(turn, 180 - turn) <= 0.51 and abs(sat[0, y, x] - s * 255) <= 0.51 and val[0, y, x] == round(v * 255)
    gray = image(rng, 2, 2)
    assert (raster.hsv(gray, gray, gray)[0] == 0).all()


def test_odd_frames_become_null_and_sizes_mix(spark):
    rows = [(1, 1, 2, 2, [1, 2, 3, 4]), (1, 2, None, 2, [1, 2]), (1, 3, 2, 2, None), (1, 4, 2, 2, [1]), (1, 5, 0, 0, []), (1, 6, 3, 1, [9, 9, 9]), (1, 7, 2, 2, [4, 3, 2, 1, 0])]
    out = shown(render.box_blurred(frames(spark, rows), F.lit(0), F.lit(1)))
    assert [out[1, k][0] for k in range(1, 8)] == [[1, 2, 3, 4], None, None, None, None, [9, 9, 9], [4, 3, 2, 1]]
    out = shown(render.box_blurred(frames(spark, rows), F.lit(None).cast("int"), F.lit(1)))
    assert {v[0] for v in out.values()} == {None}
    none = frames(spark, [])
    for done in (render.resized(none, F.lit(2), F.lit(2), "area"), render.noised(none, F.lit(1), F.lit(3)), render.interlaced(none, True), render.tonemapped(none, "clip"), render.ghosted(none, [{"delay": 1, "offset_x": 0, "offset_y": 0, "opacity": 9}])):
        assert done.collect() == []
    with pytest.raises(ValueError, match="unknown filter"):
        render.resized(none, F.lit(2), F.lit(2), "lanczos")


def test_noise_depends_on_seed_frame_and_pixel_alone(spark):
    rows = [(v, f, 6, 5, [128] * 30) for v in range(4) for f in range(1, 6)]
    df = frames(spark, rows)
    one, other = (shown(render.noised(df.repartition(n).orderBy(F.rand(n)), F.col("video_id"), F.lit(20))) for n in (1, 7))
    assert one == other and len({tuple(v[0]) for v in one.values()}) == 20
    values = [x - 128 for v in one.values() for x in v[0]]
    assert -20 <= min(values) < -8 and 8 < max(values) <= 20 and abs(sum(values) / len(values)) < 2
    assert all(v[0] == [128] * 30 for v in shown(render.noised(df, F.lit(1), F.lit(0))).values())


def test_interlacing_pairs_what_exists(spark):
    rows = [(1, f, 1, 3, [f * 10, f * 10, f * 10]) for f in (1, 4, 5, 8, 9)] + [(2, 3, 1, 3, [1, 2, 3])]
    assert shown(render.interlaced(frames(spark, rows), True)) == {(1, 1): ([10, 40, 10],), (1, 2): ([50, 80, 50],)}
    assert shown(render.interlaced(frames(spark, rows), False))[1, 1] == ([40, 10, 40],)


def test_delays_are_times(spark):
    rows = spark.createDataFrame([(1, f, [f], [-f]) for f in (1, 2, 5, 6)], "video_id long, frame_no int, u array<int>, v array<int>")
    due = lambda d: [shown(render.chroma_delayed(rows, d), "u")[1, f][0][0] for f in (1, 2, 5, 6)]
    assert due(0) == [1, 2, 5, 6] and due(1) == [1, 1, 2, 5] and due(1.5) == [1, 1, 2, 2] and due(99) == [1, 1, 1, 1]


def test_ghosts(spark):
    rows = [(1, f, 3, 1, [0, 100 * (f == 2), 0]) for f in (1, 2, 3)]
    same = render.ghosted(frames(spark, rows), [])
    assert shown(same) == shown(frames(spark, rows))
    trail = shown(render.ghosted(frames(spark, [(1, 1, 3, 1, [90, 90, 90])]), [{"delay": 3, "offset_x": 1, "offset_y": 0, "opacity": 500}]))
    assert trail[1, 1][0] == [45, 90, 90]  # black comes in from the left
    rows = [(1, 1, 1, 1, [7]), (1, 2, 1, 1, None), (1, 3, 1, 1, [9])]
    assert shown(frames(spark, rows).select("video_id", "frame_no", render.median(F.array("pixels", "pixels")).alias("pixels")))[1, 2] == (None,)


@pytest.mark.parametrize("kind", ["reinhard", "hable", "clip"])
def test_curves_rise_to_the_peak(kind):
    for peak in (1, 2, 100, 200, 255):
        table = render.curve(kind, peak)
        assert table == sorted(table) and table[peak] == 255 and table[0] == 0 and len(table) == 256


def test_tonemapping_shuffles_histograms_only(spark):
    rows = [(v, f, 2, 2, [v * 40, 3, f, 0]) for v in (1, 2, 3) for f in range(1, 5)] + [(9, 1, 2, 2, None)]
    done = render.tonemapped(frames(spark, rows), "clip", share=1000)
    assert {r.video_id: r.peak for r in done.collect()} == {1: 40, 2: 80, 3: 120, 9: None}
    assert shown(done)[2, 1][0][0] == 255 and shown(done)[9, 1] == (None,)
    assert "Exchange hashpartitioning" not in done._jdf.queryExecution().executedPlan().toString()


def test_scene_signal_shuffles_once_by_recording(spark):
    flat = lambda v: [v] * 16
    rows = [(1, f, 4, 4, flat(b), flat(10), flat(200)) for f, b in enumerate((0, 0, 10, 250, 250), 1)] + [(2, 1, 4, 4, flat(1), flat(1), flat(1)), (2, 2, 2, 2, [1] * 4, [1] * 4, [1] * 4)]
    shots = spark.createDataFrame(rows, "video_id long, frame_no int, width int, height int, blue array<int>, green array<int>, red array<int>")
    signal = render.scene_signal(shots, 3)
    got = {(r.video_id, r.frame_no): (r.score_num, r.n_px) for r in signal.collect()}
    assert got[1, 1] == (None, 1) and got[1, 2] == (0, 1) and got[1, 4][0] > got[1, 3][0] > 0 and got[2, 2] == (0, 1)
    cut = chunking.scenes(signal, 20.0)
    assert sorted((r.video_id, r.start_frame, r.end_frame) for r in cut.collect()) == [(1, 1, 4), (1, 4, 6), (2, 1, 3)]
    plan = cut._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("Exchange hashpartitioning") == 1
