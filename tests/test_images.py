"""Image kernels and operators on synthetic charts."""

import struct
import zlib

import numpy as np
from pyspark.sql import functions as F

from curvelab.functions import pixels as P
from curvelab.operators import contours, images
from curvelab.sources import readers
from curvelab.streaming import arrivals


def line(a, x0, y0, x1, y1, width=2):
    for t in np.linspace(0, 1, 2 * max(abs(x1 - x0), abs(y1 - y0)) + 1):
        x, y = int(round(x0 + t * (x1 - x0))), int(round(y0 + t * (y1 - y0)))
        a[max(0, y) : y + width, max(0, x) : x + width] = 0


def chart(h=300, w=400):
    """Axes left and below, and a curve that rises to a maximum and falls."""
    a = np.full((h, w, 3), 255, np.uint8)
    line(a, 50, h - 50, w - 50, h - 50)
    line(a, 50, h - 50, 50, 50)
    xs = list(range(60, w - 60, 5))
    ys = [int(h - 60 - 180 * (1 - ((x - 50) / (w - 100) - 0.7) ** 2 / 0.49)) for x in xs]
    for p in zip(xs, ys, xs[1:], ys[1:]):
        line(a, *p)
    return a


def rows_of(spark, named):
    return spark.createDataFrame([(n, a.shape[0], a.shape[1], 1 if a.ndim == 2 else 3, bytearray(a.tobytes())) for n, a in named.items()], "image_id string, height int, width int, channels int, data binary")


def test_quality_and_noise(spark):
    clean = chart()
    noisy = np.clip(clean.astype(int) - np.random.default_rng(0).integers(0, 60, clean.shape), 0, 255).astype(np.uint8)
    q = {r.image_id: r for r in images.quality(rows_of(spark, {"clean": clean, "noisy": noisy, "flat": np.full((20, 20), 9, np.uint8)})).collect()}
    assert all(0 <= q[n][k] <= 1 and q[n].error is None for n in q for k in ("blur", "noise", "contrast", "overall"))
    assert q["noisy"].noise > q["clean"].noise * 0.99 and q["flat"].contrast == 0 and q["flat"].blur == 1
    assert P.noise_level(noisy) > 0


def test_bad_images_are_rows(spark):
    df = spark.createDataFrame([("bad", 10, 10, 3, bytearray(b"xx"))], "image_id string, height int, width int, channels int, data binary")
    r = images.quality(df).first()
    assert r.error and r.blur is None


def test_skew_and_rotation():
    assert abs(P.skew_angle(chart())) < 1
    turned = P.rotated(chart(), 5)
    assert 3 <= abs(P.skew_angle(turned)) <= 7
    level, _ = P.rectified(turned)
    assert abs(P.skew_angle(level)) < 1.5


def test_skew_of_shallow_and_dotted_lines():
    for degrees in (-4, -1, 0, 2, 7):
        ys = np.round(100 + (np.arange(400) - 200) * np.tan(np.deg2rad(degrees))).astype(int)
        assert abs(P.skew_angle(P.drawn(ys, 200, 440, 20)) - degrees) < 0.1
    dashes = np.full((200, 440), 255, np.uint8)
    for x in range(20, 400, 60):  # short strokes far apart are no line, whatever their votes
        dashes[100:103, x : x + 25] = 0
    assert P.skew_angle(dashes) == 0.0 and P.skew_angle(np.rot90(dashes)) == 0.0


def test_a_mask_without_background_has_no_skeleton():
    assert not P.thinned(np.full((6, 9), 255, np.uint8)).any()


def test_trace_finds_the_curve(spark):
    a = np.full((300, 400), 255, np.uint8)
    xs = np.arange(40, 360)
    ys = (250 - 150 * np.sin((xs - 40) / 320 * np.pi)).astype(int)
    for x, y in zip(xs, ys):
        a[y - 1 : y + 3, x] = 0
    masks = images.curve_mask(rows_of(spark, {"m": a}))
    got = {r.px: r.py for r in images.trace(masks.drop("error")).collect()}
    assert len(got) > 300 and np.mean([abs(got[x] - y) for x, y in zip(xs, ys) if x in got]) < 3
    smooth = images.smooth_trace(images.trace(masks.drop("error")), 50).collect()
    assert len(smooth) == 50


def test_kernels():
    a = np.zeros((9, 9), np.uint8)
    a[1:4, 1:4] = a[6:8, 6:8] = 255
    labels, areas = P.components(a)
    assert areas.tolist() == [9, 4] and labels[2, 2] == 1 and labels[7, 7] == 2
    assert P.without_small(a, 5).sum() == 9 * 255
    snake = np.zeros((40, 40), np.uint8)
    snake[::4] = 1
    snake[2::4, 0] = snake[1::4, 0] = snake[3::4, 0] = 1
    assert P.components(snake)[1].tolist() == [int(snake.sum())]
    assert P.dilate(P.erode(a)).sum() == 9 * 255 and P.closed(a).sum() >= a.sum()
    assert P.thinned(a).sum() < a.sum() and P.thinned(a)[2, 2]
    assert P.auto_crop(a, padding=1) == (0, 0, 9, 9) and P.auto_crop(np.zeros((5, 6), np.uint8)) == (0, 0, 6, 5)
    x = np.random.default_rng(1).integers(0, 255, (12, 15)).astype(np.uint8)
    want = [[np.pad(x.astype(float), 2, mode="reflect")[i : i + 5, j : j + 5].mean() for j in range(15)] for i in range(12)]
    assert np.allclose(P.box_mean(x, 5), want)
    assert P.gray(np.full((2, 2, 3), 100, np.uint8)).tolist() == [[100, 100], [100, 100]]
    assert P.spline([(0, 0), (1, 1)], 9) == [(0, 0), (1, 1)] and P.spline([(i, i) for i in range(10)], 4) == [(0, 0), (3, 3), (6, 6), (9, 9)]
    assert P.for_reading(np.full((100, 150), 255, np.uint8)).shape == (300, 450)


def test_watermarks_and_sheets(spark):
    g = P.gray(chart())
    assert P.equalized(g).shape == g.shape and P.without_watermark(g).shape == g.shape
    assert np.array_equal(P.bilateral(np.full((20, 20), 7, np.uint8)), np.full((20, 20), 7))
    step = np.where(np.arange(40) < 20, 0, 255).astype(np.uint8) * np.ones((40, 1), np.uint8)
    assert np.array_equal(P.bilateral(step) > 127, step > 127)
    sheet = np.zeros((200, 300), np.uint8)
    for y in range(200):
        sheet[y, 20 + y // 10 : 280 - y // 10] = 255 if 10 <= y < 190 else 0
    corners = P.quad(sheet)
    assert corners is not None and np.abs(corners - [(21, 10), (278, 10), (261, 189), (38, 189)]).max() <= 2
    flat = P.straightened(sheet, corners)
    assert (flat > 0).mean() > 0.98 and P.quad(np.zeros((9, 9), np.uint8)) is None
    assert images.edge_mask(rows_of(spark, {"a": chart()})).first().height == 300
    assert images.cached_model("m", lambda p: [p]) is images.cached_model("m", lambda p: [p])


def test_plugs(spark):
    df = rows_of(spark, {"a": chart()})
    assert images.read_text(df).collect() == [] and images.segment(df).collect() == []
    assert [r.text for r in images.read_text(df, lambda a: [("1", 90.0, 0, 0, 1, 1)]).collect()] == ["1"]
    probability = np.zeros((30, 40))
    probability[10:13, 5:35] = 0.9
    assert images.segment(df, lambda a: probability).count() > 20


def test_contours(spark):
    square = [("i", 1, k, x, y) for k, (x, y) in enumerate([(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (0.0, 10.0)])]
    wide = [("i", 2, k, 10.0 * k, 5.0) for k in range(30)]
    m = contours.measures(spark.createDataFrame(square + wide, "img string, c int, idx int, x double, y double"), ["img", "c"])
    got = {r.c: r for r in m.collect()}
    assert (got[1].area, got[1].arc, got[1].w, got[1].n) == (100, 30, 10, 4)
    assert contours.best_contour(m, "img", "c", F.lit(300.0), F.lit(100.0), 20).first().c == 2
    assert {r.c for r in contours.isolate(m, "img", F.lit(300.0), F.lit(100.0)).collect()} >= {2}
    px = spark.createDataFrame([("i", 5, y, v) for y, v in ((3, 200), (4, 90), (6, 90), (9, 255))], "image_id string, px int, py int, v int")
    pts = spark.createDataFrame([("i", 0, 5, 5), ("i", 1, 5, 14)], "image_id string, idx int, px int, py int")
    assert {(r.idx, r.py) for r in contours.darkest_near(px, pts).collect()} == {(0, 4), (1, 14)}
    lines = spark.createDataFrame([("i", 0, 0, 100, 3), ("i", 0, 0, 100, 5), ("i", 0, 0, -4, 100), ("i", 0, 0, 9, 9)], "img string, x1 int, y1 int, x2 int, y2 int")
    r = contours.skew(lines, ["img"]).first()
    assert r.lines == 3 and 1.5 < r.skew < 3


def png(a):
    raw = b"".join(b"\0" + a[y].tobytes() for y in range(a.shape[0]))
    part = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", a.shape[1], a.shape[0], 8, 2, 0, 0, 0)) + part(b"IDAT", zlib.compress(raw)) + part(b"IEND", b"")


def test_image_files_and_stream(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.png").write_bytes(png(chart()[..., ::-1].copy()))
    (folder / "b.png").write_bytes(b"broken")
    (folder / "c.txt").write_text("no")
    got = {r.image_id.rsplit("/", 1)[1]: r for r in readers.images(spark, f"file://{folder}").collect()}
    assert got["a.png"].status == "completed" and (got["a.png"].height, got["a.png"].width) == (300, 400) and got["b.png"].status == "failed" and got["c.txt"].status == "failed"
    assert images.quality(readers.images(spark, f"file://{folder}").where("status = 'completed'")).count() == 1
    assert readers.uploads(spark, f"file://{folder}").count() == 2
    seen = []
    arrivals.run_available(arrivals.arriving_uploads(spark, f"file://{folder}"), lambda df, _: seen.extend(r.length for r in df.select("length").collect()), f"file://{tmp_path}/state")
    assert len(seen) == 2
