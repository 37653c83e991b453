"""Outlines, polylines, sheets, painting over and resampling, against plain definitions."""

import numpy as np
import pytest

from curvelab.functions import parts, resampling
from curvelab.functions import pixels as P
from curvelab.operators import curves, extraction, images
from tests.test_extraction import drawn
from tests.test_images import chart, rows_of


def spots(seed, h=14, w=17, share=0.45):
    return (np.random.default_rng(seed).random((h, w)) < share).astype(np.uint8)


def flooded(free, start):
    """Cells reached from one by steps in four directions."""
    seen, todo = {start}, [start]
    while todo:
        y, x = todo.pop()
        for p in ((y + 1, x), (y - 1, x), (y, x + 1), (y, x - 1)):
            if p in free and p not in seen:
                seen.add(p)
                todo.append(p)
    return seen


def test_outlines_of_scattered_parts():
    for seed in range(30):
        m = spots(seed)
        labels, areas = parts.components(m)
        h, w = m.shape
        off = {(y, x) for y in range(-1, h + 1) for x in range(-1, w + 1) if not (0 <= y < h and 0 <= x < w and m[y, x])}
        sea = flooded(off, (-1, -1))
        walks = parts.outlines(m, outside=False)
        assert len(walks) == len(areas)
        for k, walk in enumerate(walks):
            pixels = {(int(y), int(x)) for x, y in walk}
            mine = {tuple(p) for p in np.argwhere(labels == k + 1).tolist()}
            assert pixels <= mine and tuple(walk[0][::-1]) == min(mine)
            # what lies outside this part: the walk passes every pixel beside it, and no other
            around = flooded({(y, x) for y in range(-1, h + 1) for x in range(-1, w + 1)} - mine, (-1, -1))
            assert pixels == {p for p in mine if any((p[0] + dy, p[1] + dx) in around for dy, dx in ((0, 1), (0, -1), (1, 0), (-1, 0)))}
            steps = np.abs(np.diff(np.vstack([walk, walk[:1]]), axis=0)).max(axis=1)
            assert (steps == 1).all() or len(walk) == 1
        outer = [w for w in walks if (int(w[0][1]), int(w[0][0]) - 1) in sea]
        assert [w.tolist() for w in parts.outlines(m)] == [w.tolist() for w in outer]


def test_a_square_a_line_and_a_point():
    m = np.zeros((6, 9), np.uint8)
    m[1:4, 1:4] = 1
    m[5, 2:6] = 1
    m[1, 7] = 1
    square, point, line = sorted(parts.outlines(m), key=lambda w: (w[0][1], w[0][0]))
    assert square.tolist() == [[1, 1], [1, 2], [1, 3], [2, 3], [3, 3], [3, 2], [3, 1], [2, 1]] and parts.area(square) == 4 and parts.length(square, True) == 8
    assert point.tolist() == [[7, 1]] and parts.length(point) == 0
    assert line.tolist() == [[2, 5], [3, 5], [4, 5], [5, 5], [4, 5], [3, 5]] and parts.area(line) == 0
    assert parts.outlines(np.zeros((3, 3), np.uint8)) == []


def to_line(p, a, b):
    d = b - a
    return np.hypot(*(p - a).T) if not d.any() else np.abs((p - a)[:, 0] * d[1] - (p - a)[:, 1] * d[0]) / np.hypot(*d)


def recursive(p, epsilon):
    if len(p) < 3:
        return p.tolist()
    off = to_line(p[1:-1], p[0], p[-1])
    k = int(off.argmax()) + 1
    if off[k - 1] ** 2 <= epsilon**2:
        return [p[0].tolist(), p[-1].tolist()]
    return recursive(p[: k + 1], epsilon)[:-1] + recursive(p[k:], epsilon)


def test_simplified_polylines(spark):
    rng = np.random.default_rng(3)
    for n in (1, 2, 3, 10, 400):
        p = np.column_stack([np.arange(n), rng.integers(0, 50, n).cumsum() % 97])
        for epsilon in (0.5, 5, 30):
            assert parts.simplified(p, epsilon).tolist() == recursive(p.astype(float), epsilon)
    closed = parts.simplified(parts.outlines(np.ones((20, 30), np.uint8))[0], 1.0, closed=True)
    assert sorted(closed.tolist()) == [[0, 0], [0, 19], [29, 0], [29, 19]]
    zigzag = np.column_stack([np.arange(3000), np.arange(3000) % 2 * 9])  # no recursion, however deep
    assert len(parts.simplified(zigzag, 1.0)) == 3000
    df = spark.createDataFrame([(1, [0.0, 1.0, 2.0], [0.0, 0.1, 0.0]), (2, [], []), (3, None, None)], "curve_id int, xs array<double>, ys array<double>")
    assert {r.curve_id: r.xs for r in curves.simplify(df, 0.5).collect()} == {1: [0.0, 2.0], 2: [], 3: []}


def sheet(corners, h=300, w=400, light=220, dark=30):
    yy, xx = np.mgrid[0:h, 0:w]
    inside = np.ones((h, w), bool)
    for (x0, y0), (x1, y1) in zip(corners, [*corners[1:], corners[0]], strict=True):
        inside &= (x1 - x0) * (yy - y0) - (y1 - y0) * (xx - x0) >= 0
    return np.where(inside, light, dark).astype(np.uint8)


@pytest.mark.parametrize("corners", [[(40, 30), (350, 48), (370, 270), (24, 250)], [(60, 20), (380, 60), (330, 280), (15, 240)], [(30, 30), (370, 30), (370, 270), (30, 270)]])
def test_sheets_are_found_and_straightened(spark, corners):
    a = sheet(corners)
    cx, cy = (int(sum(c[k] for c in corners) / 4) for k in (0, 1))
    a[cy - 4 : cy + 5, cx - 4 : cx + 5] = 90
    found = P.quad(a)
    assert np.abs(found - corners).max() <= 2
    assert [(r.corner, r.x, r.y) for r in images.sheet_corners(rows_of(spark, {"a": a})).orderBy("corner").collect()] == [(k, *map(float, c)) for k, c in enumerate(found)]
    flat = P.straightened(a, np.array(corners, float))
    tl, tr, br, bl = (np.array(c, float) for c in corners)
    assert abs(flat.shape[1] - max(np.hypot(*(br - bl)), np.hypot(*(tr - tl)))) < 1 and (flat > 60).mean() > 0.98
    # the diagonals' crossing stays one under a projective map: it lands in the middle
    d1, d2 = br - tl, bl - tr
    t = np.cross(np.append(tr - tl, 0), np.append(d2, 0))[2] / np.cross(np.append(d1, 0), np.append(d2, 0))[2]
    crossing = tl + t * d1
    b = sheet(corners)
    b[int(round(crossing[1])), int(round(crossing[0]))] = 0
    dark = np.argwhere(P.straightened(b, np.array(corners, float)) < 215)
    inner = dark[(dark > 10).all(axis=1) & (dark < np.array(flat.shape) - 10).all(axis=1)]
    assert len(inner) and np.abs(inner.mean(axis=0) - (np.array(flat.shape) - 1) / 2).max() <= 2
    level, _ = P.rectified(a)
    assert abs(level.shape[0] - flat.shape[0]) <= 6 and abs(level.shape[1] - flat.shape[1]) <= 6


def test_no_sheet():
    assert P.quad(np.full((60, 80), 255, np.uint8)) is None
    yy, xx = np.mgrid[0:200, 0:200]
    assert P.quad(np.where((xx - 100) ** 2 + (yy - 100) ** 2 < 80**2, 220, 20).astype(np.uint8)) is None


def test_painting_over():
    flat = np.full((40, 50), 77, np.uint8)
    hole = np.zeros_like(flat)
    hole[10:17, 5:45] = 255
    spoilt = np.where(hole > 0, 0, flat).astype(np.uint8)
    assert np.array_equal(resampling.painted_over(spoilt, hole), flat)
    ramp = np.tile(np.arange(50, 250, 4, dtype=np.uint8), (40, 1))
    got = resampling.painted_over(np.where(hole > 0, 0, ramp).astype(np.uint8), hole)
    assert np.abs(got.astype(int) - ramp)[hole > 0].max() <= 12 and np.array_equal(got[hole == 0], ramp[hole == 0])
    edge = np.where(np.arange(50) < 25, 0, 255).astype(np.uint8) * np.ones((40, 1), np.uint8)  # an edge goes on through the gap
    got = resampling.painted_over(np.where(hole > 0, 128, edge).astype(np.uint8), hole)
    assert ((got > 127) == (edge > 127)).mean() > 0.99
    everything = np.full_like(flat, 255)
    assert np.array_equal(resampling.painted_over(flat, everything), flat) and np.array_equal(resampling.painted_over(flat, 0 * flat), flat)
    one = np.zeros((9, 9), np.uint8)
    one[4, 4] = 1
    values = np.random.default_rng(5).integers(0, 256, (9, 9)).astype(np.uint8)
    got = resampling.painted_over(values, one)
    assert np.delete(values.ravel(), 40).min() <= got[4, 4] <= np.delete(values.ravel(), 40).max()


def test_grids_are_painted_over_and_curves_stay(spark):
    t = np.arange(300) / 300
    ys = np.round(150 - 100 * (1 - ((t - 0.6) / 0.6) ** 2)).astype(int)
    plain = P.drawn(ys, 200, 340, 20, 5)
    ruled = images.ruled(rows_of(spark, {"a": plain}), 40, 2)
    g = np.frombuffer(images.without_grid(ruled).first().data, np.uint8).reshape(200, 340)
    off = plain == 255
    dirty = np.frombuffer(ruled.first().data, np.uint8).reshape(200, 340)
    assert (dirty[off] < 128).mean() > 0.08 and (g[off] < 128).mean() < 0.01
    got = dict(P.traced(P.filtered(dirty)[0]))
    assert len(got) > 250 and np.mean([abs(got[20 + k] - y) <= 3 for k, y in enumerate(ys) if 20 + k in got]) > 0.9


def test_resampling():
    a = np.random.default_rng(1).integers(0, 256, (6, 8)).astype(np.uint8)
    assert np.array_equal(resampling.resized(a, 6, 8, "cubic"), a) and np.array_equal(resampling.resized(a, 6, 8, "area"), a)
    half = a.reshape(3, 2, 4, 2).mean(axis=(1, 3))
    assert np.array_equal(resampling.resized(a, 3, 4, "area"), np.rint(half).astype(np.uint8))
    w = resampling.cubic_weights(np.array([0.0, 0.25, 0.5]))
    assert np.allclose(w.sum(axis=1), 1) and np.allclose(w[0], [0, 1, 0, 0]) and np.allclose(w[2], [-0.09375, 0.59375, 0.59375, -0.09375])
    assert resampling.resized(np.stack([a] * 3, axis=-1), 12, 16, "linear").shape == (12, 16, 3)
    assert np.array_equal(resampling.rotated(a, 0), a) and np.array_equal(resampling.rotated(a, 0, "linear"), a)
    yy, xx = np.mgrid[0:6, 0:8]
    assert np.array_equal(resampling.sampled(a, xx + 0.0, yy + 0.0, "cubic"), a) and resampling.sampled(a, np.array([[-3.0]]), np.array([[1.0]]), "linear", 0)[0, 0] == 0


def test_bilateral_is_the_plain_definition():
    g = np.random.default_rng(2).integers(0, 256, (15, 18)).astype(np.uint8)
    p = np.pad(g.astype(float), 4, mode="reflect")
    want = np.zeros(g.shape)
    for y in range(15):
        for x in range(18):
            top = bottom = 0.0
            for i in range(-4, 5):
                for j in range(-4, 5):
                    if i * i + j * j <= 16:
                        v = p[y + 4 + i, x + 4 + j]
                        k = np.exp(-((v - g[y, x]) ** 2) / (2 * 75**2) - (i * i + j * j) / (2 * 75**2))
                        top, bottom = top + k * v, bottom + k
            want[y, x] = top / bottom
    assert np.abs(P.bilateral(g).astype(int) - np.rint(want)).max() <= 1 and (P.bilateral(g) == np.rint(want)).mean() > 0.99


def test_outline_traces_and_refinement(spark):
    a = P.gray(chart())
    points, area, arc = P.traced_outline(P.filtered(a)[0][:246, 55:])
    xs = [x for x, _ in points]
    assert xs == sorted(set(xs)) and len(xs) > 8 and arc > 300 and area > 100
    g = np.full((30, 20), 255, np.uint8)
    g[12] = 10
    assert P.refined(g, [(3, 9), (4, 12), (5, 29), (0, 0)]) == [(3, 12), (4, 12), (5, 29), (0, 0)] and P.refined(g, []) == []
    df = rows_of(spark, {"a": drawn()[0]})
    for trace in extraction.TRACES:
        r = extraction.extract(df, method="contour", rectify=False, trace=trace, refine=True).first()
        assert r.extraction_method == "contour_tracing_refined" and r.features is not None and len(r.data_points) > 5
    with pytest.raises(ValueError):
        extraction.digitised(df, trace="x")


def test_every_image_is_processed_once(spark, tmp_path):
    seen = tmp_path / "calls"
    seen.mkdir()

    def reader(part, kind):
        import uuid

        (seen / f"{kind}-{uuid.uuid4().hex}").touch()
        return []

    pictures = {f"i{k}": chart(120, 160 + k) for k in range(4)}
    out = extraction.extract(rows_of(spark, pictures), reader, method="contour", rectify=False)
    assert out.count() == 4 and len(out.collect()) == 4
    calls = [f.name.split("-")[0] for f in seen.iterdir()]
    assert {k: calls.count(k) for k in set(calls)} == dict.fromkeys(("x", "y", "x_label", "y_label"), 4)


def test_a_model_on_a_grid_of_its_own(spark):
    a = np.full((60, 80, 3), 255, np.uint8)
    a[29:32] = 0

    def model(small):
        assert small.shape == (32, 32, 3)
        return np.where(small[..., 0] < 200, 0.9, 0.1)

    df = rows_of(spark, {"a": a})
    got = images.segment(df, model, size=32).where("error is null").collect()
    assert len(got) > 60 and all(abs(r.py - 30) <= 2 and 0.5 < r.confidence <= 0.9 for r in got)
