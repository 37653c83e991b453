"""Charts from image to result record."""

import numpy as np
import pytest

from curvelab.functions import pixels as P
from curvelab.operators import extraction
from tests.test_images import line, rows_of


def drawn(peak_at=0.7, h=300, w=400):
    """A chart whose curve rises from the axes' origin to 160 above it and falls again; plot margins as the detector has them."""
    a = np.full((h, w, 3), 255, np.uint8)
    left, bottom = int(w * 0.15), h - int(h * 0.15)
    xs = np.arange(left + 8, w - 20)
    t = (xs - left) / (w - 20 - left)
    ys = (bottom - 160 * (1 - ((t - peak_at) / max(peak_at, 1 - peak_at)) ** 2) - 20).astype(int)
    for x, y, x2, y2 in zip(xs, ys, xs[1:], ys[1:]):
        line(a, x, y, x2, y2)
    return a, dict(zip(xs.tolist(), ys.tolist()))


def reader(left, bottom):
    """Ticks every 50 pixels in the frame of the whole image: x counts 0.5 a tick, y 1000."""

    def read(part, kind):
        if kind == "x_label":
            return [("Strain", 90.0, 0, 0, 1, 1), ("(%)", 90.0, 0, 0, 1, 1)]
        if kind == "y_label":
            return [("Stress [kPa]", 90.0, 0, 0, 1, 1)]
        if kind == "x":
            return [(str(k * 0.5), 90.0, left + 50 * k - 5, 0, 10, 10) for k in range(6)] + [("xy", 95.0, 0, 0, 9, 9), ("7", 10.0, 0, 0, 9, 9)]
        return [(str(k * 1000), 80.0, 0, bottom - 50 * k - 5, 10, 10) for k in range(4)]

    return read


def test_regions_cover_the_margins():
    a = np.arange(200 * 100).reshape(200, 100)
    r = extraction.axis_regions(a)
    assert [(k, v[0].shape, v[1:]) for k, v in r.items()] == [("x", (30, 85), (15, 170)), ("y", (170, 15), (0, 0)), ("x_label", (15, 100), (0, 185)), ("y_label", (200, 7), (0, 0))]


def test_charts_to_records(spark):
    charts = {f"c{k}": drawn(at) for k, at in enumerate((0.5, 0.6, 0.7))}
    left, bottom = 60, 255
    df = rows_of(spark, {n: a for n, (a, _) in charts.items()})
    got = {r.image_id: r for r in extraction.extract(df, reader(left, bottom), method="contour", rectify=False).collect()}
    assert set(got) == set(charts)
    for n, (_, curve) in charts.items():
        r = got[n]
        assert r.status == "completed" and r.error is None and r.units == "calibrated" and r.extraction_method == "contour_tracing"
        assert (r.x_axis.label, r.x_axis.unit, r.x_axis.tick_count, r.y_axis.unit, r.y_axis.tick_count) == ("Strain", "%", 6, "kPa", 4)
        assert (r.x_axis.min_value, r.x_axis.max_value, r.y_axis.min_value, r.y_axis.max_value) == (0.0, 2.5, 3000.0, 0.0)
        assert r.scale.x_scale == pytest.approx(0.01) and r.scale.y_scale == pytest.approx(20.0) and r.scale.x_r2 == pytest.approx(1)
        top = min(curve.values())
        at = np.mean([x for x, y in curve.items() if y == top])
        assert abs(r.features.peak_stress / ((bottom - top) * 20.0) - 1) < 0.07 and abs(r.features.failure_strain / ((at - left) * 0.01) - 1) < 0.07
        assert len(r.data_points) > 250 and r.confidence.grade in "ABCD" and r.critical_points[0].point == "Peak" and r.critical_points[0].stress == r.features.peak_stress
        strains = [p.strain for p in r.data_points]
        assert strains == sorted(strains)


def test_what_cannot_be_read(spark):
    a, _ = drawn()
    df = rows_of(spark, {"plain": a, "blank": np.full((100, 120, 3), 255, np.uint8)}).unionByName(spark.createDataFrame([("bad", 10, 10, 3, bytearray(b"x"))], rows_of(spark, {"plain": a}).schema))
    got = {r.image_id: r for r in extraction.extract(df, method="contour").collect()}
    assert got["bad"].status == "failed" and got["bad"].error and got["bad"].features is None
    assert got["plain"].units == "pixel" and got["plain"].x_axis.tick_count == 0 and got["plain"].y_axis.unit == extraction.Y_UNIT and got["plain"].features is not None
    assert got["blank"].data_points == [] and got["blank"].features is None
    def broken(part, kind):
        raise OSError("no recogniser")
    assert extraction.extract(df.where("image_id = 'plain'"), broken, method="contour").first().x_axis.tick_count == 0
    # poor images are left to the network; without one they have no points
    auto = {r.image_id: r.extraction_method for r in extraction.extract(df).collect()}
    assert auto["blank"] == "unet_primary"
    with pytest.raises(ValueError):
        extraction.extract(df, frame="x")


def test_skewed_charts_are_levelled(spark):
    a, _ = drawn()
    line(a, 60, 255, 380, 255)
    r = extraction.extract(rows_of(spark, {"a": P.rotated(a, 4)}), method="contour").first()
    assert 2 <= abs(r.angle) <= 6 and r.status in ("completed", "failed") and len(r.data_points) > 50
