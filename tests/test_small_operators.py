"""Operators that no catalogue query exercises."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from curvelab import config
from curvelab.functions import text as T
from curvelab.operators import contours, merge, scale
from curvelab.streaming import arrivals


def one(spark, *columns):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first()


def test_masks(spark):
    m = lambda *p: spark.createDataFrame([("i", x, y) for x, y in p], "image_id string, px int, py int")
    a, b = m((0, 0), (1, 1)), m((1, 1), (2, 2))
    assert {(r.px, r.py) for r in merge.mask_union(a, b).collect()} == {(0, 0), (1, 1), (2, 2)}
    assert {(r.px, r.py) for r in merge.mask_minus(a, b).collect()} == {(0, 0)}
    p = a.withColumn("p", F.lit(0.5) + F.col("px") * 0.25)
    assert merge.mean_probability(p, a).first().probability == pytest.approx(0.625)
    assert one(spark, merge.dice(F.lit(3.0), F.lit(4.0), F.lit(5.0))).c0 == pytest.approx(0.7)


def test_box_and_region(spark):
    x, y = scale.box_mapping(F.lit(425.0), F.lit(285.0), (100, 50, 750, 520), (0.0, 6.0), (0.0, 5000.0))
    r = one(spark, x, y, scale.plot_region(F.lit(800), F.lit(600)))
    assert (r.c0, r.c1) == (pytest.approx(3.0), pytest.approx(2500.0)) and (r.c2.x, r.c2.origin_x, r.c2.origin_y, r.c2.height) == (120, 120, 510, 510)


def test_text(spark):
    ts = F.lit(datetime(2024, 3, 5, 14, 7))
    r = one(spark, T.short_id(F.lit("abcdefghij")), T.megabytes(F.lit(2097152)), T.comma_list(F.lit("a, ,b ,")), T.shown_method(F.lit("a_b_c")), T.shown_time(ts), T.is_plain_number(F.lit("-1.5")), T.is_plain_number(F.lit("1-2")), T.percent(F.lit(0.1234)))
    assert tuple(r) == ("abcdefgh", 2.0, ["a", "b"], "a b c", "Mar 5, 02:07 PM", True, False, "12.3%")


def test_corners(spark):
    p = spark.createDataFrame([("i", 0, 0), ("i", 9, 1), ("i", 10, 8), ("i", 1, 7), ("i", 5, 5)], "img string, x int, y int")
    r = contours.corners(p, ["img"]).first()
    assert [tuple(c) for c in (r.top_left, r.top_right, r.bottom_right, r.bottom_left)] == [(0, 0), (9, 1), (10, 8), (1, 7)]


def test_windows_drop_late_events(spark, tmp_path):
    schema = "user_id long, ts timestamp, value double"
    for k, rows in enumerate(([(1, datetime(2024, 1, 1, 1), 5.0), (1, datetime(2024, 1, 1, 2), 9.0)], [(1, datetime(2024, 1, 3, 0), 1.0)], [(1, datetime(2024, 1, 1, 3), 99.0), (1, datetime(2024, 1, 5), 2.0)], [(1, datetime(2024, 1, 9), 2.0)])):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    q = arrivals.window_features(stream).writeStream.format("memory").queryName("windows").outputMode("append").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/state").start()
    q.awaitTermination()
    first = spark.table("windows").where("start = timestamp'2024-01-01'").first()
    assert first.n >= 2 and first.low == 5.0 and spark.table("windows").count() >= 2


def test_doctor():
    assert config.doctor()["numpy"] and isinstance(config.settings().smoothing_window, int)


def test_the_table_function_agrees_with_the_operator(spark, sf_dir):
    from curvelab.functions.register import register
    from curvelab.operators import curves, features
    from curvelab.sources import readers

    c = curves.from_points(readers.event_points(spark.read.parquet(f"{sf_dir}/events.parquet")).unionByName(readers.synthetic_curves(spark, 3).withColumn("curve_id", F.col("curve_id") - 10)))
    register(spark)
    c.createOrReplaceTempView("some_curves")
    got = spark.sql("SELECT curve_id, p.* FROM some_curves, LATERAL critical_points(xs, ys) p")
    key = lambda rows: sorted((r.curve_id, r.point, round(r.strain, 6), round(r.stress, 6)) for r in rows)
    assert key(got.collect()) == key(features.critical_points(c).collect()) and {r.point for r in got.collect()} == {"Peak", "50% Peak", "Yield"}


def test_bare_cells(spark, tmp_path):
    from curvelab.sources import sinks

    p = spark.createDataFrame([(0, 0.5, 1.25, 0, 7)], "idx int, strain double, stress double, pixel_x int, pixel_y int")
    sinks.write_csv(p.coalesce(1), f"file://{tmp_path}/csv", pixels=True, decimals=2, blank="")
    (out,) = (tmp_path / "csv").glob("*.csv")
    assert out.read_bytes().decode().splitlines()[1] == "0.50,1.25,,7"


def test_robust_lines(spark):
    t = spark.createDataFrame([("a", float(x), 2.0 * x + 1) for x in range(6)] + [("a", 2.5, 90.0), ("b", 1.0, 1.0), ("b", 1.0, 5.0), ("c", 0.0, 3.0), ("c", 4.0, None)], "g string, x double, y double")
    (r,) = scale.fit_robust(t, ["g"]).collect()
    assert (r.g, r.inliers, r.slope, r.intercept, r.r2) == ("a", 6, pytest.approx(2), pytest.approx(1), pytest.approx(1))


def test_splines_go_through_their_points():
    import numpy as np

    from curvelab.functions import pixels as P

    rng = np.random.default_rng(0)
    knots = [(int(x), int(y)) for x, y in zip(np.cumsum(rng.integers(3, 9, 30)), rng.integers(0, 60, 30))]
    out = np.array(P.spline(knots, 3000))
    assert len(out) == 3000 and all(np.hypot(*(out - k).T).min() <= 1.5 for k in knots)
    level = P.spline([(x, 50) for x, _ in knots], 400)
    assert {y for _, y in level} == {50} and level[0][0] == knots[0][0] and level[-1][0] == knots[-1][0]
    assert len(P.spline([(i, i % 7) for i in range(4000)], 50)) == 50
    trace = [(x, int(100 + 20 * np.sin(x / 15) + rng.integers(-3, 4))) for x in range(200)]
    smooth = P.smoothed_curve(trace)
    assert len(smooth) == 200 and np.abs(np.diff([y for _, y in smooth])).mean() < np.abs(np.diff([y for _, y in trace])).mean() and P.smoothed_curve(trace[:3]) == trace[:3]
