"""What the findings of round 4 asked for."""

import tracemalloc

import numpy as np
from pyspark.sql import functions as F

from curvelab.functions import arrays as A
from curvelab.functions import pixels as P
from curvelab.operators import curves as C
from curvelab.operators import extraction, features
from curvelab.plans import queries as catalogue
from tests.test_images import rows_of


def test_images_are_mapped_and_analysed_once(spark):
    df = rows_of(spark, {"blank": np.full((100, 120, 3), 255, np.uint8)})
    plan = extraction.extract(df, method="contour")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("struct(mapped,") == 1 and "Join" not in plan  # three times before, and joined


def test_equal_x_are_left_out_without_making_the_arrays_for_every_point():
    made = C._keep_first(F.col("the_xs"), F.col("the_ys"))._jc.toString()
    assert made.count("the_xs") == made.count("the_ys") == 1


def test_short_and_long_curves_are_analysed_in_their_rows(spark):
    rows = [(1, "a", [0.0, 1.0, 2.0], [1.0, 5.0, 2.0]), (2, "b", [float(k) for k in range(30)], [float(-((k - 20) ** 2)) + 500 for k in range(30)]), (3, "c", [], []), (4, "d", None, None)]
    got = {r.curve_id: r for r in features.analyze(spark.createDataFrame(rows, "curve_id int, note string, xs array<double>, ys array<double>")).collect()}
    assert set(got) == {1, 2, 3} and [got[k].note for k in (1, 2, 3)] == ["a", "b", "c"]  # other columns were lost before
    assert (got[1].peak_stress, got[1].failure_strain, got[1].peak_index, got[1].confidence, got[1].post_peak, got[1].critical_points) == (5.0, 1.0, 1, 0.0, False, [])
    assert (got[3].peak_stress, got[3].failure_strain, got[3].peak_index) == (0.0, 0.0, 0)
    assert abs(got[2].failure_strain - 20) < 0.2 and abs(got[2].peak_stress - 500) < 1 and got[2].confidence > 0.5


def test_extremes_of_long_windows_take_few_steps():
    a, steps = np.random.default_rng(1).integers(0, 256, (30, 40)).astype(np.uint8), []
    got = P._extreme(a, 1, 15, lambda x, y: steps.append(1) or np.minimum(x, y), 255)
    p = np.pad(a, ((0, 0), (7, 7)), constant_values=255)
    assert (got == np.min([p[:, k : k + 40] for k in range(15)], axis=0)).all() and len(steps) == 4  # 15 before


def test_rows_are_convolved_a_few_at_a_time():
    a, kernel = np.random.default_rng(2).integers(0, 256, (600, 800)).astype(np.uint8), np.array([[0.1], [0.2], [0.4], [0.2], [0.1]])
    a[100:300] = 255
    P.convolve(a, kernel)
    tracemalloc.start()
    got = P.convolve(a, kernel)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    p = np.pad(a.astype(float), ((2, 2), (0, 0)), mode="reflect")
    assert np.allclose(got, sum(kernel[i, 0] * p[i : i + 600] for i in range(5))) and peak < 10e6  # 11.6 MB with all rows at once


def test_charts_are_dealt_over_more_tasks_than_cores(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(extraction, "extract", lambda drawn, **_: drawn)
    assert catalogue.charts(spark, sf_dir).rdd.getNumPartitions() == 4 * spark.sparkContext.defaultParallelism  # one a core before


def test_slopes_of_few_points(spark):
    rows = [([0.0, 2.0], [1.0, 5.0]), ([0.0, 1.0, 3.0], [0.0, 1.0, 9.0]), ([1.0], [1.0]), ([0.0, 0.0, 1.0], [1.0, 2.0, 3.0])]
    got = [r.d for r in spark.createDataFrame(rows, "x array<double>, y array<double>").select(A.gradient(F.col("y"), F.col("x")).alias("d")).collect()]
    assert got == [[2.0, 2.0], [1.0, 2.0, 4.0], None, [None, None, 1.0]]

