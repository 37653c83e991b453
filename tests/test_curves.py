"""Curves and features: published goldens, numpy parity, properties, and defined results at the edges."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from curvelab.functions import arrays as A
from curvelab.operators import curves as C
from curvelab.operators import features

GOLD = {
    "F6": dict(peak_index=60, peak_stress=1103.51940, failure_strain=3.01507538, initial_modulus=916.595076, secant_modulus_50=790.539252, energy_to_peak=2393.849035, confidence=1.0),
    "G1": dict(peak_index=93, peak_stress=4198.71225, failure_strain=2.57035176, initial_modulus=2727.01924, secant_modulus_50=1998.19979, energy_to_peak=6128.03649, confidence=0.99967323),
}


def f6():
    s = np.linspace(0, 10, 100)
    return s, 1000 * s * np.exp(-s / 3)


def g1():
    s = np.linspace(0, 5.5, 200)
    return s, np.where(s <= 2.5, 4200 * (s / 2.5) ** 0.8, 4200 * (1 - 0.4 * (np.maximum(s - 2.5, 0) / 3) ** 1.5))


def points(spark, curves):
    rows = [(name, i, float(a), None if b is None else float(b)) for name, (x, y) in curves.items() for i, (a, b) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "curve_id string, idx int, x double, y double")


@pytest.fixture(scope="module")
def analysed(spark):
    rng = np.random.default_rng(0)
    x6, y6 = f6()
    mix = rng.permutation(100)
    cases = {
        "F6": f6(), "G1": g1(), "F6-mixed": (x6[mix], y6[mix]), "F6-tall": (x6, 3 * y6), "F6-moved": (x6 + 2, y6), "one": ([1.0], [5.0]), "four": ([1, 2, 3, 4], [1, 9, 9, 2]), "five": ([0, 1, 2, 3, 4], [0, 3, 5, 4, 1]),
        "flat": (np.arange(30.0), np.full(30, 7.0)), "rising": (np.arange(30.0), np.arange(30.0) ** 2), "negative": (np.arange(30.0), -5 - (np.arange(30.0) - 10) ** 2), "twice": ([0, 1, 1, 2, 3, 4, 5], [0, 4, 99, 6, 5, 3, 1]),
        "nan": ([0, 1, 2, 3, 4, 5, 6], [0, 3, math.nan, 5, 6, 4, 1]), "null": ([0, 1, 2, 3, 4, 5, 6], [0, 3, None, 5, 6, 4, 1]),
    }
    return {r.curve_id: r for r in features.analyze(C.from_points(points(spark, cases))).collect()}


@pytest.mark.parametrize("name", GOLD)
def test_goldens(analysed, name):
    for k, v in GOLD[name].items():
        assert getattr(analysed[name], k) == pytest.approx(v, rel=1e-6), k
    assert analysed[name].post_peak


def test_properties(analysed):
    a = analysed["F6"]
    assert analysed["F6-mixed"][1:] == a[1:]
    assert analysed["F6-tall"].peak_stress == pytest.approx(3 * a.peak_stress) and analysed["F6-tall"].peak_index == a.peak_index
    assert analysed["F6-moved"].peak_index == a.peak_index and analysed["F6-moved"].failure_strain == pytest.approx(a.failure_strain + 2)
    assert a.energy_to_peak_kj_m3 == pytest.approx(a.energy_to_peak / 100)


def test_edges(analysed):
    assert (analysed["one"].peak_stress, analysed["one"].failure_strain, analysed["one"].confidence) == (5, 1, 0)
    assert (analysed["four"].peak_stress, analysed["four"].failure_strain, analysed["four"].post_peak) == (9, 2, False)
    assert analysed["five"].peak_stress > 4 and analysed["flat"].peak_stress == pytest.approx(7)
    assert analysed["rising"].peak_index == 199 and not analysed["rising"].post_peak
    assert analysed["negative"].peak_stress < 0 and not math.isnan(analysed["negative"].confidence)
    assert analysed["nan"][1:] == analysed["null"][1:]
    assert analysed["twice"].peak_stress < 10  # the first of equal x counts


def savgol(y, w=11):
    h, m = w // 2, A.savgol_matrix(w)
    out = np.convolve(y, m[h][::-1], mode="same")
    out[:h], out[-h:] = m[:h] @ y[:w], m[h + 1 :] @ y[-w:]
    return out


def test_numpy_parity(spark):
    rng = np.random.default_rng(5)
    x, y = np.sort(rng.uniform(0, 9, 80)), rng.normal(size=80)
    got = C.derivative(C.smooth(C.resample(C.from_points(points(spark, {"a": (x, y)}))))).first()
    grid = np.linspace(x[0], x[-1], 200)
    want = savgol(np.interp(grid, x, y))
    assert np.allclose(got.xs, grid) and np.allclose(got.ys, want) and np.allclose(got.ds, np.gradient(want, grid))
    g = C.gaussian(C.from_points(points(spark, {"a": (x, y)}))).first()
    taps = np.array(A.gaussian_taps())
    assert np.allclose(g.ys, np.convolve(np.pad(y, 8, mode="symmetric"), taps, mode="valid"))


def test_filters_are_the_published_ones():
    assert np.allclose(A.savgol_matrix(11)[5] * 429, [-36, 9, 44, 69, 84, 89, 84, 69, 44, 9, -36])
    assert np.allclose(A.savgol_matrix(5)[0] * 70, [69, 4, -6, 4, -1])
    assert [C.window_of(w, 200) for w in (None, 0, 4, 10, 11, 500)] == [11, 11, 5, 9, 11, 199]


def plain_peaks(y):
    out = []
    i = 1
    while i < len(y) - 1:
        if y[i] > y[i - 1]:
            r = i
            while r < len(y) - 1 and y[r + 1] == y[i]:
                r += 1
            if r < len(y) - 1 and y[r + 1] < y[i]:
                k = (i + r) // 2
                a = k
                while a >= 0 and y[a] <= y[k]:
                    a -= 1
                b = k
                while b < len(y) and y[b] <= y[k]:
                    b += 1
                out.append((k, y[k] - max(min(y[a + 1 : k + 1]), min(y[k:b]))))
            i = r
        i += 1
    return out


def test_prominence(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(v) for v in rng.integers(0, 6, 40)]) for i in range(30)] + [(99, [1.0, 2.0])]
    got = spark.createDataFrame(rows, "i int, y array<double>").select("i", A.prominent_peaks(F.col("y")).alias("p")).collect()
    for (_, y), r in zip(rows, sorted(got)):
        assert [(p.k, p.prominence) for p in r.p] == plain_peaks(y)


def test_critical_points_and_crossings(spark):
    got = {r.point: r for r in features.critical_points(C.from_points(points(spark, {"a": f6()}))).collect()}
    assert set(got) <= {"Peak", "50% Peak", "Yield"} and got["Peak"].stress == pytest.approx(1103.5194)
    z = spark.range(1).select(A.zero_crossings(F.array(*map(F.lit, [1.0, -1.0, 2.0, 0.0, 3.0, -9.0]))).alias("z")).first().z
    assert [(c.i, c.z, c.j) for c in z] == [(1, 0.5, 0), (3, 3.0, 3), (5, 4.25, 4)]


def test_median_and_first(spark):
    p = spark.createDataFrame([("a", i, x, y) for i, (x, y) in enumerate([(1, 5.0), (1, 8.0), (2, 3.0), (1, 7.0), (3, -2.5), (3, -2.0)])], "curve_id string, idx int, x int, y double")
    assert {(r.x, r.y) for r in C.median_by_x(p).collect()} == {(1, 7), (2, 3), (3, -2)}
    assert {(r.x, r.y) for r in C.dedup_first(p).collect()} == {(1, 5.0), (2, 3.0), (3, -2.5)}


def test_window_option():
    assert features.window_for(True, 21) == 21 and features.window_for(False, 21) == 5
    with pytest.raises(ValueError):
        features.window_for(True, 52)
