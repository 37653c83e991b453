"""Curves as rows in ranges, against the forms of one row a curve."""

import pytest
from pyspark.sql import functions as F

from curvelab.functions import arrays as A
from curvelab.operators import curves as C
from curvelab.operators import long_curves as L
from curvelab.sources import readers
from tests.conftest import SF


@pytest.fixture(scope="module")
def points(spark):
    events = readers.event_points(spark.read.parquet(f"{SF}/events.parquet"))
    odd = spark.createDataFrame([(901, 1, 1.0, 2.0), (902, 1, 0.0, 1.0), (902, 2, 2.0, 5.0), (902, 3, 0.0, 9.0), (903, 1, None, 1.0), (904, 1, float("nan"), 1.0), (905, 1, 3.0, None), (None, 1, 0.0, 0.0)] + [(906, k, k * k / 7, float(k % 5)) for k in range(6)], "curve_id long, idx long, x double, y double")
    return events.select(*[F.col(c).cast(t).alias(c) for c, t in (("curve_id", "long"), ("idx", "long"), ("x", "double"), ("y", "double"))]).unionByName(odd).cache()


def rows(df, *columns):
    return {tuple(r[c] for c in columns[:2]): r[columns[2]] for r in df.collect()}


@pytest.mark.parametrize("parts", [1, 7, 64])
def test_the_same_as_arrays(spark, points, parts):
    p = L.placed(points, parts)
    assert parts == 1 or p.select("part").distinct().count() > parts // 2
    curves = C.from_points(points.where("curve_id is not null"))
    for n in (200, 17):
        want = rows(C.exploded(C.resample(curves, n), y="ys"), "curve_id", "k", "y")
        got = rows(L.resample(p, n), "curve_id", "k", "y")
        assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], rel=1e-12, abs=1e-12) for k in want)
    want = rows(C.exploded(A.settled(curves, d=A.gradient(F.col("ys"), F.col("xs"))).where("d is not null"), x="xs", d="d"), "curve_id", "x", "d")
    got = rows(L.gradient(p).where("d is not null"), "curve_id", "x", "d")
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], rel=1e-9) for k in want)
    want = {r.curve_id: r.a for r in curves.select("curve_id", A.trapezoid(F.col("ys"), F.col("xs"), F.size("xs") - 1).alias("a")).collect()}
    got = {r.curve_id: r.area for r in L.area(p).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], rel=1e-9) for k in want)
    last = {r.curve_id: r.a for r in L.running_area(p).groupBy("curve_id").agg(F.max_by("area", "x").alias("a")).collect()}
    assert all(last[k] == pytest.approx(want[k], rel=1e-9) for k in want)


def test_one_long_curve_is_spread_over_tasks(spark):
    n = 2_000_000
    line = spark.range(n).select(F.lit(1).alias("curve_id"), F.col("id").alias("idx"), (F.col("id") / 1000).alias("x"), (F.col("id") % 2 + F.col("id") / 500).alias("y"))
    p = L.placed(line, 16)
    sizes = [r["count"] for r in p.groupBy("part").count().collect()]
    assert len(sizes) == 16 and max(sizes) < 2 * n / 16
    assert L.area(p).first().area == pytest.approx(sum((k % 2 + k / 500 + (k - 1) % 2 + (k - 1) / 500) / 2 / 1000 for k in range(1, n)), rel=1e-6)
    assert L.resample(p, 1000).count() == 1000 and p.select("curve_id").distinct().count() == 1


def test_no_points(spark):
    p = L.placed(spark.createDataFrame([], "curve_id long, idx long, x double, y double"))
    assert L.resample(p).collect() == L.gradient(p).collect() == L.area(p).collect() == L.running_area(p).collect() == []
