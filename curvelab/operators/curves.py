"""Curves from points: order, first of equal x, median of equal x, resampling, smoothing, derivative.

``points`` have (curve_id, idx, x, y); ``curves`` have (curve_id, xs, ys), one
row per curve, from the one shuffle by curve_id that all later steps share.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curvelab.functions import arrays as A
from curvelab.functions.parts import simplified

GRID, WINDOW, ORDER, MIN_POINTS = 200, 11, 3, 5


def ordered(points: DataFrame, x: str = "x", y: str = "y", idx: str = "idx") -> DataFrame:
    """curves, sorted by (x, idx); points whose x or y is null or NaN are left out."""
    valid = points.where(A.finite(F.col(x)).isNotNull() & A.finite(F.col(y)).isNotNull())
    by = valid.groupBy("curve_id").agg(F.sort_array(F.collect_list(F.struct(F.col(x).cast("double").alias("x"), F.col(idx).alias("i"), F.col(y).cast("double").alias("y")))).alias("p"))
    return by.select("curve_id", F.transform("p", lambda p: p["x"]).alias("xs"), F.transform("p", lambda p: p["y"]).alias("ys"))


def dedup_first(points: DataFrame) -> DataFrame:
    """The first point (by idx) of each x, as points."""
    first = points.groupBy("curve_id", "x").agg(F.min_by(F.struct("idx", "y"), "idx").alias("p"))
    return first.select("curve_id", F.col("p.idx").alias("idx"), "x", F.col("p.y").alias("y"))


def median_by_x(points: DataFrame) -> DataFrame:
    """The median y of each x, cut to a whole number."""
    return points.groupBy("curve_id", "x").agg(F.median("y").cast("int").alias("y"))


def _keep_first(xs: Column, ys: Column) -> Column:
    def body(c: Column) -> Column:
        keep = F.filter(A.indices(c["x"]), lambda i: (i == 0) | (F.get(c["x"], i) != F.get(c["x"], i - 1)))
        return A.let(keep, lambda k: F.struct(F.transform(k, lambda i: F.get(c["x"], i)).alias("xs"), F.transform(k, lambda i: F.get(c["y"], i)).alias("ys")))

    return A.let(F.struct(xs.alias("x"), ys.alias("y")), body)  # the arrays once, not once for every point


def from_points(points: DataFrame) -> DataFrame:
    """curves with strictly rising x: the first of equal x stays."""
    return A.settled(ordered(points), d=_keep_first(F.col("xs"), F.col("ys"))).select("curve_id", F.col("d.xs").alias("xs"), F.col("d.ys").alias("ys"))


def window_of(wanted: int | None, n: int) -> int:
    """The smoothing window for n samples: odd, at most n-1, at least 5; nothing means the default."""
    w = min(wanted or WINDOW, n - 1)
    return max(5, w - (w % 2 == 0))


def resample(curves: DataFrame, n: int = GRID) -> DataFrame:
    """Curves of MIN_POINTS or more on n evenly spaced x, by linear interpolation."""
    return _resampled(curves.where(F.size("xs") >= MIN_POINTS).select("curve_id", "xs", "ys"), n)


def _resampled(curves: DataFrame, n: int = GRID) -> DataFrame:
    """The same of curves that are long enough, with all else that is in their rows; null ones stay null."""
    lo, hi = F.get("xs", F.lit(0)), F.get("xs", F.size("xs") - 1)
    on = A.settled(curves, grid=F.when(F.col("xs").isNotNull(), A.linspace(lo, hi, n)))
    on = A.settled(on, y=F.when(F.col("grid").isNotNull(), A.interpolate(F.col("xs"), F.col("ys"), F.col("grid"))))
    return on.select(*[c for c in curves.columns if c not in ("xs", "ys")], F.col("grid").alias("xs"), F.col("y").alias("ys"))


def smooth(curves: DataFrame, window: int | None = None, n: int = GRID) -> DataFrame:
    """Resampled curves with their Savitzky-Golay smoothed y."""
    return A.settled(curves, s=A.smooth(F.col("ys"), window_of(window, n), ORDER)).withColumn("ys", F.col("s")).drop("s")


def derivative(curves: DataFrame) -> DataFrame:
    """curves with ds, the gradient of ys over xs."""
    return A.settled(curves, ds=A.gradient(F.col("ys"), F.col("xs")))


def gaussian(curves: DataFrame, sigma: float = 2.0) -> DataFrame:
    return A.settled(curves, s=A.gaussian(F.col("ys"), sigma)).withColumn("ys", F.col("s")).drop("s")


def exploded(curves: DataFrame, **columns: str) -> DataFrame:
    """(curve_id, k, ...): a row per sample; columns maps new names to array columns."""
    zipped = F.arrays_zip(*[F.col(a).alias(n) for n, a in columns.items()])
    return curves.select("curve_id", F.posexplode(zipped).alias("k", "v")).select("curve_id", "k", *[F.col("v")[n].alias(n) for n in columns])


def region_crop(points: DataFrame, x: int, y: int, width: int, height: int) -> DataFrame:
    """Pixels with x <= px < x+width and y <= py < y+height."""
    return points.where((F.col("px") >= x) & (F.col("px") < x + width) & (F.col("py") >= y) & (F.col("py") < y + height))


def simplify(curves: DataFrame, epsilon: float, closed: bool = False) -> DataFrame:
    """curves with the points only that a polyline needs to stay within ``epsilon`` of all of them; ``closed`` ones end where they begin."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            kept = [simplified(np.column_stack([x, y]), epsilon, closed) if x is not None and len(x) else np.zeros((0, 2)) for x, y in zip(pdf["xs"], pdf["ys"], strict=True)]
            yield pd.DataFrame({"curve_id": pdf["curve_id"], "xs": [k[:, 0].tolist() for k in kept], "ys": [k[:, 1].tolist() for k in kept]})

    kind = curves.schema["curve_id"].dataType.simpleString()
    return curves.select("curve_id", "xs", "ys").mapInPandas(run, f"curve_id {kind}, xs array<double>, ys array<double>")
