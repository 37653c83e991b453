"""Comparison of an extracted curve with its ground truth on their common range."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curvelab.functions import arrays as A

PASS, GRID, GRID_MAE = 0.95, 100, 50


def _overlap(n: int) -> tuple[Column, Column, Column]:
    """(lower end, upper end, grid) of the x that both curves have."""
    lo = F.greatest(F.array_min("gt_x"), F.array_min("ex_x"))
    hi = F.least(F.array_max("gt_x"), F.array_max("ex_x"))
    return lo, hi, A.linspace(lo, hi, n)


def paired(truth: DataFrame, extracted: DataFrame) -> DataFrame:
    """(pair_id, gt_x, gt_y, ex_x, ex_y) of curves with the same curve_id; x must rise strictly."""
    t = truth.select(F.col("curve_id").alias("pair_id"), F.col("xs").alias("gt_x"), F.col("ys").alias("gt_y"))
    e = extracted.select(F.col("curve_id").alias("e_id"), F.col("xs").alias("ex_x"), F.col("ys").alias("ex_y"))
    return t.join(e, F.col("pair_id") == F.col("e_id")).drop("e_id")


def validate(pairs: DataFrame) -> DataFrame:
    """Errors, shares within tolerance, peak errors and the score of each pair.

    Errors are on a grid over the common range; shares are fractions of the
    grid, relative to the truth's maximum; peaks are those of the given points.
    Pairs without a common range have a null score and ``status`` no_overlap.
    """
    lo, hi, grid = _overlap(GRID)
    valid = A.settled(pairs, ok=lo < hi, grid=F.when(lo < hi, grid))
    on = A.settled(valid, g=F.when(F.col("ok"), A.interpolate(F.col("gt_x"), F.col("gt_y"), F.col("grid"))), e=F.when(F.col("ok"), A.interpolate(F.col("ex_x"), F.col("ex_y"), F.col("grid"))))
    on = A.settled(on, d=F.zip_with("e", "g", lambda e, g: e - g), top=F.array_max("gt_y"))
    size = F.transform("d", lambda v: F.abs(v))
    mae = A.mean(size)
    square = A.total(F.transform("d", lambda v: v * v))
    m = A.mean(F.col("g"))
    spread = A.let(m, lambda c: A.total(F.transform("g", lambda v: (v - c) * (v - c))))
    within = lambda tol: F.when(F.col("top") > 0, A.let(F.col("top"), lambda t: A.count_if(size, lambda v: v / t <= tol)) / F.size("d")).otherwise(0.0)
    gt_peak, ex_peak = F.array_max("gt_y"), F.array_max("ex_y")
    gt_at, ex_at = F.get("gt_x", A.argmax(F.col("gt_y"))), F.get("ex_x", A.argmax(F.col("ex_y")))
    score = F.when(F.col("top") > 0, F.greatest(F.lit(0.0), 1 - mae / F.col("top"))).otherwise(0.0)
    out = on.select(
        "pair_id", mae.alias("mae"), F.sqrt(square / F.size("d")).alias("rmse"), F.array_max(size).alias("max_error"), F.when(spread > 0, 1 - square / spread).otherwise(0.0).alias("r_squared"),
        within(0.05).alias("within_5_percent"), within(0.10).alias("within_10_percent"), F.abs(ex_peak - gt_peak).alias("peak_stress_error"), F.abs(ex_at - gt_at).alias("failure_strain_error"),
        F.when(F.col("ok"), score).alias("accuracy_score"), F.when(F.col("ok"), "ok").otherwise("no_overlap").alias("status"),
    )
    return out.withColumn("passed", F.coalesce(F.col("accuracy_score") >= PASS, F.lit(False)))


def normalized_mae(pairs: DataFrame) -> DataFrame:
    """(pair_id, nmae): mean absolute error over the truth's maximum on a grid of 50; 1 without a common range or a positive maximum."""
    lo, hi, grid = _overlap(GRID_MAE)
    ok = (lo < hi) & (F.array_max("gt_y") > 0)
    on = A.settled(pairs, ok=ok, grid=F.when(ok, grid))
    diff = F.zip_with(A.interpolate(F.col("ex_x"), F.col("ex_y"), F.col("grid")), A.interpolate(F.col("gt_x"), F.col("gt_y"), F.col("grid")), lambda e, g: F.abs(e - g))
    return on.select("pair_id", F.when(F.col("ok"), A.mean(diff) / F.array_max("gt_y")).otherwise(1.0).alias("nmae"))
