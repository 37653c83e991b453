"""SQL-callable functions and table functions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf, udtf

from curvelab.functions.arrays import savgol_matrix
from curvelab.functions.lines import robust_inliers


def _prominent(y: np.ndarray) -> list[tuple[float, float, int]]:
    """(height, prominence, place) of local maxima; a plateau counts at its middle."""
    out, cuts = [], np.flatnonzero(np.diff(y)) + 1
    starts, ends = np.concatenate(([0], cuts)), np.concatenate((cuts, [len(y)])) - 1
    for l, r in zip(starts.tolist(), ends.tolist(), strict=True):
        if l and r < len(y) - 1 and y[l - 1] < y[l] > y[r + 1]:
            k, h = (l + r) // 2, y[l]
            left, right = np.flatnonzero(y[:l] > h), np.flatnonzero(y[r:] > h)
            a, b = (left[-1] + 1 if len(left) else 0), (r + right[0] if len(right) else len(y))
            out.append((float(h), float(h - max(y[a : k + 1].min(), y[k:b].min())), k))
    return out


def critical(xs: list[float], ys: list[float], n: int = 200, window: int = 11) -> list[tuple[str, float, float]]:
    """The rows of ``operators.features.critical_points`` for one curve: the same steps in numpy."""
    x, y = np.array(xs, float), np.array(ys, float)
    fine = np.isfinite(x) & np.isfinite(y)
    x, first = np.unique(x[fine], return_index=True)
    y = y[fine][first]
    if len(x) < 5:  # as for a curve's features: the raw maximum, nothing is smoothed
        if not len(x):
            return []
        p = int(y.argmax())
        h = int(np.abs(y[: p + 1] - y[p] / 2).argmin())
        return [("Peak", float(x[p]), float(y[p])), ("50% Peak", float(x[h]), float(y[h]))]
    grid = x[0] + np.arange(n) * ((x[-1] - x[0]) / (n - 1))
    grid[-1] = x[-1]
    raw, m, half = np.interp(grid, x, y), savgol_matrix(window), window // 2
    s = np.convolve(raw, m[half][::-1], mode="same")
    s[:half], s[-half:] = m[:half] @ raw[:window], m[half + 1 :] @ raw[-window:]
    d = np.gradient(s, grid)
    falls = np.flatnonzero((d[:-1] > 0) & (d[1:] <= 0)) + 1
    near = np.rint(falls - 1 + d[falls - 1] / (d[falls - 1] - d[falls])).astype(int)
    high = near[s[near] > 0.5 * s.max()]
    tall = [(h, -k) for h, prominence, k in _prominent(s) if prominence >= 0.1 * s.max()]
    p = int(high[0]) if len(high) else -max(tall)[1] if tall else int(s.argmax())
    h = int(np.abs(s[: p + 1] - s[p] / 2).argmin())
    early = d[: max(1, p // 2)]
    drops = np.flatnonzero(np.diff(early) < -0.1 * d.max()) if len(early) > 5 else []
    places = [("Peak", p), ("50% Peak", h), *[("Yield", int(k)) for k in drops[:1]]]
    return [(name, float(grid[k]), float(s[k])) for name, k in places]


@udtf(returnType="point string, strain double, stress double", useArrow=True)
class CriticalPoints:
    """The critical points of two arrays, as rows."""

    def eval(self, xs, ys):
        yield from critical(xs or [], ys or [])


LINE = T.ArrayType(T.DoubleType())


def _line(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> list:
    """[points, slope, intercept] of the weighted least-squares line; null without two different x."""
    total = c.sum()
    if not len(a) or total <= 0:
        return [float(len(a)), None, None]
    mx, my = (c * a).sum() / total, (c * b).sum() / total
    sxx = (c * (a - mx) ** 2).sum()
    if sxx <= 0:
        return [float(len(a)), None, None]
    slope = float((c * (a - mx) * (b - my)).sum() / sxx)
    return [float(len(a)), slope, float(my - slope * mx)]


@pandas_udf(LINE)
def _fit_weighted(x: pd.Series, y: pd.Series, w: pd.Series) -> list:
    fine = (x.notna() & y.notna() & w.notna()).to_numpy()
    return _line(*(v.to_numpy(float)[fine] for v in (x, y, w)))


@pandas_udf(LINE)
def _fit_robust(x: pd.Series, y: pd.Series, residual: pd.Series) -> list:
    fine = (x.notna() & y.notna()).to_numpy()
    a, b = x.to_numpy(float)[fine], y.to_numpy(float)[fine]
    if not len(a):
        return _line(a, b, a)
    near = robust_inliers(a, b, float(residual.iloc[0]))
    return _line(a[near], b[near], np.ones(int(near.sum())))


def register(spark: SparkSession) -> None:
    """clean_number(text) and grade(score) as SQL functions; fit_weighted(x, y, w) and fit_robust(x, y, residual) as aggregates that give
    an array of the number of points that count, slope and intercept, fit_robust of all pairs of a group's points; critical_points(xs, ys) as a table function. A group of the aggregates must fit a task; ``scale.fit_weighted`` and ``scale.fit_robust`` have no such bound."""
    spark.udf.register("fit_weighted", _fit_weighted)
    spark.udf.register("fit_robust", _fit_robust)
    spark.sql(r"""CREATE OR REPLACE TEMPORARY FUNCTION grade(s DOUBLE) RETURNS STRING
      RETURN CASE WHEN s IS NULL OR isnan(s) THEN NULL WHEN s >= 0.9 THEN 'A' WHEN s >= 0.8 THEN 'B' WHEN s >= 0.7 THEN 'C' WHEN s >= 0.6 THEN 'D' ELSE 'F' END""")
    spark.sql(r"""CREATE OR REPLACE TEMPORARY FUNCTION clean_number(t STRING) RETURNS STRING
      RETURN (SELECT CASE WHEN length(d) - length(replace(d, '-', '')) > 1 THEN concat(CASE WHEN startswith(d, '-') THEN '-' ELSE '' END, replace(d, '-', '')) ELSE d END
              FROM (SELECT CASE WHEN instr(k, '.') > 0 THEN concat(substring_index(k, '.', 1), '.', replace(substring(k, instr(k, '.') + 1), '.', '')) ELSE k END AS d
                    FROM (SELECT regexp_replace(translate(trim(t), 'OolI|SsBZzGg,', '001115582269.'), '[^0-9.\\-]', '') AS k)))""")
    spark.udtf.register("critical_points", CriticalPoints)



