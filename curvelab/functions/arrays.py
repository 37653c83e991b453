"""Numeric functions over array columns: a curve is two arrays, x and y.

All are built-in expressions, evaluated without a shuffle once a curve's
points are together. Indices are zero-based.
"""

from __future__ import annotations

from collections.abc import Callable
from fractions import Fraction
from functools import cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` with ``value`` evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def settled(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with columns that are evaluated once, here.

    A plain projection of a nested expression may be merged into what uses it,
    once for every use; a chain of such steps would then grow with each step. A
    generator over one row is a step that the optimizer leaves alone.
    """
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def indices(a: Column) -> Column:
    return F.sequence(F.lit(0), F.size(a) - 1)


def total(a: Column) -> Column:
    """The sum of doubles, in order; 0 for an empty array."""
    return F.aggregate(a, F.lit(0.0), lambda s, v: s + v)


def mean(a: Column) -> Column:
    """The mean; null for an empty array."""
    return F.when(F.size(a) > 0, total(a) / F.size(a))


def variance(a: Column) -> Column:
    """The population variance."""
    return let(mean(a), lambda m: mean(F.transform(a, lambda v: (v - m) * (v - m))))


def count_if(a: Column, test: Callable[[Column], Column]) -> Column:
    return F.size(F.filter(a, test))


def prefix(a: Column, n: Column | int) -> Column:
    """The first n values."""
    return F.slice(a, F.lit(1), n if isinstance(n, Column) else F.lit(n))


def first_index(a: Column, value: Column) -> Column:
    """The first place of a value, zero-based."""
    return (F.array_position(a, value) - 1).cast("int")


def argmax(a: Column) -> Column:
    return first_index(a, F.array_max(a))


def argmin(a: Column) -> Column:
    return first_index(a, F.array_min(a))


def finite(v: Column) -> Column:
    """Null for NaN and infinities, which would compare as the largest values."""
    return F.when(~F.isnan(v) & (F.abs(v) != float("inf")), v)


def linspace(lo: Column, hi: Column, n: int) -> Column:
    """n evenly spaced values; the last one is exactly ``hi``."""
    step = (hi - lo) / (n - 1)
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.when(i == n - 1, hi).otherwise(lo + i * step))


def interpolate(xs: Column, ys: Column, grid: Column) -> Column:
    """Linear interpolation at the values of a sorted grid within [x0, xn].

    A value lies in the segment (x[i-1], x[i]]; the least one in the first. Each
    segment takes its own part of the grid, so the cost grows with knots plus
    grid, not with their product. Needs two knots and strictly rising x.
    """

    def body(k: Column) -> Column:
        x, y, q, lo, m = k["x"], k["y"], k["q"], k["lo"], k["m"]
        n = F.size(x) - 1
        guess = lambda v: F.least(F.greatest(F.floor((v - lo) / k["step"]), F.lit(0)), F.lit(2**31 - 9)).cast("int")

        def segment(s: Column, i: Column) -> Column:
            a = F.greatest(guess(s["x0"]) - 1, F.lit(0))
            near = let(a, lambda a: F.slice(q, a + 1, F.greatest(F.least(guess(s["x1"]) + 1, m - 1) - a, F.lit(0)) + 1))
            inside = F.filter(near, lambda v: (v <= s["x1"]) & ((v > s["x0"]) | ((i == 0) & (v == s["x0"]))))
            return F.transform(inside, lambda v: (s["y1"] - s["y0"]) / (s["x1"] - s["x0"]) * (v - s["x0"]) + s["y0"])

        ends = F.arrays_zip(prefix(x, n).alias("x0"), F.slice(x, F.lit(2), n).alias("x1"), prefix(y, n).alias("y0"), F.slice(y, F.lit(2), n).alias("y1"))
        return F.flatten(F.transform(ends, segment))

    def stepped(k: Column) -> Column:
        lo, m = F.get(k["q"], F.lit(0)), F.size(k["q"])
        return F.struct(k["x"].alias("x"), k["y"].alias("y"), k["q"].alias("q"), lo.alias("lo"), m.alias("m"), ((F.get(k["q"], m - 1) - lo) / (m - 1)).alias("step"))

    return let(let(F.struct(xs.alias("x"), ys.alias("y"), grid.alias("q")), stepped), body)


def gradient(ys: Column, xs: Column) -> Column:
    """The central difference of second order on uneven spacing, one-sided at the ends; zero spacing gives null."""

    def body(k: Column) -> Column:
        y, h = k["y"], k["h"]
        n = F.size(y)
        cut = lambda a, first, name: F.slice(a, F.lit(first), n - 2).alias(name)
        edge = lambda a, b: F.array(F.try_divide(F.get(y, b) - F.get(y, a), F.get(h, a)))
        around = F.arrays_zip(cut(h, 1, "hs"), cut(h, 2, "hd"), cut(y, 1, "before"), cut(y, 2, "here"), cut(y, 3, "after"))

        def at(p: Column) -> Column:
            hs, hd = p["hs"], p["hd"]
            return F.try_divide(hs * hs * p["after"] + (hd * hd - hs * hs) * p["here"] - hd * hd * p["before"], hs * hd * (hs + hd))

        return F.concat(edge(F.lit(0), F.lit(1)), F.transform(around, at), edge(n - 2, n - 1))

    def spaced(k: Column) -> Column:
        x, n = k["x"], F.size(k["x"]) - 1
        return F.struct(k["y"].alias("y"), F.zip_with(prefix(x, n), F.slice(x, F.lit(2), n), lambda a, b: b - a).alias("h"))

    return F.when(F.size(xs) >= 2, let(let(F.struct(xs.alias("x"), ys.alias("y")), spaced), body))


@cache
def savgol_matrix(window: int, order: int = 3) -> np.ndarray:
    """Row h is the interior filter of half-width h; the other rows fit the ends.

    In fractions, rounded once: where a curve is level, what is left of its derivative is the weights' own error, and decides its sign.
    """
    powers = [[Fraction(t - window // 2) ** d for t in range(window)] for d in range(order + 1)]
    base: list[list[Fraction]] = []  # orthogonal columns of the same span
    for v in powers:
        for b in base:
            c = sum(x * y for x, y in zip(v, b, strict=True)) / sum(y * y for y in b)
            v = [x - c * y for x, y in zip(v, b, strict=True)]
        base.append(v)
    norms = [sum(y * y for y in b) for b in base]
    return np.array([[float(sum(b[i] * b[j] / n for b, n in zip(base, norms, strict=True))) for j in range(window)] for i in range(window)])


def smooth(ys: Column, window: int, order: int = 3) -> Column:
    """Savitzky-Golay smoothing; the ends take the polynomial fitted to the first and last window."""
    half, m = window // 2, savgol_matrix(window, order).tolist()

    def weighted(y: Column, start: Column, row: list[float]) -> Column:
        out = F.get(y, start) * row[0]
        for j in range(1, window):
            out = out + F.get(y, start + j) * row[j]
        return out

    def body(y: Column) -> Column:
        n = F.size(y)

        def at(i: Column) -> Column:
            out = F.when((i >= half) & (i < n - half), weighted(y, i - half, m[half]))
            for e in range(half):
                out = out.when(i == e, weighted(y, F.lit(0), m[e])).when(i == n - half + e, weighted(y, n - window, m[half + 1 + e]))
            return out

        return F.transform(F.sequence(F.lit(0), n - 1), at)

    return let(ys, body)


def gaussian_taps(sigma: float = 2.0, truncate: float = 4.0) -> list[float]:
    r = int(truncate * sigma + 0.5)
    w = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    return (w / w.sum()).tolist()


def gaussian(ys: Column, sigma: float = 2.0) -> Column:
    """Gaussian smoothing with mirrored ends (d c b a | a b c d | d c b a)."""
    taps = gaussian_taps(sigma)
    r = len(taps) // 2

    def body(y: Column) -> Column:
        n = F.size(y)

        def mirrored(i: Column) -> Column:
            p = F.pmod(i, 2 * n)
            return F.get(y, F.when(p < n, p).otherwise(2 * n - 1 - p))

        def at(i: Column) -> Column:
            out = mirrored(i - r) * taps[0]
            for j in range(1, len(taps)):
                out = out + mirrored(i - r + j) * taps[j]
            return out

        return F.transform(F.sequence(F.lit(0), n - 1), at)

    return F.when(F.size(ys) > 0, let(ys, body)).otherwise(ys)


def trapezoid(ys: Column, xs: Column, last: Column) -> Column:
    """The integral from the first point to the one at ``last``."""
    part = lambda k: lambda i: (F.get(k["y"], i) + F.get(k["y"], i - 1)) / 2 * (F.get(k["x"], i) - F.get(k["x"], i - 1))
    return F.when(last < 1, F.lit(0.0)).otherwise(let(F.struct(xs.alias("x"), ys.alias("y"), last.alias("p")), lambda k: total(F.transform(F.sequence(F.lit(1), k["p"]), part(k)))))


def zero_crossings(d: Column) -> Column:
    """array of (i, z, j): d falls from above zero to zero or below between i-1 and i; z is the fractional place, j the nearest index, halves to even."""

    def body(d: Column) -> Column:
        falls = F.filter(F.sequence(F.lit(1), F.size(d) - 1), lambda i: (F.get(d, i - 1) > 0) & (F.get(d, i) <= 0))
        place = lambda i: i - 1 + F.get(d, i - 1) / (F.get(d, i - 1) - F.get(d, i))
        return F.transform(falls, lambda i: F.struct(i.alias("i"), place(i).alias("z"), F.bround(place(i), 0).cast("int").alias("j")))

    return let(d, body)


def prominent_peaks(ys: Column) -> Column:
    """array of (k, height, prominence) of the local maxima; a plateau counts at its middle."""

    def body(y: Column) -> Column:
        n = F.size(y)
        starts = F.filter(F.sequence(F.lit(1), n - 2), lambda i: F.get(y, i) > F.get(y, i - 1))
        spans = F.transform(starts, lambda i: F.struct(i.alias("l"), _plateau_end(y, i, n).alias("r")))
        peaks = F.filter(spans, lambda s: (s["r"] < n - 1) & (F.get(y, s["r"] + 1) < F.get(y, s["l"])))

        def measured(s: Column) -> Column:
            k = F.floor((s["l"] + s["r"]) / 2).cast("int")
            h = F.get(y, s["l"])
            left = F.coalesce(F.array_max(F.filter(F.sequence(F.lit(0), s["l"]), lambda j: F.get(y, j) > h)), F.lit(-1))
            right = F.coalesce(F.array_min(F.filter(F.sequence(s["r"], n - 1), lambda j: F.get(y, j) > h)), n)
            low = F.greatest(F.array_min(F.slice(y, left + 2, k - left)), F.array_min(F.slice(y, k + 1, right - k)))
            return F.struct(k.alias("k"), h.alias("height"), (h - low).alias("prominence"))

        return F.transform(peaks, measured)

    return F.when(F.size(ys) >= 3, let(ys, body)).otherwise(F.array().cast("array<struct<k:int,height:double,prominence:double>>"))


def _plateau_end(y: Column, i: Column, n: Column) -> Column:
    """The last index of the run of values equal to the one at i."""
    differs = F.array_min(F.filter(F.sequence(i, n - 1), lambda j: F.get(y, j) != F.get(y, i)))
    return F.coalesce(differs - 1, n - 1)
