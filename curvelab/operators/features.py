"""Features of a curve: peak, moduli, energy, behaviour after the peak, and how far they can be trusted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curvelab.functions import arrays as A
from curvelab.operators import curves as C

PROMINENCE, HALF = 0.1, 0.5


def peak_index(ys: Column, ds: Column) -> Column:
    """The first falling zero of the derivative whose sample is over half the
    maximum; else the tallest peak of a tenth of the maximum in prominence; else
    the first maximum."""

    def body(k: Column) -> Column:
        y, d = k["y"], k["d"]
        top = F.array_max(y)
        crossing = F.get(F.filter(A.zero_crossings(d), lambda c: F.get(y, c["j"]) > HALF * top), F.lit(0))["j"]
        tall = A.let(F.filter(A.prominent_peaks(y), lambda p: p["prominence"] >= PROMINENCE * top), lambda ps: F.get(F.filter(ps, lambda p: p["height"] == F.array_max(F.transform(ps, lambda q: q["height"]))), F.lit(0))["k"])
        return F.coalesce(crossing, tall, A.argmax(y))

    return A.let(F.struct(ys.alias("y"), ds.alias("d")), body)


def secant_index(ys: Column, p: Column) -> Column:
    """The first sample up to the peak that is nearest to half of it."""
    half = F.get(ys, p) / 2
    return A.argmin(F.transform(A.prefix(ys, p + 1), lambda v: F.abs(v - half)))


def prepared(curves: DataFrame, window: int | None = None) -> DataFrame:
    """Resampled and smoothed, with derivative ds and peak p."""
    return _prepared(C.resample(curves), window)


def _prepared(resampled: DataFrame, window: int | None) -> DataFrame:
    return A.settled(C.derivative(C.smooth(resampled, window)), p=peak_index(F.col("ys"), F.col("ds")))


def window_for(apply_smoothing: bool = True, smoothing_window: int = C.WINDOW) -> int:
    """Without smoothing the least window is used, not none."""
    if not 5 <= smoothing_window <= 51:
        raise ValueError("smoothing_window must be between 5 and 51")
    return smoothing_window if apply_smoothing else 5


def analyze(curves: DataFrame, window: int | None = None) -> DataFrame:
    """One row of features per curve of at least one point, after its curve_id and all else that is in its row.

    Curves of fewer than five points have their raw maximum and zeros.
    energy_to_peak is in units of y times x; energy_to_peak_kj_m3 is a hundredth
    of it, for y in kN/m2 and x in percent.
    """
    x, y, d, p = F.col("xs"), F.col("ys"), F.col("ds"), F.col("p")
    n = F.size(y)
    zero, long, fx, fy = F.lit(0.0), F.size("xs") >= C.MIN_POINTS, F.col("few_xs"), F.col("few_ys")
    held = curves.where(long.isNotNull()).withColumns({"few_xs": F.when(~long, F.col("xs")), "few_ys": F.when(~long, F.col("ys")), "xs": F.when(long, F.col("xs")), "ys": F.when(long, F.col("ys"))})
    grown = _prepared(C._resampled(held), window)
    grown = A.settled(grown, initial_modulus=A.mean(A.prefix(d, F.greatest(F.lit(1), F.floor(p * 0.1).cast("int")))), h=secant_index(y, p), q=_yield_index(d, p))
    up, down = A.prefix(d, p), F.slice(d, p + 1, n - p)
    share = lambda a, test: A.count_if(a, test) / F.size(a)
    prominence = F.when(F.get(y, p) > 0, F.least((F.get(y, p) - F.array_min(y)) / F.get(y, p), F.lit(1.0))).otherwise(0.0)
    behaviour = F.when((p > 5) & (p < n - 5), (share(up, lambda v: v > 0) + share(down, lambda v: v < 0)) / 2).otherwise(0.5)
    rising = A.count_if(F.sequence(F.lit(0), p), lambda i: (i > 0) & (F.get(x, i) > F.get(x, i - 1))) / F.greatest(p, F.lit(1))
    density = F.least(n / 100, F.lit(1.0))
    top = F.coalesce(A.argmax(fy), F.lit(0))
    # each for long curves and for those of few points
    values = {
        "peak_stress": (F.get(y, p), F.coalesce(F.array_max(fy), zero)), "failure_strain": (F.get(x, p), F.coalesce(F.get(fx, A.argmax(fy)), zero)), "initial_modulus": (F.col("initial_modulus"), zero),
        "secant_modulus_50": (F.when(F.get(x, F.col("h")) > 0, F.get(y, F.col("h")) / F.get(x, F.col("h"))).otherwise(F.col("initial_modulus")), zero),
        "energy_to_peak": (A.trapezoid(y, x, p), zero), "post_peak": (p < n - 5, F.lit(False)), "confidence": ((density + prominence + behaviour + rising) / 4, zero), "peak_index": (p, top),
        "critical_points": (_critical(F.col("h"), F.col("q")), F.array().cast("array<struct<point:string,strain:double,stress:double>>")),
    }
    out = grown.select(*[c for c in curves.columns if c not in ("xs", "ys")], *[F.when(fx.isNull(), long).otherwise(few).alias(k) for k, (long, few) in values.items()])
    return out.withColumn("energy_to_peak_kj_m3", F.col("energy_to_peak") / 100)


def _yield_index(d: Column, p: Column) -> Column:
    """The first sample before half of the peak's index where the slope drops by a tenth of its maximum."""
    early = A.prefix(d, F.greatest(F.lit(1), F.floor(p / 2).cast("int")))
    return A.let(F.struct(early.alias("e"), F.array_max(d).alias("top")), lambda k: F.when(F.size(k["e"]) > 5, F.get(F.filter(F.sequence(F.lit(0), F.size(k["e"]) - 2), lambda i: F.get(k["e"], i + 1) - F.get(k["e"], i) < -0.1 * k["top"]), F.lit(0))))


def _critical(h: Column, q: Column) -> Column:
    point = lambda name, at: F.struct(F.lit(name).alias("point"), F.get("xs", at).alias("strain"), F.get("ys", at).alias("stress"))
    return F.array_compact(F.array(point("Peak", F.col("p")), point("50% Peak", h), F.when(q.isNotNull(), point("Yield", q))))


def critical_points(curves: DataFrame, window: int | None = None) -> DataFrame:
    """(curve_id, point, strain, stress): the peak, its half, and the yield point where the slope first drops by a tenth of its maximum."""
    ready = A.settled(prepared(curves, window), h=secant_index(F.col("ys"), F.col("p")), q=_yield_index(F.col("ds"), F.col("p")))
    return ready.select("curve_id", F.inline(_critical(F.col("h"), F.col("q"))))
