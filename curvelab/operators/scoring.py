"""How far an extraction can be trusted: factors, weights, grade, warnings and advice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curvelab.functions import arrays as A

# fixed values
WEIGHTS = {"ocr_confidence": 0.20, "curve_smoothness": 0.25, "axis_detection": 0.15, "data_validity": 0.15, "image_quality": 0.15, "method_confidence": 0.10}
GRADES = [("A", 0.9), ("B", 0.8), ("C", 0.7), ("D", 0.6)]
METHODS = {"contour_tracing": 0.9, "contour_tracing_refined": 0.95, "unet_segmentation": 0.85, "unet_primary": 0.85, "unet_fallback": 0.75, "hybrid": 0.9, "extraction_failed": 0.0}
OTHER_METHOD, TARGET, TOLERATED = 0.5, 0.95, 0.05
ADVISE_BELOW = {"ocr_confidence": 0.7, "curve_smoothness": 0.7, "axis_detection": 0.7, "image_quality": 0.6, "data_validity": 0.7}
ADVICE = {
    "ocr_confidence": ("axis numbers are hard to read", "use a sharper image with larger axis numbers"),
    "curve_smoothness": ("the curve has jumps", "clean the image or use a wider smoothing window"),
    "axis_detection": ("few axis ticks were found", "keep both axes and their tick labels in the image"),
    "image_quality": ("the image is blurred, noisy or flat", "scan again at a higher resolution"),
    "data_validity": ("the points do not look like a test curve", "check the region and the scale of the axes"),
}


def smoothness(xs: Column, ys: Column) -> Column:
    """1/(1+10 r), r the variance of the second derivative over that of y, in the given order; 0.5 for fewer than five points, 0 for fewer than three, null where equal x make it undefined."""
    ratio = lambda s: F.when(~F.exists(s, lambda v: v.isNull()), A.finite(1 / (1 + 10 * (A.variance(s) / (A.variance(ys) + 1e-6)))))
    return F.when(F.size(ys) < 3, 0.0).when(F.size(ys) < 5, 0.5).otherwise(A.let(A.gradient(A.gradient(ys, xs), xs), ratio))


def axis_score(x_ticks: Column, y_ticks: Column) -> Column:
    """The mean of min(ticks/5, 1), halved if an axis has fewer than two."""
    one = lambda t: F.least(t / 5, F.lit(1.0))
    return (one(x_ticks) + one(y_ticks)) / 2 * F.when((x_ticks < 2) | (y_ticks < 2), 0.5).otherwise(1.0)


def validity(xs: Column, ys: Column) -> Column:
    """The mean of four or five checks; 0 for fewer than three points."""
    n = F.size(ys)
    m = F.floor(n / 3).cast("int")
    rises = lambda a, last, test: A.count_if(F.sequence(F.lit(1), last), lambda i: test(F.get(a, i) - F.get(a, i - 1)))
    checks = F.array_compact(F.array(
        F.when(F.exists(xs, lambda v: v < -0.1), 0.5).otherwise(1.0),
        F.when(F.exists(ys, lambda v: v < -100), 0.5).otherwise(1.0),
        F.when(m > 2, rises(ys, F.greatest(m - 1, F.lit(1)), lambda d: d > 0) / (m - 1)),
        rises(xs, F.greatest(n - 1, F.lit(1)), lambda d: d >= 0) / (n - 1),
        F.least(n / 50, F.lit(1.0)),
    ))
    return F.when(n < 3, 0.0).otherwise(A.mean(checks))


def method_score(method: Column) -> Column:
    out = F.lit(OTHER_METHOD)
    for name, value in METHODS.items():
        out = F.when(method == name, value).otherwise(out)
    return out


def grade(score: Column) -> Column:
    """A to F; null for a null or NaN score."""
    s = A.finite(score)
    out = F.when(s.isNull(), F.lit(None).cast("string"))
    for name, least in GRADES:
        out = out.when(s >= least, name)
    return out.otherwise("F")


def scored(df: DataFrame, strict: bool = False, target: float = TARGET) -> DataFrame:
    """Adds the six factors, overall, grade, status, warnings and recommendations.

    Needs xs, ys, ocr (array of confidences), x_ticks, y_ticks, quality, method,
    and nmae (null without ground truth). strict: a factor of the first four
    under a half costs a fifth of the score. A score that is undefined is null
    with status failed.
    """
    has = F.size("ys") > 0
    raw_validity = F.when(has, validity(F.col("xs"), F.col("ys"))).otherwise(0.0)
    late = F.col("nmae").isNotNull() & (F.col("nmae") > TOLERATED)
    out = A.settled(
        df, ocr_confidence=F.coalesce(A.mean(F.col("ocr")), F.lit(0.0)), curve_smoothness=smoothness(F.col("xs"), F.col("ys")), axis_detection=axis_score(F.col("x_ticks"), F.col("y_ticks")),
        raw_validity=raw_validity, image_quality=F.col("quality"), method_confidence=method_score(F.col("method")),
    )
    out = A.settled(out, data_validity=F.when(late, F.col("raw_validity") * (1 - F.least(F.col("nmae"), F.lit(0.5)))).otherwise(F.col("raw_validity")))
    score = F.lit(0.0)
    for name, weight in WEIGHTS.items():
        score = score + F.col(name) * weight
    if strict:
        worst = F.least("ocr_confidence", "curve_smoothness", "axis_detection", "data_validity")
        score = score * F.when(worst < 0.5, 0.8).otherwise(1.0)
    out = A.settled(A.settled(out, overall=A.finite(score)), grade=grade(F.col("overall")))
    few, n = F.size("ocr") == 0, F.size("ys")
    warn = F.array_compact(F.array(
        F.when(few, "no axis numbers were read").when(F.col("ocr_confidence") < 0.7, "axis numbers were read with low confidence"),
        F.when(n < 3, "too few points for a curve").when(F.col("curve_smoothness") < 0.7, "the curve is not smooth"),
        F.when(F.col("axis_detection") < 0.7, "axes were found only in part"),
        F.when(F.col("image_quality") < 0.6, "image quality is low"),
        F.when(has & (F.col("raw_validity") < 0.7), "the points fail plausibility checks"),
        F.when(late, "the curve differs from the ground truth"),
        F.when(F.col("overall") < target, F.concat(F.lit("score is below target by "), F.format_string("%.1f%%", (target - F.col("overall")) * 100))),
    ))
    advise = F.array_compact(F.array(
        F.when(~few & (F.col("ocr_confidence") < 0.7), ADVICE["ocr_confidence"][1]),
        F.when((n >= 3) & (F.col("curve_smoothness") < 0.7), ADVICE["curve_smoothness"][1]),
        F.when(F.col("axis_detection") < 0.7, ADVICE["axis_detection"][1]),
        F.when(F.col("image_quality") < 0.6, ADVICE["image_quality"][1]),
        F.when(F.col("grade").isin("D", "F"), "check the curve by hand before using it"),
        F.when(F.col("grade").isin("D", "F"), "extract again from a better image").when(F.col("grade") == "C", "verify important values by hand"),
    ))
    return out.withColumn("status", F.when(F.col("overall").isNull(), "failed").otherwise("ok")).withColumn("warnings", warn).withColumn("recommendations", advise).drop("raw_validity")


def suggestions(report: DataFrame, key: str = "curve_id") -> DataFrame:
    """(key, factor, issue, solution) for every factor under its threshold."""
    rows = [F.struct(F.lit(f).alias("factor"), F.lit(ADVICE[f][0]).alias("issue"), F.lit(ADVICE[f][1]).alias("solution"), (F.col(f) < least).alias("low")) for f, least in ADVISE_BELOW.items()]
    return report.select(key, F.inline(F.filter(F.array(*rows), lambda r: r["low"]))).drop("low")
