"""Two extractions of the same curve: merging, choosing, routing by image quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

QUALITY, KEEP = 0.7, 0.7


def merge_weighted(a: DataFrame, b: DataFrame, weights: DataFrame) -> DataFrame:
    """(curve_id, x, y): where both have x, the mean weighted by confidence and cut to a whole number; else the y there is.

    ``weights`` have (curve_id, conf_a, conf_b). If they sum to nothing, a's
    points are the result.
    """
    left, right = a.select(F.col("curve_id"), F.col("x"), F.col("y").alias("ya")), b.select(F.col("curve_id"), F.col("x"), F.col("y").alias("yb"))
    both = left.join(right, ["curve_id", "x"], "full").join(weights, "curve_id", "left")
    total = F.coalesce(F.col("conf_a") + F.col("conf_b"), F.lit(0.0))
    mixed = (F.col("conf_a") / F.nullif(total, F.lit(0.0)) * F.col("ya") + F.col("conf_b") / F.nullif(total, F.lit(0.0)) * F.col("yb")).cast("int")
    y = F.when(F.col("ya").isNotNull() & F.col("yb").isNotNull(), F.when(total > 0, mixed).otherwise(F.col("ya").cast("int"))).otherwise(F.coalesce("ya", "yb").cast("int"))
    return both.where((total > 0) | F.col("ya").isNotNull()).select("curve_id", "x", y.alias("y"))


def best_method(contour_conf: Column, contour_points: Column, network_conf: Column, network_points: Column) -> Column:
    """struct(method, confidence): the surer of two; the first wins ties; without points a confidence is 0."""
    c = F.when(contour_points > 0, contour_conf).otherwise(0.0)
    u = F.when(network_points > 0, network_conf).otherwise(0.0)
    return (
        F.when((c >= u) & (c > 0), F.struct(F.lit("contour_tracing").alias("method"), c.alias("confidence")))
        .when(u > 0, F.struct(F.lit("unet_segmentation").alias("method"), u.alias("confidence")))
        .otherwise(F.struct(F.lit("extraction_failed").alias("method"), F.lit(0.0).alias("confidence")))
    )


def route(quality: Column, contour_conf: Column, contour_points: Column, network_conf: Column, network_points: Column, both: bool = False, threshold: float = QUALITY, method: str = "auto") -> Column:
    """struct(method, confidence) by image quality: good images are traced, and segmented only if tracing is unsure; poor ones are segmented at once."""
    option = lambda name, conf: F.struct(F.lit(name).alias("method"), conf.alias("confidence"))
    if method in ("contour", "unet"):
        return option("contour_tracing", contour_conf) if method == "contour" else option("unet_primary", network_conf)
    if both or method == "hybrid":
        return best_method(contour_conf, contour_points, network_conf, network_points)
    if method != "auto":
        raise ValueError("method is auto, contour, unet or hybrid")
    good = quality >= threshold
    return F.when(good & (contour_conf >= KEEP), option("contour_tracing", contour_conf)).when(good, option("unet_fallback", network_conf)).otherwise(option("unet_primary", network_conf))


def mean_probability(mask: DataFrame, points: DataFrame) -> DataFrame:
    """(image_id, probability): the mean of a probability map at a curve's pixels."""
    return points.join(mask, ["image_id", "px", "py"]).groupBy("image_id").agg(F.avg("p").alias("probability"))


def mask_union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("image_id", "px", "py").union(b.select("image_id", "px", "py")).distinct()


def mask_minus(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("image_id", "px", "py").subtract(b.select("image_id", "px", "py"))


def dice(both: Column, a: Column, b: Column) -> Column:
    """The smoothed overlap of two masks from the sums of their product and of each."""
    return (2 * both + 1) / (a + b + 1)
