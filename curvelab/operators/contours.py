"""Contours as point sequences: measures, selection, confidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

MIN_LENGTH = 100.0


def measures(points: DataFrame, by: list[str]) -> DataFrame:
    """Per contour of (by..., idx, x, y): n, bounding box (left, top, w, h), arc length, and area enclosed by its closing."""
    order = Window.partitionBy(*by).orderBy("idx")
    first = Window.partitionBy(*by).orderBy("idx").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    step = points.withColumn("px", F.lag("x").over(order)).withColumn("py", F.lag("y").over(order)).withColumn("nx", F.coalesce(F.lead("x").over(order), F.first("x").over(first))).withColumn("ny", F.coalesce(F.lead("y").over(order), F.first("y").over(first)))
    arc = F.sqrt((F.col("x") - F.col("px")) * (F.col("x") - F.col("px")) + (F.col("y") - F.col("py")) * (F.col("y") - F.col("py")))
    return step.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.min("x").alias("left"), F.min("y").alias("top"), (F.max("x") - F.min("x")).alias("w"), (F.max("y") - F.min("y")).alias("h"),
        F.coalesce(F.sum(arc), F.lit(0.0)).alias("arc"), (F.abs(F.sum(F.col("x") * F.col("ny") - F.col("nx") * F.col("y"))) / 2).alias("area"),
    )


def curve_score(width: Column, height: Column) -> Column:
    """How much a contour (left, top, w, h, arc) of an image looks like the curve: wide, high up, flat, long for its box."""
    one = F.lit(1.0)
    return (
        0.35 * F.col("w") / width + 0.25 * (1 - (F.col("top") + F.col("h") / 2) / height) + 0.20 * F.least(F.col("w") / F.greatest(F.col("h"), one), F.lit(5.0)) / 5
        + 0.20 * F.least(F.col("arc") / F.greatest(F.sqrt(F.col("w") * F.col("w") + F.col("h") * F.col("h")), one), F.lit(2.0)) / 2
    )


def isolation_score(width: Column, height: Column) -> Column:
    one = F.lit(1.0)
    return 0.4 * F.col("w") / width + 0.3 * (1 - F.col("top") / height) + 0.3 * F.least(F.col("w") / F.greatest(F.col("h"), one), F.lit(3.0)) / 3


def best_contour(stats: DataFrame, image: str, key: str, width: Column, height: Column, min_length: float = MIN_LENGTH) -> DataFrame:
    """The contour of each image with the best score among the long enough ones."""
    scored = stats.where(F.col("arc") >= min_length).withColumn("score", curve_score(width, height))
    return scored.withColumn("rn", F.row_number().over(Window.partitionBy(image).orderBy(F.desc("score"), key))).where("rn = 1").drop("rn")


def isolate(stats: DataFrame, image: str, width: Column, height: Column, share: float = 0.5) -> DataFrame:
    """The contours of each image whose score is at least a share of the best."""
    scored = stats.withColumn("score", isolation_score(width, height))
    return scored.withColumn("top_score", F.max("score").over(Window.partitionBy(image))).where(F.col("score") >= share * F.col("top_score")).drop("top_score")


def extraction_confidence(points: DataFrame, by: list[str], width: Column) -> DataFrame:
    """Per curve of (by..., idx, x, y, ys): density, closeness to the smoothed y, coverage of the width, few jumps; 0 for fewer than five points."""
    order = Window.partitionBy(*by).orderBy("idx")
    stats = points.withColumn("jump", (F.col("y") > F.lag("y").over(order) + 10).cast("int")).groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), (F.max("x") - F.min("x")).alias("span"), F.avg(F.abs(F.col("y") - F.col("ys"))).alias("off"), F.coalesce(F.sum("jump"), F.lit(0)).alias("jumps")
    )
    one = F.lit(1.0)
    density = F.least(10 * F.col("n") / F.greatest(F.col("span"), one), one)
    smooth = F.coalesce(F.greatest(F.lit(0.0), 1 - F.col("off") / 50), F.lit(0.5))
    coverage = F.least(2 * F.col("span") / width, one)
    mono = F.greatest(F.lit(0.0), 1 - F.col("jumps") / F.col("n"))
    return stats.select(*by, "n", F.when(F.col("n") < 5, 0.0).otherwise(0.25 * density + 0.30 * smooth + 0.25 * coverage + 0.20 * mono).alias("confidence"))


def darkest_near(pixels: DataFrame, points: DataFrame, reach: int = 5) -> DataFrame:
    """Points moved to the darkest pixel above or below (the first of equals from the top); unmoved where all are white.

    pixels: (image_id, px, py, v); points: (image_id, idx, px, py).
    """
    p = points.withColumn("near", F.explode(F.sequence(F.col("py") - reach, F.col("py") + reach)))
    seen = p.join(pixels.select("image_id", "px", F.col("py").alias("near"), "v"), ["image_id", "px", "near"], "left")
    dark = F.min(F.when(F.col("v") < 255, F.struct("v", "near")))
    return seen.groupBy("image_id", "idx", "px", "py").agg(dark.alias("d")).select("image_id", "idx", "px", F.coalesce("d.near", "py").alias("py"))


def line_angle(dx: Column, dy: Column) -> Column:
    return F.degrees(F.atan2(dy, dx))


def skew(lines: DataFrame, by: list[str]) -> DataFrame:
    """The median deviation of line segments (x1, y1, x2, y2) from level or upright; exactly diagonal ones do not count."""
    a = line_angle(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))
    folded = lines.withColumn("a", a).withColumn("a", F.when(F.col("a") > 90, F.col("a") - 180).when(F.col("a") < -90, F.col("a") + 180).otherwise(F.col("a")))
    dev = F.when(F.abs("a") < 45, F.col("a")).when(F.abs("a") > 45, F.when(F.col("a") > 0, F.col("a") - 90).otherwise(F.col("a") + 90))
    return folded.withColumn("dev", dev).where("dev is not null").groupBy(*by).agg(F.median("dev").alias("skew"), F.count(F.lit(1)).alias("lines"))


def corners(points: DataFrame, by: list[str]) -> DataFrame:
    """Four corners of each group of (x, y): least and largest sum, least and largest difference."""
    p = F.struct("x", "y")
    return points.groupBy(*by).agg(F.min_by(p, F.col("x") + F.col("y")).alias("top_left"), F.min_by(p, F.col("y") - F.col("x")).alias("top_right"), F.max_by(p, F.col("x") + F.col("y")).alias("bottom_right"), F.max_by(p, F.col("y") - F.col("x")).alias("bottom_left"))
