"""Curves of any length as rows: a curve is dealt over tasks by ranges of x, and what a step needs across a border goes with the border.

Points are sorted into ranges of (curve_id, x) of even size, so a curve that holds most of all rows takes most of the ranges. Neighbours are
looked up within a range; the first and last points of the ranges, a small table, supply those beyond its borders, the
curve's extent, and what is summed up before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from curvelab.functions import arrays as A
from curvelab.operators import curves as C
from curvelab.sources.sinks import stored


def placed(points: DataFrame, parts: int | None = None) -> DataFrame:
    """(curve_id, part, x, y): the first point (by idx) of each x, in ranges numbered in the order of (curve_id, x); points whose x or y is null or NaN are left out."""
    fine = points.where(A.finite(F.col("x")).isNotNull() & A.finite(F.col("y")).isNotNull() & F.col("curve_id").isNotNull())
    first = C.dedup_first(fine.withColumns({"x": F.col("x").cast("double"), "y": F.col("y").cast("double")})).select("curve_id", "x", "y")
    n = parts or int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # the borders are sampled, so the ranges are written before anything relies on them
    return stored(first.repartitionByRange(n, "curve_id", "x").withColumn("part", F.spark_partition_id()), "curve-ranges")


def borders(points: DataFrame) -> DataFrame:
    """(curve_id, part, before, after, lo, hi, n): a row per range of a curve: the points before and after it, and the whole curve's extent and number of points."""
    p = F.struct("x", "y")
    ends = points.groupBy("curve_id", "part").agg(F.min_by(p, "x").alias("head"), F.max_by(p, "x").alias("tail"), F.count(F.lit(1)).alias("m"))
    order = Window.partitionBy("curve_id").orderBy("part")
    whole = Window.partitionBy("curve_id")
    return ends.select("curve_id", "part", F.lag("tail").over(order).alias("before"), F.lead("head").over(order).alias("after"), F.min("head.x").over(whole).alias("lo"), F.max("tail.x").over(whole).alias("hi"), F.sum("m").over(whole).alias("n"))


def neighbours(points: DataFrame) -> DataFrame:
    """Placed points with those before and after them as prev and next (structs of x and y; null at a curve's ends), and lo, hi and n of the curve."""
    order = Window.partitionBy("curve_id", "part").orderBy("x")
    p = F.struct("x", "y")
    inner = points.withColumns({"prev": F.lag(p).over(order), "next": F.lead(p).over(order)})
    b = borders(points).select(F.col("curve_id").alias("c"), F.col("part").alias("p"), "before", "after", "lo", "hi", "n")
    both = inner.join(b, (F.col("curve_id") == F.col("c")) & (F.col("part") == F.col("p")))
    return both.select("curve_id", "part", "x", "y", F.coalesce("prev", "before").alias("prev"), F.coalesce("next", "after").alias("next"), "lo", "hi", "n")


def resample(points: DataFrame, n: int = C.GRID) -> DataFrame:
    """(curve_id, k, x, y): placed curves of MIN_POINTS or more on n evenly spaced x, by linear interpolation, as ``curves.resample``.

    A segment between two points says itself which places of the grid it holds, so nothing is joined by interval.
    """
    step = (F.col("hi") - F.col("lo")) / (n - 1)
    at = lambda k: F.when(k == n - 1, F.col("hi")).otherwise(F.col("lo") + k * step)
    near = lambda v: F.floor((v - F.col("lo")) / step).cast("int")
    x1, y1 = F.col("next.x"), F.col("next.y")
    first = F.greatest(near(F.col("x")) - 1, F.lit(0))
    held = F.filter(F.sequence(first, F.greatest(F.least(near(x1) + 1, F.lit(n - 1)), first)), lambda k: (at(k) <= x1) & ((at(k) > F.col("x")) | ((k == 0) & F.col("prev").isNull())))
    segments = neighbours(points).where(F.col("next").isNotNull() & (F.col("n") >= C.MIN_POINTS))
    places = segments.withColumn("k", F.explode(held))
    q = at(F.col("k"))
    return places.select("curve_id", "k", q.alias("x"), ((y1 - F.col("y")) / (x1 - F.col("x")) * (q - F.col("x")) + F.col("y")).alias("y"))


def gradient(points: DataFrame) -> DataFrame:
    """(curve_id, x, y, d): placed points with the slope at each, as ``arrays.gradient``; a single point has none."""
    p, q = F.col("prev"), F.col("next")
    hs, hd = F.col("x") - p["x"], q["x"] - F.col("x")
    inner = (hs * hs * q["y"] + (hd * hd - hs * hs) * F.col("y") - hd * hd * p["y"]) / (hs * hd * (hs + hd))
    edge = lambda v, w: (w["y"] - v["y"]) / (w["x"] - v["x"])
    own = F.struct("x", "y")
    d = F.when(p.isNull() & q.isNull(), F.lit(None)).when(p.isNull(), edge(own, q)).when(q.isNull(), edge(p, own)).otherwise(inner)
    return neighbours(points).select("curve_id", "x", "y", d.alias("d"))


def _panel() -> Column:
    return F.when(F.col("prev").isNull(), F.lit(0.0)).otherwise((F.col("y") + F.col("prev.y")) / 2 * (F.col("x") - F.col("prev.x")))


def area(points: DataFrame) -> DataFrame:
    """(curve_id, area): the integral over each whole curve, added up in tasks."""
    return neighbours(points).groupBy("curve_id").agg(F.sum(_panel()).alias("area"))


def running_area(points: DataFrame) -> DataFrame:
    """(curve_id, x, y, area): placed points with the integral up to each; a range begins with what those before it sum up to."""
    panels = neighbours(points).select("curve_id", "part", "x", "y", _panel().alias("panel"))
    order = Window.partitionBy("curve_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = panels.groupBy("curve_id", "part").agg(F.sum("panel").alias("s"))
    carried = carried.select(F.col("curve_id").alias("c"), F.col("part").alias("p"), F.coalesce(F.sum("s").over(order), F.lit(0.0)).alias("carried"))
    within = Window.partitionBy("curve_id", "part").orderBy("x").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return panels.join(carried, (F.col("curve_id") == F.col("c")) & (F.col("part") == F.col("p"))).select("curve_id", "x", "y", (F.col("carried") + F.sum("panel").over(within)).alias("area"))
